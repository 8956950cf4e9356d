"""Scalar expressions and aggregate functions."""

from millrace.functions.aggregates import Aggregate, avg, count, count_star, max_, min_, sum_
from millrace.functions.custom import aggregate as custom_aggregate
from millrace.functions.custom import scalar as custom_scalar
from millrace.functions.expressions import (
    DEFAULT,
    Expr,
    Options,
    and_,
    arith,
    array_and,
    array_and_scalar,
    array_not,
    array_or,
    array_or_scalar,
    array_xor,
    compare,
    const,
    field,
    interval_add,
    interval_sub,
    is_not_null,
    is_null,
    not_,
    or_,
    regex_match,
)

__all__ = [
    "DEFAULT", "Aggregate", "Expr", "Options", "and_", "arith", "array_and", "array_and_scalar", "array_not", "array_or", "array_or_scalar", "array_xor", "avg", "compare", "const", "count", "count_star", "custom_aggregate", "custom_scalar",
    "field", "interval_add", "interval_sub", "is_not_null", "is_null", "max_", "min_", "not_", "or_", "regex_match", "sum_",
]
