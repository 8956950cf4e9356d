"""Scalar and aggregate functions of one's own, under the same type checks as the built-in ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from millrace.errors import ArgumentMismatch, UnsupportedInputs
from millrace.functions.aggregates import Aggregate
from millrace.functions.expressions import Expr
from millrace.types import BOOLEAN, LogicalType

#: The result's type for the arguments' types, or None where they aren't accepted.
Returns = Callable[..., LogicalType | None]


def _result(name: str, returns: LogicalType | Returns, arguments: tuple[Expr, ...], error: type[Exception]) -> LogicalType:
    found = returns if isinstance(returns, LogicalType) else returns(*[a.type for a in arguments])
    if found is None:
        raise error(f"{name}({', '.join(str(a.type) for a in arguments)})")
    return found


def scalar(name: str, build: Callable[..., Column], returns: LogicalType | Returns) -> Callable[..., Expr]:
    """A function of expressions. build makes its column from theirs: of built-in functions, so that it is compiled with the rest of
    the plan, or of a Pandas UDF. A boolean result is a predicate, as comparisons are: null becomes false where it is an output."""

    def call(*arguments: Expr) -> Expr:
        kind = _result(name, returns, arguments, UnsupportedInputs)
        column = build(*[a.column for a in arguments]).cast(kind.stored)
        return Expr(column, kind, name if kind == BOOLEAN else "arith", f"{name}({', '.join(a.text for a in arguments)})")

    return call


def aggregate(name: str, build: Callable[..., Column], returns: LogicalType | Returns) -> Callable[..., Aggregate]:
    """An aggregate function of expressions. build makes its column from theirs: of Spark's aggregate functions, which are computed in
    parts before the shuffle, or of a grouped Pandas UDF, which isn't."""

    def call(*arguments: Expr) -> Aggregate:
        kind = _result(name, returns, arguments, ArgumentMismatch)
        column = build(*[a.output for a in arguments]).cast(kind.stored)
        return Aggregate(column, kind, f"{name}({', '.join(a.text for a in arguments)})", arguments[0] if arguments else None)

    return call
