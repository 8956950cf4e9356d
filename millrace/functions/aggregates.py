"""Aggregate functions. All can be computed in parts and merged, which Spark does before it shuffles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import ArgumentMismatch
from millrace.functions.expressions import DEFAULT, Expr, Options
from millrace.types import F64, I64, U64, U64_NARROW, Kind, LogicalType, sum_result, takes_min_max


@dataclass(frozen=True)
class Aggregate:
    column: Column
    type: LogicalType
    text: str
    argument: Expr | None = None
    name: str | None = None

    def alias(self, name: str) -> Aggregate:
        return replace(self, name=name)

    @property
    def label(self) -> str:
        return self.name or self.text


def count(of: Expr) -> Aggregate:
    """Values that aren't null; 0 for no rows."""
    return Aggregate(F.count(of.output), U64_NARROW, f"count({of.text})", of)


def count_star() -> Aggregate:
    """Rows, with nulls or without."""
    return Aggregate(F.count(F.lit(1)), U64_NARROW, "count(*)")


def _extreme(name: str, apply: Callable[[Column], Column], of: Expr, options: Options) -> Aggregate:
    if not takes_min_max(of.type, options.strict):
        raise ArgumentMismatch(f"{name} of {of.type}")
    return Aggregate(apply(of.output), of.type, f"{name}({of.text})", of)


def min_(of: Expr, options: Options = DEFAULT) -> Aggregate:
    """The least value; null if there is none."""
    return _extreme("min", F.min, of, options)


def max_(of: Expr, options: Options = DEFAULT) -> Aggregate:
    """The greatest value; null if there is none."""
    return _extreme("max", F.max, of, options)


def sum_(of: Expr, options: Options = DEFAULT) -> Aggregate:
    """The sum, as the widest type of its family: i64, u64 or f64; null if there is no value. An i64 overflow is an error, or wraps."""
    out = sum_result(of.type)
    if out is None:
        raise ArgumentMismatch(f"sum of {of.type}")
    text = f"sum({of.text})"
    if out == F64:
        return Aggregate(F.sum(of.column.cast("double")), F64, text, of)
    if out == I64 and options.overflow == "wrap":
        exact = F.sum(of.column.cast("decimal(19,0)")).cast("decimal(38,0)")
        half, whole = (F.lit(Decimal(1 << b)).cast("decimal(38,0)") for b in (63, 64))
        return Aggregate((F.pmod(exact + half, whole) - half).cast("long"), I64, text, of)
    if out == I64:
        return Aggregate(F.sum(of.column), I64, text, of)
    if of.type.kind is not Kind.U64 or of.type.narrow:
        return Aggregate(F.sum(of.column), U64_NARROW, text, of)
    exact, whole = F.sum(of.column).cast("decimal(38,0)"), F.lit(Decimal(1 << 64)).cast("decimal(38,0)")
    if options.overflow == "wrap":
        return Aggregate(F.pmod(exact, whole).cast("decimal(20,0)"), U64, text, of)
    checked = F.when(exact.isNull() | (exact < whole), exact.cast("decimal(20,0)")).otherwise(F.raise_error(F.lit("u64 overflow in sum")))
    return Aggregate(checked, U64, text, of)


def avg(of: Expr) -> Aggregate:
    """The mean: the exact sum of integers, divided once. Null if there is no value."""
    if sum_result(of.type) is None:
        raise ArgumentMismatch(f"avg of {of.type}")
    total = F.sum(of.column.cast("double")) if of.type.is_float else F.sum(of.column).cast("double")
    return Aggregate(total / F.nullif(F.count(of.column), F.lit(0)), F64, f"avg({of.text})", of)
