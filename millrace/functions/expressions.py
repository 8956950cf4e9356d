"""Typed scalar expressions: a Spark column, its logical type, and what kind of expression it is.

Booleans have three values inside, as in SQL; where a boolean expression becomes an output column, null becomes false.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import (
    BooleanExpression,
    ConstantInput,
    InvalidConstant,
    InvalidPattern,
    NotBoolean,
    NotFlattened,
    TooFewInputs,
    TwoConstants,
    UnsupportedInputs,
)
from millrace.types import BITS, BOOLEAN, INTERVAL, SIGNED, UNITS, Kind, LogicalType, arith_result, check_comparison

ARITH = ("+", "-", "*", "/", "%")
COMPARE = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


@dataclass(frozen=True)
class Options:
    """overflow: "error" or "wrap" for integers. strict: reject what a planner should have rewritten, and min and max of floats.
    ieee_nan: NaN compares with nothing; else it equals itself and is the largest value."""

    overflow: str = "error"
    strict: bool = False
    ieee_nan: bool = False


DEFAULT = Options()


@dataclass(frozen=True)
class Expr:
    """shape: "field", "constant", "arith" or the name of a boolean expression. index: of a field."""

    column: Column
    type: LogicalType
    shape: str
    text: str
    index: int | None = None
    name: str | None = None

    def alias(self, name: str) -> Expr:
        return replace(self, name=name)

    @property
    def label(self) -> str:
        """The output name: the alias, else the expression in short."""
        return self.name or self.text

    @property
    def is_boolean_expression(self) -> bool:
        return self.shape not in ("field", "constant", "arith")

    @property
    def output(self) -> Column:
        return F.coalesce(self.column, F.lit(False)) if self.is_boolean_expression else self.column

    def __str__(self) -> str:
        return self.label


def internal(index: int) -> str:
    """The name of a plan's column, so that fields are found by place, whatever their names are."""
    return f"_{index}"


def field(index: int, of: LogicalType, name: str) -> Expr:
    """The input's column at a place."""
    return Expr(F.col(internal(index)), of, "field", name, index=index)


_RANGES = {k: (-(1 << b - 1), (1 << b - 1) - 1) if k.value[0] == "i" else (0, (1 << b) - 1) for k, b in BITS.items()}


def const(value: object, of: LogicalType) -> Expr:
    """A literal of a type; None is the type's null."""
    if value is not None:
        if of.kind in _RANGES:
            low, high = _RANGES[of.kind]
            if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high or of.kind is Kind.I128 and abs(value) >= 10**38:
                raise InvalidConstant(f"{value!r} is no {of}")
        elif of.kind is Kind.BOOLEAN and not isinstance(value, bool) or of.kind is Kind.VARCHAR and not isinstance(value, str):
            raise InvalidConstant(f"{value!r} is no {of}")
        elif of.is_float and (isinstance(value, bool) or not isinstance(value, (int, float))):
            raise InvalidConstant(f"{value!r} is no {of}")
    literal = F.lit(Decimal(value) if isinstance(value, int) and of.sql.startswith("decimal") else value).cast(of.stored)
    return Expr(literal, of, "constant", "null" if value is None else str(value))


def _two(op: str, left: Expr, right: Expr, options: Options) -> None:
    if options.strict and left.shape == right.shape == "constant":
        raise TwoConstants(f"{left.text} {op} {right.text}")


# Arithmetic


def arith(left: Expr, op: str, right: Expr, options: Options = DEFAULT) -> Expr:
    """left op right for + - * / %. Integers divide towards zero, and % has the sign of the dividend and the type of the divisor.

    An integer by zero is an error under ANSI rules and null without them; floats give infinities and NaN.
    Null if either input is.
    """
    if op not in ARITH:
        raise UnsupportedInputs(f"no operator {op!r}")
    _two(op, left, right, options)
    out = arith_result(op, left.type, right.type)
    a, b = left.column, right.column
    if out.kind is Kind.DURATION:
        column = _between(a, b, out.unit)
    elif out.is_float:
        column = _float(op, a, b).cast(out.stored)
    else:
        column = _integer(op, a, b, left.type, right.type, out, options)
    return Expr(column, out, "arith", f"{left.text} {op} {right.text}")


def _between(a: Column, b: Column, unit: str) -> Column:
    if unit == "ns":
        return a - b
    micros = F.timestamp_diff("MICROSECOND", b, a)
    return micros if unit == "us" else F.call_function("div", micros, F.lit(UNITS["us"] // UNITS[unit]))


def _float(op: str, a: Column, b: Column) -> Column:
    if op in "+-*":
        return {"+": operator.add, "-": operator.sub, "*": operator.mul}[op](a, b)
    zero = b == F.lit(0.0)
    nan = F.lit(float("nan"))
    if op == "%":
        return F.when(a.isNull() | b.isNull(), None).when(zero, nan).otherwise(a % F.when(~zero, b))
    sign = F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)
    by_zero = F.when((a == 0.0) | F.isnan(a), nan).otherwise(F.signum(a) * sign * F.lit(float("inf")))
    return F.when(a.isNull() | b.isNull(), None).when(zero, by_zero).otherwise(a / F.when(~zero, b))


def _integer(op: str, a: Column, b: Column, left: LogicalType, right: LogicalType, out: LogicalType, options: Options) -> Column:
    if op == "%":
        return (a % b).cast(out.stored)
    if op == "/":
        if out.kind is Kind.U64 and not out.narrow:
            whole = "decimal(20,0)"
            return ((a.cast(whole) - (a.cast(whole) % b.cast(whole))) / b.cast(whole)).cast(whole)
        most_negative = out.kind in SIGNED and options.overflow == "wrap"
        quotient = F.call_function("div", a.cast("decimal(20,0)") if most_negative else a, b.cast("decimal(20,0)") if most_negative else b)
        if most_negative:  # only the least number by -1 leaves the type
            low = _RANGES[out.kind][0]
            return F.when((a == low) & (b == -1), F.lit(low)).otherwise(F.call_function("div", a, F.when((a == low) & (b == -1), F.lit(1)).otherwise(b))).cast(out.stored)
        return quotient.cast(out.stored)
    apply = {"+": operator.add, "-": operator.sub, "*": operator.mul}[op]
    if out.kind in SIGNED and options.overflow == "error":
        return apply(a, b).cast(out.stored)  # Spark's own check, where ANSI rules hold
    low, high = _RANGES[out.kind]
    wide = {8: "int", 16: "long", 32: "decimal(38,0)"}.get(BITS[out.kind], "decimal(38,0)")
    if BITS[out.kind] == 64 and op == "*" and options.overflow == "wrap":
        return _wrapped_product(a, b, out)
    exact = apply(a.cast(wide), b.cast(wide))
    if options.overflow == "wrap":
        return (F.pmod(exact - F.lit(low).cast(wide), F.lit(high - low + 1 if wide == "int" else Decimal(high - low + 1)).cast(wide)) + F.lit(low if wide == "int" else Decimal(low)).cast(wide)).cast(out.stored)
    inside = (exact >= F.lit(Decimal(low))) & (exact <= F.lit(Decimal(high)))
    return F.when(exact.isNull(), None).when(inside, exact.cast(out.stored)).otherwise(F.raise_error(F.lit(f"{out} overflow in {op}")))


def _wrapped_product(a: Column, b: Column, out: LogicalType) -> Column:
    """64-bit products modulo 2^64, of 32-bit parts so that no part leaves a decimal's 38 digits."""
    whole, half = "decimal(38,0)", F.lit(Decimal(1 << 32))
    modulus = F.lit(Decimal(1 << 64))
    x, y = (F.pmod(c.cast("decimal(20,0)"), modulus.cast("decimal(20,0)")).cast(whole) for c in (a, b))
    low_x, low_y = F.pmod(x, half), F.pmod(y, half)
    high_x, high_y = ((x - low_x) / half).cast("decimal(10,0)"), ((y - low_y) / half).cast("decimal(10,0)")
    low_x, low_y = low_x.cast("decimal(10,0)"), low_y.cast("decimal(10,0)")
    cross = F.pmod((low_x * high_y + high_x * low_y).cast(whole), half).cast("decimal(10,0)")
    product = F.pmod((low_x * low_y).cast(whole) + (cross * half.cast("decimal(10,0)")).cast(whole), modulus.cast(whole))
    if out.kind is Kind.I64:
        product = F.when(product >= F.lit(Decimal(1 << 63)), product - modulus.cast(whole)).otherwise(product)
    return product.cast(out.stored)


# Comparison


def compare(left: Expr, op: str, right: Expr, options: Options = DEFAULT) -> Expr:
    """left op right for == != > >= < <=; null if either input is. Only timestamps may differ in type: in their units."""
    if op not in COMPARE:
        raise UnsupportedInputs(f"no operator {op!r}")
    _two(op, left, right, options)
    check_comparison(op, left.type, right.type)
    a, b = left.column, right.column
    if left.type.kind in (Kind.TIMESTAMP, Kind.TIMESTAMPTZ):
        a, b = _same_instants(left, right)
    column = COMPARE[op](a, b)
    if options.ieee_nan and left.type.is_float:
        column = column & ~F.isnan(a) & ~F.isnan(b)
    return Expr(column, BOOLEAN, "compare", f"{left.text} {op} {right.text}")


def _same_instants(left: Expr, right: Expr) -> tuple[Column, Column]:
    nanos = [e.type.unit == "ns" for e in (left, right)]
    if all(nanos) or left.type.kind is right.type.kind and not any(nanos):
        return left.column, right.column
    # Microseconds from 1970 in UTC; where one side has nanoseconds the other is multiplied in decimals, which can't overflow.
    out = []
    for e, is_nanos in zip((left, right), nanos, strict=True):
        if is_nanos:
            out.append(e.column.cast("decimal(38,0)"))
            continue
        epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        micros = F.unix_micros(e.column) if e.type.kind is Kind.TIMESTAMPTZ else F.timestamp_diff("MICROSECOND", epoch, e.column)
        out.append(micros.cast("decimal(38,0)") * F.lit(Decimal(1000)) if any(nanos) else micros)
    return out[0], out[1]


# Logic


def _conjunction(shape: str, apply: Callable[[Column, Column], Column], inputs: Sequence[Expr], options: Options) -> Expr:
    if len(inputs) < 2:
        raise TooFewInputs(f"{shape} of {len(inputs)}")
    for e in inputs:
        if e.type != BOOLEAN:
            raise NotBoolean(f"{e.text} is {e.type}")
        if options.strict and e.shape == shape:
            raise NotFlattened(f"{shape} in {shape}: {e.text}")
        if options.strict and e.shape == "constant":
            raise ConstantInput(e.text)
    return Expr(functools.reduce(apply, [e.column for e in inputs]), BOOLEAN, shape, f" {shape.upper()} ".join(f"({e.text})" for e in inputs))


def and_(*inputs: Expr, options: Options = DEFAULT) -> Expr:
    return _conjunction("and", operator.and_, inputs, options)


def or_(*inputs: Expr, options: Options = DEFAULT) -> Expr:
    return _conjunction("or", operator.or_, inputs, options)


def not_(of: Expr, options: Options = DEFAULT) -> Expr:
    """Null, as an input, stays null, and so is false in a result."""
    if of.type != BOOLEAN:
        raise NotBoolean(f"{of.text} is {of.type}")
    if options.strict and of.shape == "constant":
        raise ConstantInput(of.text)
    return Expr(~of.column, BOOLEAN, "not", f"NOT ({of.text})")


def _null_test(of: Expr, negated: bool, options: Options) -> Expr:
    if options.strict and of.shape == "constant":
        raise ConstantInput(of.text)
    if of.is_boolean_expression:
        raise BooleanExpression(of.text)
    return Expr(of.column.isNotNull() if negated else of.column.isNull(), BOOLEAN, "null_test", f"{of.text} IS {'NOT ' * negated}NULL")


def is_null(of: Expr, options: Options = DEFAULT) -> Expr:
    return _null_test(of, False, options)


def is_not_null(of: Expr, options: Options = DEFAULT) -> Expr:
    return _null_test(of, True, options)


_BEYOND_REGULAR = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<)|[*+?}]\+")


def regex_match(of: Expr, pattern: str, negated: bool = False, ignore_case: bool = False, options: Options = DEFAULT) -> Expr:
    """Whether the pattern is found anywhere in a string: ~, ~*, !~ and !~*. Null is never selected, negated or not.

    Patterns are regular: no look-around, back-references or possessive quantifiers. Case is folded over all of Unicode.
    """
    sign = "!" * negated + "~" + "*" * ignore_case
    if of.type.kind is not Kind.VARCHAR:
        raise UnsupportedInputs(f"{of.type} {sign} pattern")
    if options.strict and of.shape == "constant":
        raise ConstantInput(of.text)
    if _BEYOND_REGULAR.search(pattern):
        raise InvalidPattern(f"{pattern!r} goes beyond regular expressions")
    try:
        re.compile(re.sub(r"\\[pP](\{[^}]*\}|.)", "x", pattern))
    except re.error as e:
        raise InvalidPattern(f"{pattern!r}: {e}") from e
    found = of.column.rlike(f"(?iu){pattern}" if ignore_case else pattern)
    return Expr(~found if negated else found, BOOLEAN, "regex", f"{of.text} {sign} '{pattern}'")


# Functions of whole arrays that no operator reaches


def _strict_logic(name: str, left: Expr, right: Expr, apply: Callable[[Column, Column], Column]) -> Expr:
    """Null if either input is, unlike AND and OR."""
    for e in (left, right):
        if e.type != BOOLEAN:
            raise NotBoolean(f"{e.text} is {e.type}")
    a, b = left.column, right.column
    return Expr(F.when(a.isNotNull() & b.isNotNull(), apply(a, b)), BOOLEAN, "arith", f"{name}({left.text}, {right.text})")


def array_and(left: Expr, right: Expr) -> Expr:
    return _strict_logic("and", left, right, operator.and_)


def array_or(left: Expr, right: Expr) -> Expr:
    return _strict_logic("or", left, right, operator.or_)


def array_xor(left: Expr, right: Expr) -> Expr:
    return _strict_logic("xor", left, right, operator.ne)


def array_not(of: Expr) -> Expr:
    """The opposite; null stays null."""
    if of.type != BOOLEAN:
        raise NotBoolean(f"{of.text} is {of.type}")
    return Expr(~of.column, BOOLEAN, "arith", f"not({of.text})")


def array_and_scalar(left: Expr, value: bool) -> Expr:
    return array_and(left, const(value, BOOLEAN))


def array_or_scalar(left: Expr, value: bool) -> Expr:
    return array_or(left, const(value, BOOLEAN))


def _interval(op: str, left: Expr, right: Expr, apply: Callable[[Column, Column], Column]) -> Expr:
    for e in (left, right):
        if e.type != INTERVAL:
            raise UnsupportedInputs(f"{left.type} {op} {right.type}")
    fields = {f.name: f.dataType for f in INTERVAL.stored.fields}
    made = F.struct(*[apply(left.column[n], right.column[n]).cast(t).alias(n) for n, t in fields.items()])
    return Expr(F.when(left.column.isNotNull() & right.column.isNotNull(), made), INTERVAL, "arith", f"{left.text} {op} {right.text}")


def interval_add(left: Expr, right: Expr) -> Expr:
    return _interval("+", left, right, operator.add)


def interval_sub(left: Expr, right: Expr) -> Expr:
    return _interval("-", left, right, operator.sub)
