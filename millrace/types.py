"""Logical types, how Spark stores them, and which operators take them."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

from millrace.errors import UnsupportedInputs


class Kind(Enum):
    BOOLEAN = "boolean"
    I8, I16, I32, I64, I128 = "i8", "i16", "i32", "i64", "i128"
    U8, U16, U32, U64 = "u8", "u16", "u32", "u64"
    F32, F64 = "f32", "f64"
    DECIMAL = "decimal"
    VARCHAR, VARBINARY = "varchar", "varbinary"
    TIMESTAMP, TIMESTAMPTZ = "timestamp", "timestamptz"
    TIME, TIMETZ = "time", "timetz"
    DATE, DURATION, INTERVAL = "date", "duration", "interval"
    UUID, IPV4, IPV6 = "uuid", "ipv4", "ipv6"
    LIST = "list"


SIGNED = (Kind.I8, Kind.I16, Kind.I32, Kind.I64)
UNSIGNED = (Kind.U8, Kind.U16, Kind.U32, Kind.U64)
FLOATS = (Kind.F32, Kind.F64)
BITS = {Kind.I8: 8, Kind.I16: 16, Kind.I32: 32, Kind.I64: 64, Kind.I128: 128, Kind.U8: 8, Kind.U16: 16, Kind.U32: 32, Kind.U64: 64}
#: Units in a second.
UNITS = {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}

INTERVAL_FIELDS = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])

_STORED: dict[Kind, T.DataType] = {
    Kind.BOOLEAN: T.BooleanType(),
    Kind.I8: T.ByteType(), Kind.I16: T.ShortType(), Kind.I32: T.IntegerType(), Kind.I64: T.LongType(), Kind.I128: T.DecimalType(38, 0),
    # The next wider signed type; u64 is a decimal unless its values are known to fit (see `wide`).
    Kind.U8: T.ShortType(), Kind.U16: T.IntegerType(), Kind.U32: T.LongType(), Kind.U64: T.DecimalType(20, 0),
    Kind.F32: T.FloatType(), Kind.F64: T.DoubleType(),
    Kind.VARCHAR: T.StringType(), Kind.VARBINARY: T.BinaryType(),
    Kind.TIMESTAMP: T.TimestampNTZType(), Kind.TIMESTAMPTZ: T.TimestampType(),
    Kind.TIME: T.LongType(), Kind.TIMETZ: T.LongType(),
    Kind.DATE: T.DateType(), Kind.DURATION: T.LongType(), Kind.INTERVAL: INTERVAL_FIELDS,
    Kind.UUID: T.StringType(), Kind.IPV4: T.LongType(), Kind.IPV6: T.BinaryType(),
}


@dataclass(frozen=True)
class LogicalType:
    """A type; unit for timestamps and durations, precision and scale for decimals, element for lists.

    narrow: a u64 whose values are known to be below 2^63, stored as a long. Equal types may differ in that.
    """

    kind: Kind
    unit: str | None = None
    precision: int | None = None
    scale: int | None = None
    element: LogicalType | None = None
    narrow: bool = False

    def __eq__(self, other: object) -> bool:
        return isinstance(other, LogicalType) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash(self._key())

    def _key(self) -> tuple:
        return self.kind, self.unit, self.precision, self.scale, self.element

    def __str__(self) -> str:
        if self.kind is Kind.DECIMAL:
            return f"decimal({self.precision},{self.scale})"
        if self.kind is Kind.LIST:
            return f"list<{self.element}>"
        return f"{self.kind.value}({self.unit})" if self.unit else self.kind.value

    @property
    def stored(self) -> T.DataType:
        if self.kind is Kind.DECIMAL:
            return T.DecimalType(self.precision, self.scale)
        if self.kind is Kind.LIST:
            return T.ArrayType(self.element.stored)
        if self.kind is Kind.TIMESTAMP and self.unit == "ns":
            return T.LongType()  # Spark's timestamps end at microseconds
        if self.kind is Kind.U64 and self.narrow:
            return T.LongType()
        return _STORED[self.kind]

    @property
    def sql(self) -> str:
        return self.stored.simpleString()

    @property
    def is_integer(self) -> bool:
        return self.kind in SIGNED + UNSIGNED

    @property
    def is_float(self) -> bool:
        return self.kind in FLOATS


BOOLEAN, I8, I16, I32, I64, I128 = (LogicalType(k) for k in (Kind.BOOLEAN, *SIGNED, Kind.I128))
U8, U16, U32, U64 = (LogicalType(k) for k in UNSIGNED)
U64_NARROW = LogicalType(Kind.U64, narrow=True)
F32, F64 = (LogicalType(k) for k in FLOATS)
VARCHAR, VARBINARY, DATE, INTERVAL, UUID, IPV4, IPV6, TIMESTAMPTZ, TIME, TIMETZ = (
    LogicalType(k) for k in (Kind.VARCHAR, Kind.VARBINARY, Kind.DATE, Kind.INTERVAL, Kind.UUID, Kind.IPV4, Kind.IPV6, Kind.TIMESTAMPTZ, Kind.TIME, Kind.TIMETZ)
)


def timestamp(unit: str = "us") -> LogicalType:
    return LogicalType(Kind.TIMESTAMP, unit=_unit(unit))


def duration(unit: str = "us") -> LogicalType:
    return LogicalType(Kind.DURATION, unit=_unit(unit))


def decimal(precision: int, scale: int) -> LogicalType:
    if not 0 <= scale <= precision <= 38 or not precision:
        raise UnsupportedInputs(f"decimal({precision},{scale})")
    return LogicalType(Kind.DECIMAL, precision=precision, scale=scale)


def list_of(element: LogicalType) -> LogicalType:
    return LogicalType(Kind.LIST, element=element)


def _unit(unit: str) -> str:
    if unit not in UNITS:
        raise UnsupportedInputs(f"no time unit {unit!r}")
    return unit


def of_spark(kind: T.DataType, logical: LogicalType | None = None) -> LogicalType:
    """The logical type of a Spark column; `logical`, if given, must be stored as that."""
    if logical is not None:
        if logical.stored != kind:
            raise UnsupportedInputs(f"{logical} is stored as {logical.sql}, not as {kind.simpleString()}")
        return logical
    if isinstance(kind, T.DecimalType):
        return decimal(kind.precision, kind.scale)
    if isinstance(kind, T.ArrayType):
        return list_of(of_spark(kind.elementType))
    plain = {
        T.BooleanType: BOOLEAN, T.ByteType: I8, T.ShortType: I16, T.IntegerType: I32, T.LongType: I64, T.FloatType: F32, T.DoubleType: F64,
        T.StringType: VARCHAR, T.BinaryType: VARBINARY, T.TimestampNTZType: timestamp("us"), T.TimestampType: TIMESTAMPTZ, T.DateType: DATE,
    }
    if type(kind) in plain:
        return plain[type(kind)]
    if isinstance(kind, T.StructType) and [(f.name, f.dataType) for f in kind] == [(f.name, f.dataType) for f in INTERVAL_FIELDS]:
        return INTERVAL
    raise UnsupportedInputs(f"no logical type for {kind.simpleString()}")


# Which operators take which types. What a table does not list is an error.


def arith_result(op: str, left: LogicalType, right: LogicalType) -> LogicalType:
    """The result type of + - * / %, which take two inputs of one type, and for % also a wider and a narrower integer."""
    if left == right and (left.is_integer or left.is_float):
        # A u64 that is known to be small stays so only where no result can be larger.
        return right if op == "%" else LogicalType(left.kind, narrow=left.narrow and right.narrow and op == "/")
    if op == "%":
        for family in (SIGNED, UNSIGNED):
            if left.kind in family and right.kind in family and family.index(left.kind) > family.index(right.kind):
                return right
    if op == "-" and left.kind is right.kind is Kind.TIMESTAMP and left.unit == right.unit:
        return duration(left.unit)
    raise UnsupportedInputs(f"{left} {op} {right}")


_ORDERED = (Kind.BOOLEAN, *SIGNED, Kind.I128, *UNSIGNED, *FLOATS, Kind.VARCHAR, Kind.VARBINARY, Kind.DATE)
_EQUAL_ONLY = (Kind.UUID, Kind.IPV4, Kind.IPV6)
_INSTANTS, _TIMES = (Kind.TIMESTAMP, Kind.TIMESTAMPTZ), (Kind.TIME, Kind.TIMETZ)


def check_comparison(op: str, left: LogicalType, right: LogicalType) -> None:
    kinds = (left.kind, right.kind)
    if left.kind is right.kind and (left.kind in _ORDERED or left.kind in _EQUAL_ONLY and op in ("==", "!=")):
        return
    if any(all(k in family for k in kinds) for family in (_INSTANTS, _TIMES)):
        return
    raise UnsupportedInputs(f"{left} {op} {right}")


def sum_result(of: LogicalType) -> LogicalType | None:
    if of.kind in SIGNED:
        return I64
    if of.kind in UNSIGNED:
        return U64
    return F64 if of.is_float else None


def takes_min_max(of: LogicalType, strict: bool) -> bool:
    return of.kind is not Kind.LIST and not (strict and of.is_float)
