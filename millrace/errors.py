"""What constructors raise. Nothing is coerced: an input that an operator's table does not list is an error."""


class MillraceError(ValueError):
    """Base of all errors of the library."""


class UnsupportedInputs(MillraceError):
    """The operator has no signature for these types."""


class TwoConstants(MillraceError):
    """Both operands are constants."""


class ConstantInput(MillraceError):
    """The operator rejects a constant input."""


class InvalidConstant(MillraceError):
    """The value isn't one of the constant's type."""


class NotBoolean(MillraceError):
    """An input of a logical operator isn't boolean."""


class BooleanExpression(MillraceError):
    """The operator takes no boolean expression, only a field."""


class NotFlattened(MillraceError):
    """AND in AND, or OR in OR."""


class TooFewInputs(MillraceError):
    """AND and OR take two inputs or more."""


class InvalidPattern(MillraceError):
    """The regular expression does not compile, or goes beyond regular languages."""


class InvalidPredicate(MillraceError):
    """A filter's predicate isn't boolean."""


class ConstantPredicate(MillraceError):
    """A filter's predicate is a constant."""


class UnionInputs(MillraceError):
    """The inputs of a union differ in their types."""


class LimitOutOfRange(MillraceError):
    """A limit of 0, a negative offset, or a sum of both beyond 64 bits."""


class EmptyProjection(MillraceError):
    """A projection of nothing."""


class EmptyGroupKeys(MillraceError):
    """Grouping by nothing; use a global aggregate."""


class EmptyAggregates(MillraceError):
    """An aggregation without functions."""


class NotAField(MillraceError):
    """Group keys and arguments of aggregates are fields; project expressions first."""


class FieldOutOfRange(MillraceError):
    """The input has no such field."""


class FieldTypeMismatch(MillraceError):
    """The input's field has another type than the reference to it."""


class ArgumentMismatch(MillraceError):
    """An aggregate function does not take this type."""


class EmptyMemoryTable(MillraceError):
    """A memory table without blocks; use an empty table."""


class BlocksMismatch(MillraceError):
    """Blocks of a memory table that differ in their types or lengths."""


class InvalidRange(MillraceError):
    """A range of numbers that is empty or leaves the unsigned 64-bit integers."""


class QueryCancelled(MillraceError):
    """The query was cancelled."""


class InvalidParallelism(MillraceError):
    """A query needs one task at least."""
