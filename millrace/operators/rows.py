"""Row operators. Each checks its inputs and adds one node to Spark's logical plan."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from millrace.errors import ConstantPredicate, EmptyProjection, FieldOutOfRange, FieldTypeMismatch, InvalidPredicate, LimitOutOfRange, UnionInputs
from millrace.functions.expressions import DEFAULT, Expr, Options, internal
from millrace.types import BOOLEAN, LogicalType

if TYPE_CHECKING:
    from millrace.plans.plan import Plan


def check_field(plan: Plan, e: Expr) -> None:
    """A reference to a field has its place and type."""
    if e.shape != "field":
        return
    if not 0 <= e.index < len(plan.fields):
        raise FieldOutOfRange(f"field {e.index} of {len(plan.fields)}")
    if plan.fields[e.index].type != e.type:
        raise FieldTypeMismatch(f"field {e.index} is {plan.fields[e.index].type}, not {e.type}")


def project(plan: Plan, exprs: Sequence[Expr]) -> Plan:
    """A row for each row. Boolean expressions give true or false, never null; a boolean field keeps its nulls."""
    from millrace.plans.plan import Field, Plan

    if not exprs:
        raise EmptyProjection("nothing to project")
    for e in exprs:
        check_field(plan, e)
    frame = plan.frame.select(*[e.output.alias(internal(i)) for i, e in enumerate(exprs)])
    return Plan(frame, tuple(Field(e.label, e.type) for e in exprs), f"Project[{', '.join(e.label for e in exprs)}]", (plan,))


def filter_(plan: Plan, predicate: Expr, options: Options = DEFAULT) -> Plan:
    """The rows for which the predicate is true; null is not."""
    from millrace.plans.plan import Plan

    check_field(plan, predicate)
    if predicate.type != BOOLEAN:
        raise InvalidPredicate(f"{predicate.text} is {predicate.type}")
    if predicate.shape == "constant" and options.strict:
        raise ConstantPredicate(predicate.text)
    return Plan(plan.frame.filter(predicate.column), plan.fields, f"Filter[{predicate.text}]", (plan,))


def union(left: Plan, *others: Plan) -> Plan:
    """All rows of all, repeated ones too. Types must be equal, place by place; names are those of the first."""
    from millrace.plans.plan import Plan

    out = left
    for other in others:
        if [f.type for f in out.fields] != [f.type for f in other.fields]:
            raise UnionInputs(f"{[str(f.type) for f in out.fields]} and {[str(f.type) for f in other.fields]}")
        fields, frame, more = out.fields, out.frame, other.frame
        for i, (a, b) in enumerate(zip(out.fields, other.fields, strict=True)):
            if a.type.stored != b.type.stored:  # unsigned integers in longs and in decimals
                wide = LogicalType(a.type.kind)
                frame, more = (f.withColumn(internal(i), f[internal(i)].cast(wide.stored)) for f in (frame, more))
                fields = (*fields[:i], type(a)(a.name, wide), *fields[i + 1 :])
        out = Plan(frame.union(more), fields, "Union", (out, other))
    return out


def limit(plan: Plan, n: int, offset: int = 0) -> Plan:
    """n rows after the first `offset`. Without an order these are any rows, in number min(n, max(0, rows - offset))."""
    from millrace.plans.plan import Plan

    if n < 1 or offset < 0 or n + offset >= 1 << 64:
        raise LimitOutOfRange(f"limit {n} offset {offset}")
    most = (1 << 31) - 1
    if n + offset > most:  # Spark's limits are 32-bit: count the rows before each partition instead
        return Plan(_far_limit(plan.frame, n, offset), plan.fields, f"Limit[{n}, {offset}]", (plan,))
    frame = plan.frame.offset(offset).limit(n) if offset else plan.frame.limit(n)
    return Plan(frame, plan.fields, f"Limit[{n}, {offset}]", (plan,))


def _far_limit(frame, n: int, offset: int):
    """Rows [offset, offset + n) by the number of rows before them in their partition and in those before it. The input is checkpointed,
    so that both readings find the same rows in the same places."""
    from pyspark.sql import functions as F

    columns = frame.columns
    placed = checkpointed(frame).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place"))
    before, start = [], 0
    for part, rows in sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect()):
        before += [F.lit(part), F.lit(start)]
        start += rows
    if not before:
        return frame
    place = F.create_map(*before)[F.col("__part")] + F.col("__place").bitwiseAND((1 << 33) - 1)
    return placed.filter((place >= offset) & (place < offset + n)).select(*columns)


def checkpointed(frame):
    """frame, stored in the folder of spark.checkpoint.dir; in a temporary one only where that is unset and Spark runs in one process."""
    sc = frame.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(folder)
    return frame.checkpoint()


def custom(plan: Plan, name: str, transform: Callable[[DataFrame], DataFrame], fields: Mapping[str, LogicalType] | None = None) -> Plan:
    """An operator of one's own: transform gets the plan's DataFrame under its fields' names, and returns another, of these fields or, without
    fields, of those that its columns tell. Built-in functions, mapInPandas or mapInArrow, or a join with another table."""
    from millrace.plans.plan import Field, Plan
    from millrace.types import of_spark

    out = transform(plan.dataframe())
    if fields is None:
        logical = {f.name: f.metadata.get("logical") for f in out.schema.fields}
        kept = {f.name: f.type for f in plan.fields if logical.get(f.name) == str(f.type)}
        fields = {f.name: kept.get(f.name) or of_spark(f.dataType, None) for f in out.schema.fields}
    found = [f.dataType for f in out.schema.fields]
    if found != [t.stored for t in fields.values()]:
        raise FieldTypeMismatch(f"{name} returns {out.schema.simpleString()}, not {({n: str(t) for n, t in fields.items()})}")
    return Plan(out.toDF(*[internal(i) for i in range(len(fields))]), tuple(Field(n, t) for n, t in fields.items()), f"{name}[{', '.join(fields)}]", (plan,))
