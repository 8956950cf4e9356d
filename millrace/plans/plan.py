"""A plan: a DataFrame whose columns are found by place, with the logical types and the names they are shown under."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource

from millrace.errors import FieldOutOfRange
from millrace.functions.aggregates import Aggregate
from millrace.functions.expressions import DEFAULT, Expr, Options, field, internal
from millrace.operators import aggregation, rows
from millrace.types import LogicalType

class Walk(Enum):
    """How a walk goes on."""

    ON, SKIP, STOP = range(3)


#: Rows of a batch that a handler gets.
BATCH_ROWS = 4096


@dataclass(frozen=True)
class Field:
    name: str
    type: LogicalType


@dataclass(frozen=True)
class Plan:
    """Operators return new plans; nothing runs until the result is asked for."""

    frame: DataFrame
    fields: tuple[Field, ...]
    node: str
    inputs: tuple[Plan, ...] = ()

    def field(self, which: int | str) -> Expr:
        """A field by place, or by name: the first one that has it."""
        if isinstance(which, str):
            places = [i for i, f in enumerate(self.fields) if f.name == which]
            if not places:
                raise FieldOutOfRange(f"no field {which!r} in {[f.name for f in self.fields]}")
            which = places[0]
        if not 0 <= which < len(self.fields):
            raise FieldOutOfRange(f"field {which} of {len(self.fields)}")
        return field(which, self.fields[which].type, self.fields[which].name)

    __getitem__ = field

    def project(self, *exprs: Expr) -> Plan:
        return rows.project(self, exprs)

    def filter(self, predicate: Expr, options: Options = DEFAULT) -> Plan:
        return rows.filter_(self, predicate, options)

    def union(self, *others: Plan) -> Plan:
        return rows.union(self, *others)

    def limit(self, n: int, offset: int = 0) -> Plan:
        return rows.limit(self, n, offset)

    def aggregate(self, *functions: Aggregate, options: Options = DEFAULT) -> Plan:
        return aggregation.aggregate(self, functions, options)

    def group_by(self, *keys: Expr) -> Callable[..., Plan]:
        """group_by(keys...)(functions...)"""
        return lambda *functions, options=DEFAULT: aggregation.group_by(self, keys, functions, options)

    def custom(self, name: str, transform: Callable[[DataFrame], DataFrame], fields: Mapping[str, LogicalType] | None = None) -> Plan:
        return rows.custom(self, name, transform, fields)

    # Results

    def dataframe(self) -> DataFrame:
        """The result under its fields' names, each column with its logical type in its metadata."""
        columns = [self.frame[internal(i)].alias(f.name, metadata={"logical": str(f.type)}) for i, f in enumerate(self.fields)]
        return self.frame.select(*columns)

    def batches(self, size: int = BATCH_ROWS) -> Iterator[list[Row]]:
        """The result in batches, of which the driver holds one partition at a time."""
        part: list[Row] = []
        for row in self.dataframe().toLocalIterator(prefetchPartitions=True):
            part.append(row)
            if len(part) == size:
                yield part
                part = []
        if part:
            yield part

    def execute(self, handler: Callable[[list[Row]], None], size: int = BATCH_ROWS) -> None:
        """Calls handler on the driver with each batch, in no order."""
        for part in self.batches(size):
            handler(part)

    def execute_on_workers(self, handler: Callable[[Iterator[Row]], None]) -> None:
        """Calls handler with the rows of each partition where they are, in parallel."""
        self.dataframe().foreachPartition(handler)

    def write_to(self, sink: type[DataSource], options: Mapping[str, object] | None = None, mode: str = "append") -> None:
        """Writes the result by a sink of one's own: a class of Spark's Python data source interface, whose writer commits all tasks or none."""
        self.frame.sparkSession.dataSource.register(sink)
        self.dataframe().write.format(sink.name()).options(**(options or {})).mode(mode).save()

    # Display

    def tree(self) -> str:
        lines = [self.node]
        for i, plan in enumerate(self.inputs):
            last = i == len(self.inputs) - 1
            first, *rest = plan.tree().split("\n")
            lines.append(("└── " if last else "├── ") + first)
            lines += [("    " if last else "│   ") + x for x in rest]
        return "\n".join(lines)

    def explain(self, mode: str = "formatted") -> str:
        """Spark's plan."""
        query = self.dataframe()._jdf.queryExecution()
        return query.explainString(self.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def apply(self, f: Callable[[Plan], Walk | None]) -> Walk:
        """Calls f with the plan and then, in order, with what is below it. SKIP leaves out a plan's inputs, STOP ends the walk."""
        return self.walk(down=f)

    def walk(self, down: Callable[[Plan], Walk | None] | None = None, up: Callable[[Plan], Walk | None] | None = None) -> Walk:
        """down is called before a plan's inputs are walked, up after. Where down says SKIP the inputs aren't, but up is called. Nothing returned is ON."""
        said = (down and down(self)) or Walk.ON
        if said is Walk.STOP:
            return said
        if said is Walk.ON:
            for plan in self.inputs:
                if plan.walk(down, up) is Walk.STOP:
                    return Walk.STOP
        return (up and up(self)) or Walk.ON

    def visit(self, visitor: Callable[[Plan], bool]) -> None:
        """Visits the plan and, as long as visitor returns true, its inputs."""
        self.apply(lambda plan: Walk.ON if visitor(plan) else Walk.SKIP)

    def pipelines(self) -> list[str]:
        """The stretches between what must be gathered: each from a source, or the result of an aggregation, to a sink or the result."""
        out: list[str] = []

        def paths(plan: Plan) -> list[list[str]]:
            name = re.split(r"[\[(]", plan.node)[0]
            if not plan.inputs:
                return [[f"Source({name})"]]
            if name == "Union":  # dissolved: what follows it follows each of its inputs
                return [p for i in plan.inputs for p in paths(i)]
            below = [p for i in plan.inputs for p in paths(i)]
            if name in ("Aggregate", "GroupBy"):
                out.extend(" --> ".join([*p, f"Sink({name})"]) for p in below)
                return [[f"Source({name})"]]
            return [[*p, name] for p in below]

        ends = paths(self)
        return out + [" --> ".join(p) for p in ends]

    def show(self, n: int = 20) -> str:
        """The first rows in a box, under names and types, with Null for nulls."""
        head = [f"{f.name}\n{f.type}".split("\n") for f in self.fields]
        body = [["Null" if v is None else str(v) for v in row] for row in self.dataframe().limit(n).collect()]
        lines = [[h[0] for h in head], [h[1] for h in head], *body]
        widths = [max(len(x[i]) for x in lines) for i in range(len(self.fields))]
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        text = ["|" + "|".join(f" {v:<{w}} " for v, w in zip(x, widths, strict=True)) + "|" for x in lines]
        return "\n".join([rule, *text[:2], rule, *text[2:], *([rule] if body else [])])
