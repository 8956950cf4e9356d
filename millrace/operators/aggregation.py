"""Aggregation: over all rows, and by group."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from millrace.errors import EmptyAggregates, EmptyGroupKeys, NotAField
from millrace.functions.aggregates import Aggregate
from millrace.functions.expressions import DEFAULT, Expr, Options, internal
from millrace.operators.rows import check_field

if TYPE_CHECKING:
    from millrace.plans.plan import Plan


def _check(plan: Plan, functions: Sequence[Aggregate], options: Options) -> None:
    if not functions:
        raise EmptyAggregates("no aggregate functions")
    for a in functions:
        if a.argument is not None:
            if options.strict and a.argument.shape != "field":
                raise NotAField(a.text)
            check_field(plan, a.argument)


def aggregate(plan: Plan, functions: Sequence[Aggregate], options: Options = DEFAULT) -> Plan:
    """One row, also for no rows: counts are 0 then, and the other functions null."""
    from millrace.plans.plan import Field, Plan

    _check(plan, functions, options)
    frame = plan.frame.agg(*[a.column.alias(internal(i)) for i, a in enumerate(functions)])
    return Plan(frame, tuple(Field(a.label, a.type) for a in functions), f"Aggregate[{', '.join(a.label for a in functions)}]", (plan,))


def group_by(plan: Plan, keys: Sequence[Expr], functions: Sequence[Aggregate], options: Options = DEFAULT) -> Plan:
    """A row for each group: its keys, then the functions. Nulls are one group, and so are all NaN, and 0.0 and -0.0."""
    from millrace.plans.plan import Field, Plan

    if not keys:
        raise EmptyGroupKeys("no keys")
    _check(plan, functions, options)
    for k in keys:
        if options.strict and k.shape != "field":
            raise NotAField(k.text)
        check_field(plan, k)
    named = [k.output.alias(f"k{i}") for i, k in enumerate(keys)]
    grouped = plan.frame.groupBy(*named).agg(*[a.column.alias(f"a{i}") for i, a in enumerate(functions)])
    frame = grouped.toDF(*[internal(i) for i in range(len(keys) + len(functions))])
    fields = (*(Field(k.label, k.type) for k in keys), *(Field(a.label, a.type) for a in functions))
    return Plan(frame, fields, f"GroupBy[{', '.join(k.label for k in keys)}; {', '.join(a.label for a in functions)}]", (plan,))
