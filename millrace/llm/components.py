"""Connected components of a table of links, by alternating large and small stars.

Each round is two joins of a stored table; nothing is gathered on the driver. What a hub's links have least is found before the
shuffle; its links themselves meet in a join, whose large partitions Spark splits. So few links that they could be broadcast are
joined by a single task, in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import BROADCAST_ROWS, forget, stored

#: Links that a single task joins, at most; ids that Python orders as Spark does.
FEW_LINKS, PLAIN = BROADCAST_ROWS, ("tinyint", "smallint", "int", "bigint", "string")


def _large_star(links: DataFrame) -> DataFrame:
    """Joins the larger neighbours of each node to the smallest of it and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of them. Links are (smaller, larger)."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    kept = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.union(kept).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _in_one_task(links: DataFrame, kind: str) -> DataFrame:
    """(id, root) of few links, by union and find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
            kind_ = batch.schema.field(0).type
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(list(above), kind_), pa.array([top(x) for x in list(above)], kind_)], ["id", "root"])

    return stored(links.select("a", "b").coalesce(1).mapInArrow(run, f"id {kind}, root {kind}"), "links")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, root) for each node of links (a, b) that isn't the smallest of its component, which is its root.

    Null ends and links of a node to itself are ignored; no links give no rows.
    """
    kind, links = dict(links.dtypes)["a"], links.filter("a <> b")
    if kind in PLAIN and links.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        return _in_one_task(links, kind)
    now = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        after = stored(_small_star(_large_star(now)), "links")
        forget(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    out = now.select(F.col("b").alias("id"), F.col("a").alias("root"))
    out._stored_path = now._stored_path
    return out
