"""The sources. Each returns a Plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from millrace.errors import BlocksMismatch, EmptyMemoryTable, InvalidRange
from millrace.functions.expressions import internal
from millrace.plans.plan import Field, Plan
from millrace.types import U64, U64_NARROW, LogicalType, of_spark

#: Rows that one task generates at least.
NUMBERS_PER_TASK = 128 * 4096


def empty(spark: SparkSession, fields: Mapping[str, LogicalType]) -> Plan:
    """No rows, of these types."""
    return memory(spark, [[[] for _ in fields]], fields)


def memory(spark: SparkSession, blocks: Sequence[Sequence[Sequence[object]]], fields: Mapping[str, LogicalType]) -> Plan:
    """Blocks of columns in memory; each block has a column of values for each field. Read as often as wanted."""
    if not blocks:
        raise EmptyMemoryTable("no blocks")
    rows: list[tuple] = []
    for block in blocks:
        if len(block) != len(fields) or len({len(c) for c in block}) > 1:
            raise BlocksMismatch(f"a block of columns of {[len(c) for c in block]} rows for {len(fields)} fields")
        rows += zip(*block, strict=True)
    schema = T.StructType([T.StructField(internal(i), t.stored) for i, t in enumerate(fields.values())])
    try:
        frame = spark.createDataFrame(rows, schema, verifySchema=True)
    except Exception as e:
        raise BlocksMismatch(f"values that aren't of the types {[str(t) for t in fields.values()]}: {e}") from e
    return Plan(frame, tuple(Field(n, t) for n, t in fields.items()), "Memory" if rows else "Empty")


def numbers(spark: SparkSession, start: int, count: int, partitions: int | None = None) -> Plan:
    """The unsigned integers [start, start + count), cut off at 2^64 - 1, as the field `number`. Generated where they are used."""
    if count <= 0 or not 0 <= start < 1 << 64:
        raise InvalidRange(f"{count} numbers from {start}; use an empty table for none")
    end = min(start + count, (1 << 64) - 1)
    if end <= start:
        raise InvalidRange(f"no numbers from {start}")
    tasks = partitions or max(1, min(spark.sparkContext.defaultParallelism, -(-(end - start) // NUMBERS_PER_TASK)))
    if end < 1 << 63:
        return Plan(spark.range(start, end, 1, tasks).toDF(internal(0)), (Field("number", U64_NARROW),), f"Numbers({start}, {end - start})")
    # Spark's ranges are of signed integers, so that more than 2^63 numbers are several ranges.
    frame = None
    for low in range(start, end, (1 << 63) - 1):
        n = min(end - low, (1 << 63) - 1)
        number = F.col("id").cast("decimal(20,0)") + F.lit(Decimal(low)).cast("decimal(20,0)")
        part = spark.range(0, n, 1, tasks).select(number.cast("decimal(20,0)").alias(internal(0)))
        frame = part if frame is None else frame.union(part)
    return Plan(frame, (Field("number", U64),), f"Numbers({start}, {end - start})")


def custom(spark: SparkSession, source: type[DataSource], options: Mapping[str, object] | None = None, logical: Mapping[str, LogicalType] | None = None) -> Plan:
    """A source of one's own: a class of Spark's Python data source interface, whose partitions are read in parallel."""
    spark.dataSource.register(source)
    plan = dataframe(spark.read.format(source.name()).options(**(options or {})).load(), logical)
    return Plan(plan.frame, plan.fields, f"{source.name()}")


def dataframe(frame: DataFrame, logical: Mapping[str, LogicalType] | None = None) -> Plan:
    """Any DataFrame; logical types where Spark's don't tell, such as unsigned integers or durations."""
    known = logical or {}
    fields = tuple(Field(f.name, of_spark(f.dataType, known.get(f.name))) for f in frame.schema.fields)
    return Plan(frame.toDF(*[internal(i) for i in range(len(fields))]), fields, "Table")


def parquet(spark: SparkSession, path: str, logical: Mapping[str, LogicalType] | None = None) -> Plan:
    """Parquet files; only the columns and row groups that a query needs are read."""
    plan = dataframe(spark.read.parquet(path), logical)
    return Plan(plan.frame, plan.fields, f"Parquet({path})")
