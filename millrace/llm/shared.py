"""What the corpus operators have in common: words, tables, and the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space. The same text is valid in Java's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Size up to which a table of short keys is broadcast, in rows and in bytes of memory; beyond it the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 48 << 20

#: Bytes of an Arrow batch, about. A batch is held by the JVM and by the worker, which makes Python objects of it, so Spark's 64 MB are much.
BATCH_BYTES = 4 << 20

_scratch: ContextVar[list[str | DataFrame] | None] = ContextVar("millrace_scratch", default=None)
_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in a single process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dirs.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="millrace-"))


def bound_batches(spark: SparkSession) -> None:
    """Sends texts to Python in batches of BATCH_BYTES, unless the session has a limit of its own. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, and no lost executor loses it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    made = _scratch.get()
    if made is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def held(df: DataFrame) -> DataFrame:
    """Keeps df on the executors' disks, from its first use until forget() or the end of scratch(), without writing files through Hadoop.

    On local folders Hadoop starts a process for each file, which small tables don't repay. What a lost executor held is made again,
    so what df reads must last as long."""
    out = df.persist(StorageLevel.DISK_ONLY)
    made = _scratch.get()
    if made is not None:
        made.append(out)
    return out


def _delete(spark: SparkSession, path: str | DataFrame) -> None:
    if isinstance(path, DataFrame):
        path.unpersist()
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(conf).delete(parent, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by stored() or held(), once nothing reads them any more."""
    made = _scratch.get()
    for t in tables:
        own = getattr(t, "_stored_path", t)
        _delete(t.sparkSession, own)
        if made is not None:
            made[:] = [x for x in made if x != own]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables that stored() and held() make within are deleted at the end, but those given to keep(), the function that it yields."""
    made: list[str | DataFrame] = []
    outer, kept, token = _scratch.get(), set(), _scratch.set(made)
    try:
        yield lambda *tables: kept.update(t._stored_path for t in tables)
    finally:
        _scratch.reset(token)
        for path in made:
            if path not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it has no more than so many rows and bytes. It reads df, so df should be stored or held."""
    long = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    # A row of a hashed relation has a header, a word for each column, and what strings have besides.
    width = sum(long, F.lit(64 + 8 * len(df.columns)))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= size else df


def words_of(text: Column) -> Column:
    """The array of words of a text, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def free_name(df: DataFrame, wanted: str, taken: Iterable[str] = ()) -> str:
    """A column name that df, whatever its extra columns, does not have."""
    used = {c.lower() for c in df.columns} | {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted
