"""Exact duplicates: groups by a 128-bit content hash, MD5, whose bytes are compared within groups, so that collisions are told apart.

Documents are counted by hash first. Only texts whose hash occurs more than once are grouped by hash and text; each task sums up its
copies before the shuffle, so a group that holds a third of all rows sends its text once for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import free_name, scratch, small, stored


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _classes(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """(h, text, class_size, stays): a stored row for each text under a hash that several rows have. text is null where the hash has
    no other text, so that no join needs it there."""
    if keep not in ("min", "max"):
        raise ValueError(f"keep is 'min' or 'max', not {keep!r}")
    stays = {"min": F.min, "max": F.max}[keep]  # null only if there is no other id
    text = docs.select(F.col(id_col).alias("id"), _text(text_col).alias("text")).withColumn("h", _hash128(F.col("text")))
    repeated = stored(text.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "repeated")
    same = text.join(small(repeated), "h", "left_semi").groupBy("h", "text").agg(F.count(F.lit(1)).alias("class_size"), stays("id").alias("stays"))
    same = stored(same, "texts")
    several = stored(same.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h", F.lit(True).alias("several")), "collisions")
    return stored(same.join(small(several), "h", "left").select("h", F.when(F.col("several"), F.col("text")).alias("text"), "class_size", "stays"), "classes")


def _with_class(rows: DataFrame, classes: DataFrame, h: str, text: str, names: tuple[str, str]) -> DataFrame:
    """Adds class_size and stays, under names, to rows with a hash h; null where no other row has the hash. Rows under a hash of several texts
    are told apart by their bytes."""
    size, stays = names
    alone = classes.filter("text IS NULL").select(F.col("h").alias(h), F.col("class_size").alias(size), F.col("stays").alias(stays))
    alone._stored_path = classes._stored_path
    collided = classes.filter("text IS NOT NULL").select("h", "text", "class_size", "stays")
    if collided.isEmpty():
        return rows.join(small(alone), h, "left")
    hashes = collided.select(F.col("h").alias(h)).distinct()
    clear = rows.join(hashes, h, "left_anti").join(small(alone), h, "left")
    mixed = rows.join(hashes, h, "left_semi").join(collided.toDF(h, text, size, stays), [h, text])
    return clear.unionByName(mixed)


def classify_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. The row with the smallest id of a group stays
    (keep="max": the largest). Of repeated rows, equal in id and text, one stays. A null id stays only in a group
    without any other id; keep_id is null then. No rows: no rows. Extra columns of docs are not read.
    """
    with scratch(docs.sparkSession) as keep_tables:
        classes = _classes(docs, id_col, text_col, keep)
        rows = docs.select(F.col(id_col).alias("id"), _text(text_col).alias("text"))
        # Copies of a row are counted, so that one of them stays; the digest is 256 bits of each, and no text is shuffled for it.
        rows = rows.select("id", "text", _hash128(F.col("text")).alias("h"), F.unhex(F.sha2("text", 256)).alias("sha"))
        found = _with_class(rows, classes, "h", "text", ("class_size", "stays"))
        found = found.select("id", "h", "sha", "class_size", "stays", F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("stays")).alias("keep_id"))
        units = found.groupBy("id", "keep_id", "sha", "class_size", "h").agg(F.count(F.lit(1)).alias("n"))
        units = stored(units, "units")
        keep_tables(units)
    return units.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.coalesce("class_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that classify_copies() keeps, with all their columns.

    Of repeated rows, equal in id and text, any one stays with the other columns it has.
    """
    h, text, size, stays = (free_name(docs, x) for x in ("__h", "__text", "__size", "__stays"))
    with scratch(docs.sparkSession) as keep_tables:
        classes = _classes(docs, id_col, text_col, keep)
        keep_tables(classes)
        rows = docs.withColumns({h: _hash128(_text(text_col)), text: _text(text_col)})
        found = _with_class(rows, classes, h, text, (size, stays)).filter(F.col(size).isNull() | F.col(id_col).eqNullSafe(F.col(stays)))
        # Rows that repeat one that stays, if there are any; whole documents are grouped only then.
        again = stored(found.filter(F.col(size).isNotNull()).groupBy(F.col(id_col).alias("id"), F.col(h).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "h"), "again")
        if again.isEmpty():
            return found.select(*docs.columns)
        keep_tables(again)
    i, g = free_name(docs, "__id"), free_name(docs, "__hash")
    match = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(h) == F.col(g))
    once = found.join(small(again.toDF(i, g)), match, "left_anti")
    rest = found.join(small(again.toDF(i, g)), match, "left_semi").dropDuplicates([id_col, h, text])
    return once.select(*docs.columns).unionByName(rest.select(*docs.columns))
