"""Mixing sources to target weights by balanced sampling with the cube method.

Each document of a source has the same expected number of copies, target / source size. Its whole part is taken for certain;
its fractional part is an inclusion probability. The flight moves probabilities along directions that change neither their
sum nor their sum weighted by document size (the null space of two constraints on three documents), until each is 0 or 1.

The flight runs in blocks of documents dealt out by hash; of each source at most two documents of a block stay undecided, and a
reserve of its smallest ones is held back. They fly again with those of other blocks, in groups of bounded size. At last the reserve
of a source is left with two other documents at most. These are drawn, what they miss in words is spread over the reserve's probabilities,
and the reserve flies until a dozen small documents are left, of which the best choice is taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import WORD, free_name, scratch, small, stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Documents of a block about, and blocks whose undecided documents fly together at most.
BLOCK_ROWS, GROUP_BLOCKS = 8192, 1024
#: Documents of a source that are kept for the landing, besides the two at most that a flight leaves.
LANDING = 10
#: The reserve can take or give up so many times the largest document, but has at most that share of the documents.
RESERVE, RESERVE_SHARE = 2.0, 0.75
#: Ways of moving the reserve's probabilities that are tried.
TILTS = 21
SEED = 17
_EPS = 1e-9


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, the place from 0 of each source by code point, null last. Ranges are sorted apart; only their counts go to the driver."""
    by_range = sources.repartitionByRange(*[F.col("source").isNull(), F.col("source")]).sortWithinPartitions(F.col("source").isNull(), "source")
    placed = stored(by_range.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "placed")
    parts = sorted((r["part"], r["n"], r["low"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low")).collect())
    before, start = {}, 0
    for part, n, low in parts:
        before[part] = start - low
        start += n
    shift = F.create_map(*[F.lit(x) for p, s in before.items() for x in (p, s)]) if before else F.create_map(F.lit(0), F.lit(0))
    return placed.withColumn("rank", F.col("place") + shift[F.col("part")]).drop("part", "place")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size).

    Sources by code point, null last, have the weights in turn and share all words; a target stops at `most` times its
    source's size, and what it leaves is shared by weight among the others until none is above.
    """
    rows = stored(_ranked(sizes), "ranked")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = rows.withColumns({"weight": weight.cast("double"), "cap": (most * F.col("source_size")).cast("double")})
    level, total = 0.0, float(rows.agg(F.sum("source_size")).first()[0] or 0)
    while True:  # sources at their cap stay there: the level only rises
        over = F.col("weight") * level > F.col("cap")
        r = rows.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not r["weight"]:
            break
        new = (total - r["capped"]) / r["weight"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return rows.select("source", "source_size", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def _fly(pi: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The flight, in the order given. At most two entries stay strictly between 0 and 1."""
    pi = pi.copy()
    open_: list[int] = []
    for k in range(len(pi)):
        if not _EPS < pi[k] < 1 - _EPS:
            pi[k] = round(pi[k])
            continue
        open_.append(k)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], dtype=float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        p = pi[open_]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.nanmin(np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)))
            down = np.nanmin(np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)))
        p = p + (up if draw[k] < down / (up + down) else -down) * u  # the mean step is 0: probabilities are kept
        done = (p < _EPS) | (p > 1 - _EPS)
        p[done] = np.round(p[done])
        pi[open_] = p
        open_ = [x for x, d in zip(open_, done, strict=True) if not d]
    return pi


def _land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the few documents that are open: of all choices the one nearest in words, and then in documents, to what is due."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    if not len(open_):
        return pi
    pi, own = pi.copy(), size[open_]
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(choices @ own - pi[open_] @ own) / max(own.mean(), 1)
    documents = np.abs(choices.sum(axis=1) - pi[open_].sum())
    pi[open_] = choices[np.argmin(words + 0.02 * documents)]
    return pi


def _spread(pi: np.ndarray, size: np.ndarray, words: float) -> np.ndarray:
    """Probabilities moved, as far as 0 and 1 allow, so that they expect so many words more, and as nearly as can be as many documents: larger
    documents move more, by that of several tilts that changes the number of documents least."""
    if abs(words) <= _EPS or not len(pi):
        return pi
    aim, best = float(pi @ size) + words, pi
    for tilt in np.linspace(0, 2, TILTS):
        base = pi + math.copysign(tilt, words) * (size - size.mean()) / max(size.max(), 1)
        low, high = -4.0, 4.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if np.clip(base + middle, 0, 1) @ size < aim else (low, middle)
        moved = np.clip(base + (low + high) / 2, 0, 1)
        if best is pi or abs(moved.sum() - pi.sum()) < abs(best.sum() - pi.sum()):
            best = moved
    return best


def _open(pi: np.ndarray) -> np.ndarray:
    return (pi > _EPS) & (pi < 1 - _EPS)


def _reserve(pi: np.ndarray, size: np.ndarray, parts: int = 1, least: float = 0.0) -> int:
    """The place from which on documents, largest first, are the reserve. Each of several parts holds back less, for they come together, but
    room for so many words at least, which the source's largest document may need in another part."""
    if not len(pi):
        return 0
    some = int(np.searchsorted(-size, 0))  # documents without words are none, but come last
    room = np.cumsum((np.minimum(pi, 1 - pi) * size)[::-1])
    most = min(int(RESERVE_SHARE * len(pi)) + 1, some)
    return some - min(most, int(np.searchsorted(room[len(pi) - some :], max(RESERVE * size[0] / math.sqrt(parts), least))) + LANDING)


def _settle(pi: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Decides the open rows of one source, largest first: all but the reserve, and then that."""
    pi = pi.copy()
    cut = _reserve(pi, size)
    pi[:cut] = _fly(pi[:cut], size[:cut], draw[:cut])
    left = np.flatnonzero(_open(pi[:cut]))
    rest = np.arange(cut, len(pi))
    room = float(pi[rest] @ size[rest]), float((1 - pi[rest]) @ size[rest])  # words the reserve can give up, and take
    for i in left:
        for choice in sorted((0.0, 1.0), key=lambda c: (c == 1) != (draw[i] < pi[i])):
            missing = float((pi[i] - choice) * size[i])
            if -room[0] <= missing <= room[1]:
                break
        else:
            choice = round(pi[i])
            missing = float((pi[i] - choice) * size[i])
        pi[i] = choice
        pi[rest] = _spread(pi[rest], size[rest], missing)
        room = float(pi[rest] @ size[rest]), float((1 - pi[rest]) @ size[rest])
    held = rest[np.unique(np.linspace(0, max(len(rest) - 1, 0), LANDING).round().astype(int))] if len(rest) else rest
    fly = np.setdiff1d(rest, held, assume_unique=True)
    pi[fly] = _fly(pi[fly], size[fly], draw[fly])
    return _land(np.where(_open(pi), pi, pi.round()), size)


def _flown(rows: pd.DataFrame, parts: int, blocks: int = 1) -> pd.DataFrame:
    """Rows of one of so many blocks, of which so many parts come together: rank, key, size, pi, draw, largest (of the source). The reserve of each
    source stays as it is; with 0 parts all are decided."""
    rows = rows.sort_values(["rank", "size", "draw"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
    pi, size, draw, rank = (rows[c].to_numpy(dtype=t) for c, t in (("pi", float), ("size", float), ("draw", float), ("rank", np.int64)))
    edges = np.flatnonzero(np.diff(rank)) + 1
    for a, b in zip([0, *edges], [*edges, len(rows)], strict=True):
        place = a + np.flatnonzero(_open(pi[a:b]))
        pi[a:b] = np.where(_open(pi[a:b]), pi[a:b], pi[a:b].round())
        if parts:
            fly = place[: _reserve(pi[place], size[place], parts, RESERVE * rows["largest"].iloc[a] / blocks)]
            pi[fly] = _fly(pi[fly], size[fly], draw[fly])
        else:
            pi[place] = _settle(pi[place], size[place], draw[place])
    rows["pi"] = pi
    return rows


def _flight(parts: int, blocks: int = 1) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: _flown(rows, parts, blocks)


def _sampled(units: DataFrame) -> DataFrame:
    """Adds chosen (0 or 1) to units (rank, key, size, pi, draw), whose key is unique within rank."""
    n = units.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    if blocks > 1:
        units = units.join(small(stored(units.groupBy("rank").agg(F.max("size").alias("largest")), "largest")), "rank")
    schema = units.schema
    open_, decided = units, []
    keys: list = [F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(blocks)).alias("block")]
    while blocks > 1:
        flown = stored(open_.groupBy(*keys).applyInPandas(_flight(min(blocks, GROUP_BLOCKS), blocks), schema), "flown")
        undecided = (F.col("pi") > 0) & (F.col("pi") < 1)
        decided.append(flown.filter(~undecided))
        open_ = flown.filter(undecided)
        if blocks <= GROUP_BLOCKS:
            break
        divisor = -(-blocks // GROUP_BLOCKS)
        # A source's undecided documents of up to GROUP_BLOCKS blocks fly together.
        keys = ["rank", F.pmod(F.xxhash64("key", F.lit(SEED + blocks)), F.lit(divisor)).alias("block")]
        blocks = divisor
    out = open_.groupBy("rank").applyInPandas(_flight(0), schema)
    for d in decided:
        out = out.unionByName(d)
    return out.select("rank", "key", F.col("pi").cast("long").alias("chosen"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int) -> DataFrame:
    """(id, source, size, n, source_size, target, copies) of each distinct (id, source, size); n rows have it."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    units = stored(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "units")
    sizes = stored(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sizes")
    aims = targets(sizes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = stored(aims.select(F.col("source").alias("s"), "source_size", "target", F.xxhash64("source").alias("rank"), ratio.alias("ratio")), "aims")
    known = units.join(small(aims), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor(F.col("ratio") + _EPS)
    known = known.withColumns({"whole": whole, "pi": F.greatest(F.col("ratio") - whole, F.lit(0.0)), "key": F.xxhash64("id", "size", F.lit(SEED + 1))})
    # Units of one key are decided together; of rows that repeat an id and size all are.
    merged = known.groupBy("rank", "key").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("size"), F.max("pi").alias("pi"))
    draw = F.pmod(F.xxhash64("key", F.lit(SEED + 2)), F.lit(1 << 40)) / float(1 << 40)
    flying = stored(merged.withColumn("draw", draw), "flying")
    chosen = stored(_sampled(flying), "chosen")
    return known.join(chosen, ["rank", "key"], "left").withColumn("copies", F.col("whole") + F.coalesce("chosen", F.lit(0).cast("long")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """One row for each row of docs: id_col, size, source_size, target, taken, copies.

    copies is how often the mix takes the document, at most `most` times; taken its words in it. Null sources are a source, null
    texts have no words. Rows equal in id, source and size are decided together. Sources without words get 0. Reruns agree,
    however the table is split into files. Extra columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        rows = stored(_mixed(docs, id_col, text_col, source_col, weights, most), "mixed")
        keep(rows)
    return rows.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def apply_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it, with all their columns."""
    with scratch(docs.sparkSession) as keep:
        rows = stored(_mixed(docs, id_col, text_col, source_col, weights, most).filter("copies > 0").select("id", "source", "size", "copies"), "copies")
        keep(rows)
    i, s, z, c, again = (free_name(docs, f"__{x}") for x in ("id", "source", "size", "copies", "again"))
    size = free_name(docs, "__own_size")
    found = docs.withColumn(size, size_of(F.col(text_col))).join(
        small(rows.toDF(i, s, z, c)), F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).eqNullSafe(F.col(s)) & (F.col(size) == F.col(z))
    )
    return found.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(c)))).select(*docs.columns)
