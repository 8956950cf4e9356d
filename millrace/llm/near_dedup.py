"""Near duplicates by HyperMinHash sketches.

Each set of word shingles is hashed once. The leading bits of a hash choose a bucket; of a bucket's least hash the sketch
stores the number of leading zeros and some mantissa bits. Empty buckets take over the register of another bucket, found
in an order of their own that is the same for all documents. Bands of compressed registers give candidate pairs, which are
confirmed on full sets; more than can be broadcast are first filtered by the Jaccard estimate, corrected for equal registers of
different hashes.

Equal sets are one class first. In each band members are compared with a pivot, and found components are joined. Bands that hold one
component are done; only the rows of others are read again. If comparing what they hold costs many pairs a document, large ones get
another pivot, a few times at most and as long as that joins some. Then all pairs across components that share a band are compared, in
blocks. So a large group of copies costs a number of comparisons in proportion to its size, only documents that are similar but not
linked are compared with each other, and there is no cap. A pivot's pairs are dealt to several tasks by a salt, and its set is sent
once to each.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.shared import BROADCAST_ROWS, bound_batches, forget, free_name, held, scratch, small, stored

#: Registers, mantissa bits, registers of a band. A pair at 0.8 shares none of the 42 bands with a chance of about 3e-6.
REGISTERS, MANTISSA, ROWS = 256, 10, 6
BANDS = REGISTERS // ROWS
#: Members of a band that gets one pivot only; documents of a block, about; shingles that a block compares at a time.
FEW, BLOCK, TOKENS = 8, 128, 4096
#: Pairs a document that blocks may compare before large bands get another pivot instead.
BLOCK_PAIRS = 512
#: Shingles of a block, about; pivots of a band beyond the first, at most; pairs of one pivot that a salt gets.
BLOCK_SHINGLES, PIVOTS, SALT_PAIRS = 1 << 18, 4, 256
#: Words whose hash a worker remembers.
KNOWN_WORDS = 500_000
#: Candidates are dropped when the estimate lies this many standard deviations below the threshold.
DEVIATIONS = 5.0

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit hashes of shingles of `words` words; A-Z count as a-z, words are runs of anything but ASCII white space."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted and distinct. Fewer words than a shingle has make one shingle, no words make none."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = _mix(out * _M1 + h[i : len(h) - k + 1 + i])
        return np.unique(out)


@functools.cache
def _order() -> np.ndarray:
    """[i, j]: the place of bucket j in the order in which the empty bucket i looks for another."""
    return np.argsort(np.random.default_rng(20240229).random((REGISTERS, REGISTERS)), axis=1).argsort(axis=1).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set that isn't empty, from its sorted hashes."""
    bits = np.uint64(64 - int(math.log2(REGISTERS)))
    bucket = (hashes >> bits).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # hashes are sorted: a bucket's first is its least
    least = (hashes[first] & np.uint64((1 << int(bits)) - 1)) >> np.uint64(3)  # 53 bits: exact as a double
    _, exponent = np.frexp(least.astype(np.float64))
    zeros = np.uint64(53) - exponent.astype(np.uint64)
    mantissa = ((least << zeros) & np.uint64((1 << 52) - 1)) >> np.uint64(52 - MANTISSA)
    found = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    full = bucket[first]
    out = np.empty(REGISTERS, dtype=np.uint16)
    out[full] = found
    if len(full) < REGISTERS:
        empty = np.setdiff1d(np.arange(REGISTERS), full, assume_unique=True)
        out[empty] = found[np.argmin(_order()[np.ix_(empty, full)], axis=1)]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Keys of the bands of many sketches: [n, REGISTERS] to [n, BANDS]."""
    parts = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = _mix(key * _M1 + parts[:, :, i])
    return key.view(np.int64)


def chance_equal(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The chance that two registers of unrelated sets of these sizes are equal: the sum, over values, of both having it."""
    a, b = (np.maximum(n / REGISTERS, 1e-3)[:, None] for n in (n_a, n_b))
    low = 0.5 ** np.arange(1, 54)[None, :]
    both = a * b / (a + b) * (np.exp(-(a + b) * low) - np.exp(-(a + b) * 2 * low)) / ((1 - np.exp(-a)) * (1 - np.exp(-b)))
    return np.minimum((both * low / (1 << MANTISSA)).sum(axis=1), 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches, [n, REGISTERS] each."""
    chance = chance_equal(n_a, n_b)
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def least_estimate(n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """What the estimate of a pair at the threshold hardly ever falls below. Small sets fill few buckets, so it varies more."""
    own = np.minimum(np.minimum(n_a, n_b) * 0.6, REGISTERS)
    return similarity - DEVIATIONS * np.sqrt(similarity * (1 - similarity) / np.maximum(own, 1))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _sketched(docs: DataFrame, words: int, sets: bool) -> DataFrame:
    """(id, n, fp, registers) of rows (id, text as binary), with the sets if wanted. fp: 128 bits, equal for equal sets."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                found = [shingle(t.as_py()) for t in batch.column(1)]
                columns = [
                    batch.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found], pa.binary()),
                    pa.array([sketch(x).tobytes() if len(x) else None for x in found], pa.binary()),
                ]
                if sets:
                    columns.append(pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "fp", "registers", "hashes"][: len(columns)])

    return docs.mapInArrow(run, f"id {kind}, n bigint, fp binary, registers binary" + ", hashes array<bigint>" * sets)


def _bands(classes: DataFrame) -> DataFrame:
    """(band, id, n): a row for each band of each class."""
    kind = dict(classes.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                again = pa.array(np.repeat(np.arange(len(batch)), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(_registers(batch.column(2))).reshape(-1)), batch.column(0).take(again), batch.column(1).take(again)], ["band", "id", "n"])

    return classes.select("id", "n", "registers").mapInArrow(run, f"band bigint, id {kind}, n bigint")


def _likely(pairs: DataFrame, kind: str, similarity: float) -> DataFrame:
    """Of (a, b, salt, n_a, n_b, r_a, r_b) the (a, b, salt) whose estimate is near the threshold or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 5000):
                a, b, salt, n_a, n_b, r_a, r_b = whole.slice(at, 5000).columns
                n_a, n_b = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (n_a, n_b))
                good = pa.array(estimate(_registers(r_a), _registers(r_b), n_a, n_b) >= least_estimate(n_a, n_b, similarity))
                yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good), salt.filter(good)], ["a", "b", "salt"])

    return pairs.mapInArrow(run, f"a {kind}, b {kind}, salt int")


def _confirmed(pairs: DataFrame, sets: DataFrame, kind: str, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, stored. An a with many pairs is salted, so that they meet in several tasks.

    A pair may be found twice if an id is repeated."""
    share = round(100 * similarity)
    pairs = held(pairs.distinct())
    salts = held(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_PAIRS).cast("int").alias("salts")))
    heads = small(salts)
    dealt = pairs.join(heads, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")

    def both(dealt: DataFrame, column: str) -> DataFrame:
        """dealt (a, b, salt) with n and the column of a and of b. What can be broadcast leaves the sets where they lie until they meet."""
        own = sets.select("id", "n", F.col(column).alias("x"))
        left = own.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("x").alias("x_a")).join(heads, "a")
        left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        right = own.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("x").alias("x_b")).join(small(dealt), "b")
        return right.join(left, ["a", "salt"]).filter(100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b"))

    made = [pairs, salts]
    if pairs.count() > BROADCAST_ROWS:
        dealt = stored(_likely(both(dealt, "registers").select("a", "b", "salt", "n_a", "n_b", "x_a", "x_b"), kind, similarity), "likely")
        made.append(dealt)
    common = F.size(F.array_intersect("x_a", "x_b"))
    out = stored(both(dealt, "hashes").filter(100 * common >= share * (F.col("n_a") + F.col("n_b") - common)).select("a", "b"), "found")
    forget(*made)
    return out


def _links(docs: DataFrame, sketches: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, root) of the classes, named by their ids, that are linked."""
    kind = dict(classes.dtypes)["id"]
    shared = _bands(classes).groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("pivot")).filter("k > 1")
    members = stored(_bands(classes).join(shared, "band"), "members")
    wanted = held(members.select("id").distinct())
    text = docs.join(small(wanted), "id", "left_semi")
    # A repeated id has one set here for each of its texts; the sets of other ids stay where they are made.
    again = held(sketches.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id"))
    sets = _sketched(text.join(small(again), "id", "left_anti"), words, True).filter("n > 0")
    if not again.isEmpty():
        repeated = _sketched(text.join(small(again), "id", "left_semi"), words, True).filter("n > 0")
        sets = sets.unionByName(repeated.groupBy("id", "fp").agg(*(F.first(c).alias(c) for c in ("n", "registers", "hashes"))))
    sets = stored(sets, "sets")
    first = members.filter("id <> pivot")  # a repeated id may have sets of several sizes, so sizes are compared with the sets
    roots = components(_confirmed(first.select(F.col("pivot").alias("a"), F.col("id").alias("b")), sets, kind, similarity))

    def still_open(rows: DataFrame) -> DataFrame:
        """(band, id, n, k, root) of those rows whose band holds several components. Components only grow, so other bands are done."""
        rooted = rows.select("band", "id", "n", "k").join(small(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
        rooted = stored(rooted, "rooted")
        mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
        mixed = held(mixed)
        out = stored(rooted.join(small(mixed), "band"), "open")  # few bands: a large one's members stay where they are
        forget(rooted, mixed)
        return out

    def join_up(more: DataFrame) -> bool:
        """Joins the components that links connect; whether there are any."""
        nonlocal roots
        if more.isEmpty():
            return False
        roots = components(more.union(roots.select(F.col("root").alias("a"), F.col("id").alias("b"))))  # as links, roots connect what they did
        return True

    rest = still_open(members.filter("k > 2"))
    for round_ in range(PIVOTS):
        if rest.isEmpty():
            return roots
        tagged = _tagged(rest)
        if not _costly(tagged):
            break
        large = rest.filter(F.col("k") > FEW)
        of_band = F.min(F.struct(F.xxhash64("id", "band", F.lit(round_)).alias("h"), F.col("id").alias("p"), F.col("root").alias("p_root")))
        chosen = small(held(large.groupBy("band").agg(of_band.alias("x")).select("band", "x.p", "x.p_root")))
        pairs = large.join(chosen, "band").filter("root <> p_root").select(F.col("p").alias("a"), F.col("id").alias("b"))
        if not join_up(_confirmed(pairs, sets, kind, similarity)):
            break
        rest = still_open(rest)
    else:
        tagged = _tagged(rest)
    join_up(held(_across(tagged, sets, kind, similarity)))
    return roots


def _tagged(rest: DataFrame) -> DataFrame:
    """(main, id, root, n, out) of bands (band, id, n, root), held, with each band's main component, its largest. out: it lies outside that.

    Bands with the same main component are one."""
    main = rest.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("root").alias("main"))).alias("m")).select("band", "m.main")
    return held(rest.join(small(held(main)), "band").select("main", "id", "root", "n").distinct().withColumn("out", F.col("root") != F.col("main")))


def _costly(tagged: DataFrame) -> bool:
    """Whether blocks would compare more than BLOCK_PAIRS pairs a document."""
    outs = F.sum(F.col("out").cast("double")).alias("outs")
    found = tagged.groupBy("main").agg(F.count(F.lit(1)).alias("n"), outs).agg(F.sum("n").alias("n"), F.sum(F.col("outs") * F.col("n")).alias("pairs")).first()
    return (found["pairs"] or 0) > BLOCK_PAIRS * (found["n"] or 0)


def _across(tagged: DataFrame, sets: DataFrame, kind: str, similarity: float) -> DataFrame:
    """The links (a, b) across components in groups (main, id, root, n, out), from full sets, in blocks of bounded size.

    The documents outside a main component are compared with those in it and with each other. No pair is a row unless it is a link.
    """
    share = round(100 * similarity)
    # A block has so many documents or so many shingles, whichever makes more blocks; what fits one block is one.
    blocks = lambda flag: F.ceil(F.greatest(F.sum(F.when(flag, 1).otherwise(0)) / BLOCK, F.sum(F.when(flag, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    sizes = tagged.groupBy("main").agg(blocks(F.col("out")).alias("outs"), blocks(~F.col("out")).alias("ins"), blocks(F.lit(True)).alias("blocks"))
    sizes = sizes.withColumn("ins", F.when(F.col("blocks") > 1, F.col("ins")).otherwise(0))
    placed = tagged.join(small(held(sizes)), "main").withColumn("out", F.col("out") | (F.col("blocks") == 1))
    placed = placed.withColumn("at", F.when(F.col("out"), F.pmod(F.xxhash64("id"), F.col("outs"))).otherwise(F.col("outs") + F.pmod(F.xxhash64("id"), F.greatest("ins", F.lit(1)))).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("out"), F.col("outs") + F.col("ins")).otherwise(F.col("outs")) - 1)))
    dealt = dealt.select("id", "root", "main", "at", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    rows = sets.select("id", "hashes").join(small(held(dealt)), "id")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at", kind="stable")
        hashes, at = part["hashes"].to_list(), part["at"].to_numpy()
        a, b = np.flatnonzero(at == part["i"].iloc[0]), np.flatnonzero(at == part["j"].iloc[0])
        n = np.array([len(x) for x in hashes])
        known, which = np.unique(np.concatenate(hashes), return_inverse=True)
        row = np.repeat(np.arange(len(hashes)), n)
        common = np.zeros((len(a), len(b)), dtype=np.float32)
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(0, len(known) + TOKENS, TOKENS))
        for low, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            has = np.zeros((len(hashes), TOKENS), dtype=np.float32)
            has[row[order[x:y]], which[order[x:y]] - low * TOKENS] = 1
            common += has[a] @ has[b].T
        roots = part["root"].to_numpy()
        good = (100 * common >= share * (n[a][:, None] + n[b][None, :] - common)) & (roots[a][:, None] != roots[b][None, :])
        x, y = np.nonzero(good)
        ids = part["id"].to_numpy()
        return pd.DataFrame({"a": ids[a[x]], "b": ids[b[y]]})

    found = rows.groupBy("main", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, kept.

    Documents are linked if their sets of shingles have a Jaccard similarity of at least similarity; component_id is the
    smallest id of those reachable, kept whether it is the document's own. Without words or text a set is empty and
    linked with nothing; fewer words than a shingle has make one shingle. Rows that repeat an id are one node, linked if any of
    their texts is; of rows equal in id, all are kept or none. A null id is linked with nothing, and kept.
    Extra columns are not read.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    with scratch(docs.sparkSession) as keep:
        sketches = stored(_sketched(slim, words, False), "sketches")
        some = sketches.filter("id IS NOT NULL AND n > 0")
        classes = some.groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("rows"))
        classes = stored(classes, "classes")
        roots = _links(slim, sketches, classes, words, similarity)
        moved = classes.select("fp", "id", "rows").join(roots, "id", "left").filter("rows > 1 OR root IS NOT NULL")
        moved = stored(moved.select("fp", F.coalesce("root", "id").alias("component")), "moved")
        all_rows = stored(sketches.select("id", "n", F.when(F.col("id").isNotNull(), F.col("fp")).alias("fp")), "rows")  # without the registers
        keep(moved, all_rows)
    out = all_rows.join(small(moved), "fp", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns."""
    with scratch(docs.sparkSession) as keep:
        gone = stored(classify(docs, id_col, text_col, words, similarity).filter("NOT kept").select(id_col).distinct(), "gone")
        keep(gone)
    name = free_name(docs, "__gone")
    return docs.join(small(gone.toDF(name)), F.col(id_col) == F.col(name), "left_anti")
