"""Language identification, word first: known words are scored by each language's log frequency, unseen ones by the longest
known character n-grams at each of their places, from four characters down to one."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import small, stored

#: Rows of each language that are learned from, about so many at most: those of the smallest hashes of their id.
ROWS_PER_LANGUAGE = 3000
#: Counts below which a word or an n-gram isn't learned.
LEAST_WORDS, LEAST_GRAMS = 3, 5
ORDERS = (4, 3, 2, 1)
#: Words whose scores a worker remembers.
KNOWN_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with marks at both ends; the marks alone are none."""
    marked = f"\x02{word}\x03" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """counts: (language, order, gram, count), order 0 for words. Scores are log frequencies with add-half smoothing."""

    def __init__(self, counts: Sequence[tuple[str, int, str, int]]):
        self.languages = sorted({c[0] for c in counts})
        at = {lang: i for i, lang in enumerate(self.languages)}
        raw: list[dict[str, np.ndarray]] = [{} for _ in range(max(ORDERS) + 1)]
        for lang, order, gram, n in counts:
            raw[order].setdefault(gram, np.zeros(len(at)))[at[lang]] += n
        self.tables = []
        for table in raw:
            total = sum(table.values(), np.zeros(len(at))) + 0.5 * (len(table) + 1)
            self.tables.append({g: (np.log(v + 0.5) - np.log(total)).astype(np.float32) for g, v in table.items()})
        self.known: dict[str, int] = {}
        self.rows = np.zeros((KNOWN_WORDS + 1, len(at)), dtype=np.float32)

    def of_word(self, word: str) -> np.ndarray:
        """Log frequencies of a known word; else the mean over places of the longest known n-gram that starts there."""
        found = self.tables[0].get(word)
        if found is not None:
            return found
        marked = f"\x02{word}\x03"
        total, n = np.zeros(len(self.languages), dtype=np.float32), 0
        for i in range(len(marked)):
            for order in ORDERS:
                found = self.tables[order].get(marked[i : i + order]) if i + order <= len(marked) else None
                if found is not None:
                    total += found
                    n += 1
                    break
        return total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score). Nothing learned, null or no letter: ("und", 0). Ties go to the first language in order."""
        words = _WORD.findall((text or "").lower())
        # Fractions and other numbers that aren't digits stand in words too, but are no letters.
        if not self.languages or not any(any(map(str.isalpha, w)) for w in words):
            return "und", 0.0
        if len(self.known) + len(words) > KNOWN_WORDS:
            self.known.clear()
        if len(words) > KNOWN_WORDS:  # a text with more words than are remembered
            counts = Counter(words)
            total = sum((self.of_word(w) * n for w, n in counts.items()), np.zeros(len(self.languages)))
        else:
            for w in set(words).difference(self.known):
                self.rows[len(self.known)] = self.of_word(w)
                self.known[w] = len(self.known)
            total = self.rows[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0, dtype=np.float64)
        odds = total / len(words) * min(len(words), 20)
        p = np.exp(odds - odds.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def learnable(id_col: str = "doc_id") -> Column:
    """Whether a document is learned from: crc32 of its id as text, modulo 3, isn't 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from the rows of docs with a language: of each language about so many, by hash. Counts are made where the texts lie."""
    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = stored(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(small(sizes), "lang").filter(place * F.col("n") < rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(_WORD.findall((text or "").lower()))
            for lang, own in words.items():
                found: dict[int, Counter] = {n: Counter() for n in ORDERS}
                for w, n in own.items():
                    for order in ORDERS:
                        for g in grams(w, order):
                            found[order][g] += n
                for order, table in ((0, own), *found.items()):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(table), pa.string()), pa.array([order] * len(table), pa.int32()), pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], ["lang", "kind", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, kind int, gram string, n bigint").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    kept = counts.filter(F.col("n") >= F.when(F.col("kind") == 0, LEAST_WORDS).otherwise(LEAST_GRAMS))
    table = kept.toArrow()
    got = sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "kind", "gram", "n")), strict=True))
    found = {r[0] for r in got}
    # A language of too few words is learned from its single letters at least.
    rest = [r["lang"] for r in sizes.select("lang").collect() if r["lang"] not in found]
    return Model(got + [(lang, 1, "\x00", 1) for lang in rest])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, lang_pred, score from 0 to 1.

    Only the text is used, all of it. und with score 0 if it is null or has no letter, or if nothing was learned.
    Repeated rows give repeated rows; extra columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, [(list(t), np.stack(list(t.values())) if t else None) for t in model.tables]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(())
        own.languages = sent.value[0]
        own.tables = [dict(zip(names, rows, strict=True)) if names else {} for names, rows in sent.value[1]]
        own.rows = np.zeros((KNOWN_WORDS + 1, len(own.languages)), dtype=np.float32)
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")

