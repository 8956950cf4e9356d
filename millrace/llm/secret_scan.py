"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

A candidate token is called a secret when the log-likelihood ratio of the two models, per character, is over a threshold in some window
of the token; so a key joined to an ordinary name is found too. The models are trained from labelled samples: keys that the fixed
patterns find in a corpus and generated ones are random, identifiers put together of the corpus's own words are ordinary, as are the dates and
numbers that stand in such names. The threshold comes from samples that the models haven't seen.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import scratch, stored

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = re.compile(_ASSIGN, re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so these are the runs of 24 or more
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: Tokens that the models judge.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: What a text has at least if a scan finds anything; for RE2, which reads it once without going back.
_MAYBE = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}", r"[A-Za-z0-9+/_=-]{20}")

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_AT = {c: i for i, c in enumerate(_ALPHABET)}
#: Vowels, consonants, those in capitals, digits, signs.
_CLASS = np.array([(not c.islower() and 2) + (c.lower() not in "aeiouy") if c.isalpha() else 4 if c.isdigit() else 5 for c in _ALPHABET])
#: Transitions for which a class counts beside those seen.
BACK_OFF = 100
#: Documents that are learned from, about so many: those of the smallest hashes of their id. Of what they have, so many common words and
#: found keys at most.
SAMPLE_ROWS, LEARNT_WORDS, LEARNT_KEYS = 20_000, 4000, 2000
#: Transitions of a window, the least that a token has; errors that an ordinary sample called random counts for.
WINDOW, ORDINARY_WEIGHT = 19, 5
#: Words of identifiers, which stand beside those of the corpus.
_PARTS = (
    "get set user name value index count list item node data file path read write open close create delete update insert select table column row "
    "query result error message request response server client config option default buffer stream input output string number format parse print "
    "event handler listener callback service manager factory builder context session state store cache queue stack tree graph edge vertex point "
    "size length width height color image text label button window panel view model controller action filter search sort merge split join group"
).split()
_WORD = re.compile(r"(?<![^\W\d_])[A-Za-z]{3,12}(?![^\W\d_])")


def labelled_samples(n: int = 4000, seed: int = 7, words: Sequence[str] = (), keys: Sequence[str] = ()) -> list[tuple[str, bool]]:
    """(string, whether it is random), n of each: strings over the alphabets of keys, half of them from keys if there are so many; identifiers
    of words, half of them from `words`, with numbers, dates, and some rules of one character."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", _ALPHABET[:62], _ALPHABET[:64], _ALPHABET[26:62], "abcdefghijklmnopqrstuvwxyz0123456789")
    keys = rng.sample(list(keys), min(len(keys), n // 2))
    out = [(k, True) for k in keys] + [("".join(rng.choices(rng.choice(alphabets), k=rng.randrange(20, 65))), True) for _ in range(n - len(keys))]
    words = list(words) or _PARTS
    for _ in range(n):
        parts = rng.choices(rng.choice((words, _PARTS)), k=rng.randrange(3, 7))
        style = rng.randrange(6)
        if style == 0:
            s = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 1:
            s = "".join(p.title() for p in parts)
        elif style == 5:
            s = "_".join(parts).upper()
        else:
            s = ("_", "-", "/", "")[style - 2 if style < 5 else 0].join(parts)
        kind = rng.random()
        if kind < 0.03:  # a rule or filler
            s = rng.choice("-=_/+xXaA0") * rng.randrange(20, 80)
        elif kind < 0.07:
            date = f"{rng.randrange(1970, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
            s = rng.choice((f"{date}T{rng.randrange(24):02d}-{rng.randrange(60):02d}-{rng.randrange(60):02d}-{rng.randrange(1000):03d}Z", f"{date}_{date}", f"{s}_{date}", f"{date}/{s}"))
        elif kind < 0.10:
            s = "-".join(str(rng.randrange(1, 10**6)) for _ in range(rng.randrange(3, 7)))
        elif kind < 0.35:
            s += rng.choice(("_", "-", "")) + str(rng.randrange(0, 3000))
        if len(s) < WINDOW + 1:
            s += "_" + "_".join(rng.choices(words, k=6))
        out.append((s, False))
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, seed: int = 7) -> Markov:
    """Models from about so many documents: words and keys are found where the texts lie, and only their counts are brought together.
    Documents without any leave the words of identifiers and generated keys. The same rows give the same models."""
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bool, Counter] = {False: Counter(), True: Counter()}
            for text in batch.column(0).to_pylist():
                found[False].update(w.lower() for w in _WORD.findall(text or ""))
                found[True].update(t for t in fixed_keys(text or "") if WINDOW < len(t) <= 200)
            for key, table in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(table), pa.bool_()), pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], ["key", "word", "n"])

    with scratch(docs.sparkSession):
        n = docs.count()
        counts = docs.filter(place * n < rows).select(text_col).mapInArrow(run, "key boolean, word string, n bigint")
        counts = stored(counts.groupBy("key", "word").agg(F.sum("n").alias("n")), "counts")
        words = [r["word"] for r in counts.filter("NOT key AND n > 1").orderBy(F.desc("n"), "word").limit(LEARNT_WORDS).collect()]
        keys = [r["word"] for r in counts.filter("key").orderBy(F.xxhash64("word"), "word").limit(LEARNT_KEYS).collect()]
    return train(labelled_samples(seed=seed, words=words, keys=keys), labelled_samples(seed=seed + 1, words=words, keys=keys))


def fixed_keys(text: str) -> list[str]:
    """Values of the fixed patterns, as far as they have letters and digits."""
    values = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) > WINDOW] + [m[0] for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS] + HEX.findall(text)
    return [v for v in values if set(v) <= _AT.keys() and any(map(str.isdigit, v)) and any(map(str.isalpha, v))]


@dataclass(frozen=True)
class Markov:
    """Log ratios of the chance of a character after another: random over ordinary; threshold per character."""

    ratio: np.ndarray
    threshold: float

    def score(self, token: str) -> float:
        """The mean of the ratio in the window of the token where it is highest."""
        codes = np.fromiter((_AT[c] for c in token), dtype=np.int64, count=len(token))
        if len(codes) < 2:
            return 0.0
        sums = np.concatenate([[0.0], np.cumsum(self.ratio[codes[:-1], codes[1:]])])
        k = min(WINDOW, len(sums) - 1)
        return float((sums[k:] - sums[:-k]).max() / k)


def _transitions(counts: np.ndarray) -> np.ndarray:
    """Chances of a character after another. Pairs seen rarely lean on how often the classes of characters (vowels, consonants,
    capitals, digits, signs) follow each other, and on the character's share of its class."""
    member = (_CLASS[:, None] == np.arange(_CLASS.max() + 1)[None, :]).astype(float)
    after = member.T @ counts @ member + 1
    after /= after.sum(axis=1, keepdims=True)
    own = counts.sum(axis=0) + 1
    own /= (own @ member)[_CLASS]
    back_off = after[_CLASS][:, _CLASS] * own[None, :]
    return (counts + BACK_OFF * back_off) / (counts.sum(axis=1, keepdims=True) + BACK_OFF)


def train(samples: Sequence[tuple[str, bool]], more: Sequence[tuple[str, bool]]) -> Markov:
    """Transition models of samples, which back off to classes; the threshold is where they tell more samples apart with the least
    weight of errors."""
    counts = np.zeros((2, len(_AT), len(_AT)))
    for text, label in samples:
        codes = [_AT[c] for c in text]
        np.add.at(counts[int(label)], (codes[:-1], codes[1:]), 1)
    logs = np.log(np.stack([_transitions(c) for c in counts]))
    model = Markov(logs[1] - logs[0], 0.0)
    scores = sorted((model.score(t), label) for t, label in more)
    # Of all places between neighbours, that with the fewest errors; the middle of them if there are several.
    wrong, errors = ORDINARY_WEIGHT * sum(not label for _, label in scores), []
    for i in range(len(scores) + 1):
        errors.append(wrong)
        if i < len(scores):
            wrong += 1 if scores[i][1] else -ORDINARY_WEIGHT
    best = [i for i, e in enumerate(errors) if e == min(errors)]
    low, high = scores[max(best[0] - 1, 0)][0], scores[min(best[-1], len(scores) - 1)][0]
    return Markov(model.ratio, (low + high) / 2)


def find(text: str, model: Markov) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind. A model's span isn't added where a fixed pattern has one."""
    base = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    base += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    base += [(*m.span(), "hex") for m in HEX.finditer(text)]
    more = []
    for m in CANDIDATE.finditer(text):
        if model.score(m[0]) > model.threshold and not any(a < m.end() and m.start() < b for a, b, _ in base):
            more.append((*m.span(), "markov"))
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, model: Markov | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    Whole texts are read, null as empty. spans are kind:start:end, joined by commas, in code points, the end exclusive;
    base_sha256 is the hash of those of the fixed patterns alone. Without a model one is learned from the documents. Repeated rows give repeated rows; extra columns are not read.
    """
    model = model or learn(docs, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            maybe = pa.array([False] * len(batch))
            for pattern in _MAYBE:
                maybe = pc.or_(maybe, pc.fill_null(pc.match_substring_regex(texts, pattern), False))
            counts = {k: np.zeros(len(batch), dtype=np.int64) for k in KINDS}
            digests, spans = [nothing] * len(batch), [""] * len(batch)
            for i in np.flatnonzero(maybe.to_numpy(zero_copy_only=False)):
                found = find(texts[int(i)].as_py(), model)
                for *_, k in found:
                    counts[k][i] += 1
                digests[i] = hashlib.sha256(_joined([s for s in found if s[2] != "markov"]).encode()).hexdigest()
                spans[i] = _joined(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k]) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = f"`{id_col}` {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
