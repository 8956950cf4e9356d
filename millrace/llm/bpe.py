"""Byte-level BPE: encodes and decodes with the tokenizers library over Arrow batches.

The vocabulary is a file of ranks (base64 token, rank). Byte-level BPE works on characters that stand for bytes:
``BYTE_CHARS`` maps each byte to its character, and decoding reverses that table for the characters of each id's token. Ids may
end inside a character; their bytes are joined before anything is read as UTF-8.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import bound_batches

#: Characters of text that one call of the library gets, so that memory does not follow the size of a batch.
CALL_CHARS = 1 << 20
#: Distinct pieces whose ids a worker remembers; it forgets all when there are more.
KNOWN_PIECES = 400_000


def _byte_chars() -> list[str]:
    """Printable Latin-1 characters stand for themselves, the other bytes for characters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


BYTE_CHARS = _byte_chars()
#: For str.translate(): of bytes read as Latin-1, and back.
TO_CHARS = dict(enumerate(BYTE_CHARS))
FROM_CHARS = {ord(c): b for b, c in enumerate(BYTE_CHARS)}


def to_chars(data: bytes) -> str:
    """The characters that stand for bytes."""
    return data.decode("latin-1").translate(TO_CHARS)


def from_chars(chars: str) -> bytes:
    """The bytes that characters stand for: the byte table reversed."""
    return chars.translate(FROM_CHARS).encode("latin-1")


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def decoder(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of each id, from the vocabulary's tokens, which are characters that stand for bytes."""
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for chars, i in vocab.items():
        out[i] = from_chars(chars)
    return out


class Bpe:
    """Encoder and decoder for a set of ranks and the pattern that splits a text before the merges.

    The pattern's matches are merged by the library once each and remembered: most pieces of a corpus come again.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import models

        as_chars = {t: to_chars(t) for t in ranks}
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            # Any pair whose bytes make a token may merge, at that token's rank.
            merges += [(as_chars[token[:i]], as_chars[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        vocab = {as_chars[t]: r for t, r in ranks.items()}
        self.tokenize = models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0).tokenize
        # \s of the rank files' patterns is Unicode's White_Space, in and outside brackets.
        self.split = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"), regex.V0).findall
        self.known: dict[str, bytes] = {}
        self.bytes_of = decoder(vocab)
        self.lengths = np.array([len(t) for t in self.bytes_of], dtype=np.int64)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        known = self.known
        if len(known) > KNOWN_PIECES:
            known.clear()
        for piece in {p for pieces in split for p in pieces}.difference(known):
            known[piece] = np.array([t.id for t in self.tokenize(to_chars(piece.encode()))], dtype="<u4").tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), dtype="<u4") for pieces in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: np.ndarray | list[int]) -> np.ndarray:
        """For each id the code points [start, end) of text that it touches; a split character belongs to all its ids."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1  # by byte
        ends = np.cumsum(self.lengths[np.asarray(ids, dtype=np.int64)])
        if not len(ends):
            return np.zeros((0, 2), dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        return np.stack([char_of[starts], char_of[ends - 1] + 1], axis=1)


@functools.lru_cache(maxsize=2)
def _bpe(data: bytes, pattern: str) -> Bpe:
    return Bpe(read_ranks(data), pattern)


def _calls(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= CALL_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, offsets: bool = False
) -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, ids_sha256, decoded_sha256, offsets_sha256 and, if wanted, ids and offsets.

    ranks is the content of a rank file. Every whole text is encoded, null as the empty text, without special tokens;
    the ids are decoded again for decoded_sha256. ids_sha256 is that of the ids as little-endian 32-bit integers.
    offsets are (start, end) code points of each id; offsets_sha256 is that of their little-endian 32-bit integers. Repeated rows give repeated rows. Extra columns are not read.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kinds = dict(docs.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, offsets_sha256 string"
    schema += ", ids array<int>" * ids + ", offsets array<struct<start:int,end:int>>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(sent.value, pattern)
        for batch in batches:
            done = 0
            for texts in _calls([t or "" for t in batch.column(1).to_pylist()]):
                count, of_ids, of_text, of_spans, all_ids, spans = [], [], [], [], [], []
                for text, found in zip(texts, bpe.encode_batch(texts), strict=True):
                    count.append(len(found))
                    of_ids.append(hashlib.sha256(found.tobytes()).hexdigest())
                    of_text.append(hashlib.sha256(bpe.decode(found.tolist())).hexdigest())
                    places = bpe.offsets(text, found).astype("<i4")
                    of_spans.append(hashlib.sha256(places.tobytes()).hexdigest())
                    if ids:
                        all_ids.append(found.astype(np.int32))
                    if offsets:
                        spans.append([{"start": a, "end": b} for a, b in places.tolist()])
                columns = [batch.column(0).slice(done, len(texts)), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), pa.array(of_spans, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"]
                if ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                if offsets:
                    columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                    names.append("offsets")
                yield pa.RecordBatch.from_arrays(columns, names)
                done += len(texts)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, data, text): the bytes of each row's ids, and they as UTF-8 with U+FFFD for broken characters. Null ids: no bytes."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder({to_chars(t): r for t, r in read_ranks(sent.value).items()})
        for batch in batches:
            data = [b"".join(map(table.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in data], pa.string())], [id_col, "data", "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, data binary, text string")
