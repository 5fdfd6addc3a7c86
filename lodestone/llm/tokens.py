"""Encoding a whole corpus with a public byte-level BPE by reuse of content-defined chunks.

A rolling hash over the bytes cuts every text into small chunks at places that depend
on content only, so the same phrase in two documents gives the same chunks.  A chunk
is encoded once per Python worker and then found in a memo; no text is shuffled,
since moving a corpus costs more than encoding its distinct chunks once per worker.

Where a chunk is cut before a blank between two ASCII letters the tokenizer's own
pattern has a boundary for certain, so the join is exact as it stands.  A stretch
without such a place that is longer than ``LONG_CHUNK`` is cut at any character the
hash chooses; its joins are repaired by scanning again from before the join until
the boundaries agree with those the next chunk has by itself (`repaired_pieces`).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary of byte_bpe_50k lies if the caller names no other place.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: One of 2**MASK_BITS possible places is a cut; the hash sees HASH_WINDOW bytes.
MASK_BITS, HASH_WINDOW = 1, 4
#: Bytes beyond which a chunk without a certain boundary is cut anywhere.
LONG_CHUNK = 8192
#: Chunks and bytes that a worker's memo may hold before it starts afresh.
MEMO_CHUNKS, MEMO_BYTES = 400_000, 48 << 20
#: Bytes of text handled at once.
SLICE_BYTES = 4 << 20

_PRETOKEN = regex.compile(PATTERN)
_GEAR = ((np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def rolling_hash(data: np.ndarray, window: int = HASH_WINDOW) -> np.ndarray:
    """Gear hash of the ``window`` bytes that end at each place, by doubling."""
    h, width = _GEAR[data], 1
    while width < window:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h, width = h + shifted, width * 2
    return h


def certain_cuts(data: np.ndarray, bits: int = MASK_BITS) -> np.ndarray:
    """Places of content-defined cuts: a blank between ASCII letters whose preceding hash is zero under the mask."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data[1:-1] == 32) & _LETTER[data[2:]] & _LETTER[data[:-2]]) + 1
    mask = np.uint32(((1 << bits) - 1) << 20)
    return at[(rolling_hash(data)[at - 1] & mask) == 0]


def any_cuts(text: str, size: int = LONG_CHUNK) -> list[str]:
    """Cut a stretch at characters chosen by the hash, about every ``size // 2`` bytes, and at ``size`` at the latest."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts = (data & 0xC0) != 0x80
    mask = np.uint32((max(2, size // 2) - 1) << 8)
    chosen = np.flatnonzero(starts & ((rolling_hash(data, 16) & mask) == 0)) if len(data) else []
    pieces, last = [], 0
    for c in [*map(int, chosen), len(data)]:
        while c - last > size:
            forced = last + size
            while not starts[forced]:
                forced -= 1
            pieces.append((last, forced))
            last = forced
        if c > last:
            pieces.append((last, c))
            last = c
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in pieces]


def repaired_pieces(chunks: list[str]) -> list[str]:
    """The pattern's pieces of the joined chunks, from each chunk's own pieces.

    Only the last two pieces before a join can differ from those of the whole text (a
    contraction or a run of blanks may go on), so the scan starts there and stops as
    soon as it stands at a boundary that the next chunk has by itself.
    """
    out: list[str] = []
    for chunk in chunks:
        own = _PRETOKEN.findall(chunk)
        if not out:
            out = own
            continue
        tail = "".join(out[-2:])
        del out[-2:]
        text, at, place, k = tail + chunk, 0, -len(tail), 0
        start = 0
        while at < len(text):
            piece = _PRETOKEN.match(text, at).group()
            out.append(piece)
            at += len(piece)
            place += len(piece)
            while k < len(own) and start < place:
                start += len(own[k])
                k += 1
            if place >= 0 and start == place:
                out += own[k:]
                break
    return out


class ChunkEncoder:
    """Encodes texts; holds the memo of one Python worker."""

    _workers: dict[int, ChunkEncoder] = {}

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.wide = max(ranks.values()) > 0xFFFF
        self.code = np.uint32 if self.wide else np.uint16
        self.bpe = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[bytes, bytes] = {}
        self.held = 0

    @classmethod
    def of(cls, vocabulary: bytes) -> ChunkEncoder:
        key = hash(vocabulary)
        if key not in cls._workers:
            cls._workers[key] = cls(vocabulary)
        return cls._workers[key]

    def _encode(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if len(chunk) <= LONG_CHUNK:
            ids = self.bpe.encode_ordinary(text)
        else:
            ids = [i for piece in repaired_pieces(any_cuts(text)) for i in self.bpe.encode_ordinary(piece)]
        return np.array(ids, self.code).tobytes()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts; null and empty texts have no ids."""
        raw = [t.encode("utf-8") if t else b"" for t in texts]
        data = b"".join(raw)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        bounds = np.unique(np.concatenate([[0], ends, certain_cuts(np.frombuffer(data, np.uint8))]))
        places = bounds.tolist()
        chunks = [data[a:b] for a, b in zip(places, places[1:])]
        if self.held > MEMO_BYTES or len(self.memo) > MEMO_CHUNKS:
            self.memo.clear()
            self.held = 0
        memo = self.memo
        for c in set(chunks).difference(memo):
            memo[c] = ids = self._encode(c)
            self.held += len(c) + len(ids) + 120
        found = list(map(memo.__getitem__, chunks))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.code).itemsize
        upto = np.concatenate([[0], np.cumsum(sizes)])
        offsets = np.concatenate([[0], upto[np.searchsorted(bounds, ends)]]) if len(texts) else np.zeros(1, np.int64)
        return offsets, np.frombuffer(b"".join(found), self.code)


def _slices(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column in runs of about ``SLICE_BYTES``, so that memory doesn't follow the batch."""
    run: list[str | None] = []
    size = 0
    for text in column.to_pylist():
        run.append(text)
        size += len(text or "")
        if size >= SLICE_BYTES:
            yield run
            run, size = [], 0
    yield run


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    with open(os.path.realpath(path), "rb") as f:
        return f.read()


def encode_corpus(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens.

    Text that looks like a special token is ordinary text.  Empty and null texts give
    an empty list, a blank text the ids of its blanks.  Repeated rows are encoded each;
    rows with a null key are kept.  Other columns are not read.  The vocabulary (a fixed
    size, under 1 MB) is read on the driver and broadcast.
    """
    held = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(held.value)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                offsets, ids = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], [key, "ids"])
                at += len(texts)

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """``keep`` columns plus ``n_tokens``, by the same encoder; the ids never leave Python."""
    held = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(held.value)
        for batch in batches:
            sizes = [np.diff(encoder.encode(texts)[0]) for texts in _slices(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(sizes), pa.int64())], [*keep, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (documents.schema[k] for k in keep))
    return documents.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{fields}, n_tokens bigint")
