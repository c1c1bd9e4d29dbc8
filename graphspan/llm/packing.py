"""Harmonic packing of token sequences.

Lengths fall into classes by the reciprocal of the capacity: class k holds what is
longer than capacity / (k + 1) and at most capacity / k, and a bin of class k takes
just k items. Since documents may be cut, a document gives full sequences first; its
rest gives pieces as long as the slot of a class (capacity // k), at most `cuts` of
them, and a last piece in the class that fits it best. Each worker fills its own bins;
bins still open at its end are joined and cut into full sequences, and the last tokens
into lengths that are powers of two, which need no padding. Apart from the open bins
(under `capacity` pieces) nothing is held in memory, and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty
from .tokens import encoder

CAPACITY = 1024
#: Exact cuts of a document's rest before its last piece.
CUTS = 2
#: Slots whose full bin leaves more than this share empty are not cut to.
WASTE = 1 / 128


def cut_lengths(capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Slot lengths, descending, whose full bins are (nearly) full."""
    slots = {capacity // k: capacity - k * (capacity // k) for k in range(2, capacity + 1)}
    return sorted((s for s, w in slots.items() if w <= waste * capacity), reverse=True)


def pieces(n: int, capacity: int, cuts: int, slots: list[int]) -> Iterator[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens; class 1 fills a sequence."""
    for _ in range(n // capacity):
        yield capacity, 1
    n %= capacity
    for _ in range(cuts):
        best = capacity // max(1, capacity // n) if n else 0
        if not n or best - n <= capacity // (64 * max(1, capacity // n)):
            break  # it nearly fills a slot of its class
        s = next((s for s in slots if s <= n), 0)
        if not s:
            break
        yield s, capacity // s
        n -= s
    if n:
        yield n, capacity // n


class Harmonic:
    """Bins of one worker. `place` returns the pieces that have got their place: (document,
    ids, start, length, sequence, offset). An open bin holds its pieces' own ids only."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, cuts: int = CUTS):
        self.next, self.capacity, self.cuts, self.slots = first_id, capacity, cuts, cut_lengths(capacity)
        self.open: dict[int, list[tuple]] = {}

    def _close(self, items: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for doc, ids, start, length in items:
            out.append((doc, ids, start, length, self.next, at))
            at += length
        self.next += 1
        return out

    def place(self, doc, ids: np.ndarray) -> list[tuple]:
        out, start = [], 0
        for length, k in pieces(len(ids), self.capacity, self.cuts, self.slots):
            part = ids[start : start + length]
            if k == 1:
                out += self._close([(doc, part, start, length)])
            else:
                items = self.open.setdefault(k, [])
                items.append((doc, part.copy(), start, length))
                if len(items) == k:
                    out += self._close(self.open.pop(k))
            start += length
        return out

    def finish(self) -> list[tuple]:
        rest = [x for k in sorted(self.open) for x in self.open[k]]
        self.open = {}
        left, out = sum(x[3] for x in rest), []
        sizes = [self.capacity] * (left // self.capacity)
        left %= self.capacity
        sizes += [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
        rest.reverse()
        for size in sizes:
            items = []
            while size:
                doc, ids, start, length = rest.pop()
                take = min(size, length)
                items.append((doc, ids[:take], start, take))
                size -= take
                if take < length:
                    rest.append((doc, ids[take:], start + take, length - take))
            out += self._close(items)
        return out


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, cuts: int = CUTS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and the piece's ids if asked for.

    A document is its text's ids, then end_id; a null or empty text is end_id alone. Rows
    with a null or repeated doc_id are documents of their own. An empty table gives no
    piece. A sequence's number is made of the partition's and a counter; it is the same
    when a task runs again. `capacity` is best a power of two."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        bins = Harmonic((TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, capacity, cuts)
        end = np.array([end_id], dtype="<u4")

        def rows(placed: Iterable[tuple]) -> pa.RecordBatch:
            d, start, length, crc, total, seq, offset, ids = [], [], [], [], [], [], [], []
            for (doc_id, n_tokens), part, s, n, q, o in placed:
                d.append(doc_id), start.append(s), length.append(n), crc.append(zlib.crc32(part.tobytes()))
                total.append(n_tokens), seq.append(q), offset.append(o)
                if with_ids:
                    ids.append(part.astype("i4"))
            cols = [pa.array(x, pa.int64()) for x in (d, start, length, crc, total, seq, offset)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names + ["ids"] * with_ids)

        for b in batches:
            placed: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist()), strict=True):
                placed += bins.place((doc_id, len(ids) + 1), np.append(ids, end))
                if len(placed) > 20_000:
                    yield rows(placed)
                    placed = []
            yield rows(placed)
        yield rows(bins.finish())

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def op8(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    import public_tokenizers as tokenizers_files

    return pack(docs, tokenizers_files.path("byte_bpe_50k.json"), tokenizers_files.PATTERN, with_ids=with_ids)
