"""Line dedup with two Bloom filters.

One pass fills a filter of line hashes seen once and one of those seen twice. A second
pass shuffles only lines that the second filter suspects, counted map-side, for exact
confirmation; a third drops them.
"""

from __future__ import annotations

import hashlib
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import BROADCAST_ROWS, ship, table, text_or_empty

MIN_DOCS = 10
#: Line counts are gathered map-side for at most so many keys at once.
_HELD_KEYS = 100_000


def keys_of(text: str) -> list[bytes]:
    r"""Keys of a text's lines: without [\x20\x09-\x0D] at both ends, A-Z lower-cased."""
    return [line.strip() for line in text.encode().lower().split(b"\n")]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _doc_keys(text: str, least: int) -> set[bytes]:
    return {k for k in keys_of(text) if k and (least <= 1 or len(k.decode()) >= least)}


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = 1) -> DataFrame:
    """(key binary, n_docs, first_doc): digests of keys in at least min_docs (2 or more)
    documents, and the smallest doc_id among these. docs has doc_id and text."""
    return _confirmed(docs, min_docs, least)[0]


def _confirmed(docs: DataFrame, min_docs: int, least: int) -> tuple[DataFrame, Broadcast, int]:
    """repeated_lines, the filter of lines seen twice, and the number of all lines."""
    spark = docs.sparkSession
    ship(spark)
    if min_docs < 2:
        raise ValueError("min_docs must be 2 at least")
    n_lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = bloom.bits_for(n_lines)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = bloom.OnceTwice(bits)
        for b in batches:
            held: list[bytes] = []
            for text in b.column(0):
                held += _doc_keys(text.as_py(), least)  # of each document once
                if len(held) > _HELD_KEYS:
                    filters.add(_hashes(held))
                    held = []
            filters.add(_hashes(held))
        yield from bloom.as_batches(filters)

    twice = spark.sparkContext.broadcast(bloom.twice_filter(docs.select("text").mapInArrow(fill, bloom.SLICES), bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            keys, seen = list(counts), list(counts.values())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([n for n, _ in seen], pa.int64()), pa.array([d for _, d in seen], pa.int64())], ["key", "n_docs", "first_doc"])

        filt = twice.value
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys = list(_doc_keys(text.as_py(), least))
                for i in np.flatnonzero(bloom.has(filt, _hashes(keys))):
                    k = digest(keys[i])
                    if k in counts:
                        counts[k][0] += 1
                        if doc_id is not None and (counts[k][1] is None or doc_id < counts[k][1]):
                            counts[k][1] = doc_id
                    else:
                        counts[k] = [1, doc_id]
            if len(counts) > _HELD_KEYS:
                yield out()
                counts.clear()
        yield out()

    found = docs.select("doc_id", "text").mapInArrow(suspects, "key binary, n_docs long, first_doc long")
    bad = table(found.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc")).filter(F.col("n_docs") >= min_docs), "lines")
    return bad, twice, n_lines


_OUT = "doc_id long, n_lines long, n_dropped long, kept string"


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = 1, keep: str = "none", held_rows: int = BROADCAST_ROWS) -> DataFrame:
    r"""(doc_id, n_lines, n_dropped, kept): whole texts split at \n, without the lines
    whose key is in at least `min_docs` documents, each line of a key's first occurrence
    (smallest doc_id, first line) excepted if keep is "first".

    Keys have at least `least` code points; empty lines always stay. Null and empty texts
    are one empty line. Rows with a null or repeated doc_id count as documents of their
    own; with keep="first", rows repeating the first doc_id all keep the line. Up to
    `held_rows` dropped keys are broadcast. If there are more, those in the most documents are,
    still at most so many; of the others each text's own are found by a shuffle of its
    suspects, in which no key has more than lines / held_rows rows, and joined to it by the
    text's digest."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    bad, twice, n_lines = _confirmed(docs, min_docs, least)

    def cut(doc_id, text: str, first_of: dict[bytes, int]) -> tuple[int, int, str]:
        lines, keys = text.split("\n"), keys_of(text)
        kept, had = [], set()
        for line, key in zip(lines, keys, strict=True):
            d = digest(key) if key else None
            if d in first_of:
                if keep != "first" or first_of[d] != doc_id or d in had:
                    continue
                had.add(d)
            kept.append(line)
        return len(lines), len(lines) - len(kept), "\n".join(kept)

    def batch(ids: list, done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    if bad.count() <= held_rows:
        held = spark.sparkContext.broadcast({bytes(r["key"]): r["first_doc"] for r in bad.select("key", "first_doc").toLocalIterator()})

        def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                yield batch(ids, [cut(i, t.as_py(), held.value) for i, t in zip(ids, b.column(1), strict=True)])

        return docs.mapInArrow(small, _OUT)

    at = n_lines // max(1, held_rows) + 1  # fewer than held_rows keys are in more documents
    often = spark.sparkContext.broadcast({bytes(r["key"]): r["first_doc"] for r in bad.filter(F.col("n_docs") > at).select("key", "first_doc").toLocalIterator()})

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                keys = list(_doc_keys(text, least))
                found = [digest(keys[i]) for i in np.flatnonzero(bloom.has(twice.value, _hashes(keys)))]
                found = [k for k in found if k not in often.value]
                if found:
                    td = hashlib.sha256(text.encode()).digest()
                    yield pa.RecordBatch.from_arrays([pa.array([td] * len(found), pa.binary()), pa.array(found, pa.binary())], ["td", "key"])

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            own = [{bytes(x["key"]): x["first_doc"] for x in v or ()} for v in b.column(2).to_pylist()]
            yield batch(ids, [cut(i, t.as_py(), ChainMap(o, often.value)) for i, t, o in zip(ids, b.column(1), own, strict=True)])

    pairs = docs.select("text").mapInArrow(own_keys, "td binary, key binary").distinct().join(bad.filter(F.col("n_docs") <= at), "key")
    by_text = pairs.groupBy("td").agg(F.collect_list(F.struct("key", "first_doc")).alias("own"))
    marked = docs.withColumn("td", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    return marked.join(by_text.hint("merge"), "td", "left").select("doc_id", "text", "own").mapInArrow(large, _OUT)


def op6(docs: DataFrame) -> DataFrame:
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
