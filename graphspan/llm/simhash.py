"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints that differ in at most `most` bits agree, once their 64 bits are cut into
`most` + 2 blocks, on two blocks at least. Those two blocks, a masked pattern shared by
all its members, are the key by which distinct fingerprints are dealt to tasks: the
index's uppermost nodes. Under a key, fingerprints sorted by Gray rank form the index's
lower nodes (gray_index.py), and only links that span each cluster leave the task. Keys
that too many fingerprints share are split by further masked patterns of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import free_name, last_table, maybe_broadcast, ship, table, tables_made, text_or_empty
from .components import components, with_least
from .gray_index import gray_rank, run_links
from .substring_dedup import mixed

SEED = 42
MOST = 4
#: Keys with more fingerprints than this are split once more.
HOT_KEY = 20_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = 4) -> int:
    """64 bits by majority over the XXH64 (seed 42) of all shingles of `size` words, repeats
    included. Words are runs outside [\\x20\\x09-\\x0D], A-Z lower-cased. Fewer words are one
    shingle; no words give 0."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    n = len(words) - size + 1
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        bits = np.unpackbits(h[i : i + 4096].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 4) -> DataFrame:
    """(doc_id, fp long: the 64 bits) of every row, whole texts; null counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n nearly equal blocks of the given bits."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(fp: Column, masks: list[int]) -> Column:
    """One struct (which pair of blocks, their masked pattern) for each pair."""
    pairs = [_signed(a | b) for a, b in combinations(masks, 2)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), fp.bitwiseAND(F.lit(m).cast("long")).alias("pattern")) for i, m in enumerate(pairs)]))


def links(distinct: DataFrame, most: int = MOST, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b): links between the distinct fingerprints (fp) that join exactly those which
    chains of at most `most` differing bits join."""
    n_blocks = most + 2
    masks = blocks(list(range(64)), n_blocks)
    keyed = distinct.select("fp", _keys(F.col("fp"), masks).alias("k")).select("fp", F.col("k.pair").alias("pair"), F.col("k.pattern").alias("pattern"), F.lit(-1).alias("pair2"), F.lit(0).cast("long").alias("pattern2"))
    hot = table(keyed.groupBy("pair", "pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_key).drop("n"), "hotkeys")
    # at most 15 * fingerprints / hot_key keys, each known by 12 bytes
    if hot.count():
        again = keyed.drop("pair2", "pattern2").join(hot, ["pair", "pattern"], "left_semi")
        parts = None
        for i, (x, y) in enumerate(combinations(range(n_blocks), 2)):
            rest = [b for b in range(64) if not (masks[x] | masks[y]) >> b & 1]
            own = again.filter(F.col("pair") == i).select("fp", "pair", "pattern", _keys(F.col("fp"), blocks(rest, n_blocks)).alias("k"))
            own = own.select("fp", "pair", "pattern", F.col("k.pair").alias("pair2"), F.col("k.pattern").alias("pattern2"))
            parts = own if parts is None else parts.unionByName(own)
        keyed = keyed.join(hot, ["pair", "pattern"], "left_anti").select("fp", "pair", "pattern", "pair2", "pattern2").unionByName(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def cols(b: pa.RecordBatch) -> np.ndarray:
            return np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])

        def done(part: np.ndarray) -> pa.RecordBatch:
            new = np.ones(part.shape[1], bool)
            new[1:] = (part[1:, 1:] != part[1:, :-1]).any(axis=0)
            starts = np.flatnonzero(new)
            fp = part[0].view(np.uint64)
            # keys held by one fingerprint have no link
            alone = np.append(starts[1:], len(fp)) - starts == 1
            keep = np.ones(len(fp), bool)
            keep[starts[alone]] = False
            number = np.cumsum(new)[keep]
            fp = fp[keep]
            starts = np.flatnonzero(np.diff(number, prepend=-1) != 0)
            order = np.lexsort((gray_rank(fp), number))
            a, b = run_links(fp[order], starts, most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for b in batches:
            now = cols(b)
            if not now.shape[1]:
                continue
            # the last key may go on in the next batch
            last = np.flatnonzero((now[1:] != now[1:, -1:]).any(axis=0))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield done(np.concatenate([*held, now[:, :cut]], axis=1))
                held = [now[:, cut:]]
            elif held and (held[-1][1:, -1] != now[1:, 0]).any():
                yield done(np.concatenate(held, axis=1))
                held = [now]
            else:
                held.append(now)
        if held:
            yield done(np.concatenate(held, axis=1))

    key = ["pair", "pattern", "pair2", "pattern2"]
    dealt = keyed.select("fp", *key).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", most: int = MOST, size: int = 4, hot_key: int = HOT_KEY) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id that chains of
    fingerprints with at most `most` differing bits reach.

    Equal fingerprints are one node, so copies are never paired. Texts without words
    have fingerprint zero, linked like any other; null counts as empty. A null doc_id is
    never the smallest unless it is alone with others of its kind (then null). Repeated
    rows stay. An empty table gives an empty result."""
    fps = table(fingerprints(docs, text, id_col, size), "fingerprints")
    made = len(tables_made(docs.sparkSession))
    distinct = table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(links(distinct.select("fp"), most, hot_key))
    linked = table(linked.join(distinct, linked["node"] == distinct["fp"]).select("node", "root", "least"), "linked")
    of_fp = with_least(linked, "root", "least", "comp", linked.count()).select(F.col("node").alias("fp"), "comp")
    found = last_table(distinct.join(of_fp.hint("merge"), "fp", "left").select("fp", F.coalesce("comp", "least").alias("component_id")), "classes", made)
    return fps.join(found.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op4(docs: DataFrame) -> DataFrame:
    d = near_dedup(docs)
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str, size: int) -> set[int]:
    """XXH64 of the distinct shingles, as words and shingles are for fingerprint()."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return set()
    return {xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))}


#: Bands of min-hashes by which possible copies meet, and min-hashes in each: texts of a
#: similarity of 0.8 share no band with a chance of (1 - 0.8 ** 4) ** 16 = 0.02 %.
BANDS, BAND_ROWS = 16, 4


def _shingle_array(text: str, words: int) -> np.ndarray:
    found = shingle_hashes(text, words)
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One long for each band of min-hashes of a set."""
    n = BANDS * BAND_ROWS
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flip, factor = seeds[:n], seeds[n:] | np.uint64(1)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[i : i + 1024, None] ^ flip) * factor).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        key = mixed(key * factor[0] + mixed(row))
    return key.view(np.int64)


def buckets(docs: DataFrame, words: int) -> DataFrame:
    """(bucket, doc_id) of the bands of each row's set of `words`-word shingles."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [bands(_shingle_array(t.as_py(), words)) for t in b.column(1)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["bucket", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "bucket long, doc_id long")


def _compared(dealt: DataFrame, words: int, similarity: float) -> DataFrame:
    """(bucket, doc_id, keep_id) of texts sorted by bucket, salt and id: each is held against
    those of its bucket and salt that resemble none before them. keep_id is the first that
    it resembles, or null if it is such a one itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, []
        for b in batches:
            keeps = []
            for bucket, salt, doc_id, text in zip(*b.columns, strict=True):
                if (now := (bucket.as_py(), salt.as_py())) != at:
                    at, kept = now, []
                own, doc_id, keep = _shingle_array(text.as_py(), words), doc_id.as_py(), None
                for other_id, other in kept:
                    small, large = sorted((own, other), key=len)
                    if other_id == doc_id or len(small) < similarity * len(large):
                        continue
                    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                    if both >= similarity * (len(small) + len(large) - both):
                        keep = other_id
                        break
                else:
                    kept.append((doc_id, own))
                keeps.append(keep)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keeps, pa.int64())], ["bucket", "doc_id", "keep_id"])

    return dealt.select("bucket", "salt", "doc_id", "text").mapInArrow(run, "bucket long, doc_id long, keep_id long")


def confirmed_links(docs: DataFrame, most: int = MOST, size: int = 4, words: int = 5, similarity: float = 0.8, per_task: int = 500) -> DataFrame:
    """(doc_id, keep_id): links between documents whose sets of `words`-word shingles have a
    Jaccard similarity of at least `similarity`, computed exactly; see confirmed_copies()."""
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    linked = near_dedup(texts, most=most, size=size).select(F.xxhash64(F.lit("fingerprint"), "component_id").alias("bucket"), "doc_id")
    placed = table(buckets(texts, words).unionByName(linked), "bands")
    # buckets with the same members are compared once
    mark = F.xxhash64("doc_id")
    of = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(F.lit((1 << 40) - 1))).alias("s"))
    met = table(of.filter("a < z").groupBy("n", "a", "z", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket"), "met")
    left = table(placed.join(maybe_broadcast(met, met.count()), "bucket", "left_semi").distinct(), "members")
    links, before = None, None
    while True:
        sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_task)
        sizes = table(sizes, "large")
        n_large, largest = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
        if before is not None and n_large and largest > 0.9 * before:
            per_task, n_large = largest, 0  # too few are alike to shrink further: whole buckets
        before = largest
        salt = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(largest or 0)), F.ceil(F.col("n") / per_task)), F.lit(0)).cast("int")
        salted = left.join(maybe_broadcast(sizes, sizes.count()), "bucket", "left").select("bucket", "doc_id", salt.alias("salt"))
        dealt = texts.join(salted.hint("merge"), "doc_id").repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "doc_id")
        got = table(_compared(dealt, words, similarity), "compared")
        found = got.filter("keep_id IS NOT NULL").select("doc_id", "keep_id")
        links = found if links is None else links.unionByName(found)
        if not n_large:
            return links.distinct()
        left = table(got.filter("keep_id IS NULL").join(maybe_broadcast(sizes.select("bucket"), n_large), "bucket", "left_semi").select("bucket", "doc_id").distinct(), "members")


def confirmed_copies(docs: DataFrame, most: int = MOST, size: int = 4, words: int = 5, similarity: float = 0.8, per_task: int = 500) -> DataFrame:
    """(doc_id, keep_id): documents of a group of near-copies with the smallest doc_id of
    the group, which is never itself listed. Groups are joined by confirmed links only.

    Documents meet in buckets: components at `most` differing bits of fingerprints over `size`
    words, and bands of min-hashes of their `words`-word shingles. In a bucket each is held
    exactly against those before it that are no copies. Buckets of more than `per_task`
    documents are dealt to several tasks, whose documents that are no copies meet again
    until one task holds them. Missed are pairs of which neither shares a bucket, and links
    between two documents that are both copies of others. Texts without words equal each
    other. Rows with a null id are left out."""
    linked = components(confirmed_links(docs, most, size, words, similarity, per_task).select(F.col("doc_id").alias("a"), F.col("keep_id").alias("b")))
    return linked.filter("node > root").select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))


def drop_near_copies(docs: DataFrame, **params) -> DataFrame:
    """docs without those that confirmed_copies (which takes `params`) lists: of each group
    of near-copies one row stays. All columns stay.

    Rows whose doc_id is null or on several rows are documents of their own: they take
    part under new ids, smaller than all others or, where ids reach down to -2^62, larger (in
    any order among themselves)."""
    row, own = free_name(docs, "row"), F.col("doc_id").cast("long")
    plain = docs.select(own.alias("doc_id"), text_or_empty().alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    of_id = plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("again"))
    again = table(of_id, "again")
    n = again.count()
    if n:
        again = maybe_broadcast(again, n)
        on = plain["doc_id"].eqNullSafe(again["again"])
        least, most = (x or 0 for x in plain.agg(F.min("doc_id"), F.max("doc_id")).first())
        k = F.monotonically_increasing_id()
        new = F.lit(least - 1) - k if least > -(1 << 62) else F.lit(most + 1) + k
        renamed = table(plain.join(again, on, "left_semi").withColumn("doc_id", new), "renamed")
        plain = plain.join(again, on, "left_anti").unionByName(renamed)
    made = len(tables_made(docs.sparkSession))
    gone = last_table(confirmed_copies(plain.select("doc_id", "text"), **params).select(F.col("doc_id").alias("gone")).distinct(), "gone", made)
    kept = plain.join(maybe_broadcast(gone, gone.count()), plain["doc_id"] == F.col("gone"), "left_anti")
    return kept.select(f"{row}.*")
