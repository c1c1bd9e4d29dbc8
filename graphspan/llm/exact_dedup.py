"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent; their exact counts and
winners are verified and broadcast, so their rows are decided map-side. All other
digests, each below a fixed share of the rows, take an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, last_table, maybe_broadcast, ship, table, tables_made, text_or_empty

#: Least and most counters of a Misra-Gries summary, whose error is at most rows / (counters + 1).
COUNTERS, MOST_COUNTERS = 1024, 1 << 17


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """One summary of a partition's only column: (key, n), at most `counters` rows."""
    kept: dict = {}
    kind = pa.binary()
    for batch in batches:
        kind = batch.column(0).type
        values, counts = batch.column(0).value_counts().flatten()
        for key, n in zip(values.to_pylist(), counts.to_pylist(), strict=True):
            kept[key] = kept.get(key, 0) + n
        if len(kept) > counters:  # the merge of two summaries: lower all by the first counter too many
            less = sorted(kept.values(), reverse=True)[counters]
            kept = {d: n - less for d, n in kept.items() if n > less}
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), kind), pa.array(list(kept.values()), pa.int64())], ["key", "n"])


def heavy_candidates(keys: DataFrame, rows: int, counters: int = COUNTERS, column: str = "digest", kind: str = "binary") -> DataFrame:
    """Keys of a column that may be frequent.

    Summed over partitions, a key's counter is short of its count by at most
    rows / (counters + 1), so every key with more than 1.5 times that share passes.
    The sum of all counters is at most `rows`, so at most 2 * (counters + 1) keys
    pass: the result's size is bounded."""
    least = max(2, rows // (2 * (counters + 1)))

    def summary(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return misra_gries(it, counters)

    summed = keys.select(column).mapInArrow(summary, f"key {kind}, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return summed.filter(F.col("n") >= least).select(F.col("key").alias(column))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", counters: int | None = None) -> DataFrame:
    """Decide every row of docs: (doc_id, digest binary, uid, keep_id, group_size, kept).

    Texts are equal when identical; null counts as empty. Of equal texts the row with
    the largest id stays; a null id is smaller than any other. Rows that repeat id and
    text are rows like others: just one of them stays (the one with the larger internal
    `uid`). An empty table gives an empty result. Extra columns are ignored. By default there
    are four counters for each shuffle partition, so that no digest left to the shuffle
    makes up half of a partition.
    """
    spark = docs.sparkSession
    if counters is None:
        counters = min(MOST_COUNTERS, max(COUNTERS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ship(spark)
    rows = table(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("uid")),
        "digests",
    )
    n = rows.count()
    best = F.max(F.struct("doc_id", "uid")).alias("best")
    candidates = table(heavy_candidates(rows, n, counters), "heavy")
    heavy = table(rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")), "winners")
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(candidates), "digest", "left_anti")
    winners = rest.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
    cold = rest.join(winners.hint("merge"), "digest")
    out = hot.unionByName(cold)
    return out.select("doc_id", "digest", "uid", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"))


def drop_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that `exact_dedup` drops; all columns stay.

    Only the losers' (id, digest) pairs are joined back. They are broadcast if few,
    else joined by a shuffle."""
    made = len(tables_made(docs.sparkSession))
    decided = table(exact_dedup(docs, text, id_col), "decided")
    pair = decided.groupBy("doc_id", "digest").agg(F.max("kept").alias("any_kept"), F.min("kept").alias("all_kept"))
    own, key, key_digest = (free_name(docs, x) for x in ("digest", "id", "of_digest"))
    losers = last_table(pair.filter(~F.col("all_kept")).select(F.col("doc_id").alias(key), F.col("digest").alias(key_digest), "any_kept"), "losers", made)
    n_losers, n_repeats = losers.agg(F.count(F.lit(1)), F.count(F.when(F.col("any_kept"), 1))).first()
    marked = docs.withColumn(own, F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256)))
    on = [marked[id_col].cast("long").eqNullSafe(F.col(key)), marked[own] == F.col(key_digest)]
    out = marked.join(maybe_broadcast(losers, n_losers), on, "left_anti")
    if n_repeats:  # rows that repeat id and text: one of them stays
        twins = losers.filter("any_kept").select(key, key_digest)
        out = out.unionByName(marked.join(maybe_broadcast(twins, n_repeats), on, "left_semi").dropDuplicates([id_col, own]))
    return out.drop(own)


def op1(docs: DataFrame) -> DataFrame:
    d = exact_dedup(docs)
    return d.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
