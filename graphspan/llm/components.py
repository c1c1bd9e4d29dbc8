"""Connected components of a distributed edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import last_table, table, tables_made

#: A node with more than this share of all edge ends (and HUB_ROWS at least) is a hub;
#: there are at most 2 / HUB_SHARE of them, so their minima can be broadcast.
HUB_SHARE, HUB_ROWS = 1 / 1000, 200


def _with_min(ends: DataFrame, rows: int) -> DataFrame:
    """ends(a, b) with m, the smallest of a and all its b. Hubs are joined map-side, the
    other nodes by a shuffle in which no key has more than HUB_SHARE of the rows."""
    mins = table(ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")), "mins")
    at = max(HUB_ROWS, int(rows * HUB_SHARE))
    hubs = mins.filter(F.col("n") > at).select("a", "m")
    near = ends.join(F.broadcast(hubs), "a")
    far = ends.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(mins.filter(F.col("n") <= at).select("a", "m").hint("merge"), "a")
    return near.unionByName(far)


def with_least(rows: DataFrame, key: str, value: str, out: str, n_rows: int) -> DataFrame:
    """rows with `out`, the least value of their key. Keys of more than HUB_SHARE of all rows
    (and HUB_ROWS) are joined map-side."""
    least = table(rows.groupBy(key).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("n")), "least")
    at = max(HUB_ROWS, int(n_rows * HUB_SHARE))
    hubs = F.broadcast(least.filter(F.col("n") > at).select(key, out))
    far = rows.join(hubs.select(key), key, "left_anti").join(least.filter(F.col("n") <= at).select(key, out).hint("merge"), key)
    return rows.join(hubs, key).unionByName(far)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node with an edge, the smallest node of its component.

    edges(a long, b long) may repeat, be in both directions and hold loops; edges with a
    null end are ignored. No edges, no rows. Each round writes its edges to the shared
    folder; nothing is gathered."""
    spark = edges.sparkSession
    e = table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        made = len(tables_made(spark)) - 1  # this round's edges go too when the next are written
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_min(both, 2 * state[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = table(large, "edges")
        down = _with_min(large, state[0])
        small = down.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(large.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        e = last_table(small, "edges", made)
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
