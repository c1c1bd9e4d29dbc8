"""Statistics of graphs and feature tables."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import Graphs
from . import local
from .local import by_graph
from .selection import running_sums

#: Parts of a class's span that are counted in a pass over its values.
BINS = 4_096


def graph_stats(g: Graphs) -> DataFrame:
    """(graph_id, n_nodes, n_edges, density, n_labels, min_degree, max_degree)."""
    found = by_graph(g, local.stats, "graph_id, n_nodes long, n_edges long, density double, n_labels long, min_degree long, max_degree long")
    return found.withColumn("density", F.round("density", 6))


def nonzeros(features: DataFrame) -> DataFrame:
    return features.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nnz"), F.sum(F.when(F.col("feature_id") == 0, F.col("value"))).alias("n_nodes"), F.sum(F.when(F.col("feature_id") == 1, F.col("value"))).alias("degree_sum"))


def components(g: Graphs) -> DataFrame:
    """(graph_id, node_id, component): the smallest node of each node's component. The trees
    found so far are hooked to their smallest neighbour and flattened, round by round."""
    return by_graph(g, local.node_components, "graph_id, node_id long, component long")


def component_stats(g: Graphs) -> DataFrame:
    """(graph_id, n_components, largest, connected)."""
    return by_graph(g, local.component_stats, "graph_id, n_components long, largest long, connected boolean")


def _placed(x: Column) -> Column:
    """The part of its class's span (lo to hi) that a number lies in; what is not finite lies beyond."""
    s, lo, hi = F.col("__s"), F.col("__lo"), F.col("__hi")
    part = F.when(hi > lo, F.least(F.floor((x * s - lo * s) / (hi * s - lo * s) * BINS).cast("int"), F.lit(BINS - 1))).otherwise(0)
    return F.when(F.isnan(x), BINS + 1).when(x == float("inf"), BINS).when(x == float("-inf"), -1).otherwise(part)


def _medians(held: DataFrame, keys: list[str], value: str, spans: dict[tuple, tuple]) -> dict[tuple, float]:
    """The median of each class of spans: {class: (number of values, least and largest finite one)}.
    A pass counts the parts of each class's span; the part that holds the middle is the next span."""
    x = F.col(value).cast("double")
    names = [f"__k{i}" for i in range(len(keys))]
    kinds = [f"{n} {held.schema[k].dataType.simpleString()}" for n, k in zip(names, keys)]
    state = {k: (n, 0, lo, hi) for k, (n, lo, hi) in spans.items() if n}
    found: dict[tuple, float] = {}
    rows, first = held.filter(x.isNotNull()), True
    while state:
        # a span too wide for a double is halved
        table = [(*k, lo, hi, 0.5 if math.isinf(hi - lo) else 1.0) for k, (_, _, lo, hi) in state.items()]
        known = held.sparkSession.createDataFrame(table, ", ".join([*kinds, "__lo double", "__hi double", "__s double"]))
        met = rows.join(F.broadcast(known), [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
        if not first:
            met = met.filter(x.between(F.col("__lo"), F.col("__hi")))
        parts: dict[tuple, list] = {}
        for r in met.groupBy(*names, _placed(x).alias("__part")).agg(F.count(F.lit(1)), F.min(x), F.max(x)).collect():
            parts.setdefault(tuple(r[: len(keys)]), []).append(tuple(r[len(keys) :]))
        for k, (n, below, _, _) in list(state.items()):
            middle = []  # the parts of both middle places, which is one if n is odd
            for part, size, low, high in sorted(parts[k], key=lambda p: p[0]):
                middle += [(part, below, low, high)] * sum(below <= at < below + size for at in ((n - 1) // 2, n // 2))
                below += size
            (part, before, low, high), (other, _, next_low, _) = middle
            if part != other:
                found[k] = 0.5 * high + 0.5 * next_low
            elif low == high or not 0 <= part < BINS:
                found[k] = low
            else:
                state[k] = n, before, low, high
                continue
            del state[k]
        first = False
    return found


def by_class(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, exact median, population deviation, least and largest of a column by class. Values
    are made once, lie on the executors' disks and are counted in ever narrower spans around the
    medians, so no task holds those of a class; the driver gets some rows of counts a class."""
    v = F.col(value)
    x = v.cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    held = values.select(*keys, value).persist(StorageLevel.DISK_ONLY)
    try:
        plain = held.groupBy(*keys).agg(F.avg(v).alias("mean"), F.lit(None).cast("double").alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(v), F.coalesce(F.min(finite), F.lit(0.0)), F.coalesce(F.max(finite), F.lit(0.0)))
        rows = [tuple(r) for r in plain.collect()]
        n = len(keys)
        medians = _medians(held, keys, value, {r[:n]: r[-3:] for r in rows})
    finally:
        held.unpersist()
    out = [(*r[: n + 1], medians.get(r[:n]), *r[n + 2 : -3]) for r in rows]
    return values.sparkSession.createDataFrame(out, StructType(plain.schema.fields[:-3]))


def kernel_profile(kernel: DataFrame) -> DataFrame:
    """(graph_id, value): the median of each graph's row of a symmetric kernel table (g1, g2,
    cosine) with g1 < g2; a graph's kernel with itself is 1. Pairs without a row count as 0."""
    ids = kernel.select(F.explode(F.array("g1", "g2")).alias("graph_id"), "cosine")
    own = ids.groupBy("graph_id").agg(F.collect_list("cosine").alias("k"))
    n = F.broadcast(own.agg(F.count(F.lit(1)).alias("n")))
    row = F.array_sort(F.concat("k", F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), (F.col("n") - 1 - F.size("k")).cast("int"))))
    half = F.floor((F.col("n") - 1) / 2).cast("int"), F.floor(F.col("n") / 2).cast("int")
    return own.join(n).withColumn("row", row).select("graph_id", ((F.get("row", half[0]) + F.get("row", half[1])) / 2).alias("value"))


def profiles(rows: DataFrame, at: str, value: str) -> DataFrame:
    """(at, mean, std): mean and population deviation over repeats at each place."""
    return rows.groupBy(at).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def ranking_quality(scores: DataFrame, score: str, label: str) -> DataFrame:
    """One row (n_pos, n_neg, roc_auc, average_precision) of scores against a 0/1 label; tied
    scores stand together, and rows with a null are left out. Scores are counted first and
    summed by ranges, so no task sees all of them. Null with one class only."""
    met = scores.select(F.col(score).cast("double").alias("s"), F.col(label).cast("long").alias("y")).dropna()
    counts = met.groupBy((-F.col("s")).alias("order")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    placed = running_sums(counts, "order", ["pos", "neg"])
    pos, neg, above, false_above = (F.col(c).cast("double") for c in ("pos", "neg", "before_pos", "before_neg"))
    # negatives below each positive, and half of those at its score; precision at each score
    placed = placed.select("pos", "neg", (neg * (above + pos / 2)).alias("won"), (pos * (above + pos) / (above + pos + false_above + neg)).alias("hit"))
    n = placed.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("won").alias("won"), F.sum("hit").alias("hit"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return n.select("n_pos", "n_neg", F.when(both, F.col("won") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"), F.when(both, F.col("hit") / F.col("n_pos")).alias("average_precision"))


def throughput(progress: list) -> dict:
    """Of a streaming query's recentProgress: graphs, batches, seconds and rates."""
    rows = [p["numInputRows"] for p in progress if p["numInputRows"]]
    seconds = sum(p["batchDuration"] for p in progress) / 1000
    total = sum(rows)
    return {
        "graphs_streamed": total,
        "batches": len(rows),
        "elapsed_sec": seconds,
        "graphs_per_sec": total / seconds if seconds else float("nan"),
        "ms_per_graph": 1000 * seconds / total if total else float("nan"),
        "mean_batch_rows": total / len(rows) if rows else float("nan"),
        "max_batch_rows": max(rows, default=float("nan")),
    }
