"""Feature archive, and importance of features, nodes and edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.hashing import check_nbits
from ..plans.ship import ship_code
from ..sources.tables import Graphs
from . import local
from .features import node_features
from .local import by_graph


#: Columns of an occurrence, before its provenance.
OCCURRENCE = ("feature_id", "raw_signature", "feature_kind", "graph_id", "root_node", "target_node")


_COLUMNS = "feature_id int, raw_signature long, feature_kind string, graph_id, root_node long, target_node long"
_PACK = "span int, feature_id int, n long, at binary, ids binary"


def _occurrence_params(radius: int = 1, distance: int = 3, connector: int = 0, nbits: int = 10, degree_threshold: int | None = None, use_edges: bool = True) -> dict:
    return {"nbits": check_nbits(nbits), "radius": radius, "distance": distance, "connector": connector, "degree_threshold": degree_threshold, "use_edges": use_edges}


def occurrences(g: Graphs, radius: int = 1, distance: int = 3, connector: int = 0, nbits: int = 10, degree_threshold: int | None = None, use_edges: bool = True, provenance: bool = False) -> DataFrame:
    """Every occurrence of every feature, before counting: feature_id, raw_signature,
    feature_kind, graph_id, root_node, target_node; with provenance also source_node_ids
    (sorted array) and source_edge_ids (sorted array of u, v): where in the graph it lies."""
    params = _occurrence_params(radius, distance, connector, nbits, degree_threshold, use_edges)
    if provenance:
        return by_graph(g, local.provenance, f"{_COLUMNS}, source_node_ids array<bigint>, source_edge_ids array<struct<u:bigint;v:bigint>>", **params)
    return by_graph(g, local.occurrences, _COLUMNS, **params)


def subgraph_nodes(g: Graphs, found: DataFrame) -> DataFrame:
    """The nodes of occurrences with provenance: the occurrence's columns, original_node_id
    and label (and whatever else the nodes carry)."""
    rows = found.select(*OCCURRENCE, F.explode("source_node_ids").alias("original_node_id"))
    return rows.join(g.nodes.withColumnRenamed("node_id", "original_node_id"), ["graph_id", "original_node_id"])


def subgraph_edges(g: Graphs, found: DataFrame) -> DataFrame:
    """The edges of occurrences with provenance: the occurrence's columns, the original u, v and label."""
    rows = found.select(*OCCURRENCE, F.explode("source_edge_ids").alias("e")).select(*OCCURRENCE, "e.u", "e.v")
    return rows.join(g.edges, ["graph_id", "u", "v"])


def occurrence_edges(g: Graphs, **params) -> DataFrame:
    """subgraph_edges of the graphs' own occurrences, whose blocks hold the labels."""
    columns = "graph_id, u long, v long, feature_id int, raw_signature long, feature_kind string, root_node long, target_node long, label string"
    return by_graph(g, local.provenance_edges, columns, **_occurrence_params(**params))


def subgraphs(g: Graphs, found: DataFrame) -> DataFrame:
    """The occurrences with their nodes (original_node_id, label) and edges (u, v, label) nested."""
    key = [*OCCURRENCE, F.col("source_node_ids").alias("ids"), F.col("source_edge_ids").alias("eids")]
    rows = found.select(*key)
    names = [*OCCURRENCE, "ids", "eids"]
    n = rows.withColumn("node_id", F.explode("ids")).join(g.nodes.select("graph_id", "node_id", "label"), ["graph_id", "node_id"]).groupBy(*names).agg(F.array_sort(F.collect_set(F.struct(F.col("node_id").alias("original_node_id"), "label"))).alias("nodes"))
    e = rows.withColumn("e", F.explode("eids")).select(*names, "e.u", "e.v").join(g.edges.select("graph_id", "u", "v", "label"), ["graph_id", "u", "v"]).groupBy(*names).agg(F.array_sort(F.collect_set(F.struct("u", "v", "label"))).alias("edges"))
    none = F.array().cast("array<struct<u:bigint,v:bigint,label:string>>")
    return n.join(e, names, "left").select(*OCCURRENCE, "nodes", F.coalesce("edges", none).alias("edges"))


#: What makes an occurrence the first of its feature.
_ORDER = ("feature_id", "graph_id", "root_node", "target_node", "feature_kind", "raw_signature")
#: Signatures of a packed row lie this close, and a task packs so many occurrences at once.
_SPAN, _PACKED = 1 << 20, 1 << 22


def _firsts(batch: pa.RecordBatch, held: pa.Table | None, least: dict) -> pa.Table | None:
    """The candidates for each feature's first occurrence, with those of one more batch."""
    place, known = pd.factorize(batch["feature_id"].to_numpy())
    graphs = batch["graph_id"].dictionary_encode()
    order = pc.sort_indices(graphs.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    g = rank[graphs.indices.to_numpy()]
    low = np.full(len(known), len(order))
    np.minimum.at(low, place, g)
    lowest = graphs.dictionary.take(pa.array(order[low])).to_pylist()
    wanted = np.array([f not in least or x <= least[f] for f, x in zip(known.tolist(), lowest)])
    least.update((f, x) for f, x, ok in zip(known.tolist(), lowest, wanted) if ok)
    found = np.flatnonzero((g == low[place]) & wanted[place])
    if not len(found):
        return held
    some = pa.Table.from_batches([batch.take(pa.array(found))])
    rows = (some if held is None else pa.concat_tables([held, some])).sort_by([(c, "ascending") for c in _ORDER])
    # of each feature the rows that are equal to its first in all of the order's columns
    new = np.ones(rows.num_rows, bool)
    starts = np.ones(rows.num_rows, bool)
    same = [pc.equal(rows[c][1:], rows[c][:-1]).to_numpy() for c in _ORDER]
    new[1:], starts[1:] = ~np.logical_and.reduce(same), ~same[0]
    groups = np.cumsum(new)
    return rows.filter(pa.array(groups == groups[starts][np.cumsum(starts) - 1]))


def _pack(batches: Iterator[pa.RecordBatch], first: pa.StructType | None = None) -> Iterator[pa.RecordBatch]:
    """Occurrences counted by feature, and their distinct signatures in short sorted lists; with
    `first` also each feature's first occurrence, as such a struct."""
    held, n, candidates, least = [], 0, None, {}

    def row(columns: dict, first_rows: pa.Array | None = None) -> pa.RecordBatch:
        if first is not None:
            columns["first"] = pa.nulls(len(columns["span"]), first) if first_rows is None else first_rows
        return pa.RecordBatch.from_pydict(columns)

    def packed():
        raw, fid = (np.concatenate(x) for x in zip(*held))
        ids, counts = np.unique(fid, return_counts=True)
        yield row({"span": np.full(len(ids), -1, np.int32), "feature_id": ids, "n": counts, "at": pa.nulls(len(ids), pa.binary()), "ids": pa.nulls(len(ids), pa.binary())})
        raw, at = np.unique(raw, return_index=True)
        fid, cuts = fid[at], np.flatnonzero(np.diff(raw // _SPAN)) + 1
        parts = list(zip(np.split(raw, cuts), np.split(fid, cuts)))
        steps = [np.diff(r % _SPAN, prepend=0) for r, _ in parts]
        small = lambda x: x.astype(np.uint8 if x.max() < 1 << 8 else np.uint16 if x.max() < 1 << 16 else np.uint32)
        rows = {"span": pa.array([int(r[0]) // _SPAN for r, _ in parts], pa.int32()), "feature_id": pa.nulls(len(parts), pa.int32()), "n": [len(r) for r, _ in parts]}
        yield row(rows | {"at": [small(x).tobytes() for x in steps], "ids": [small(f).tobytes() for _, f in parts]})

    for b in batches:
        if not b.num_rows:
            continue
        held.append((b["raw_signature"].to_numpy(), b["feature_id"].to_numpy()))
        n += b.num_rows
        if first is not None:
            candidates = _firsts(b, candidates, least)
        if n >= _PACKED:
            yield from packed()
            held, n = [], 0
    if n:
        yield from packed()
    if candidates is not None:
        rows = candidates.combine_chunks()
        nested = pa.StructArray.from_arrays([rows[f.name].combine_chunks().cast(f.type) for f in first], fields=list(first))
        none = pa.nulls(rows.num_rows, pa.binary())
        yield row({"span": np.full(rows.num_rows, -1, np.int32), "feature_id": rows["feature_id"].combine_chunks(), "n": np.zeros(rows.num_rows, np.int64), "at": none, "ids": none}, nested)


def _unpack(batches: Iterator[pa.RecordBatch], first: pa.StructType | None = None) -> Iterator[pa.RecordBatch]:
    """Of lists in order of their spans: the distinct signatures of each feature."""
    now, ids = None, np.full(_SPAN, -1, np.int32)

    def counted():
        found, n = np.unique(ids[ids >= 0], return_counts=True)
        columns = {"feature_id": pa.array(found, pa.int32()), "occurrence_count": np.zeros(len(found), np.int64), "raw_signature_count": n.astype(np.int64)}
        return pa.RecordBatch.from_pydict(columns | ({} if first is None else {"first": pa.nulls(len(found), first)}))

    def wide(data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n]).astype(np.int64)

    for b in batches:
        plain = b.filter(pc.less(b["span"], 0))
        columns = {"feature_id": plain["feature_id"], "occurrence_count": plain["n"], "raw_signature_count": np.zeros(plain.num_rows, np.int64)}
        yield pa.RecordBatch.from_pydict(columns | ({} if first is None else {"first": plain["first"]}))
        for r in b.filter(pc.greater_equal(b["span"], 0)).select(["span", "n", "at", "ids"]).to_pylist():
            if r["span"] != now and now is not None:
                yield counted()
                ids[:] = -1
            now = r["span"]
            ids[np.cumsum(wide(r["at"], r["n"]))] = wide(r["ids"], r["n"])
    if now is not None:
        yield counted()


def archive_summary(found: DataFrame, firsts: bool = False) -> DataFrame:
    """Occurrences and distinct signatures of each feature. Signatures are codes of 30 bits, a
    signature's feature is always the same: a task's distinct ones cross the shuffle in sorted
    lists of some 3 bytes each, and meet in 1,024 spans. With `firsts` also the first occurrence
    (by graph, root, target, kind and signature, then where it lies), seen in the same pass."""
    ship_code(found.sparkSession)
    rows = found.withColumn("raw_signature", F.col("raw_signature").cast("long")).withColumn("feature_id", F.col("feature_id").cast("int"))
    if not firsts:
        return _met(rows.select("raw_signature", "feature_id").mapInArrow(_pack, _PACK))
    names = [*_ORDER[1:], *[c for c in ("source_node_ids", "source_edge_ids") if c in found.columns]]
    kind = rows.select(F.struct(*names).alias("first")).schema["first"].dataType
    arrow = to_arrow_schema(StructType().add("first", kind)).field("first").type
    return _met(rows.select("feature_id", *names).mapInArrow(lambda x: _pack(x, arrow), f"{_PACK}, first {kind.simpleString()}"), kind)


def _met(packed: DataFrame, first: StructType | None = None) -> DataFrame:
    """The summary of what _pack made."""
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = first and to_arrow_schema(StructType().add("first", first)).field("first").type
    extra, sums = "", [F.sum("occurrence_count").alias("occurrence_count"), F.sum("raw_signature_count").alias("raw_signature_count")]
    if first:
        extra = f", first {first.simpleString()}"
        sums.append(F.min("first").alias("first"))
    met = packed.repartition(n, "span").sortWithinPartitions("span").mapInArrow(lambda x: _unpack(x, kind), f"feature_id int, occurrence_count long, raw_signature_count long{extra}")
    return met.groupBy("feature_id").agg(*sums)


def graph_summary(g: Graphs, firsts: bool = False, **params) -> DataFrame:
    """archive_summary of the graphs' own occurrences, which no task gives away: it counts them."""
    params = _occurrence_params(**params)
    if not firsts:
        return _met(by_graph(g, local.occurrences, _COLUMNS, then=_pack, out=_PACK, **params))
    key = g.nodes.schema["graph_id"].dataType
    kind = StructType.fromDDL("graph_id long, root_node long, target_node long, feature_kind string, raw_signature long")
    kind = StructType([StructField("graph_id", key), *kind.fields[1:]])
    arrow = to_arrow_schema(StructType().add("first", kind)).field("first").type
    return _met(by_graph(g, local.occurrences, _COLUMNS, then=lambda x: _pack(x, arrow), out=f"{_PACK}, first {kind.simpleString()}", **params), kind)


def top_features(importance: DataFrame, found: DataFrame, top_k: int = 10, min_importance: float = 0.0, shift: int = 0) -> DataFrame:
    """The top_k archived features by importance (ties: smaller id), with a first occurrence.
    shift: columns that stand before the features in the importance table."""
    return _best(importance, archive_summary(found, firsts=True), top_k, min_importance, shift)


def top_graph_features(importance: DataFrame, g: Graphs, top_k: int = 10, min_importance: float = 0.0, shift: int = 0, **params) -> DataFrame:
    """top_features of the graphs' own occurrences, made and counted in one pass."""
    return _best(importance, graph_summary(g, firsts=True, **params), top_k, min_importance, shift)


def _best(importance: DataFrame, summary: DataFrame, top_k: int, min_importance: float, shift: int) -> DataFrame:
    imp = importance.select((F.col("feature_id") - shift).alias("feature_id"), "importance")
    best = imp.join(summary, "feature_id").filter((F.col("importance") > 0) & (F.col("importance") >= min_importance)).orderBy(F.col("importance").desc(), "feature_id").limit(top_k)
    return best.select("feature_id", "importance", "occurrence_count", "raw_signature_count", "first.*")


def node_importance(features: DataFrame, importance: DataFrame, normalize: bool = True) -> DataFrame:
    """(graph_id, node_id, score): values times importances, by each graph's maximum."""
    part = F.coalesce(F.col("value") * F.col("importance"), F.lit(0.0))
    every = features.join(importance, "feature_id", "left").groupBy("graph_id", "node_id").agg(F.sum(part).alias("score"))
    if not normalize:
        return every
    most = F.max("score").over(Window.partitionBy("graph_id"))
    return every.withColumn("score", F.col("score") / F.when(most > 0, most).otherwise(1.0))


#: Importances of so many features at most are sent to all tasks.
TABLE = 1 << 20


def graph_scores(g: Graphs, importance: DataFrame, normalize: bool = True, edges: bool = False, **params) -> DataFrame:
    """node_importance of the graphs' own features, graph by graph; with edges their
    edge_importance."""
    params = local.PLAIN | params
    width = 1 << check_nbits(params["nbits"])
    if width > TABLE:
        nodes = node_importance(node_features(g, **params), importance, normalize)
        return edge_importance(g.edges, nodes) if edges else nodes
    table = np.zeros(width)
    for r in importance.filter(F.col("feature_id").between(0, width - 1)).filter("importance IS NOT NULL").groupBy("feature_id").agg(F.sum("importance").alias("x")).collect():
        table[r.feature_id] = r.x
    columns = "graph_id, u long, v long, score double" if edges else "graph_id, node_id long, score double"
    return by_graph(g, local.edge_scores if edges else local.node_scores, columns, table=table, normalize=normalize, **params)


def edge_importance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, u, v, score): the product of the ends' scores."""
    a, b = (nodes.select("graph_id", F.col("node_id").alias(e), F.col("score").alias(s)) for e, s in (("u", "su"), ("v", "sv")))
    return edges.join(a, ["graph_id", "u"]).join(b, ["graph_id", "v"]).select("graph_id", "u", "v", (F.col("su") * F.col("sv")).alias("score"))


def edge_features(edges: DataFrame, features: DataFrame) -> DataFrame:
    """(graph_id, u, v, feature_id, value): the sum of both ends' features."""
    at = [edges.select("graph_id", "u", "v", F.col(end).alias("node_id")) for end in ("u", "v")]
    met = at[0].unionByName(at[1]).join(features.select("graph_id", "node_id", "feature_id", "value"), ["graph_id", "node_id"])
    return met.groupBy("graph_id", "u", "v", "feature_id").agg(F.sum("value").alias("value"))


def edge_feature_sums(g: Graphs, **params) -> DataFrame:
    """edge_features of the graphs' own features, graph by graph."""
    params = local.PLAIN | params
    check_nbits(params["nbits"])
    return by_graph(g, local.edge_sums, f"graph_id, u long, v long, feature_id int, value {'long' if params['sigma'] is None else 'double'}", **params)


def postprocess(runs: DataFrame, quantile: float = 0.5) -> DataFrame:
    """(feature_id, importance) of (run, feature_id, importance): mean less deviation, not
    below zero, zero below the quantile, by the maximum."""
    s = runs.groupBy("feature_id").agg(F.greatest(F.avg("importance") - F.stddev_pop("importance"), F.lit(0.0)).alias("w"))
    q = s.agg(F.percentile("w", F.lit(quantile)).alias("q"), F.max("w").alias("m"))
    kept = F.when(F.col("w") < F.col("q"), 0.0).otherwise(F.col("w"))
    return s.join(F.broadcast(q)).select("feature_id", (kept / F.when(F.col("m") > 0, F.col("m")).otherwise(1.0)).alias("importance"))
