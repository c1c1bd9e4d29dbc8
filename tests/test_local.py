"""Graph operators that work graph by graph: their shuffles, odd graphs, and the SQL."""

import os
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphspan.operators import analytics, attribution, features, local, structure, vectors
from graphspan.sources.tables import Graphs

DATA = "/root/testdata/sf0.001"
#: Exchanges that are no broadcasts, and eager jobs' tables aside.
SHUFFLES = {
    "bfs_distances": 1,
    "archive_summary": 3,
    "path_union_edges": 1,
    "path_union_nodes": 1,
    "rooted_codes": 1,
    "rooted_codes_threshold": 1,
    "edge_importance": 1,
    "connector_codes": 1,
    "feature_nonzeros": 2,
    "graph_features": 1,
    "graph_features_threshold": 1,
    "graph_features_connector": 1,
    "importance_by_class_part": 4,
    "node_features": 1,
    "node_importance": 1,
    "stream_batches": 9,
    "top_features": 9,
    "node_kernel": 1,
    "archive_provenance": 1,
    "edge_feature_sums": 1,
    "archive_subgraph_edges": 4,
    "node_codes": 1,
    "graph_components": 1,
    "edge_triplets": 1,
    "node_features_sigma": 1,
    "graph_stats": 1,
    "weighted_features": 1,
}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")


@pytest.mark.parametrize("name", SHUFFLES)
def test_shuffles_and_sql(spark, name):
    """Each graph crosses one shuffle, nothing is checkpointed, and rows are those of the SQL."""
    folder = spark.sparkContext.getCheckpointDir()
    jvm = spark.sparkContext._jvm
    path = folder and jvm.org.apache.hadoop.fs.Path(folder)
    fs = path and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = fs.getContentSummary(path).getFileCount() if fs and fs.exists(path) else 0
    df = entry.queries()[name](spark, DATA)
    assert exchanges(df) <= SHUFFLES[name]
    rows = df.toPandas().fillna(-1)
    if name == "stream_batches":  # places of the orders, not of features
        pass
    elif folder:
        assert (fs.getContentSummary(path).getFileCount() if fs.exists(path) else 0) == before
    else:
        assert spark.sparkContext.getCheckpointDir() is None
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = c.execute(entry.oracle_sql()[name]).fetchdf().fillna(-1)
    assert sorted(want.columns) == sorted(rows.columns)
    assert Counter(rows[list(want.columns)].itertuples(index=False, name=None)) == Counter(want.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def odd(spark):
    """A path, a ring longer than DENSE_NODES allows in the tests, a loop, lone nodes, and an
    edge to a node without a row."""
    nodes = [(1, k, "a" if k % 3 else "b") for k in range(6)] + [(2, k, "x") for k in range(40)] + [(3, 7, "z"), (3, 9, "z"), (5, 0, "q")]
    edges = [(1, k, k + 1, "-") for k in range(5)] + [(2, k, k + 1, "=") for k in range(39)] + [(2, 0, 39, "=")] + [(3, 7, 7, "-"), (3, 8, 9, "-"), (3, 7, 8, "-")]
    return Graphs(spark.createDataFrame(nodes, "graph_id long, node_id long, label string"), spark.createDataFrame(edges, "graph_id long, u long, v long, label string"))


def made(g, dense, rows, cells):
    """Everything, with other sizes of blocks and chunks, in this process."""
    table = g.by_rows().toArrow().sort_by("graph_id")
    old = local.DENSE_NODES, local.BLOCK_ROWS, local.CELLS
    local.DENSE_NODES, local.BLOCK_ROWS, local.CELLS = dense, rows, cells
    try:
        out = Counter()
        for b in local.blocks(iter(table.to_batches(max_chunksize=7)), False, None):
            for name, part in (
                ("d", local.distances(b, 3)), ("n", local.path_nodes(b, 3)), ("e", local.path_edges(b, 3)), ("r", local.rooted(b, 2, None)), ("u", local.connectors(b, 3, 1, 1)),
                ("f", local.features(b, True, **(local.PLAIN | {"connector": 1}))), ("k", local.kernel(b, **local.PLAIN)), ("c", local.component_stats(b)), ("s", local.edge_sums(b, **local.PLAIN)),
            ):
                for columns in part:
                    g_at = 0
                    for row in zip(*[c.tolist() for c in columns]):
                        out[name, b.ids[row[g_at]].as_py(), *row[1:]] += 1
        return out
    finally:
        local.DENSE_NODES, local.BLOCK_ROWS, local.CELLS = old


def test_sizes_of_blocks_change_nothing(odd):
    want = made(odd, 2_048, 30_000, 1 << 21)
    assert {k[0] for k in want} == set("dnerufkcs") and max(want.values()) == 1
    for dense, rows, cells in ((3, 5, 1 << 21), (2_048, 5, 50), (3, 30_000, 2_560)):
        assert made(odd, dense, rows, cells) == want


def test_ends_without_rows(odd):
    """A node without a row is reached and passed, but is neither root nor coded."""
    dist = {(r.root, r.node): r.d for r in structure.distances(odd, 3).filter("graph_id = 3").collect()}
    assert dist == {(7, 7): 0, (7, 8): 1, (7, 9): 2, (9, 9): 0, (9, 8): 1, (9, 7): 2}
    assert {(r.root, r.target, r.node) for r in structure.shortest_path_nodes(odd, 3).filter("graph_id = 3").collect()} == {tuple(r) for r in structure.path_nodes(structure.distances(odd, 3)).filter("graph_id = 3").select("root", "target", "node").collect()}
    pairs = Counter(map(tuple, structure.shortest_path_edges(odd, 3).collect()))
    assert pairs == Counter(map(tuple, structure.path_edges(odd, structure.distances(odd, 3)).collect()))
    assert structure.triplet_codes(odd).filter("graph_id = 3").count() == 1
    assert {r.graph_id: (r.n_components, r.largest, r.connected) for r in analytics.component_stats(odd).collect()} == {1: (1, 6, True), 2: (1, 40, True), 3: (1, 2, True), 5: (1, 1, True)}


def test_joined_forms_agree(spark, odd):
    """What is made graph by graph is what joins of its features make."""
    near = lambda df: {tuple(r)[:-1]: round(tuple(r)[-1], 9) for r in df.collect()}
    f = features.node_features(odd, 1, 2, nbits=8)
    imp = spark.range(256).select(F.col("id").cast("int").alias("feature_id"), (F.col("id") % 7 / 8).alias("importance"))
    scores = attribution.node_importance(f, imp)
    assert near(attribution.graph_scores(odd, imp, radius=1, distance=2, nbits=8)) == near(scores)
    assert near(attribution.graph_scores(odd, imp, edges=True, radius=1, distance=2, nbits=8)) == near(attribution.edge_importance(odd.edges, scores))
    assert near(attribution.edge_feature_sums(odd, radius=1, distance=2, nbits=8)) == near(attribution.edge_features(odd.edges, f))
    assert near(vectors.graph_kernel(odd, radius=1, distance=2, nbits=8)) == near(vectors.node_kernel(f, 8))
    heavy = replace(odd, nodes=odd.nodes.withColumn("weight", F.col("node_id") / 4))
    assert near(vectors.weighted_features(heavy, radius=1, distance=2, nbits=8)) == near(vectors.reweighted(f, heavy.nodes))
    tags = spark.createDataFrame([(1, 10), (3, 11)], "graph_id long, batch long")
    got = features.node_features(odd, 1, 2, nbits=8, tags=tags, tag="batch")
    assert near(got) == near(f.join(tags, "graph_id"))


def test_repeated_rows_count_once(spark):
    """Rows with repeats: nodes once, of an edge's labels the largest, none is the default."""
    rows = [(1, False, 0, 0, None), (1, False, 0, 0, None), (1, False, 1, 0, "a"), (1, True, 0, 1, "m"), (1, True, 0, 1, None), (1, True, 0, 1, "n")]
    rows = spark.createDataFrame(rows, "graph_id long, edge boolean, a long, b long, label string").withColumn("extra", F.lit(None).cast("double"))
    plain = Graphs(spark.createDataFrame([(1, 0, "0"), (1, 1, "a")], "graph_id long, node_id long, label string"), spark.createDataFrame([(1, 0, 1, "n")], "graph_id long, u long, v long, label string"))
    g = replace(plain, rows=rows, dealt=False, repeated=True, default="0")
    assert sorted(map(tuple, features.node_features(g).collect())) == sorted(map(tuple, features.node_features(plain).collect()))


def test_summary_counts_distinct_signatures(spark, monkeypatch):
    raw = np.random.default_rng(1).integers(0, 1 << 30, 5000)
    raw = np.concatenate([raw, raw[:2000], [0, (1 << 30) - 1]]).tolist()
    found = spark.createDataFrame([(r % 9 + 2, r) for r in raw], "feature_id int, raw_signature long").repartition(3)
    want = {k: (n, len({r for r in raw if r % 9 + 2 == k})) for k, n in Counter(r % 9 + 2 for r in raw).items()}
    assert {r.feature_id: (r.occurrence_count, r.raw_signature_count) for r in attribution.archive_summary(found).collect()} == want
    assert attribution.archive_summary(found.filter("false")).count() == 0


def test_many_texts_hashed_at_once(monkeypatch):
    """Codes of many texts, of no, one and several blocks, are those of hashlib, and few are hashed one by one."""
    from hashlib import sha256

    import pyarrow as pa

    from graphspan.functions import block_hash, block_sha

    one, left = block_sha._one_by_one, []
    monkeypatch.setattr(block_sha, "_one_by_one", lambda x: left.append(len(x)) or one(x))
    monkeypatch.setattr(block_sha, "ROWS", 1_000)
    k = np.random.default_rng(2).integers(0, 1 << 30, (30_000, 2))
    texts = [f"({a}, {b})" for a, b in k.tolist()] + [f"{'7, ' * (i % 75)}{i}" for i in range(30_000)] + ["é" * (i % 40) for i in range(20_000)] + [""] * 10
    want = [int.from_bytes(sha256(x.encode()).digest()[28:], "big") & ((1 << 30) - 1) for x in texts]
    for held, w in ((pa.array(texts), want), (pa.array(texts).slice(31), want[31:]), (pa.array(texts[:5]), want[:5]), (pa.array([], pa.string()), [])):
        assert block_hash.codes(held).tolist() == w
    assert sum(left) < 2 * block_sha.FEW
    monkeypatch.setattr(block_sha, "FEW", 1)
    assert block_hash.codes(pa.array(texts)).tolist() == want


@pytest.mark.parametrize("provenance", [False, True])
def test_top_features_make_occurrences_once(spark, odd, provenance):
    """The first occurrence is found in the pass that counts: one pass in the plan, the same rows as by a join."""
    occ = attribution.occurrences(odd, radius=1, distance=2, nbits=4, provenance=provenance)
    imp = spark.range(16).select(F.col("id").cast("int").alias("feature_id"), (F.col("id") % 5 / 8).alias("importance"))
    got = attribution.top_features(imp, occ, top_k=7)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow run(") == 1
    counts = occ.groupBy("feature_id").agg(F.count("*").alias("occurrence_count"), F.countDistinct("raw_signature").alias("raw_signature_count"))
    order = ["graph_id", "root_node", "target_node", "feature_kind", "raw_signature", *occ.columns[6:]]
    first = occ.groupBy("feature_id").agg(F.min(F.struct(*order)).alias("o"))
    want = imp.filter("importance > 0").join(counts, "feature_id").join(first, "feature_id").select("feature_id", "importance", "occurrence_count", "raw_signature_count", "o.*").orderBy(F.desc("importance"), "feature_id").limit(7)
    rows = sorted(map(tuple, want.collect()))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == rows
    if not provenance:
        fused = attribution.top_graph_features(imp, odd, top_k=7, radius=1, distance=2, nbits=4)
        assert fused.columns == want.columns and sorted(map(tuple, fused.collect())) == rows
        assert fused._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # made, counted and packed in one


def test_edges_of_occurrences_need_no_join(spark, odd):
    """The labels come from the graphs' blocks: one shuffle, and the rows of the join, at loops and
    repeated edges too."""
    assert exchanges(entry.queries()["archive_subgraph_edges"](spark, DATA)) == 1
    more = spark.createDataFrame([(1, 0, 1, "+"), (3, 7, 7, "-")], "graph_id long, u long, v long, label string")
    g = replace(odd, edges=odd.edges.unionByName(more))
    params = {"radius": 1, "distance": 2, "connector": 1, "nbits": 6}
    want = attribution.subgraph_edges(g, attribution.occurrences(g, provenance=True, **params))
    got = attribution.occurrence_edges(g, **params)
    assert got.columns == want.columns and got.count() > 100
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("bins", [2, 4096])
def test_medians_by_class_need_no_task_with_a_class(spark, monkeypatch, bins):
    """No aggregate that holds a class's values; ties, nulls and numbers that are not finite."""
    monkeypatch.setattr(F, "median", None)
    monkeypatch.setattr(analytics, "BINS", bins, raising=False)
    r = np.random.default_rng(3)
    classes = {"odd": r.normal(size=301), "even": r.normal(size=300), "ties": r.integers(0, 3, 200) / 1.0, "one": [0.25], "gap": [-1e308, 1.7e308, -1.7e308, 1e308], "tiny": [0.0, 5e-324, 1e-323], "last": [1.0, float("nan"), float("nan")], "far": [float("-inf"), 2.0, float("inf"), float("inf")], None: [1.0, 2.0, 4.0, 1e9], "none": []}
    rows = [(k, float(x)) for k, found in classes.items() for x in found] + [("none", None), ("odd", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    wanted = {r["k"]: r for r in df.groupBy("k").agg(F.expr("median(x)").alias("median"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most")).collect()}
    found = {r["k"]: r for r in analytics.by_class(df, ["k"], "x").collect()}
    assert found.keys() == wanted.keys()
    for k, row in found.items():
        for c in ("median", "mean", "least", "most"):
            assert row[c] == wanted[k][c] or np.isclose(row[c], wanted[k][c], rtol=1e-12, equal_nan=True), (k, c)
