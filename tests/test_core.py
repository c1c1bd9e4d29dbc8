"""Graph operators against a plain Python model, and argument checks."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphspan.functions import hashing as h
from graphspan.operators import attribution, features, selection, structure
from graphspan.sources.tables import Graphs

GRAPHS = {
    1: ({0: "a", 1: "b", 2: "a", 3: "c"}, {(0, 1): "x", (1, 2): "y", (2, 3): "x"}),
    2: ({0: "a", 1: "a", 2: "b"}, {(0, 1): "x", (1, 2): "x", (0, 2): "y"}),
    3: ({5: "z"}, {}),
    4: ({0: "0", 1: "1", 2: "0", 3: "1", 4: "0", 5: "2"}, {(0, 1): "0", (1, 4): "0", (0, 2): "0", (2, 4): "0", (0, 3): "0", (3, 4): "0", (4, 5): "0"}),
}


def code(x) -> int:
    return int(hashlib.sha256(str(x).encode()).hexdigest()[-8:], 16) & ((1 << 30) - 1)


def brute(radius, distance, connector, nbits):
    out = Counter()
    for gid, (labels, edges) in GRAPHS.items():
        near = {n: {} for n in labels}
        for (u, v), lab in edges.items():
            near[u][v] = near[v][u] = lab
        d = {}
        for r in labels:
            d[r], todo = {r: 0}, [r]
            for n in todo:
                for m in near[n]:
                    if m not in d[r]:
                        d[r][m] = d[r][n] + 1
                        todo.append(m)
        nh = {n: code((code(labels[n]), code(tuple(sorted(code((code(labels[m]), code(lab))) for m, lab in near[n].items()))))) for n in labels}
        cut = max(radius, connector)
        rooted = {}
        for n in labels:
            shells = []
            for k in range(cut + 1):
                own = [m for m, x in d[n].items() if x == k]
                if own:
                    shells.append(code(tuple(sorted(code(labels[m]) if k == 0 else nh[m] for m in own))))
            rooted[n] = [code(tuple(shells[: i + 1])) if i < len(shells) else 0 for i in range(cut + 1)]
        fid = lambda raw: (code(raw) & ((1 << nbits) - 3)) + 2
        for u in labels:
            out[gid, u, 0] += 1
            if near[u]:
                out[gid, u, 1] += len(near[u])
            for t, x in d[u].items():
                if x > distance:
                    continue
                for m, lab in near[t].items():
                    out[gid, u, fid(code((x, code(tuple(sorted((code(labels[t]), code(lab), code(labels[m])))))))) ] += 1
                for ci in rooted[u]:
                    for cj in rooted[t]:
                        out[gid, u, fid(code((ci, x, cj)))] += 1
                        for k in range(1, connector + 1):
                            on = [w for w in d[u] if d[u][w] + d[w][t] == x]
                            uc = code(tuple(sorted(code((d[u][w], rooted[w][k - 1])) for w in on)))
                            out[gid, u, fid(code((ci, x, cj, uc)))] += 1
    return dict(out)


@pytest.fixture(scope="module")
def graphs(spark):
    nodes = [(g, n, lab) for g, (ns, _) in GRAPHS.items() for n, lab in ns.items()]
    edges = [(g, u, v, lab) for g, (_, es) in GRAPHS.items() for (u, v), lab in es.items()]
    return Graphs(spark.createDataFrame(nodes, "graph_id long, node_id long, label string"), spark.createDataFrame(edges, "graph_id long, u long, v long, label string"))


@pytest.mark.parametrize("radius, distance, connector, nbits", [(1, 3, 0, 10), (1, 2, 1, 12), (0, 1, 2, 4)])
def test_node_features_equal_brute_force(graphs, radius, distance, connector, nbits):
    got = {(r.graph_id, r.node_id, r.feature_id): r.value for r in features.node_features(graphs, radius, distance, connector, nbits).collect()}
    assert got == brute(radius, distance, connector, nbits)


def test_counts_follow_the_formula(graphs):
    got = features.node_features(graphs, 1, 2, 1, 10).filter("feature_id >= 2").groupBy("graph_id", "node_id").agg(F.sum("value").alias("n"))
    dist = structure.distances(graphs, 2)
    deg = structure.degrees(graphs).select("graph_id", F.col("node_id").alias("node"), "neighbours")
    want = dist.join(deg, ["graph_id", "node"]).groupBy("graph_id", F.col("root").alias("node_id")).agg((F.sum("neighbours") + F.count(F.lit(1)) * 4 * 2).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_union_of_shortest_paths(graphs):
    g = Graphs(graphs.nodes.filter("graph_id = 4"), graphs.edges.filter("graph_id = 4"))
    dist = structure.distances(g, 3)
    assert {r.node for r in structure.path_nodes(dist).filter("root = 0 AND target = 4").collect()} == {0, 1, 2, 3, 4}
    assert structure.path_edges(g, dist).filter("root = 0 AND target = 4").count() == 6


def test_hash_contract(spark):
    row = spark.range(1).select(
        h.code(F.lit("1")).alias("a"), h.code(F.lit(1)).alias("b"), h.set_code(F.array(F.lit(3), F.lit(1))).alias("s1"), h.set_code(F.array(F.lit(1), F.lit(3))).alias("s2"),
        h.sequence_code(F.lit(3), F.lit(1)).alias("q1"), h.sequence_code(F.lit(1), F.lit(3)).alias("q2"), h.sequence_code(F.lit(7)).alias("one"), h.feature_id(F.lit("abc"), 8).alias("f"),
    ).first()
    assert row.a == row.b == code(1) and row.s1 == row.s2 and row.q1 != row.q2 and row.one == code((7,)) and 2 <= row.f < 256
    with pytest.raises(ValueError):
        h.feature_id(F.lit("x"), 1)


def test_archive_agrees_with_features(graphs):
    n = attribution.archive_summary(attribution.occurrences(graphs, 1, 2, 0, 6)).collect()
    f = {r.feature_id: r.n for r in features.graph_features(graphs, radius=1, distance=2, nbits=6).groupBy("feature_id").agg(F.sum("value").alias("n")).collect()}
    assert {r.feature_id: r.occurrence_count for r in n} == {k: v for k, v in f.items() if k >= 2}


def test_selection(spark):
    df = spark.range(10).select(F.col("id").alias("seq"), F.when(F.col("id") < 7, "x").otherwise("y").alias("name"))
    assert [r.seq for r in selection.offset_limit(df, "seq", 2, 3).collect()] == [2, 3, 4]
    assert Counter(r.name for r in selection.balanced(df, "seq", "name").collect()) == {"x": 3, "y": 3}
    assert Counter(r.name for r in selection.balanced(df, "seq", "name", 8).collect()) == {"x": 5, "y": 3}
    assert Counter(r.batch_id for r in selection.batches(df, "seq", 4).collect()) == {0: 4, 1: 4, 2: 2}
    assert sorted(Counter(r.chunk for r in selection.chunks(df, "seq", 3).collect()).values()) == [3, 3, 4]
    for bad in (True, -1, 1.5, "3"):
        with pytest.raises(ValueError):
            selection.offset_limit(df, "seq", 0, bad)
    with pytest.raises(ValueError):
        selection.balanced(df.filter("name = 'x'"), "seq", "name")


def test_provenance_against_sets(graphs):
    """What every occurrence covers, by plain sets, over graphs with a cycle and parallel paths."""
    connector, distance = 1, 2
    rows = attribution.occurrences(graphs, 1, distance, connector, 8, provenance=True).collect()
    want = Counter()
    for gid, (labels, edges) in GRAPHS.items():
        near = {n: set() for n in labels}
        for u, v in edges:
            near[u].add(v), near[v].add(u)
        d = {}
        for r in labels:
            d[r], todo = {r: 0}, [r]
            for n in todo:
                for m in near[n] - d[r].keys():
                    d[r][m] = d[r][n] + 1
                    todo.append(m)
        ball = lambda n, r: {m for m, x in d[n].items() if x <= r}  # noqa: B023, E731
        inside = lambda s: {e for e in edges if s >= set(e)}  # noqa: B023, E731
        for u in labels:
            for v, x in d[u].items():
                if x > distance:
                    continue
                path = {w for w in d[u] if w in d[v] and d[u][w] + d[v][w] == x}
                steps = {e for e in edges for a, b in (e, e[::-1]) if a in d[u] and b in d[v] and d[u][a] + 1 + d[v][b] == x}
                for n in near[v]:
                    want[gid, "edge_triplet", u, v, tuple(sorted(path | {v, n})), tuple(sorted(steps | {tuple(sorted((v, n)))}))] += 1
                for i in (0, 1):
                    for j in (0, 1):
                        held = ball(u, i) | ball(v, j)
                        want[gid, "paired_rooted_subgraph", u, v, tuple(sorted(held)), tuple(sorted(inside(held)))] += 1
                        want[gid, "paired_rooted_subgraph", u, v, tuple(sorted(held | path)), tuple(sorted(inside(held) | inside(path) | steps))] += 1
    assert Counter((r.graph_id, r.feature_kind, r.root_node, r.target_node, tuple(r.source_node_ids), tuple((e.u, e.v) for e in r.source_edge_ids)) for r in rows) == want
    few = attribution.occurrences(graphs, 1, 1, 0, 8, provenance=True).filter("graph_id = 2")
    sub = attribution.subgraphs(graphs, few).collect()
    assert all({n.original_node_id for n in r.nodes} >= {r.root_node, r.target_node} and all(e.label for e in r.edges) for r in sub)
    assert attribution.subgraph_nodes(graphs, few).count() == few.select(F.sum(F.size("source_node_ids"))).first()[0]
