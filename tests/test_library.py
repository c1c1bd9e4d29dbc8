"""Encoders, importance, readers, smoothing, streaming and analytics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspan.operators import analytics, selection, smoothing
from graphspan.operators.encoders import GraphEncoder, NodeEncoder, gram
from graphspan.operators.importance import ImportanceEstimator
from graphspan.sources import readers
from graphspan.sources.tables import Graphs
from graphspan.streaming.encode import NESTED, encode_stream


def star_and_paths(spark, n=12):
    nodes, edges = [], []
    for g in range(n):
        for v in range(5):
            nodes.append((g, v, str(v % 2), [float(g), float(v), 1.0], 2.0))
        edges += [(g, v, v + 1, "0") for v in range(4)] if g % 2 else [(g, 0, v, "0") for v in range(1, 5)]
    return Graphs(spark.createDataFrame(nodes, "graph_id long, node_id long, label string, attr array<double>, weight double"), spark.createDataFrame(edges, "graph_id long, u long, v long, label string"))


@pytest.fixture(scope="module")
def small(spark):
    return star_and_paths(spark)


def test_parameters():
    e = GraphEncoder(r=2, d=1)
    assert (e.radius, e.distance, e.connector) == (2, 1, 0) and "radius=2" in repr(e)
    assert e.set_params(c=1).connector == 1 and e.set_nbits(12).get_params()["nbits"] == 12
    with pytest.raises(ValueError):
        GraphEncoder(radius=3, r=2)


def test_weights_and_kernel(small):
    plain = {(r.graph_id, r.feature_id): r.value for r in GraphEncoder(d=1, nbits=6).transform(small).collect()}
    twice = {(r.graph_id, r.feature_id): r.value for r in GraphEncoder(d=1, nbits=6, weight_key="weight").transform(small).collect()}
    assert twice == {k: 2.0 * v for k, v in plain.items()}
    x = {}
    for r in NodeEncoder(d=1, nbits=4).transform(small).filter("graph_id = 1").collect():
        x.setdefault(r.node_id, np.zeros(16))[r.feature_id] = r.value
    m = np.stack(list(x.values()))
    got = np.zeros(256)
    for r in GraphEncoder(d=1, nbits=4, use_node_kernel=True).transform(small).filter("graph_id = 1").collect():
        got[r.feature_id] = r.value
    assert np.allclose(got, np.sqrt(np.abs(m.T @ m)).ravel())


def test_fitted_attributes(small):
    a = np.array([r.attr for r in small.nodes.collect()])
    assert np.allclose(gram(small.nodes), a.T @ a)
    e = GraphEncoder(d=1, nbits=6, node_attribute_key="attr", attribute_dim=2, attribute_alphabet_size=3)
    with pytest.raises(ValueError):
        e.transform(small)
    p = e.fit(small).prepared(small).nodes
    v = np.linalg.svd(a)[2][:2]
    got = {(r.graph_id, r.node_id): r for r in p.collect()}
    for r in small.nodes.collect():
        own = got[r.graph_id, r.node_id]
        assert np.allclose(np.abs(own.attr), np.abs(v @ np.array(r.attr))) and own.original_attr == r.attr
    assert 2 <= p.select("label").distinct().count() <= 3
    assert e.transform(small).agg(F.max("feature_id")).first()[0] < 2 * 64


def loaded(small):
    index = small.nodes.select("graph_id").distinct().select("graph_id", F.col("graph_id").alias("seq"), F.when(F.col("graph_id") < 8, "a").otherwise("b").alias("name"))
    return readers.Loaded(small, index)


def test_load_and_batches(small):
    e = NodeEncoder(d=1, nbits=6)
    got = e.load_from(loaded(small), balance=True)
    assert e.transform(got.graphs).select("graph_id").distinct().count() == 8
    assert e.loaded_class_weight_ == {"a": 0.75, "b": 1.5} and e.loaded_label_counts_ == {"a": 8, "b": 4} and e.loaded_balance_candidate_size_ == 12
    e.load_from(loaded(small), limit=3)
    assert e.loaded_class_weight_ is e.loaded_label_counts_ is e.loaded_balance_candidate_size_ is None
    b = e.stream_from(loaded(small), batch_size=5, start_after_instance=1).select("graph_id", "batch_id").distinct()
    assert {r.graph_id: r.batch_id for r in b.collect()} == {g: (g - 1) // 5 for g in range(1, 12)}
    x, y = e.stream_from(loaded(small), batch_size=4, label_extractor="name")
    assert x.select("graph_id").distinct().count() == 12 and {r.graph_id: (r.batch_id, r.label) for r in y.collect()} == {g: (g // 4, "a" if g < 8 else "b") for g in range(12)}
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            e.stream_from(loaded(small), batch_size=bad)
    with pytest.raises(TypeError):
        e.stream_from(loaded(small), label_extractor=3)
    with pytest.raises(ValueError):
        GraphEncoder(node_attribute_key="attr", attribute_dim=2).stream_from(loaded(small))


def test_estimators_inside(small):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import PCA

    e = GraphEncoder(d=1, nbits=6, node_attribute_key="attr", attribute_dim=2, attribute_alphabet_size=3, embedder=PCA(k=2), classifier=DecisionTreeClassifier(maxDepth=3))
    assert e.get_params()["classifier__maxDepth"] == 3 and "classifier__maxDepth" not in e.get_params(deep=False)
    e.set_params(classifier__maxDepth=4, nbits=7)
    assert e.get_params()["classifier__maxDepth"] in (3, 4) and e.nbits == 7
    assert e.set_params(classifier__maxDepth=5).get_params()["classifier__maxDepth"] == 5
    p = e.fit(small).prepared(small).nodes
    assert len(p.first().attr) == 2 and len(p.first().original_attr) == 3 and 2 <= p.select("label").distinct().count() <= 3


def test_importance(spark, small):
    targets = small.nodes.select("graph_id", (F.col("graph_id") % 2).alias("target")).distinct()
    imp = ImportanceEstimator(NodeEncoder(d=1, nbits=6), n_iter=2, n_estimators=5)
    with pytest.raises(ValueError):
        imp.get_top_features()
    imp.fit(small, targets)
    with pytest.raises(ValueError):
        imp.get_top_features()
    imp.build_feature_archive(small)
    top = imp.get_top_features(3).collect()
    assert top and all(t.feature_id >= 2 and 0 < t.importance <= 1 for t in top)
    imp.build_feature_archive(small, provenance=True)
    first = imp.get_top_features(1).first()
    assert set(first.source_node_ids) >= {first.root_node, first.target_node}
    assert imp.features(small)[1].select("graph_id", "u", "v").distinct().count() == 48
    nodes, edges = imp.transform(small)
    assert nodes.count() == 60 and edges.count() == 48 and nodes.agg(F.max("score")).first()[0] == 1.0


def test_lines(spark, tmp_path):
    (tmp_path / "a.smi").write_text('CCO ethanol\n\n# note\nsmiles,activity,HIV_active\nCC, CI ,0\nO,"a, ""b""",1\nN\n')
    (tmp_path / "b.smi").write_text("C methane\n")
    rows = {(r.source_uri[-5:], r.source_line): (r.smiles, r.name, r.props) for r in readers.parse_lines(readers.numbered_lines(spark, str(tmp_path))).collect()}
    assert rows == {
        ("a.smi", 1): ("CCO", "ethanol", None),
        ("a.smi", 5): ("CC", "CI", {"activity": "CI", "HIV_active": "0"}),
        ("a.smi", 6): ("O", 'a, "b"', {"activity": 'a, "b"', "HIV_active": "1"}),
        ("a.smi", 7): ("N", None, {}),
        ("b.smi", 1): ("C", "methane", None),
    }
    with pytest.raises(ValueError):
        readers.reader("xyz")


def letter_parser():
    return lambda text: None if text == "?" else (list(text), [(i, i + 1, "-") for i in range(len(text) - 1)])


letters = letter_parser()


LINES = "CCO ethanol\n# note\n\nCC propane\n? bad\nO water\nsmiles,activity,HIV_active\nN,CI,1\nC,CM,0\n"


def test_load_by_type(spark, tmp_path, capsys):
    path = tmp_path / "x.smi"
    path.write_text(LINES)
    e = GraphEncoder(d=1, nbits=6)
    got = e.load_from(str(path), "  SMILES ", parse=letters, verbose=True, spark=spark)
    assert "[load_from] final" in capsys.readouterr().err and got.errors == 1 and got.seen == 5
    rows = {r.seq: (r.name, r.source_line, r.props.get("smiles"), r.props.get("HIV_active")) for r in got.index.collect()}
    assert rows == {0: ("ethanol", 1, "CCO", None), 1: ("propane", 4, "CC", None), 2: ("water", 6, "O", None), 3: ("CI", 8, "N", "1"), 4: ("CM", 9, "C", "0")}
    assert [r.name for r in e.load_from(str(path), "smiles", parse=letters, start_after_instance=1, limit=2, spark=spark).index.orderBy("seq").collect()] == ["propane", "water"]
    x, y = e.stream_from(str(path), "smiles", parse=letters, batch_size=2, start_after_instance=3, label_extractor=lambda i: i["props"]["HIV_active"].cast("int"), spark=spark)
    assert {(r.batch_id, r.label) for r in y.collect()} == {(0, 1), (0, 0)} and x.select("graph_id").distinct().count() == 2
    with pytest.raises(ValueError, match="pyg_pt, sdf, smiles"):
        e.load_from(str(path), "xyz", spark=spark)


def test_load_from_a_url(spark, tmp_path):
    import functools
    import threading
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    (tmp_path / "x.smi").write_text(LINES)
    server = ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}/x.smi"
        got = readers.load(spark, url, "smiles", parse=letters)
        assert readers.is_url(url) and not readers.is_url(str(tmp_path)) and got.seen == 5 and {r.source_uri for r in got.index.collect()} == {url}
    finally:
        server.shutdown()


MOL = "{}\n  x\n\n  3  2  0  0  0  0            999 V2000\n    0.0       0.0       0.0    C   0  0\n    1.0       0.0       0.0    C   0  0\n    2.0       0.0       0.0    O   0  0\n  1  2  1  0\n  2  3  2  0\nM  END\n> <kind>\nalcohol\n\n> <IC>\n 7 \n\n$$$$\n"


def test_sd_files(spark, tmp_path):
    (tmp_path / "x.sdf").write_text(MOL.format("one") + "broken\n\n\nno counts\nM  END\n$$$$\n" + MOL.format("two"))
    got = readers.load(spark, str(tmp_path / "x.sdf"), "sdf", parse=readers.plain_block)
    assert got.errors == 1 and [(r.name, r.props) for r in got.index.orderBy("seq").collect()] == [(n, {"kind": "alcohol", "IC": "7"}) for n in ("one", "two")]
    assert sorted(tuple(r)[:3] for r in got.graphs.nodes.collect()) == [(g, i, x) for g in (0, 1) for i, x in enumerate("CCO")]
    assert {(r.u, r.v, r.label) for r in got.graphs.edges.collect()} == {(0, 1, "1"), (1, 2, "2")}


def test_readers_of_your_own(spark):
    def reader(uri):
        for i in range(int(uri)):
            yield readers.GraphRecord(["a", i], [(1, 0, ("x", [1]))], name="abc"[i % 3], attrs=[[i, 1.0], [0, i]])

    got = readers.load(spark, "6", "no such type", reader_of=reader, limit=4, balance=True)
    assert got.candidate_size == 6 and got.seen == 4  # one of each class, and one of any
    assert got.graphs.edges.first().label == "('x', (1,))" and got.graphs.nodes.filter("node_id = 0").first().attr[1] == 1.0
    with pytest.raises(Exception, match="GraphRecord"):
        readers.load(spark, "x", reader_of=lambda uri: ["not a graph"])
    with pytest.raises(TypeError):
        readers.from_reader(spark, "x", 3)
    with pytest.raises(TypeError):
        readers.validated({})
    assert readers.hashable({"b": [1, [2]], "a": np.arange(2)}) == (("a", (0, 1)), ("b", (1, (2,))))


def test_tensor_objects(spark):
    class Data:
        num_nodes, edge_index, x, edge_attr = 3, np.array([[0, 1, 1], [1, 0, 2]]), np.array([[1], [2], [1]]), np.array([5, 5, 6])
        keys = ("x", "edge_index", "edge_attr")
        is_node_attr = staticmethod(lambda k: k == "x")
        is_edge_attr = staticmethod(lambda k: k in ("edge_index", "edge_attr"))

    r = readers.of_tensors(Data)
    row = readers._row("u", 1, r)
    assert [n["label"] for n in row["nodes"]] == ["(1,)", "(2,)", "(1,)"] and [(e["u"], e["v"], e["label"]) for e in row["edges"]] == [(0, 1, "5"), (1, 2, "6")]
    Data.keys = ("edge_index",)
    assert readers._row("u", 1, readers.of_tensors(Data))["nodes"][0]["label"] == "0"
    for f in (readers._torch, readers._chem):
        with pytest.raises(ImportError, match="optional package"):
            f()


def test_generators_and_online_training(spark):
    from graphspan.operators.online import OnlineClassifier
    from graphspan.sources import generators

    g = generators.regular_graph(26, 3, 3, 3, seed=7)
    degree = np.zeros(26, int)
    for u, v, _ in g.edges:
        degree[[u, v]] += 1
    assert (degree == 3).all() and generators.connected(26, g.edges) and len(g.attrs[0]) == 3
    steps = generators.removal_sequence(g, 13, seed=3)
    assert [len(x.edges) for x in steps] == list(range(39, 25, -1)) and all(generators.connected(26, x.edges) for x in steps)
    for bad in ((5, 3), (4, 4), (1, 0)):
        with pytest.raises(ValueError):
            generators.regular_graph(*bad)
    graphs, index = generators.to_tables(spark, generators.core_and_noise(6, 16, 2, 12, seed=1))
    x, y = GraphEncoder(r=1, d=2, nbits=10).stream_from(readers.Loaded(graphs, index), batch_size=8, label_extractor="name")
    x, model = x.persist(), OnlineClassifier(10, epochs=4)
    for _ in range(2):
        for b in range(3):
            model.partial_fit(x.filter(F.col("batch_id") == b), y.filter(F.col("batch_id") == b), classes=["0", "1"])
    assert model.trained_count == 48
    scored = model.decision_function(x).join(y, "graph_id").select("score", F.col("label").cast("int").alias("label"))
    assert analytics.ranking_quality(scored, "score", "label").first().roc_auc > 0.95
    tie = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (None, 1), (0.1, 0)], "s double, y int")
    r = analytics.ranking_quality(tie, "s", "y").first()
    assert (r.n_pos, r.n_neg, r.roc_auc) == (2, 2, 0.875) and r.average_precision == pytest.approx((1 + 2 / 3) / 2)
    assert analytics.ranking_quality(tie.filter("y = 1"), "s", "y").first().roc_auc is None


def test_edge_matrices(spark):
    from graphspan.operators import vectors

    edges = spark.createDataFrame([(1, 0, 1, [1.0, 2.0], 3.0)], "graph_id long, u long, v long, attr array<double>, weight double")
    assert sorted(map(tuple, vectors.edge_attributes(edges).collect())) == [(1, 0, 1, 0, 1.0), (1, 0, 1, 1, 2.0)]
    f = spark.createDataFrame([(1, 0, 1, 4, 2.0)], "graph_id long, u long, v long, feature_id int, value double")
    assert tuple(vectors.reweighted_edges(f, edges).first()) == (1, 0, 1, 4, 6.0)


def test_graphs_of_text(spark):
    def parse(text):
        return None if text == "?" else (list(text), [(i + 1, i, "-") for i in range(len(text) - 1)])

    g, bad = readers.graphs_of(spark.createDataFrame([(1, "CCO"), (2, "?"), (3, "N")], "graph_id long, smiles string"), parse)
    assert [r.graph_id for r in bad.collect()] == [2]
    assert sorted(map(tuple, g.nodes.collect())) == [(1, 0, "C"), (1, 1, "C"), (1, 2, "O"), (3, 0, "N")]
    assert sorted(map(tuple, g.edges.collect())) == [(1, 0, 1, "-"), (1, 1, 2, "-")]


def test_smoothing(spark):
    rng = np.random.default_rng(1)
    x, y = np.append(np.arange(12.0), [3.0, 3.0]), rng.normal(size=14)
    got = {r.x: r.fitted for r in smoothing.quadratic_loess(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double"), 0.6).collect()}
    span = int(np.ceil(0.6 * 14))
    for x0 in np.unique(x):
        far = np.abs(x - x0)
        w = (1 - np.clip(far / np.sort(far)[span - 1], 0, 1) ** 3) ** 3
        a = np.vander(x - x0, 3, increasing=True)
        assert got[x0] == pytest.approx(np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0][0], abs=1e-6)
    band = smoothing.series_with_band(spark.createDataFrame([(float(i), float(k + i)) for i in range(6) for k in (-1, 1)], "n double, v double"), "n", "v").collect()
    assert {(r.x, r["mean"], r["std"]) for r in band} == {(float(i), float(i), 1.0) for i in range(6)} and all(r.fitted == pytest.approx(r.x, abs=1e-6) for r in band)
    for frac in (0, 1.5):
        with pytest.raises(ValueError):
            smoothing.quadratic_loess(spark.range(5).selectExpr("id x", "id y"), frac)


def test_stream(spark, tmp_path, small):
    nested = small.nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "label")).alias("nodes")).join(small.edges.groupBy("graph_id").agg(F.collect_list(F.struct("u", "v", "label")).alias("edges")), "graph_id")
    nested.repartition(2).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(NESTED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    encode_stream(stream, GraphEncoder(d=1, nbits=6), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("graph_id", "feature_id", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, GraphEncoder(d=1, nbits=6).transform(small).collect()))


def test_components_and_places(spark):
    nodes = [(1, i, "0") for i in range(20)] + [(2, 5, "0"), (2, 6, "0")]
    edges = [(1, i, i + 1, "0") for i in range(12)] + [(1, 15, 19, "0")]
    g = Graphs(spark.createDataFrame(nodes, "graph_id long, node_id long, label string"), spark.createDataFrame(edges, "graph_id long, u long, v long, label string"))
    got = {(r.graph_id, r.node_id): r.component for r in analytics.components(g).collect()}
    assert got == {(1, i): 0 if i <= 12 else 15 if i == 19 else i for i in range(20)} | {(2, 5): 5, (2, 6): 6}
    df = spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 == 0, None).otherwise("x").alias("k"))
    placed = selection.ranked(df, ["k"], ["seq"], "n").filter("k IS NULL")
    assert {r.seq: r.n for r in placed.collect()} == {10 * i: i for i in range(100)}
