"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing as h
from .functions.hashing import sql
from .operators import analytics, attribution, features, selection, smoothing, structure, vectors
from .operators.encoders import GraphEncoder, NodeEncoder
from .plans import oracle
from .sources import readers
from .sources.tables import EMBEDDING_SQL, ORDER_SQL, SESSION_SQL, embedding_graphs, order_graphs, read, session_graphs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, text: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, text
        return f

    return add


def _importance(spark: SparkSession, nbits: int) -> DataFrame:
    """A fixed importance for each possible feature, in place of a fitted one."""
    f = spark.range(1 << nbits).select(F.col("id").cast("int").alias("feature_id"))
    return f.select("feature_id", (F.pmod(F.col("feature_id").cast("long") * 7919, F.lit(1000)) / 1024.0).alias("importance"))


_IMPORTANCE_SQL = "(CAST(feature_id AS BIGINT) * 7919 % 1000) / 1024.0"
_GRAPH = {"radius": 1, "distance": 2, "nbits": 10}
_NODE = {"radius": 1, "distance": 1, "nbits": 10}

# --- scalar hashes ---


@register("hash_scalars", f"""SELECT p_partkey, {sql.code('p_brand')} AS code, {sql.code('p_brand')} & 1048575 AS masked, {sql.feature_id('p_brand', 8)} AS feature_id,
    {sql.sequence_code('p_brand')} AS one, {sql.sequence_code('p_partkey', 'p_size')} AS sequence, {sql.set_code('[p_partkey, CAST(p_size AS BIGINT), p_partkey]')} AS multiset, {sql.set_code('CAST([] AS BIGINT[])')} AS empty FROM part""")
def hash_scalars(spark, d):
    p = read(spark, d, "part")
    b = F.col("p_brand")
    return p.select("p_partkey", h.code(b).alias("code"), h.masked(b).alias("masked"), h.feature_id(b, 8).alias("feature_id"), h.sequence_code(b).alias("one"), h.sequence_code(F.col("p_partkey"), F.col("p_size")).alias("sequence"),
                    h.set_code(F.array(F.col("p_partkey"), F.col("p_size").cast("long"), F.col("p_partkey"))).alias("multiset"), h.set_code(F.array().cast("array<bigint>")).alias("empty"))


# --- structure ---

_BASE = f"WITH {ORDER_SQL}, {oracle.CODES}"


@register("degrees", f"{_BASE} SELECT graph_id, node_id, CAST(degree AS BIGINT) AS degree, neighbours FROM dg")
def degrees(spark, d):
    return structure.degrees(order_graphs(spark, d).together())


@register("node_codes", f"{_BASE} SELECT * FROM nc")
def node_codes(spark, d):
    return structure.node_codes(order_graphs(spark, d))


@register("edge_triplets", f"{_BASE} SELECT * FROM tr")
def edge_triplets(spark, d):
    return structure.triplet_codes(order_graphs(spark, d))


@register("bfs_distances", f"WITH {ORDER_SQL}, {oracle.distances(3)} SELECT * FROM dist")
def bfs_distances(spark, d):
    return structure.distances(order_graphs(spark, d), 3)


@register("node_balls", f"WITH {SESSION_SQL}, {oracle.distances(2)} SELECT graph_id, root AS center, node FROM dist")
def node_balls(spark, d):
    return structure.ball(structure.distances(session_graphs(spark, d), 2), 2)


@register("induced_edges", f"""WITH {SESSION_SQL}, {oracle.distances(2)} SELECT a.graph_id, a.root AS center, e.u, e.v FROM dist a
    JOIN edges e ON a.graph_id = e.graph_id AND a.node = e.u JOIN dist b ON b.graph_id = e.graph_id AND b.root = a.root AND b.node = e.v""")
def induced_edges(spark, d):
    g = session_graphs(spark, d).together()
    return structure.induced_edges(g, structure.ball(structure.distances(g, 2), 2))


@register("path_union_nodes", f"WITH {ORDER_SQL}, {oracle.distances(2)}, {oracle.PATHS} SELECT * FROM pn")
def path_union_nodes(spark, d):
    return structure.shortest_path_nodes(order_graphs(spark, d), 2)


@register("path_union_edges", f"""WITH {ORDER_SQL}, {oracle.distances(2)} SELECT a.graph_id, a.root, st.node AS target, least(j.src, j.dst) AS u, greatest(j.src, j.dst) AS v FROM dist a
    JOIN adj j ON a.graph_id = j.graph_id AND a.node = j.src JOIN dist b ON b.graph_id = j.graph_id AND b.root = j.dst
    JOIN dist st ON st.graph_id = a.graph_id AND st.root = a.root AND st.node = b.node AND a.d + 1 + b.d = st.d""")
def path_union_edges(spark, d):
    return structure.shortest_path_edges(order_graphs(spark, d), 2)


@register("rooted_codes", f"{_BASE}, {oracle.distances(2)}, {oracle.rooted(2)} SELECT * FROM rc")
def rooted_codes(spark, d):
    return structure.rooted_codes(order_graphs(spark, d), 2)


@register("rooted_codes_threshold", f"{_BASE}, {oracle.distances(2)}, {oracle.rooted(2, 3)} SELECT * FROM rc")
def rooted_codes_threshold(spark, d):
    return structure.rooted_codes(order_graphs(spark, d), 2, 3)


@register("connector_codes", f"{_BASE}, {oracle.distances(2)}, {oracle.rooted(1)}, {oracle.connectors(1)} SELECT * FROM uc1")
def connector_codes(spark, d):
    return structure.shortest_path_codes(order_graphs(spark, d), 2, 1, 1)


# --- features ---


@register("graph_features", oracle.features(ORDER_SQL, **_GRAPH, per_graph=True))
def graph_features(spark, d):
    return features.graph_features(order_graphs(spark, d), **_GRAPH)


@register("node_features", oracle.features(ORDER_SQL, **_NODE))
def node_features(spark, d):
    return features.node_features(order_graphs(spark, d), **_NODE)


@register("graph_features_connector", oracle.features(ORDER_SQL, 1, 2, connector=1, nbits=12, per_graph=True))
def graph_features_connector(spark, d):
    return features.graph_features(order_graphs(spark, d), radius=1, distance=2, connector=1, nbits=12)


@register("graph_features_threshold", oracle.features(ORDER_SQL, 1, 1, nbits=10, degree_threshold=3, use_edges=False, per_graph=True))
def graph_features_threshold(spark, d):
    return features.graph_features(order_graphs(spark, d), radius=1, distance=1, degree_threshold=3, use_edges=False)


@register("node_features_sigma", oracle.features(SESSION_SQL, 1, 2, nbits=10, sigma=2.0))
def node_features_sigma(spark, d):
    return features.node_features(session_graphs(spark, d), radius=1, distance=2, sigma=2.0).withColumn("value", F.round("value", 6))


# --- matrices ---


@register("weighted_features", f"SELECT f.graph_id, f.node_id, f.feature_id, round(f.value * e.value, 6) AS value FROM ({oracle.features(SESSION_SQL, 1, 1)}) f JOIN events e ON f.node_id = e.event_id")
def weighted_features(spark, d):
    return vectors.weighted_features(session_graphs(spark, d), radius=1, distance=1).withColumn("value", F.round("value", 6))


_EMB = oracle.features(EMBEDDING_SQL, 1, 1, nbits=6)
_ATTR = "(SELECT CAST(label AS BIGINT) AS graph_id, vec_id AS node_id, unnest(embedding)::DOUBLE AS a, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


@register("attribute_graph_vectors", f"SELECT f.graph_id, CAST(a.dim * 64 + f.feature_id AS INTEGER) AS feature_id, round(sum(a.a * f.value), 6) AS value FROM ({_EMB}) f JOIN {_ATTR} a USING (graph_id, node_id) GROUP BY f.graph_id, a.dim, f.feature_id")
def attribute_graph_vectors(spark, d):
    g = embedding_graphs(spark, d)
    return vectors.attribute_graph_vectors(features.node_features(g, radius=1, distance=1, nbits=6), g.nodes, 6).withColumn("value", F.round("value", 6))


@register("attribute_node_vectors", f"""WITH f AS ({_EMB}), a AS {_ATTR}, y AS (SELECT graph_id, dim, feature_id, sum(a.a * f.value) AS y FROM f JOIN a USING (graph_id, node_id) GROUP BY ALL),
    z AS (SELECT f.graph_id, f.node_id, y.dim, sum(f.value * y.y) AS z FROM f JOIN y USING (graph_id, feature_id) GROUP BY ALL)
    SELECT graph_id, node_id, CAST(dim AS INTEGER) AS feature_id, round(a, 4) AS value FROM a UNION ALL SELECT graph_id, node_id, CAST(dim + 64 AS INTEGER), round(pow(abs(z), 1.0 / 3), 4) FROM z UNION ALL SELECT graph_id, node_id, CAST(feature_id + 128 AS INTEGER), CAST(value AS DOUBLE) FROM f""")
def attribute_node_vectors(spark, d):
    g = embedding_graphs(spark, d)
    return vectors.attribute_node_vectors(features.node_features(g, radius=1, distance=1, nbits=6), g.nodes, 64).withColumn("value", F.round("value", 4))


@register("node_kernel", f"""WITH f AS ({oracle.features(SESSION_SQL, 1, 1, nbits=6)}) SELECT a.graph_id, CAST(b.feature_id AS BIGINT) * 64 + a.feature_id AS feature_id, round(sqrt(abs(sum(a.value * b.value))), 6) AS value
    FROM f a JOIN f b USING (graph_id, node_id) GROUP BY a.graph_id, b.feature_id, a.feature_id""")
def node_kernel(spark, d):
    return vectors.graph_kernel(session_graphs(spark, d), radius=1, distance=1, nbits=6).withColumn("value", F.round("value", 6))


@register("cosine_kernel", f"""WITH f AS ({oracle.features(EMBEDDING_SQL, 1, 2, per_graph=True)}), n AS (SELECT graph_id, sqrt(sum(value * value)) AS norm FROM f GROUP BY graph_id)
    SELECT a.graph_id AS g1, b.graph_id AS g2, round(sum(a.value / na.norm * (b.value / nb.norm)), 6) AS cosine FROM f a JOIN f b ON a.feature_id = b.feature_id AND a.graph_id < b.graph_id
    JOIN n na ON na.graph_id = a.graph_id JOIN n nb ON nb.graph_id = b.graph_id GROUP BY ALL""")
def cosine_kernel(spark, d):
    return vectors.cosine(features.graph_features(embedding_graphs(spark, d), radius=1, distance=2)).withColumn("cosine", F.round("cosine", 6))


# --- selection ---


@register("offset_limit", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 37")
def offset_limit(spark, d):
    return selection.offset_limit(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 37, 100)


@register("bernoulli", f"SELECT o_orderkey FROM orders WHERE {sql.code(chr(39) + 'sample:7:' + chr(39) + ' || o_orderkey')} % 1000000 < 250000")
def bernoulli(spark, d):
    return selection.bernoulli(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.25, 7)


@register("class_weights", "SELECT o_orderstatus AS label, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM orders GROUP BY o_orderstatus")
def class_weights(spark, d):
    return selection.class_weights(read(spark, d, "orders"), "o_orderstatus")


_DRAW = sql.code("'balance:3:' || o_orderkey")


@register("balanced", f"""WITH c AS (SELECT count(*) AS k, min(n) AS least FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)),
    r AS (SELECT o_orderkey, o_orderstatus, {_DRAW} AS x, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_DRAW}, o_orderkey) AS rank FROM orders),
    p AS (SELECT r.*, least(c.least, 1000 // c.k) AS per, c.k FROM r, c),
    o AS (SELECT *, row_number() OVER (ORDER BY x, o_orderkey) AS over_rank FROM p WHERE rank > per)
    SELECT o_orderkey, o_orderstatus FROM p WHERE rank <= per UNION ALL SELECT o_orderkey, o_orderstatus FROM o WHERE over_rank <= 1000 - per * k""")
def balanced(spark, d):
    return selection.balanced(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 1000, 3)


@register("batches", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 128 AS BIGINT) AS batch_id FROM orders")
def batches(spark, d):
    return selection.batches(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 128)


@register("chunks", "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS chunk FROM orders")
def chunks(spark, d):
    return selection.chunks(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


# --- archive and importance ---

_OCC = f"{_BASE}, {oracle.distances(1)}, {oracle.rooted(1)}, {oracle.raw(1)}, oc AS (SELECT {sql.feature_id('raw', 8)} AS feature_id, raw FROM rw)"


@register("archive_summary", f"{_OCC} SELECT feature_id, count(*) AS occurrence_count, count(DISTINCT raw) AS raw_signature_count FROM oc GROUP BY feature_id")
def archive_summary(spark, d):
    return attribution.graph_summary(order_graphs(spark, d), radius=1, distance=1, nbits=8)


@register("top_features", f"{_OCC} SELECT feature_id, {_IMPORTANCE_SQL} AS importance, count(*) AS occurrence_count, count(DISTINCT raw) AS raw_signature_count FROM oc GROUP BY feature_id HAVING {_IMPORTANCE_SQL} > 0 ORDER BY importance DESC, feature_id LIMIT 10")
def top_features(spark, d):
    return attribution.top_graph_features(_importance(spark, 8), order_graphs(spark, d), radius=1, distance=1, nbits=8).select("feature_id", "importance", "occurrence_count", "raw_signature_count")


_PROVENANCE = {"radius": 1, "distance": 1, "nbits": 10}


@register("archive_provenance", f"""SELECT feature_id, raw_signature, feature_kind, graph_id, root_node, target_node, array_to_string(source_node_ids, ',') AS nodes,
    array_to_string([e.u || '-' || e.v FOR e IN source_edge_ids], ',') AS edges FROM ({oracle.provenance(SESSION_SQL, connector=1, **_PROVENANCE)})""")
def archive_provenance(spark, d):
    occ = attribution.occurrences(session_graphs(spark, d), connector=1, provenance=True, **_PROVENANCE)
    edges = F.transform("source_edge_ids", lambda e: F.concat_ws("-", e["u"], e["v"]))
    return occ.select(*attribution.OCCURRENCE, F.array_join("source_node_ids", ",").alias("nodes"), F.array_join(edges, ",").alias("edges"))


@register("archive_subgraph_edges", f"""SELECT o.* EXCLUDE (source_node_ids, source_edge_ids, e), o.e.u AS u, o.e.v AS v, x.label FROM (SELECT *, unnest(source_edge_ids) AS e FROM ({oracle.provenance(SESSION_SQL, **_PROVENANCE)})) o
    JOIN (WITH {SESSION_SQL} SELECT * FROM edges) x ON x.graph_id = o.graph_id AND x.u = o.e.u AND x.v = o.e.v""")
def archive_subgraph_edges(spark, d):
    return attribution.occurrence_edges(session_graphs(spark, d), **_PROVENANCE)


_SCORE = f"""WITH f AS ({oracle.features(ORDER_SQL, **_NODE)}), s AS (SELECT graph_id, node_id, sum(value * {_IMPORTANCE_SQL}) AS score FROM f GROUP BY graph_id, node_id),
    n AS (SELECT graph_id, node_id, score / CASE WHEN max(score) OVER (PARTITION BY graph_id) > 0 THEN max(score) OVER (PARTITION BY graph_id) ELSE 1 END AS score FROM s)"""


def _scores(spark, d):
    return attribution.graph_scores(order_graphs(spark, d), _importance(spark, 10), **_NODE)


@register("node_importance", f"{_SCORE} SELECT graph_id, node_id, score FROM n")
def node_importance(spark, d):
    return _scores(spark, d)


@register("edge_importance", f"""SELECT x.graph_id, x.u, x.v, a.score * b.score AS score FROM (WITH {ORDER_SQL} SELECT * FROM edges) x
    JOIN ({_SCORE} SELECT * FROM n) a ON x.graph_id = a.graph_id AND x.u = a.node_id JOIN ({_SCORE} SELECT * FROM n) b ON x.graph_id = b.graph_id AND x.v = b.node_id""")
def edge_importance(spark, d):
    return attribution.graph_scores(order_graphs(spark, d), _importance(spark, 10), edges=True, **_NODE)


@register("edge_feature_sums", f"""SELECT e.graph_id, e.u, e.v, f.feature_id, CAST(sum(f.value) AS BIGINT) AS value FROM (SELECT graph_id, u, v, unnest([u, v]) AS node_id FROM (WITH {SESSION_SQL} SELECT * FROM edges)) e
    JOIN ({oracle.features(SESSION_SQL, **_NODE)}) f USING (graph_id, node_id) GROUP BY e.graph_id, e.u, e.v, f.feature_id""")
def edge_feature_sums(spark, d):
    return attribution.edge_feature_sums(session_graphs(spark, d), **_NODE)


@register("importance_by_class_part", f"""{_SCORE} SELECT o_orderstatus, part, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS least, round(max(score), 6) AS most
    FROM (SELECT *, CASE WHEN node_id = 0 THEN 'order' WHEN node_id % 2 = 1 THEN 'part' ELSE 'supplier' END AS part FROM n) JOIN orders ON graph_id = o_orderkey GROUP BY o_orderstatus, part""")
def importance_by_class_part(spark, d):
    part = F.when(F.col("node_id") == 0, "order").when(F.col("node_id") % 2 == 1, "part").otherwise("supplier")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("graph_id"), "o_orderstatus")
    found = analytics.by_class(_scores(spark, d).withColumn("part", part).join(o, "graph_id"), ["o_orderstatus", "part"], "score")
    return found.select("o_orderstatus", "part", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "least", "most")])


@register("importance_postprocess", """WITH r AS (SELECT l_suppkey AS feature_id, l_linenumber AS run, avg(l_discount) AS importance FROM lineitem GROUP BY 1, 2),
    s AS (SELECT feature_id, greatest(avg(importance) - stddev_pop(importance), 0) AS w FROM r GROUP BY feature_id),
    q AS (SELECT quantile_cont(w, 0.5) AS q, max(w) AS m FROM s)
    SELECT feature_id, round(CASE WHEN w < q THEN 0 ELSE w END / CASE WHEN m > 0 THEN m ELSE 1 END, 6) AS importance FROM s, q""")
def importance_postprocess(spark, d):
    runs = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("feature_id"), F.col("l_linenumber").alias("run")).agg(F.avg("l_discount").alias("importance"))
    return attribution.postprocess(runs, 0.5).withColumn("importance", F.round("importance", 6))


# --- analytics ---


@register("graph_stats", f"""{_BASE}, n AS (SELECT graph_id, count(*) AS n_nodes, count(DISTINCT label) AS n_labels FROM nodes GROUP BY graph_id), e AS (SELECT graph_id, count(*) AS n_edges FROM edges GROUP BY graph_id),
    d AS (SELECT graph_id, CAST(min(degree) AS BIGINT) AS min_degree, CAST(max(degree) AS BIGINT) AS max_degree FROM dg GROUP BY graph_id)
    SELECT graph_id, n_nodes, coalesce(n_edges, 0) AS n_edges, round(CASE WHEN n_nodes > 1 THEN 2 * coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)) ELSE 0 END, 6) AS density, n_labels, min_degree, max_degree
    FROM n LEFT JOIN e USING (graph_id) JOIN d USING (graph_id)""")
def graph_stats(spark, d):
    return analytics.graph_stats(order_graphs(spark, d))


@register("feature_nonzeros", f"""WITH f AS ({oracle.features(ORDER_SQL, **_GRAPH, per_graph=True)}) SELECT graph_id, count(*) AS nnz, CAST(sum(value) FILTER (WHERE feature_id = 0) AS BIGINT) AS n_nodes, CAST(sum(value) FILTER (WHERE feature_id = 1) AS BIGINT) AS degree_sum FROM f GROUP BY graph_id""")
def feature_nonzeros(spark, d):
    return analytics.nonzeros(features.graph_features(order_graphs(spark, d), **_GRAPH))


@register("graph_components", f"""WITH RECURSIVE {ORDER_SQL.strip()}, reach AS (SELECT graph_id, node_id AS root, node_id FROM nodes UNION SELECT r.graph_id, r.root, a.dst FROM reach r JOIN adj a ON r.graph_id = a.graph_id AND r.node_id = a.src),
    c AS (SELECT graph_id, root, min(node_id) AS component FROM reach GROUP BY graph_id, root), z AS (SELECT graph_id, component, count(*) AS size FROM c GROUP BY graph_id, component)
    SELECT graph_id, count(*) AS n_components, max(size) AS largest, count(*) = 1 AS connected FROM z GROUP BY graph_id""")
def graph_components(spark, d):
    return analytics.component_stats(order_graphs(spark, d))


@register("class_degrees", f"""{_BASE}, m AS (SELECT graph_id, min(degree) AS least, max(degree) AS most FROM dg GROUP BY graph_id), k AS (SELECT graph_id, 'least' AS kind, least AS x FROM m UNION ALL SELECT graph_id, 'most', most FROM m)
    SELECT o_orderstatus, kind, round(avg(x), 6) AS mean, median(x) AS median, round(stddev_pop(x), 6) AS std, CAST(min(x) AS BIGINT) AS least, CAST(max(x) AS BIGINT) AS most FROM k JOIN orders ON graph_id = o_orderkey GROUP BY o_orderstatus, kind""")
def class_degrees(spark, d):
    g = order_graphs(spark, d).together()
    deg = structure.degrees(g).groupBy("graph_id").agg(F.min("degree").alias("least"), F.max("degree").alias("most"))
    both = deg.select("graph_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("x")) for k in ("least", "most")])).alias("k")).select("graph_id", "k.*")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("graph_id"), "o_orderstatus")
    return analytics.by_class(both.join(o, "graph_id"), ["o_orderstatus", "kind"], "x").withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@register("ranking_quality", """WITH s AS (SELECT l_discount * 100 + l_tax AS s, CAST(l_returnflag = 'R' AS BIGINT) AS y FROM lineitem), c AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY s),
    r AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS above, coalesce(sum(neg) OVER w, 0) AS wrong FROM c WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(neg * (above + pos / 2.0)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)), 6) AS roc_auc, round(sum(pos * (above + pos) / CAST(above + pos + wrong + neg AS DOUBLE)) / sum(pos), 6) AS average_precision FROM r""")
def ranking_quality(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_discount") * 100 + F.col("l_tax")).alias("score"), (F.col("l_returnflag") == "R").cast("long").alias("label"))
    found = analytics.ranking_quality(rows, "score", "label")
    return found.select(F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"), *[F.round(c, 6).alias(c) for c in ("roc_auc", "average_precision")])


_EMB_FEATURES = oracle.features(EMBEDDING_SQL, 1, 2, per_graph=True)


@register("kernel_profiles", f"""WITH f AS ({_EMB_FEATURES}), n AS (SELECT graph_id, sqrt(sum(value * value)) AS norm FROM f GROUP BY graph_id), g AS (SELECT DISTINCT graph_id FROM f),
    k AS (SELECT a.graph_id AS g1, b.graph_id AS g2, sum(a.value / na.norm * (b.value / nb.norm)) AS cosine FROM f a JOIN f b ON a.feature_id = b.feature_id JOIN n na ON na.graph_id = a.graph_id JOIN n nb ON nb.graph_id = b.graph_id GROUP BY ALL)
    SELECT a.graph_id, round(median(coalesce(k.cosine, 0)), 6) AS value FROM g a CROSS JOIN g b LEFT JOIN k ON k.g1 = a.graph_id AND k.g2 = b.graph_id GROUP BY a.graph_id""")
def kernel_profiles(spark, d):
    kernel = vectors.cosine(features.graph_features(embedding_graphs(spark, d), radius=1, distance=2))
    return analytics.kernel_profile(kernel).withColumn("value", F.round("value", 6))


_SPLIT = sql.code("'split:5:' || o_orderkey")


@register("stratified_split", f"""SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_SPLIT}, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.7::DOUBLE) AS in_train FROM orders""")
def stratified_split(spark, d):
    return selection.stratified_split(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.7, 5)


@register("learning_prefixes", """WITH RECURSIVE s(size) AS (SELECT count(*) FROM customer UNION ALL SELECT size // 2 FROM s WHERE size // 2 >= 100), p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)
    SELECT c_custkey, size FROM p JOIN s ON n <= size WHERE size >= 100""")
def learning_prefixes(spark, d):
    return selection.learning_prefixes(read(spark, d, "customer").select("c_custkey"), "c_custkey", 100)


@register("parse_lines", """SELECT 'part' AS source_uri, p_partkey AS source_line, p_brand AS smiles, p_name AS name FROM part WHERE p_partkey % 5 = 1
    UNION ALL SELECT 'part', p_partkey, regexp_extract(p_name, '^\\S+'), nullif(regexp_extract(p_name, '^\\S+\\s+(\\S+)', 1), '') FROM part WHERE p_partkey % 5 NOT IN (0, 1)""")
def parse_lines(spark, d):
    p = read(spark, d, "part")
    text = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" # "), "p_name")).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit(" "), "p_brand", F.lit(", "), "p_name", F.lit(",x"))).otherwise(F.concat("p_name", F.lit("  ")))
    return readers.parse_lines(p.select(F.lit("part").alias("source_uri"), F.col("p_partkey").alias("source_line"), text.alias("value"))).drop("props")


@register("quadratic_loess", """WITH d AS (SELECT CAST(dayofyear(ts) AS DOUBLE) AS x, avg(value) AS y FROM events GROUP BY 1), m AS (SELECT g.x, p.x - g.x AS z, p.y, row_number() OVER (PARTITION BY g.x ORDER BY abs(p.x - g.x)) AS k FROM d g CROSS JOIN d p),
    r AS (SELECT x, max(abs(z)) AS reach FROM m WHERE k <= greatest(3, ceil(0.5 * (SELECT count(*) FROM d))) GROUP BY x), w AS (SELECT x, z, y, power(1 - power(abs(z) / reach, 3), 6) AS w FROM m JOIN r USING (x) WHERE abs(z) <= reach),
    s AS (SELECT x, sum(w) AS a, sum(w * z) AS b, sum(w * z * z) AS c, sum(w * z * z * z) AS d, sum(w * z * z * z * z) AS e, sum(w * y) AS t, sum(w * y * z) AS u, sum(w * y * z * z) AS v FROM w GROUP BY x)
    SELECT x, round((t * (c * e - d * d) - b * (u * e - d * v) + c * (u * d - c * v)) / (a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c)), 5) AS fitted FROM s""")
def quadratic_loess(spark, d):
    days = read(spark, d, "events").groupBy(F.dayofyear("ts").alias("x")).agg(F.avg("value").alias("y"))
    return smoothing.quadratic_loess(days, 0.5).withColumn("fitted", F.round("fitted", 5))


def reduced_graph_vectors(spark, d):
    """Attributes reduced to 4 dimensions, labels by 5 clusters of them."""
    return GraphEncoder(distance=1, nbits=6, node_attribute_key="attr", attribute_dim=4, attribute_alphabet_size=5).fit_transform(embedding_graphs(spark, d))


@register("stream_batches", f"""WITH f AS ({oracle.features(ORDER_SQL, 1, 1, nbits=8)}), b AS (SELECT o_orderkey AS graph_id, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS BIGINT) AS batch_id FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 10))
    SELECT f.*, batch_id FROM f JOIN b USING (graph_id)""")
def stream_batches(spark, d):
    index = read(spark, d, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_orderkey").alias("seq"))
    return NodeEncoder(r=1, d=1, nbits=8).stream_from(readers.Loaded(order_graphs(spark, d), index), batch_size=64, start_after_instance=10)


#: Fitted: tested against NumPy instead of SQL.
QUERIES |= {"reduced_graph_vectors": reduced_graph_vectors}
