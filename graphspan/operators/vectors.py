"""Matrix products over long-form features: weights, attributes and kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import check_nbits
from ..sources.tables import Graphs
from . import local
from .local import by_graph


def reweighted(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node's values times its weight, reserved columns too."""
    return features.join(nodes.select("graph_id", "node_id", "weight"), ["graph_id", "node_id"]).select("graph_id", "node_id", "feature_id", (F.col("value") * F.col("weight")).alias("value"))


def attributes(nodes: DataFrame) -> DataFrame:
    return nodes.select("graph_id", "node_id", F.posexplode("attr").alias("dim", "a"))


def attribute_products(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, dim, feature_id, value): transposed attributes times features."""
    return features.join(attributes(nodes), ["graph_id", "node_id"]).groupBy("graph_id", "dim", "feature_id").agg(F.sum(F.col("a") * F.col("value")).alias("value"))


def attribute_graph_vectors(features: DataFrame, nodes: DataFrame, nbits: int) -> DataFrame:
    """The products as one vector, dim by dim."""
    return attribute_products(features, nodes).select("graph_id", (F.col("dim") * (1 << nbits) + F.col("feature_id")).alias("feature_id"), "value")


def attribute_node_vectors(features: DataFrame, nodes: DataFrame, dims: int, structural: bool = True) -> DataFrame:
    """Attributes, cube roots of their interaction with structure, and the features."""
    a = attributes(nodes).select("graph_id", "node_id", F.col("dim").alias("feature_id"), F.col("a").alias("value"))
    z = features.join(attribute_products(features, nodes).withColumnRenamed("value", "y"), ["graph_id", "feature_id"]).groupBy("graph_id", "node_id", "dim").agg(F.sum(F.col("value") * F.col("y")).alias("z"))
    out = a.unionByName(z.select("graph_id", "node_id", (F.col("dim") + dims).alias("feature_id"), F.pow(F.abs("z"), F.lit(1 / 3)).alias("value")))
    if structural:
        out = out.unionByName(features.select("graph_id", "node_id", (F.col("feature_id") + 2 * dims).alias("feature_id"), F.col("value").cast("double").alias("value")))
    return out


def node_kernel(features: DataFrame, nbits: int, matrix: DataFrame | None = None) -> DataFrame:
    """(graph_id, feature_id, value): square roots of |MᵀX|, kept sparse; M is X by default."""
    m = (features if matrix is None else matrix).select("graph_id", "node_id", F.col("feature_id").alias("m"), F.col("value").alias("mv"))
    s = features.join(m, ["graph_id", "node_id"]).groupBy("graph_id", "m", "feature_id").agg(F.sum(F.col("mv") * F.col("value")).alias("v"))
    return s.select("graph_id", (F.col("m").cast("long") * (1 << nbits) + F.col("feature_id")).alias("feature_id"), F.sqrt(F.abs(F.col("v"))).alias("value"))


def graph_kernel(g: Graphs, nbits: int, **params) -> DataFrame:
    """node_kernel of the graphs' own features, graph by graph."""
    return by_graph(g, local.kernel, "graph_id, feature_id long, value double", **(local.PLAIN | params | {"nbits": check_nbits(nbits)}))


def weighted_features(g: Graphs, **params) -> DataFrame:
    """Node features times each node's weight, reserved columns too."""
    check_nbits(params.get("nbits", local.PLAIN["nbits"]))
    return by_graph(g, local.weighted, "graph_id, node_id long, feature_id int, value double", extra="weight", **(local.PLAIN | params))


def cosine(features: DataFrame) -> DataFrame:
    """(g1, g2, cosine) of graphs, g1 < g2, that share a feature: a join on features."""
    norm = features.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    unit = features.join(norm, "graph_id").select("graph_id", "feature_id", (F.col("value") / F.col("norm")).alias("x"))
    a, b = (unit.select(F.col("graph_id").alias(g), "feature_id", F.col("x").alias(x)) for g, x in (("g1", "x1"), ("g2", "x2")))
    return a.join(b, "feature_id").filter("g1 < g2").groupBy("g1", "g2").agg(F.sum(F.col("x1") * F.col("x2")).alias("cosine"))


def edge_attributes(edges: DataFrame, column: str = "attr") -> DataFrame:
    """(graph_id, u, v, dim, a): attribute vectors of edges."""
    return edges.select("graph_id", "u", "v", F.posexplode(column).alias("dim", "a"))


def reweighted_edges(features: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge's values (graph_id, u, v, feature_id, value) times its weight."""
    key = ["graph_id", "u", "v"]
    return features.join(edges.select(*key, "weight"), key).select(*key, "feature_id", (F.col("value") * F.col("weight")).alias("value"))
