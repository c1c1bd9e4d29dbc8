"""Structure of graphs: degrees, distances, balls, path unions, and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sequence_code, set_code
from ..sources.tables import Graphs
from . import local
from .local import by_graph


def degrees(g: Graphs) -> DataFrame:
    """(graph_id, node_id, degree, neighbours): a loop counts twice in the degree and once
    among the distinct neighbours; nodes without edges have 0."""
    d = g.adjacency().groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sum(F.when(F.col("src") == F.col("dst"), 2).otherwise(1)).alias("degree"), F.count(F.lit(1)).alias("neighbours"))
    return g.nodes.select("graph_id", "node_id").join(d, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbours"))


def distances(g: Graphs, most: int) -> DataFrame:
    """(graph_id, root, node, d): hops between all nodes at most `most` apart. Level by
    level: the frontier's neighbours without what has been reached."""
    return by_graph(g, local.distances, "graph_id, root long, node long, d int", most=most)


def shortest_path_nodes(g: Graphs, most: int) -> DataFrame:
    """path_nodes of all pairs at most `most` apart, graph by graph."""
    return by_graph(g, local.path_nodes, "graph_id, root long, target long, node long, d int", most=most)


def shortest_path_edges(g: Graphs, most: int) -> DataFrame:
    """path_edges of all pairs at most `most` apart, graph by graph."""
    return by_graph(g, local.path_edges, "graph_id, root long, target long, u long, v long", most=most)


def ball(dist: DataFrame, radius: int) -> DataFrame:
    return dist.filter(F.col("d") <= radius).select("graph_id", F.col("root").alias("center"), "node")


def induced_edges(g: Graphs, members: DataFrame, by: str = "center") -> DataFrame:
    """(graph_id, center, u, v): edges with both ends among a center's members."""
    m = members.select("graph_id", by, "node")
    one = m.withColumnRenamed("node", "u").join(g.edges.select("graph_id", "u", "v"), ["graph_id", "u"])
    return one.join(m.withColumnRenamed("node", "v"), ["graph_id", by, "v"], "left_semi").select("graph_id", by, "u", "v")


def path_nodes(dist: DataFrame, most: int | None = None) -> DataFrame:
    """(graph_id, root, target, node): nodes on any shortest path; `dist` tells which pairs
    are looked at, and holds all distances up to theirs. `most`, if known, is the largest: what
    two distances exceed it leaves the first join at once."""
    st = dist.select("graph_id", "root", F.col("node").alias("target"), F.col("d").alias("dt"))
    a = dist.select("graph_id", "root", "node", F.col("d").alias("da"))
    b = dist.select("graph_id", F.col("root").alias("node"), F.col("node").alias("target"), F.col("d").alias("db"))
    met = a.join(b, ["graph_id", "node"])
    met = met if most is None else met.filter(F.col("da") + F.col("db") <= most)
    return met.join(st, ["graph_id", "root", "target"]).filter("da + db = dt").select("graph_id", "root", "target", "node", F.col("da").alias("d"))


def path_edges(g: Graphs, dist: DataFrame, most: int | None = None) -> DataFrame:
    """(graph_id, root, target, u, v): edges on any shortest path; `most` as in path_nodes."""
    st = dist.select("graph_id", "root", F.col("node").alias("target"), F.col("d").alias("dt"))
    a = dist.select("graph_id", "root", F.col("node").alias("src"), F.col("d").alias("da"))
    b = dist.select("graph_id", F.col("root").alias("dst"), F.col("node").alias("target"), F.col("d").alias("db"))
    adj = g.adjacency().select("graph_id", "src", "dst")
    met = a.join(adj, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    met = met if most is None else met.filter(F.col("da") + 1 + F.col("db") <= most)
    steps = met.join(st, ["graph_id", "root", "target"]).filter("da + 1 + db = dt")
    return steps.select("graph_id", "root", "target", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))


def node_codes(g: Graphs) -> DataFrame:
    """(graph_id, node_id, lh, nh): codes of the label, and of label and neighbourhood."""
    return by_graph(g, local.node_codes, "graph_id, node_id long, lh long, nh long")


def triplet_codes(g: Graphs) -> DataFrame:
    """(graph_id, u, v, triplet) of every edge."""
    return by_graph(g, local.triplets, "graph_id, u long, v long, triplet long")


def rooted_codes(g: Graphs, cutoff: int, degree_threshold: int | None = None) -> DataFrame:
    """(graph_id, node_id, r, c) for r from 0 to cutoff: the code of the shells up to r, 0
    beyond the last shell, and beyond r = 0 for nodes of more neighbours than the threshold."""
    return by_graph(g, local.rooted, "graph_id, node_id long, r int, c long", cutoff=cutoff, degree_threshold=degree_threshold)


def shortest_path_codes(g: Graphs, most: int, cutoff: int, connect: int) -> DataFrame:
    """connector_codes of all pairs at most `most` apart, graph by graph."""
    if connect < 1:
        raise ValueError("connect must be 1 at least")
    return by_graph(g, local.connectors, "graph_id, root long, target long, uc long", most=most, cutoff=cutoff, connect=connect)


def connector_codes(dist: DataFrame, rooted: DataFrame, connect: int, most: int | None = None) -> DataFrame:
    """(graph_id, root, target, uc): code of the shortest-path union, each of its nodes by
    its distance and its rooted code of radius connect - 1."""
    if connect < 1:
        raise ValueError("connect must be 1 at least")
    at = rooted.filter(F.col("r") == connect - 1).select("graph_id", F.col("node_id").alias("node"), "c")
    return path_nodes(dist, most).join(at, ["graph_id", "node"]).groupBy("graph_id", "root", "target").agg(set_code(F.collect_list(sequence_code(F.col("d"), F.col("c")))).alias("uc"))
