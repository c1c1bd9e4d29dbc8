"""Feature emission and counting, for nodes and graphs, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import check_nbits
from ..sources.tables import Graphs
from . import local
from .local import by_graph


def node_features(g: Graphs, radius: int = 1, distance: int = 3, connector: int = 0, nbits: int = 10, degree_threshold: int | None = None, sigma: float | None = None, use_edges: bool = True, per_graph: bool = False, tags: DataFrame | None = None, tag: str = "tag") -> DataFrame:
    """(graph_id, node_id, feature_id, value), or sums over nodes with per_graph.

    Radii go up to the larger of radius and connector. Feature 0 is 1 and feature 1 the
    degree of every node. Values are whole numbers without sigma. With tags (graph_id, and a
    whole number named by `tag`) only their graphs, each with its tag."""
    check_nbits(nbits)
    kind = "double" if sigma is not None else "long"
    columns = f"graph_id, feature_id int, value {kind}" if per_graph else f"graph_id, node_id long, feature_id int, value {kind}"
    make = local.features
    if tags is not None:
        g, make, columns = g.tagged(tags.select("graph_id", F.col(tag).alias("extra"))), local.tagged, f"{columns}, {tag} long"
    return by_graph(g, make, columns, per_graph=per_graph, nbits=nbits, sigma=sigma, radius=radius, distance=distance, connector=connector, degree_threshold=degree_threshold, use_edges=use_edges)


def graph_features(g: Graphs, **params) -> DataFrame:
    """(graph_id, feature_id, value): node features summed over each graph."""
    return node_features(g, per_graph=True, **params)
