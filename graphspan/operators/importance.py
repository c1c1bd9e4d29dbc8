"""Importance of features learned from labelled graphs by forests."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut, sparse_vectors
from ..sources.tables import Graphs
from . import attribution
from .encoders import NodeEncoder
from .selection import draw


class ImportanceEstimator:
    """Forests over graph sums of node features, n_iter times on another 70 % of the graphs;
    importances are averaged less their deviation (attribution.postprocess). Spark has no
    extremely randomised trees, so these are random forests: ranks agree, values need not."""

    def __init__(self, encoder: NodeEncoder, n_iter: int = 10, n_estimators: int = 100, quantile: float = 0.5, normalize: bool = True):
        self.encoder, self.n_iter, self.n_estimators, self.quantile, self.normalize = encoder, n_iter, n_estimators, quantile, normalize
        self.importance_: DataFrame | None = None
        self.archive_: DataFrame | None = None

    def fit(self, g: Graphs, targets: DataFrame) -> ImportanceEstimator:
        """targets: (graph_id, target), a row for each graph."""
        width = 1 << self.encoder.nbits
        rows = self.encoder.fit_transform(g).groupBy("graph_id", "feature_id").agg(F.sum("value").cast("double").alias("value"))
        if self.encoder.node_attribute_key:
            raise ValueError("importance is learned over structural features only")
        held = rows.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("m"))
        held = held.select("graph_id", F.transform("m", lambda x: x["feature_id"]).alias("at"), F.transform("m", lambda x: x["value"]).alias("values"))
        classes = targets.select("target").distinct().orderBy("target")
        number = {r.target: float(i) for i, r in enumerate(classes.limit(1001).collect())}
        if not 2 <= len(number) <= 1000:
            raise ValueError("targets have between 2 and 1000 classes")
        label = F.element_at(F.create_map(*[F.lit(x) for kv in number.items() for x in kv]), F.col("target"))
        x = sparse_vectors(held.join(targets, "graph_id").select("graph_id", label.alias("label"), "at", "values"), "at", "values", width)
        runs = []
        for run in range(1, self.n_iter + 1):
            train = x.filter(F.pmod(draw(F.col("graph_id"), run, "forest"), F.lit(1000)) < 700)
            forest = RandomForestClassifier(numTrees=self.n_estimators, seed=run, maxDepth=10).fit(train)
            runs += [(run, i, float(v)) for i, v in enumerate(forest.featureImportances.toArray())]
        made = g.nodes.sparkSession.createDataFrame(runs, "run int, feature_id int, importance double")
        self.importance_, self.archive_ = cut(attribution.postprocess(made, self.quantile)), None
        return self

    def _fitted(self) -> DataFrame:
        if self.importance_ is None:
            raise ValueError("fit before use")
        return self.importance_

    def build_feature_archive(self, g: Graphs, provenance: bool = False) -> DataFrame:
        """All occurrences, with provenance the nodes and edges of each too."""
        self._fitted()
        e = self.encoder
        self.archive_ = attribution.occurrences(e.prepared(g), e.radius, e.distance, e.connector, e.nbits, e.degree_threshold, e.use_edges_as_features, provenance)
        return self.archive_

    def get_top_features(self, top_k: int = 10, min_importance: float = 0.0) -> DataFrame:
        importance = self._fitted()
        if self.archive_ is None:
            raise ValueError("build the archive before its top features")
        return attribution.top_features(importance, self.archive_, top_k, min_importance)

    def transform(self, g: Graphs) -> tuple[DataFrame, DataFrame]:
        """Scores of nodes and of edges."""
        nodes = attribution.node_importance(self.encoder.transform(g), self._fitted(), self.normalize)
        return nodes, attribution.edge_importance(g.edges, nodes)

    def features(self, g: Graphs) -> tuple[DataFrame, DataFrame]:
        """Features of nodes, and of edges: the sums of their ends'."""
        nodes = self.encoder.transform(g)
        return nodes, attribution.edge_features(g.edges, nodes)
