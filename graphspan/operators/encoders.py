"""Encoders: the feature operators behind parameters, with fitting where attributes ask for it."""

from __future__ import annotations

import inspect
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import cut
from ..sources import readers
from ..sources.tables import Graphs
from . import selection, vectors
from .features import graph_features, node_features

#: Estimators inside an encoder.
PARTS = ("embedder", "clustering_predictor", "classifier")
#: Trees of the default classifier.
FOREST_TREES = 300


def gram(attrs: DataFrame, column: str = "attr") -> np.ndarray:
    """Sums of outer products of an array column: one matrix for each task, added up on the
    executors; what reaches the driver is dims x dims."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                a = np.stack(f[column].to_list()).astype(float)
                total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel()]})

    rows = attrs.select(column).filter(F.col(column).isNotNull()).mapInPandas(run, "g array<double>")
    sums = rows.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.array([r.x for r in sorted(sums, key=lambda r: r.i)])
    return flat.reshape(round(len(flat) ** 0.5), -1)


class _Encoder:
    def __init__(self, radius: int = 1, distance: int = 3, connector: int = 0, nbits: int = 10, degree_threshold: int | None = None, dense: bool = True, parallel: bool = True, weight_key: str | None = None, node_attribute_key: str | None = None,
                 edge_attribute_key: str | None = None, attribute_dim: int | None = None, attribute_alphabet_size: int | None = None, use_node_kernel: bool = False, sigma: float | None = None, use_edges_as_features: bool = True, r: int | None = None, d: int | None = None, c: int | None = None, seed: int = 0,
                 embedder: Estimator | None = None, clustering_predictor: Estimator | None = None, classifier: Estimator | None = None):
        """r, d and c are short names of radius, distance and connector. dense, parallel and
        edge_attribute_key are accepted and change nothing: rows are long form, Spark deals
        the work, and edge attributes are not used.

        embedder, clustering_predictor and classifier are Spark ML estimators used in place of
        the own reduction, of k-means and of a forest of FOREST_TREES trees (Spark has no
        extremely randomised ones). Their input, output and label columns are set here."""
        for name, short, default in (("radius", r, 1), ("distance", d, 3), ("connector", c, 0)):
            full = {"radius": radius, "distance": distance, "connector": connector}[name]
            if short is not None and full not in (default, short):
                raise ValueError(f"{name} is given twice: {full} and {short}")
            setattr(self, name, full if short is None else short)
        self.nbits, self.degree_threshold, self.dense, self.parallel = nbits, degree_threshold, dense, parallel
        self.weight_key, self.node_attribute_key, self.edge_attribute_key = weight_key, node_attribute_key, edge_attribute_key
        self.attribute_dim, self.attribute_alphabet_size, self.use_node_kernel = attribute_dim, attribute_alphabet_size, use_node_kernel
        self.sigma, self.use_edges_as_features, self.seed = sigma, use_edges_as_features, seed
        self.embedder = embedder
        self.clustering_predictor = clustering_predictor or (KMeans(k=attribute_alphabet_size, seed=seed) if attribute_alphabet_size else None)
        self.classifier = classifier or (RandomForestClassifier(numTrees=FOREST_TREES, seed=seed) if attribute_alphabet_size else None)
        self._own = {"embedder": embedder, "clustering_predictor": clustering_predictor, "classifier": classifier}
        self.components_: np.ndarray | None = None
        self.reduction_ = self.classifier_ = None
        self.loaded_balance_candidate_size_: int | None = None
        self.loaded_label_counts_: dict | None = None
        self.loaded_class_weight_: dict | None = None

    def get_params(self, deep: bool = True) -> dict:
        """Parameters; with `deep` also those of the estimators inside, as embedder__name."""
        names = [p for p in inspect.signature(_Encoder.__init__).parameters if p not in ("self", "r", "d", "c", *PARTS)]
        out = {p: getattr(self, p) for p in names}
        for part in PARTS if deep else ():
            inside = getattr(self, part)
            out |= {} if inside is None else {f"{part}__{p.name}": v for p, v in inside.extractParamMap().items()}
        return out

    def set_params(self, **params):
        """Changed parameters drop what was fitted, and make new estimators but for those given
        to the encoder. Names like classifier__numTrees go to the estimator inside."""
        long = {"r": "radius", "d": "distance", "c": "connector"}
        nested = {k: v for k, v in params.items() if k.split("__")[0] in PARTS and "__" in k}
        if own := {long.get(k, k): v for k, v in params.items() if k not in nested}:
            self.__init__(**(self.get_params(deep=False) | self._own | own))
        for key, value in nested.items():
            part, _, name = key.partition("__")
            inside = getattr(self, part)
            if inside is not None:
                inside.set(inside.getParam(name), value)
                self.components_ = self.reduction_ = self.classifier_ = None
        return self

    def set_nbits(self, nbits: int):
        return self.set_params(nbits=nbits)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.get_params(deep=False).items())})"

    @property
    def requires_fit(self) -> bool:
        return bool(self.node_attribute_key and (self.attribute_dim or self.attribute_alphabet_size))

    def _renamed(self, g: Graphs) -> Graphs:
        nodes = g.nodes
        if not (self.node_attribute_key or self.weight_key):
            return g
        for key, name in ((self.node_attribute_key, "attr"), (self.weight_key, "weight")):
            if key and key != name:
                nodes = nodes.withColumn(name, F.col(key))
        return replace(g, nodes=nodes)

    def fit(self, g: Graphs, targets=None):
        """Directions of the largest second moments of the attributes, clusters of the
        attributes along them, and a classifier of these clusters. Without either, nothing."""
        if not self.requires_fit:
            return self
        nodes = self._renamed(g).nodes
        if self.attribute_dim and self.embedder is not None:
            self.reduction_ = self.embedder.copy({self.embedder.inputCol: "features", self.embedder.outputCol: "reduced"}).fit(nodes.select(array_to_vector("attr").alias("features")))
        elif self.attribute_dim:
            values, vecs = np.linalg.eigh(gram(nodes))
            top = vecs[:, np.argsort(values)[::-1][: self.attribute_dim]].T
            self.components_ = top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]
        if self.attribute_alphabet_size:
            x = cut(self.embed_attributes(nodes).select(array_to_vector("attr").alias("features")))
            grouped = self.clustering_predictor.copy({self.clustering_predictor.featuresCol: "features", self.clustering_predictor.predictionCol: "label"}).fit(x).transform(x)
            groups = cut(grouped.select("features", F.col("label").cast("double").alias("label")))
            self.classifier_ = self.classifier.copy({self.classifier.featuresCol: "features", self.classifier.labelCol: "label"}).fit(groups)
        return self

    def embed_attributes(self, nodes: DataFrame) -> DataFrame:
        """attr reduced, and the old one as original_attr."""
        if self.reduction_ is not None:
            kept = [c for c in nodes.columns if c != "attr"]
            found = self.reduction_.transform(nodes.withColumn("features", array_to_vector("attr")))
            return found.select(*kept, F.col("attr").alias("original_attr"), vector_to_array("reduced").alias("attr"))
        if self.components_ is None:
            return nodes
        directions = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in self.components_])
        product = F.transform(directions, lambda v: F.aggregate(F.zip_with("attr", v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
        return nodes.withColumn("original_attr", F.col("attr")).withColumn("attr", product)

    def set_discrete_labels(self, nodes: DataFrame) -> DataFrame:
        """label by what the fitted classifier predicts from attr."""
        if self.classifier_ is None:
            return nodes
        kept = [c for c in nodes.columns if c != "label"]
        found = self.classifier_.transform(nodes.select(*kept, array_to_vector("attr").alias("features")))
        return found.select(*kept, F.col("prediction").cast("long").cast("string").alias("label"))

    def prepared(self, g: Graphs) -> Graphs:
        """Attributes reduced and labels by the classifier, as fitted."""
        if self.requires_fit and (self.attribute_dim and self.components_ is None and self.reduction_ is None or self.attribute_alphabet_size and self.classifier_ is None):
            raise ValueError("fit the encoder before it transforms")
        g = self._renamed(g)
        return replace(g, nodes=self.set_discrete_labels(self.embed_attributes(g.nodes)), rows=None if self.requires_fit else g.rows).with_labels()

    def _params(self) -> dict:
        return {"radius": self.radius, "distance": self.distance, "connector": self.connector, "nbits": self.nbits, "degree_threshold": self.degree_threshold, "sigma": self.sigma, "use_edges": self.use_edges_as_features}

    def _dims(self, nodes: DataFrame) -> int:
        first = nodes.select(F.size("attr")).first()
        return first[0] if first else 0

    def _node_rows(self, g: Graphs) -> DataFrame:
        out = node_features(g, **self._params())
        return vectors.reweighted(out, g.nodes) if self.weight_key else out

    def transform(self, g: Graphs) -> DataFrame:
        raise NotImplementedError

    def _placed(self, g: Graphs, placed: DataFrame) -> DataFrame:
        """transform with the batch_id of placed. Plain features take it along by graph."""
        if self.node_attribute_key or self.weight_key or self.use_node_kernel:
            return self.transform(g).join(placed, "graph_id")
        return node_features(self.prepared(g), per_graph=isinstance(self, GraphEncoder), tags=placed, tag="batch_id", **self._params())

    def fit_transform(self, g: Graphs, targets=None) -> DataFrame:
        return self.fit(g, targets).transform(g)

    def _source(self, spark_of, uri, kind, reader, parse, mode, verbose) -> readers.Loaded:
        if isinstance(uri, readers.Loaded):
            return uri
        spark = spark_of or SparkSession.active()
        return readers.load(spark, uri, kind, reader, parse, verbose=verbose, mode=mode)

    def load_from(self, uri, type: str | None = None, reader=None, limit=None, random_state: int = 0, verbose: bool = False, balance: bool = False, label_extractor=None, start_after_instance: int = 0, parse=None, spark: SparkSession | None = None) -> readers.Loaded:
        """Graphs of a uri by type (smiles, sdf, pyg_pt), or by a reader called with the uri;
        or a selection of graphs already loaded, given in place of the uri. After balanced
        loading loaded_label_counts_, loaded_class_weight_ and loaded_balance_candidate_size_
        tell of the graphs before it; after other loading they are None. A label is a
        column of the index, its name, or a function of the index; by default the name."""
        selection.check_limit(limit)
        if isinstance(uri, readers.Loaded):
            out = readers.selected(uri, limit, start_after_instance, random_state, balance, label_extractor)
        else:
            out = readers.load(spark or SparkSession.active(), uri, type, reader, parse, limit, start_after_instance, random_state, balance, label_extractor, verbose)
        rows = out.class_weight.collect() if out.class_weight is not None else None  # one row for each class
        self.loaded_balance_candidate_size_ = out.candidate_size
        self.loaded_label_counts_ = None if rows is None else {r["label"]: r["n"] for r in rows}
        self.loaded_class_weight_ = None if rows is None else {r["label"]: r["weight"] for r in rows}
        return out

    def stream_from(self, uri, type: str | None = None, reader=None, limit=None, random_state: int = 0, batch_size: int = 128, verbose: bool = False, label_extractor=None, start_after_instance: int = 0, parse=None, spark: SparkSession | None = None):
        """Features with the batch_id of their graph, batches by the order of the source, in
        one job; with a label_extractor also (graph_id, batch_id, label) of the graphs. The
        source is given as to load_from."""
        if self.requires_fit and self.components_ is None and self.reduction_ is None and self.classifier_ is None:
            raise ValueError("fit the encoder before it streams")
        source = self._source(spark, uri, type, reader, parse, "stream", verbose)
        chosen = readers.selected(source, limit, start_after_instance, random_state)
        index = chosen.index if label_extractor is None else chosen.index.withColumn("label", readers.label_of(chosen.index, label_extractor))
        placed = selection.batches(index, "seq", batch_size)
        found = self._placed(chosen.graphs, placed.select("graph_id", "batch_id"))
        return found if label_extractor is None else (found, placed.select("graph_id", "batch_id", "label"))


class GraphEncoder(_Encoder):
    """(graph_id, feature_id, value) of each graph."""

    def transform(self, g: Graphs) -> DataFrame:
        g = self.prepared(g)
        if not (self.use_node_kernel or self.node_attribute_key or self.weight_key):
            return graph_features(g, **self._params())
        if not (self.node_attribute_key or self.weight_key):
            return vectors.graph_kernel(g, **self._params())
        rows = self._node_rows(g)
        if self.use_node_kernel:
            matrix = vectors.attribute_node_vectors(rows, g.nodes, self._dims(g.nodes)) if self.node_attribute_key else None
            return vectors.node_kernel(rows, self.nbits, matrix)
        if self.node_attribute_key:
            return vectors.attribute_graph_vectors(rows, g.nodes, self.nbits)
        return rows.groupBy("graph_id", "feature_id").agg(F.sum("value").alias("value"))


class NodeEncoder(_Encoder):
    """(graph_id, node_id, feature_id, value) of each node."""

    def transform(self, g: Graphs) -> DataFrame:
        g = self.prepared(g)
        rows = self._node_rows(g)
        return vectors.attribute_node_vectors(rows, g.nodes, self._dims(g.nodes)) if self.node_attribute_key else rows
