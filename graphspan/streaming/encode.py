"""Encoding of a stream of graphs, each one row with its nodes and edges nested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.encoders import GraphEncoder
from ..sources.tables import Graphs

NESTED = "graph_id long, nodes array<struct<node_id: long, label: string>>, edges array<struct<u: long, v: long, label: string>>"


def unnested(rows: DataFrame) -> Graphs:
    return Graphs(rows.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", "n.*"), rows.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.*"))


def encode_stream(rows: DataFrame, encoder: GraphEncoder, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Features of each micro-batch as Parquet under out/batch_id=N. A batch done again after
    a failure replaces its own folder, so each graph counts once. No state is kept."""

    def write(batch: DataFrame, n: int) -> None:
        encoder.transform(unnested(batch)).write.mode("overwrite").parquet(f"{out}/batch_id={n}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
