"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir. A folder of our own only where
    that is unset, on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphspan-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: both sides of a later join see the same
    rows, and keep how they were dealt."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sparse_vectors(df: DataFrame, indices: str, values: str, size: int, out: str = "features") -> DataFrame:
    """df with two array columns in place of which stands one of sparse vectors: the parts of a
    vector are written as they lie in Parquet, and read again as vectors."""
    spark = df.sparkSession
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col(indices).cast("array<int>").alias("indices"), F.col(values).cast("array<double>").alias("values"))
    rest = [c for c in df.columns if c not in (indices, values)]
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    df.select(*rest, parts.alias(out)).write.parquet(path)
    return spark.read.schema(StructType([*[df.schema[c] for c in rest], StructField(out, VectorUDT())])).parquet(path)
