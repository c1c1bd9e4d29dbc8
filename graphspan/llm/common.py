"""What the operators share: shipping code, shared-folder tables, small helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship_code

#: Arrow batches hold at most so many rows and bytes (one row at least): whole texts of
#: 10,000 rows, Spark's own limit, take some 100 MB on both sides of each worker.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
_own_dir: str | None = None
_cleaned: set[str] = set()
_tables: dict[tuple[str, int], list[str]] = {}  # by application and thread of the driver


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    workers import it whatever their working directory is, and bound the session's
    Arrow batches by ARROW_LIMITS (lower limits stay)."""
    sc = spark.sparkContext
    for key, most in ARROW_LIMITS.items():
        now = sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    ship_code(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; an own temporary one only if that
    is unset (tests and single-machine runs)."""
    global _own_dir
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="graphspan-tables-")
    return f"file://{_own_dir}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_tables(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables made by `table()`: those named, or all of this application."""
    app = spark.sparkContext.applicationId
    for (owner, _), known in list(_tables.items()):
        for path in list(known) if owner == app else ():
            if paths is None or path in paths:
                with contextlib.suppress(Exception):
                    _delete(spark, path)
                known.remove(path)


def _own(spark: SparkSession) -> list[str]:
    return _tables.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def tables_made(spark: SparkSession) -> list[str]:
    """Tables made by this thread that are still there, oldest first. (Steps of a query that
    another thread runs are none of ours.)"""
    return list(_own(spark))


def last_table(df: DataFrame, name: str, made_before: int) -> DataFrame:
    """table(df), after which the tables made since there were `made_before` go: they were
    steps on the way to this one."""
    spark = df.sparkSession
    steps = tables_made(spark)[made_before:]
    out = table(df, name)
    drop_tables(spark, steps)
    return out


def table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    The files stay until the application ends (or `drop_tables`), so a lost
    executor never loses them."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/graphspan/{app}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(drop_tables_quietly, spark)
    _own(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc is not None:
            drop_tables(spark)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, wish: str, *others: str) -> str:
    """A column name that begins with two underscores and clashes with no column of df (in
    any case) or of `others`."""
    taken = {c.lower() for c in (*df.columns, *others)}
    name = f"__{wish}"
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A side with at most so many rows is broadcast (a few dozen MB for id-sized rows);
#: beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df.hint("merge")
