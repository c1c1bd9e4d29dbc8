"""Exact top-k inner products over norm-sorted vectors.

Candidates are dealt and sorted by descending length. An orthogonal rotation (the
eigenvectors of the Gram matrix, i.e. the right singular vectors) moves most of the
length into the first components, so partial sums over those plus a Cauchy-Schwarz bound
of the rest rule out most candidates; chunks whose longest vector cannot reach any
query's k-th best are passed over. A task may read several files in any order, so each
chunk is judged by its own lengths. What passes is scored in exact integers. The bounds are widened by the rounding error of the rotated sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, table, tables_made

K = 10
SCALE = 1024
#: Queries answered in one pass over the candidates; bounds what is broadcast.
QUERY_BLOCK = 8192
#: Longest vectors that give every query its first k-th best.
HEAD = 2048
#: Share of the dimensions in the partial sums.
PARTIAL = 0.25
_CHUNK = 1024
_EXACT = float(1 << 53)  # below this, sums of doubles are exact integers
_LONG = 1 << 63


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: id and vector not null, no
    component null or not finite."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    d = vectors.filter(F.coalesce(fine, F.lit(False)))
    # from 2^53 on, doubles are whole numbers already
    v = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * SCALE) < 2.0**53, F.floor(c.cast("double") * SCALE).cast("double")).otherwise(c.cast("double") * SCALE))
    return d.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal width; shorter vectors get zeros."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _rows(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([_matrix(c, dim) for c in col.chunks] or [np.zeros((0, dim))])


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; beyond longs the nearest long."""
    if np.abs(q).sum(axis=1).max(initial=0) * np.abs(c).max(initial=0) < _EXACT:
        return (q @ c.T).astype(np.int64)
    qi, ci = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (q, c))
    return np.clip(qi.dot(ci.T), -_LONG, _LONG - 1).astype(np.int64)


class TopK:
    """The k best (score, smaller id first) of each query."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), -_LONG, np.int64), np.full((n, k), _LONG - 1, np.int64)
        self.full = np.zeros((n, k), bool)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """rows: queries; score, ok: (rows, candidates)."""
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        f = np.concatenate([self.full[rows], ok], axis=1)
        if s.shape[1] > 4 * self.k:  # the k best scores, and whatever ties with the last
            worst = np.partition(np.where(f, s, -_LONG), -self.k, axis=1)[:, [-self.k]]
            wide = np.flatnonzero((f & (s >= worst)).any(axis=0))
            s, i, f = s[:, wide], i[:, wide], f[:, wide]
        order = np.lexsort((i, ~s, ~f), axis=1)[:, : self.k]
        self.score[rows], self.id[rows], self.full[rows] = (np.take_along_axis(x, order, axis=1) for x in (s, i, f))

    def least(self) -> np.ndarray:
        return np.where(self.full[:, -1], self.score[:, -1].astype(float), -np.inf)


def search_chunk(best: TopK, floor: np.ndarray, q: dict, ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, partial: int) -> bool:
    """Hold candidates against all queries. False if none can matter."""
    norm = np.sqrt((c * c).sum(axis=1))
    need = np.maximum(best.least(), floor)
    slack = 1e-9 * q["norm"] * norm.max(initial=0) + 1e-6
    rows = np.flatnonzero(q["norm"] * norm.max(initial=0) + slack >= need)
    if not len(rows):
        return False
    r = c @ rotation
    rest = np.sqrt((r[:, partial:] ** 2).sum(axis=1))
    bound = q["rot"][rows, :partial] @ r[:, :partial].T + np.outer(q["rest"][rows], rest)
    ok = bound + slack[rows, None] >= need[rows, None]
    some = np.flatnonzero(ok.any(axis=1))
    rows, cand = rows[some], np.flatnonzero(ok.any(axis=0))
    if len(rows):
        score = exact_scores(q["v"][rows], c[cand])
        own = q["id"][rows, None] == ids[cand][None, :]
        ok = ok[np.ix_(some, cand)] & (score >= need[rows, None]) & ~own
        hit = ok.any(axis=1)
        best.add(rows[hit], score[hit], ids[cand], ok[hit])
    return True


def top_k(vectors: DataFrame, queries: Column, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k highest integer inner products
    with all other rows, ties to the smaller vec_id; fewer if there are fewer rows.

    vectors: vec_id, embedding. Vectors null or with null or non-finite components, and rows
    with a null vec_id, take no part. Rows with a query's own vec_id are its own. A query
    id given twice is one query (with the smaller vector); repeated rows are candidates
    each. Shorter vectors count as filled with zeros; an empty vector scores 0.
    Components are integers below 2^53; scores beyond a long are the nearest long. Queries
    are answered in blocks of `query_block`, each broadcast, in one pass over the candidates."""
    spark = vectors.sparkSession
    ship(spark)
    v = usable(vectors)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    v = table(v.withColumn("norm", norm), "vectors")
    rows, dim = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    schema = "query_id long, vec_id long, score long"
    result = spark.createDataFrame([], schema)
    if not rows:
        return result.withColumn("rank", F.lit(0)).select("query_id", "rank", "vec_id", "score")

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0), dim)
            m = m / np.maximum(1, np.sqrt((m * m).sum(axis=1, keepdims=True)))
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    summed = v.select("v").mapInArrow(gram, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    g = np.zeros((dim, dim))
    for r in summed.toLocalIterator():  # dim x dim, whatever the number of rows
        g[r["i"], r["j"]] = r["x"]
    rotation = np.linalg.eigh(g)[1][:, ::-1].copy() if dim else np.zeros((0, 0))
    partial = max(1, int(dim * PARTIAL)) if dim else 0

    # equal lengths are dealt by id, so that one common vector is not one task's
    n_parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (2 * _CHUNK))))
    sorted_v = table(v.repartitionByRange(n_parts, F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("norm").desc(), F.col("vec_id")), "sorted")
    head = v.orderBy(F.col("norm").desc(), "vec_id").limit(HEAD).select("vec_id", "v").toArrow()
    head_ids, head_v = head.column("vec_id").to_numpy(), _rows(head.column("v"), dim)

    asked = table(v.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n_blocks = -(-asked.count() * 5 // (4 * query_block))
    numbered = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n_blocks))).alias("block"))
    made = len(tables_made(spark))
    for block in range(n_blocks):
        mine = numbered.filter(F.col("block") == block).select("vec_id", "v").toArrow()
        if not mine.num_rows:
            continue
        qv = _rows(mine.column("v"), dim)
        q = {"id": mine.column("vec_id").to_numpy(), "v": qv, "rot": qv @ rotation, "norm": np.sqrt((qv * qv).sum(axis=1))}
        q["rest"] = np.sqrt((q["rot"][:, partial:] ** 2).sum(axis=1))
        first = TopK(len(qv), k)
        none = np.full(len(qv), -np.inf)
        for i in range(0, len(head_ids), _CHUNK):
            if not search_chunk(first, none, q, head_ids[i : i + _CHUNK], head_v[i : i + _CHUNK], rotation, partial):
                break
        held = spark.sparkContext.broadcast((q, first.least(), rotation))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q, floor, rotation = held.value
            best = TopK(len(q["id"]), k)
            for b in batches:
                ids, c = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                for i in range(0, len(ids), _CHUNK):
                    search_chunk(best, floor, q, ids[i : i + _CHUNK], c[i : i + _CHUNK], rotation, partial)
            at = np.nonzero(best.full)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q["id"][at[0]], best.id[at], best.score[at])], ["query_id", "vec_id", "score"])

        result = sorted_v.select("vec_id", "v").mapInArrow(run, schema)
        if n_blocks > 1:  # each block's rows are written, so that the plan does not grow with their number
            table(result, "found")
    if n_blocks > 1:
        result = spark.read.schema(schema).parquet(*tables_made(spark)[made:])
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return result.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 100 == 0)
