"""Byte-level BPE over Arrow batches: encode and decode columns, and query op3."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import free_name, ship, text_or_empty
from .tokens import Encoder, decode_bytes, encoder, token_bytes

_tables: dict[int, tuple[list[bytes], np.ndarray]] = {}


def _of(enc: Encoder) -> list[bytes]:
    if id(enc) not in _tables:
        _tables.clear()
        _tables[id(enc)] = token_bytes(enc.tokenizer)
    return _tables[id(enc)]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", starts: str | None = None) -> DataFrame:
    """df with the column `out` (array<int>) of ids, and `starts` (array<long>) of their
    byte offsets in the UTF-8 text if named. Null and empty texts have no ids; other
    columns and the rows' number stay. A column of df named like an output is replaced."""
    ship(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name not in (out, starts)]
    names = [f.name for f in fields]
    source = free_name(df, "text")
    schema = StructType([*fields, StructField(out, ArrayType(IntegerType())), *([StructField(starts, ArrayType(LongType()))] if starts else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for b in batches:
            found = list(enc.encode_all(b.column(len(names)).to_pylist()))
            cols = [b.column(i) for i in range(len(names))] + [pa.array([x.astype("i4") for x in found], pa.list_(pa.int32()))]
            if starts:
                cols.append(pa.array([enc.starts(x) for x in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names + [out] + ([starts] if starts else []))

    return df.select(*[f"`{n}`" for n in names], text_or_empty(text).alias(source)).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the column `out` (binary) of the ids' bytes. Null ids give null."""
    ship(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in fields]
    schema = StructType([*fields, StructField(out, BinaryType())])
    at = free_name(df, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _of(encoder(ranks_path, pattern))
        for b in batches:
            done = [None if x is None else decode_bytes(x, table) for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(done, pa.binary())], [*names, out])

    return df.select(*[f"`{n}`" for n in names], F.col(f"`{ids}`").alias(at)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, whole texts, in one
    pass without a shuffle; ids never leave the worker. Null texts count as empty; rows
    with a null or repeated doc_id are rows like others."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        table, shown = _of(enc), [str(i) for i in range(len(_of(enc)))]
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for found in enc.encode_all(b.column(1).to_pylist()):
                ids = found.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decode_bytes(ids, table)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3(docs: DataFrame) -> DataFrame:
    import public_tokenizers as tokenizers_files

    return round_trip(docs, tokenizers_files.path("byte_bpe_50k.tiktoken"), tokenizers_files.PATTERN)
