r"""Chat formatting by token-level assembly.

A turn becomes: turn id, role ids, text id, content ids, end id. The segments are
encoded separately and the three reserved ids, which lie beyond the vocabulary, are
spliced in, so no content can produce them. As text, they read `### `, `: ` and
` </turn>\n`. For readers of that text, control strings in roles and contents are
escaped: a backslash is doubled and one is put before the second of two `#`, before a
`/` that follows `<`, and in roles before a `:`. The loss mask is set by prefix sums of
the segments' lengths: ones on the contents of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship
from .tokens import decode_bytes, encoder, token_bytes

#: How far beyond the vocabulary the reserved ids lie, and the text of each.
TURN, TEXT, END = 0, 1, 2
SHOWN = {TURN: "### ", TEXT: ": ", END: " </turn>\n"}

_ESCAPED = re.compile(r"\\|(?<=#)#|(?<=<)/")
_ESCAPED_ROLE = re.compile(r"\\|(?<=#)#|(?<=<)/|:")
_UNESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_ESCAPED_ROLE if role else _ESCAPED).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def assemble(role_ids: np.ndarray, content_ids: np.ndarray, base: int, learned: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn."""
    parts = [[base + TURN], role_ids, [base + TEXT], content_ids, [base + END]]
    ends = np.cumsum([len(p) for p in parts])
    mask = np.zeros(ends[-1] + 1, dtype=np.int8)
    if learned:  # +1 where the content starts, -1 where it ends; the sums are the mask
        mask[ends[2]] += 1
        mask[ends[3]] -= 1
    return np.concatenate([np.asarray(p, dtype="i4") for p in parts]), np.cumsum(mask[:-1], dtype=np.int8)


def format_turns(conversations: DataFrame, vocabulary: str, pattern: str, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text, ids array<int>, loss_mask array<tinyint>), one row per
    turn, encoded where it is read. A conversation is its rows by turn (ties: by role, then
    text; null turns first). Null roles and texts count as empty; rows with a null
    conv_id form one conversation; repeated rows are turns of their own."""
    ship(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        base = len(token_bytes(enc.tokenizer))
        for b in batches:
            roles, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            parts = enc.encode_all(escape(r, True) for r in roles), enc.encode_all(map(escape, texts))
            made = [assemble(x, y, base, r == loss_role) for r, x, y in zip(roles, *parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int8()))], ["conv_id", "turn", "role", "text", "ids", "loss_mask"])

    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return plain.mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, loss_mask array<tinyint>")


class _Digest:
    """What is read back of one conversation, turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, mask: np.ndarray, table: list[bytes]) -> None:
        base = len(table)
        at = {k: int(np.flatnonzero(ids == base + k)[0]) for k in SHOWN}
        role, content = (decode_bytes(ids[a + 1 : b].tolist(), table).decode() for a, b in ((at[TURN], at[TEXT]), (at[TEXT], at[END])))
        self.turns += 1
        self.chars += len(role) + len(content) + sum(map(len, SHOWN.values()))
        self.turns_sha.update(f"{unescape(role)}\n{unescape(content)}\n".encode())
        loss = unescape(decode_bytes(ids[mask.astype(bool)].tolist(), table).decode())
        self.loss_chars += len(loss)
        self.loss_sha.update(loss.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars


def read_back(turns: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row per conversation, from the ids and masks alone. A conversation's turns are
    read as a sorted stream: only one turn is in memory at a time, however many it has."""
    ship(turns.sparkSession)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def rows(done: list[_Digest]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(d.row() for d in done), strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(encoder(vocabulary, pattern).tokenizer)
        now, done = None, []
        for b in batches:
            for conv_id, ids, mask in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if now is None or now.conv_id != conv_id:
                    done += [now] if now else []
                    now = _Digest(conv_id)
                now.add(ids.values.to_numpy(), mask.values.to_numpy(), table)
            if done:
                yield rows(done)
                done = []
        if now:
            yield rows([now])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    import public_tokenizers as tokenizers_files

    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    at = tokenizers_files.path("byte_bpe_50k.json"), tokenizers_files.PATTERN
    return read_back(format_turns(conversations.select("conv_id", "turn", "role", "text").unionByName(extra), *at), *at)
