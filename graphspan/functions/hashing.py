"""Hash functions as column expressions, each beside SQL text of the same meaning.

A value's code is the low 30 bits of the SHA-256 of its text. A tuple's text is the
values in parentheses, separated by ', ', a single value followed by a comma.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK30 = (1 << 30) - 1


def code(text: Column) -> Column:
    return F.conv(F.right(F.sha2(text.cast("string").cast("binary"), 256), F.lit(8)), 16, 10).cast("long").bitwiseAND(F.lit(MASK30))


def masked(text: Column, mask: int = (1 << 20) - 1) -> Column:
    return code(text).bitwiseAND(F.lit(mask))


def check_nbits(nbits: int) -> int:
    if not 2 <= nbits <= 30:
        raise ValueError("nbits must lie between 2 and 30")
    return nbits


def feature_id(text: Column, nbits: int = 10) -> Column:
    """Columns 0 and 1 are reserved; only half of the rest can be reached by this mask."""
    return (masked(text, (1 << check_nbits(nbits)) - 3) + 2).cast("int")


def tuple_text(items: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(items.cast("array<string>"), ", "), F.when(F.size(items) == 1, ",").otherwise(""), F.lit(")"))


def sequence_code(*items: Column) -> Column:
    return code(F.concat(F.lit("("), F.concat_ws(", ", *[i.cast("string") for i in items]), F.lit("," if len(items) == 1 else ""), F.lit(")")))


def list_code(items: Column) -> Column:
    return code(tuple_text(items))


def set_code(items: Column) -> Column:
    """Of a multiset of codes: order does not matter, repeats do."""
    return list_code(F.array_sort(items))


class sql:
    """The same in DuckDB SQL."""

    @staticmethod
    def code(text: str) -> str:
        return f"(CAST('0x' || right(sha256(CAST({text} AS VARCHAR)), 8) AS BIGINT) & {MASK30})"

    @staticmethod
    def feature_id(text: str, nbits: int = 10) -> str:
        return f"CAST(({sql.code(text)} & {(1 << nbits) - 3}) + 2 AS INTEGER)"

    @staticmethod
    def sequence_code(*items: str) -> str:
        inner = " || ', ' || ".join(f"CAST({i} AS VARCHAR)" for i in items)
        return sql.code(f"('(' || {inner} || '{',' if len(items) == 1 else ''})')")

    @staticmethod
    def list_code(items: str) -> str:
        return sql.code(f"('(' || array_to_string({items}, ', ') || CASE WHEN len({items}) = 1 THEN ',)' ELSE ')' END)")

    @staticmethod
    def set_code(items: str) -> str:
        return sql.list_code(f"list_sort({items})")
