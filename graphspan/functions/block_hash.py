"""The codes of hashing.py over NumPy columns, each distinct text hashed once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .block_sha import last_words
from .hashing import MASK30


def codes(texts: pa.Array) -> np.ndarray:
    """The code of each text."""
    return last_words(texts).astype(np.int64) & MASK30


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each value among the distinct ones, and those."""
    return pd.factorize(key)


def _sequence_texts(columns: list[np.ndarray]) -> pa.Array:
    parts = [pa.array(c).cast(pa.string()) for c in columns]
    inner = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, ", ")
    return pc.binary_join_element_wise("(", inner, ",)" if len(parts) == 1 else ")", "")


def sequence_codes(*columns: np.ndarray) -> np.ndarray:
    """The code of each row's values as a tuple. Values are not negative; each distinct row is
    hashed once."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 63:
        if len(columns) < 3 or not len(columns[0]):
            return codes(_sequence_texts(list(columns)))
        # the last column stays apart, the others are numbered by their distinct rows
        head = columns[0].astype(np.int64)
        for c, width in zip(columns[1:-1], bits[1:-1]):
            head = distinct(head)[0].astype(np.int64)
            head = (head << width) | c
        head = distinct(head)[0].astype(np.int64)
        key = (head << bits[-1]) | columns[-1]
    else:
        key = np.zeros(len(columns[0]), np.int64)
        for c, width in zip(columns, bits):
            key = (key << width) | c
    place, found = distinct(key)
    if len(found) == len(key):
        return codes(_sequence_texts(list(columns)))
    first = np.empty(len(found), np.int64)
    first[place[::-1]] = np.arange(len(key))[::-1]
    return codes(_sequence_texts([c[first] for c in columns]))[place]


def list_codes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The code of each list of values, list i from offsets[i] to offsets[i + 1]."""
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(pa.string()))
    tails = pa.array([")", ",)"]).take(pa.array((np.diff(offsets) == 1).astype(np.int8)))
    texts = pc.binary_join_element_wise("(", pc.binary_join(lists, ", "), tails, "").dictionary_encode()
    return codes(texts.dictionary)[texts.indices.to_numpy()]


def set_codes(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The code of each group's multiset of codes, for groups 0 to n - 1; values are codes."""
    key = np.sort((groups.astype(np.int64) << 30) | values)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=n))])
    return list_codes(key & MASK30, offsets)
