"""The last word of SHA-256 for many short texts at once, over NumPy columns."""

from __future__ import annotations

from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fewer texts of a length, or longer ones (in blocks of 64 bytes), are hashed one by one.
FEW, LONG = 6_000, 4
#: Texts hashed at once.
ROWS = 1 << 15

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]


def _root(p: int, k: int) -> int:
    """The first 32 bits of the fraction of the k-th root of p."""
    low, high = 0, p << 32
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**k <= p << (32 * k) else (low, mid)
    return low & 0xFFFFFFFF


_START = [np.uint32(_root(p, 2)) for p in _PRIMES[:8]]
_K = [np.array(_root(p, 3), np.uint32) for p in _PRIMES]
_N = [np.array(k, np.uint32) for k in range(33)]


def _block(w: list[np.ndarray | None], state: list, last: bool) -> list:
    """The state after a block of 16 words, which are overwritten; None is a word of zeros. Of
    the last block only the last word is right: it is known three rounds before the end."""
    right, left, xor, both, add = np.right_shift, np.left_shift, np.bitwise_xor, np.bitwise_and, np.add
    n = next(len(x) for x in w if x is not None)
    t, z, ab, bc = (np.empty(n, np.uint32) for _ in range(4))
    a, b, c, d, e, f, g, h = [np.full(n, x, np.uint32) for x in state]
    xor(b, c, bc)

    def small(x, p, q, s):  # t: x turned by p, by q, and shifted by s
        right(x, _N[p], t)
        for k, by in ((left, 32 - p), (right, q), (left, 32 - q), (right, s)):
            k(x, _N[by], z)
            xor(t, z, t)

    def large(x, p, q, s):  # t: x turned by p, by q and by s
        right(x, _N[s - q], t)
        left(x, _N[32 - s + q], z)
        xor(t, z, t)
        xor(t, x, t)
        for by in (q - p, p):
            right(t, _N[by], z)
            left(t, _N[32 - by], t)
            xor(t, z, t)
            if by != p:
                xor(t, x, t)

    ends = 61 if last else 64
    for i in range(ends):
        j = i & 15
        if i > 15:
            for back, turns in ((2, (17, 19, 10)), (15, (7, 18, 3)), (7, None)):
                x = w[(i - back) & 15]
                if x is None:
                    continue
                if turns:
                    small(x, *turns)
                    x = t
                if w[j] is None:
                    w[j] = x.copy()
                else:
                    add(w[j], x, w[j])
        if w[j] is not None:
            add(h, w[j], h)
        add(h, _K[i], h)
        large(e, 6, 11, 25)
        add(h, t, h)
        xor(f, g, t)
        both(t, e, t)
        xor(t, g, t)
        add(h, t, h)
        add(d, h, d)
        if not last or i < 57:  # what later rounds make of a
            large(a, 2, 13, 22)
            add(h, t, h)
            xor(a, b, ab)
            both(ab, bc, bc)
            xor(bc, b, bc)
            add(h, bc, h)
            ab, bc = bc, ab
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    found = (a, b, c, d, e, f, g, e if last else h)
    return [x + y for x, y in zip(found, state)]


def _words(texts: pa.Array, size: np.ndarray, blocks: int) -> np.ndarray:
    """Last words of texts that have so many blocks, padding included."""
    n, width = len(texts), (int(size.max()) // 4 + 1) * 4
    padded = pc.ascii_rpad(texts, width, padding="\0")
    text = np.frombuffer(padded.buffers()[2], np.uint8, n * width, int(padded.offset) * width).reshape(n, width).copy()
    text[np.arange(n), size] = 128
    columns = text.view(">u4")
    state: list = _START
    for k in range(blocks):
        w: list[np.ndarray | None] = [columns[:, 16 * k + j].astype(np.uint32) if 16 * k + j < width // 4 else None for j in range(16)]
        if k == blocks - 1:
            bits = (size * 8).astype(np.uint32)
            w[15] = bits if w[15] is None else w[15] | bits
        state = _block(w, state, k == blocks - 1)
    return state[7]


def _one_by_one(texts: pa.Array) -> np.ndarray:
    digests = b"".join([sha256(x).digest() for x in texts.cast(pa.binary()).to_pylist()])
    return np.frombuffer(digests, ">u4")[7::8].astype(np.uint32)


def last_words(texts: pa.Array) -> np.ndarray:
    """The last 32 bits of the digest of each text in UTF-8."""
    if len(texts) < FEW:
        return _one_by_one(texts)
    texts = texts.cast(pa.string())
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    blocks = np.minimum((size + 8) // 64 + 1, LONG + 1)
    out = np.empty(len(texts), np.uint32)
    for k, count in zip(*np.unique(blocks, return_counts=True)):
        at = None if count == len(texts) else np.flatnonzero(blocks == k)
        some = texts if at is None else texts.take(pa.array(at))
        if k > LONG or count < FEW:
            found = _one_by_one(some)
        else:
            own = size if at is None else size[at]
            found = np.concatenate([_words(some.slice(i, ROWS), own[i : i + ROWS], int(k)) for i in range(0, len(own), ROWS)])
        out[slice(None) if at is None else at] = found
    return out
