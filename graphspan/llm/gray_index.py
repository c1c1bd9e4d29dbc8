"""Hamming search in sorted Gray order under a hierarchy of masked patterns.

Codes sorted by Gray rank differ little from their neighbours. Sixteen neighbours form a
node: its mask has the bits on which all agree, its pattern their values. Sixteen nodes
form a node above, and so on. A node keeps only the bits its parent does not have yet, so
going down adds the differences bit group by bit group; a whole group goes as soon as
they exceed the limit.
"""

from __future__ import annotations

import numpy as np

FAN = 16
#: Query-node pairs examined at once; bounds the memory of a search.
_AT_ONCE = 1 << 19


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of a code in the reflected Gray sequence (prefix xor of its bits)."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    def __init__(self, codes: np.ndarray):
        """codes: distinct uint64, sorted by Gray rank."""
        self.codes, self.levels = codes, []
        both = codes, codes  # of each node, the AND and the OR of its codes
        while not self.levels or len(both[0]) > FAN:
            starts = np.arange(0, len(both[0]), FAN)
            both = np.bitwise_and.reduceat(both[0], starts), np.bitwise_or.reduceat(both[1], starts)
            self.levels.append((~(both[0] ^ both[1]), both[0]))
        self.levels.reverse()  # from the top
        self.own = []  # mask bits that a node has beyond its parent's
        for i, (mask, _) in enumerate(self.levels):
            above = self.levels[i - 1][0][np.arange(len(mask)) // FAN] if i else np.zeros(len(mask), np.uint64)
            self.own.append(mask & ~above)
        self.leaf_own = ~self.levels[-1][0][np.arange(len(codes)) // FAN]

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, code number) of all pairs with at most `most` differing bits."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, _AT_ONCE // FAN)
        for at in range(0, len(queries), step):
            top = len(self.levels[0][0])
            q = np.repeat(np.arange(at, min(at + step, len(queries))), top)
            work = [(0, q, np.tile(np.arange(top), len(q) // top), np.zeros(len(q), np.uint8))]
            while work:
                level, q, node, diff = work.pop()
                leaf = level == len(self.levels)
                pattern, own = (self.codes, self.leaf_own) if leaf else (self.levels[level][1], self.own[level])
                diff = diff + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
                ok = diff <= most
                q, node, diff = q[ok], node[ok], diff[ok]
                if leaf:
                    found.append((q, node))
                    continue
                below = len(self.codes) if level + 1 == len(self.levels) else len(self.levels[level + 1][0])
                for i in range(0, len(q), step):
                    part = slice(i, i + step)
                    child = (node[part, None] * FAN + np.arange(FAN)).ravel()
                    real = child < below
                    work.append((level + 1, np.repeat(q[part], FAN)[real], child[real], np.repeat(diff[part], FAN)[real]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def spanning_links(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (both ends as codes) that join what differs in at most `most` bits: fewer
    than there are codes, however many pairs are alike. codes: distinct, sorted by Gray rank.

    Large clusters are walked first: from a code to all it reaches, each reached once.
    When that has been tried often enough to have met any large cluster, the codes left
    are searched for at once."""
    left, ends = np.ones(len(codes), bool), []
    tries = 8 * len(codes).bit_length() if len(codes) > 256 else 0
    for k in range(1, tries + 1):
        todo = np.flatnonzero(left)
        if len(todo) < 2:
            break
        frontier = todo[[k * 2654435761 % len(todo)]]
        left[frontier] = False
        while len(frontier):
            rest = np.flatnonzero(left)
            q, c = GrayIndex(codes[np.sort(frontier)]).search(codes[rest], most)
            q, first = np.unique(q, return_index=True)
            new = rest[q]
            ends.append((codes[new], codes[np.sort(frontier)[c[first]]]))
            left[new] = False
            frontier = new
    # codes reached from no start yet; those walked are whole clusters and done
    todo = codes[left]
    if len(todo) > 1:
        q, c = GrayIndex(todo).search(todo, most)
        a, b = _forest(q[c < q], c[c < q])
        ends.append((todo[a], todo[b]))
    if not ends:
        return codes[:0], codes[:0]
    return np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links."""
    top = {x: x for x in np.concatenate([a, b]).tolist()}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            top[max(p, q)] = min(p, q)
            out.append((x, y))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def run_links(codes: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """`spanning_links` of consecutive runs of codes, each sorted by Gray rank; starts: where
    runs begin. Runs no longer than a node are leaves: they are compared as they stand."""
    lengths = np.diff(np.append(starts, len(codes)))
    run = np.repeat(np.arange(len(starts)), lengths)
    short = np.repeat(lengths <= FAN, lengths)
    a, b = [], []
    for shift in range(1, min(FAN, int(lengths.max(initial=1)))):
        i = np.flatnonzero((run[shift:] == run[:-shift]) & short[shift:] & (np.bitwise_count(codes[shift:] ^ codes[:-shift]) <= most))
        a.append(codes[i + shift]), b.append(codes[i])
    for k in np.flatnonzero(lengths > FAN):
        x, y = spanning_links(codes[starts[k] : starts[k] + lengths[k]], most)
        a.append(x), b.append(y)
    if not a:
        return codes[:0], codes[:0]
    return np.concatenate(a), np.concatenate(b)
