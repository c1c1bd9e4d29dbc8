"""Suffix-array dedup by a depth-limited radix sort.

Only the order of suffixes down to `depth` bytes matters, and only whether windows of
that length are equal. The most significant digits come first and drop whatever is
alone after each pass:

1. Every window has an anchor, the smallest hash of the 48-byte strings in it, which
   equal windows share. The first digit is the 200 bytes behind the anchor, or those
   before it if the window reaches further to the left. Digits found once go.
2. What is left, the bytes around the remaining anchors, is dealt to tasks by that
   digit, and there windows are sorted by the anchor's place and then digit by digit of
   50 bytes. Groups of two or more after the last digit are the repeated windows.
3. Digits too frequent for one task are counted by window instead, with map-side sums.
   Misra-Gries summaries find those of a large share before anything is dealt by digit.

Texts that are equal as a whole take part once: all their bytes are repeated.

The passes work on sequences of symbols: a text's bytes, or, for repeated passages of a
number of words, 32-bit codes of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import bloom
from .common import BROADCAST_ROWS, drop_tables, last_table, maybe_broadcast, ship, table, tables_made, text_or_empty
from .exact_dedup import exact_dedup, heavy_candidates

DEPTH = 400


def sizes(depth: int) -> tuple[int, int, int]:
    """Symbols of an anchor, of the first digit, and of the following digits: of 400 bytes
    48, 200 and 50."""
    return max(1, 3 * depth // 25), max(1, depth // 2), max(1, depth // 8)


#: Digits with more anchors than this are counted by window.
HOT_DIGIT = 10_000

_SEGMENT = 1 << 22  # longer texts are read in segments that overlap by depth - 1 symbols
_BUFFER = 1 << 20
_POSITION = np.uint64((1 << 24) - 1)  # low bits of an anchor's hash: its place in a buffer, which is no longer than a segment
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                made = np.multiply.accumulate(steps)
            _powers[i:i + 1] = [made]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Polynomial hashes modulo 2^64 of any substring of a buffer, by prefix sums."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def at(self, i: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.sums[i + length] - self.sums[i]) * self.down[i])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all w consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """(anchor, first window, last window) of the windows in a buffer of texts with the
    given ends. No window reaches over an end."""
    h = Hashes(data)
    if len(data) < depth:
        return *[np.empty(0, np.int64)] * 3, h
    value = (h.all(gram) & ~_POSITION) | np.arange(len(data) - gram + 1, dtype=np.uint64)
    least = sliding_min(value, depth - gram + 1)
    lengths = np.diff(ends, prepend=0)
    left = np.repeat(ends, lengths)[: len(least)] - np.arange(len(least))
    s = np.flatnonzero(left >= depth)
    p = (least[s] & _POSITION).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1 if len(first) else first
    return p[first], s[first], s[last], h


def _packed(p: np.ndarray, far: np.ndarray, near: np.ndarray, side: int) -> np.ndarray:
    return ((p * 1024 + far) * 1024 + near) * 2 + side


def first_digits(texts: list[tuple[bytes, np.ndarray]], depth: int = DEPTH) -> tuple[np.ndarray, list[bytes], np.ndarray, list[tuple[bytes, int, int]]]:
    """(digit, id, place) of the anchors of (id, symbols) pairs, and spans found within a text.
    A place is packed: anchor, its greatest and least distance from the starts of its
    windows, side. Where all symbols around several anchors of a text are the same, as in
    periodic passages, they are repeated, and only the first of these anchors goes on."""
    gram, first, _ = sizes(depth)
    buffers: list[list[tuple[bytes, int, np.ndarray]]] = [[]]  # of (id, place in the text, segment)
    size = 0
    for key, text in texts:
        for a in range(0, max(1, len(text) - depth + 1), _SEGMENT - depth + 1):
            part = text[a : a + _SEGMENT]
            if size + len(part) > _SEGMENT and buffers[-1]:
                buffers.append([])
                size = 0
            buffers[-1].append((key, a, part))
            size += len(part)
    found = [_buffer_digits(x, depth, gram, first) for x in buffers]
    spans: dict[bytes, list[tuple[int, int]]] = {}
    for *_, own in found:
        for key, a, b in own:
            spans.setdefault(key, []).append((a, b))
    own = [(key, a, b) for key, x in spans.items() for a, b in merged(x)]
    return np.concatenate([x[0] for x in found]), [key for x in found for key in x[1]], np.concatenate([x[2] for x in found]), own


def _buffer_digits(segments: list[tuple[bytes, int, np.ndarray]], depth: int, gram: int, first: int) -> tuple[np.ndarray, list[bytes], np.ndarray, list[tuple[bytes, int, int]]]:
    """The same of (id, place in the text, segment) that fit one buffer."""
    owner, parts = [x[0] for x in segments], [x[2] for x in segments]
    lengths = np.array([len(x) for x in parts], np.int64)
    shift = (np.array([x[1] for x in segments], np.int64) - (np.cumsum(lengths) - lengths)).tolist()
    data = np.concatenate([*parts, np.empty(0, np.uint8)])
    ends = np.cumsum(lengths)
    p, lo, hi, h = anchors(data, ends, depth, gram)
    text_no = np.searchsorted(ends, p, side="right")
    local = p + np.array(shift, np.int64)[text_no] if len(p) else p
    far, near = p - lo, p - hi
    around = mixed((h.sums[hi + depth] - h.sums[lo]) * h.down[lo])
    around = mixed(around + far.astype(np.uint64) * np.uint64(1024) + near.astype(np.uint64)) ^ mixed(text_no.astype(np.uint64))
    _, once, back, times = np.unique(around, return_index=True, return_inverse=True, return_counts=True)
    twin = np.flatnonzero(times[back] > 1)
    own = []
    for t, a, b in zip(text_no[twin].tolist(), lo[twin].tolist(), (hi[twin] + depth).tolist(), strict=True):
        own.append((owner[t], a + shift[t], b + shift[t]))
    once = np.sort(once)
    p, text_no, local, far, near = p[once], text_no[once], local[once], far[once], near[once]
    out = []
    right = near <= depth - first
    out.append((h.at(p[right], first), text_no[right], _packed(local[right], np.minimum(far[right], depth - first), near[right], 0)))
    to_left = far > depth - first
    q = p[to_left]
    out.append((~h.at(q - first, first), text_no[to_left], _packed(local[to_left], far[to_left], np.maximum(near[to_left], depth - first + 1), 1)))
    digits, numbers, places = (np.concatenate(x) for x in zip(*out, strict=True))
    return digits, [owner[i] for i in numbers.tolist()], places, own


def contexts(text: np.ndarray, places: list[int], depth: int = DEPTH) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, distance of the first window to the anchor, symbols) of packed places."""
    for place in places:
        place, near = divmod(place // 2, 1024)
        p, far = divmod(place, 1024)
        yield p - far, far, text[p - far : p - near + depth]


def repeated_windows(groups: np.ndarray, far: np.ndarray, parts: list[np.ndarray], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, window in it) of the windows found twice or more within their group."""
    digit = sizes(depth)[2]
    lengths = np.array([len(x) for x in parts], np.int64)
    offsets = np.cumsum(lengths) - lengths
    n = lengths - depth + 1
    who = np.repeat(np.arange(len(parts)), n)
    j = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    h = Hashes(np.concatenate(parts))
    rank = groups[who] * 1024 + (far[who] - j)
    start = offsets[who] + j
    for d in range(-1, -(-depth // digit)):
        if d >= 0:
            at = min(d * digit, depth - digit)
            rank = mixed(rank.astype(np.uint64) * np.uint64(_BASE) + h.at(start + at, digit))
        _, rank, counts = np.unique(rank, return_inverse=True, return_counts=True)
        again = counts[rank] > 1
        rank, who, j, start = rank[again], who[again], j[again], start[again]
        if not len(rank):
            break
    return who, j


def _spans(who: np.ndarray, j: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that touch, as (context, first byte, end)."""
    order = np.lexsort((j, who))
    who, j = who[order], j[order]
    new = np.ones(len(j), bool)
    new[1:] = (who[1:] != who[:-1]) | (j[1:] > j[:-1] + depth)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(j)) - 1 if len(first) else first
    return who[first], j[first], j[last] + depth


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_EDGE = np.isin(np.arange(256), np.frombuffer(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", np.uint8)) | _BLANK


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words, runs outside [\x20\x09-\x0D]."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_BLANK[data]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_codes(texts: list[bytes]) -> list[np.ndarray]:
    """32-bit hashes of each text's words, without ASCII punctuation at a word's ends unless
    it is nothing else."""
    if len(texts) == 1 and len(texts[0]) > 2 * _SEGMENT:  # in parts that end at blanks
        parts, at = [], 0
        while at < len(texts[0]):
            blank = texts[0].find(b" ", at + _SEGMENT)
            end = blank if blank >= 0 else len(texts[0])
            parts.append(texts[0][at:end])
            at = end + 1
        return [np.concatenate([_codes([p])[0] for p in parts])] if len(parts) > 1 else [_codes(texts)[0]]
    return _codes(texts)


def _codes(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts), np.uint8)
    a, b = words_of(data)
    if not len(a):
        return [np.empty(0, np.uint32)] * len(texts)
    inner = np.flatnonzero(~_EDGE[data])
    if len(inner):
        first, last = np.searchsorted(inner, a), np.searchsorted(inner, b) - 1
        some = last >= first
        a2, b2 = np.where(some, inner[np.minimum(first, len(inner) - 1)], a), np.where(some, inner[last] + 1, b)
    else:
        a2, b2 = a, b
    h = Hashes(data)
    codes = (mixed((h.sums[b2] - h.sums[a2]) * h.down[a2]) >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(codes, np.searchsorted(a, ends[:-1]))


def word_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of the text, from the first word's start to the last one's
    end; at the text's ends with the blanks there."""
    if not spans:
        return []
    first, ends = words_of(np.frombuffer(text, np.uint8))
    return [(int(first[a]) if a else 0, int(ends[b - 1]) if b < len(ends) else len(text)) for a, b in spans]


def byte_codes(texts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint8) for t in texts]


_SPAN = "td binary, start long, end long"


def _span_batch(ids: list[bytes], a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["td", "start", "end"])


def _spans_of_cold(shipped: DataFrame, depth: int, kind: type) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # digit, td, start, far, bytes
        size = 0

        def done(part: list[tuple]) -> pa.RecordBatch:
            if len(part) < 2:
                return _span_batch([], [], [])
            groups = np.cumsum([0] + [x[0] != y[0] for x, y in zip(part, part[1:], strict=False)])
            # a digit found once here has lost its twin nowhere: it was alone in step 1's hash
            who, j = repeated_windows(groups, np.array([x[3] for x in part]), [np.frombuffer(x[4], kind) for x in part], depth)
            who, a, b = _spans(who, j, depth)
            return _span_batch([part[i][1] for i in who.tolist()], [part[i][2] + x for i, x in zip(who.tolist(), a.tolist(), strict=True)], [part[i][2] + x for i, x in zip(who.tolist(), b.tolist(), strict=True)])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > _BUFFER and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        yield done(rows)

    dealt = shipped.repartition("digit").sortWithinPartitions("digit")
    return dealt.select("digit", "td", "start", "far", "part").mapInArrow(run, _SPAN)


def _spans_of_hot(shipped: DataFrame, depth: int, kind: type) -> DataFrame:
    """The same for digits with too many anchors for one task: windows are counted by
    their hash with map-side sums, and joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digit, td, start, far, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                symbols = np.frombuffer(part, kind)
                j = np.arange(len(symbols) - depth + 1)
                h = Hashes(symbols).at(j, depth)
                h = mixed(h + mixed(np.uint64(digit & (1 << 64) - 1) + (far - j).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([td] * len(j), pa.binary()), pa.array(start + j, pa.int64())], ["h", "td", "start"])

    windows = table(shipped.select("digit", "td", "start", "far", "part").mapInArrow(run, "h long, td binary, start long"), "windows")
    twice = table(windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    # windows of so many rows are known to all tasks; there are 100,000 of them at most
    at = max(HOT_DIGIT, windows.count() // 100_000)
    often = F.broadcast(twice.filter(F.col("n") > at).select("h"))
    found = windows.join(often, "h", "left_semi").unionByName(windows.join(often, "h", "left_anti").join(twice.filter(F.col("n") <= at).select("h").hint("merge"), "h", "left_semi"))
    return _touching(found.select("td", "start", (F.col("start") + depth).alias("end")))


def _touching(spans: DataFrame) -> DataFrame:
    """Spans of one text that touch or overlap as one, within each 64 KB of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            ids, a, e = [], [], []
            for td, start, end in zip(*(b.column(c).to_pylist() for c in ("td", "start", "end")), strict=True):
                if now and now[0] == td and start <= now[2]:
                    now = (td, now[1], max(end, now[2]))
                    continue
                if now:
                    ids.append(now[0]), a.append(now[1]), e.append(now[2])
                now = (td, start, end)
            yield _span_batch(ids, a, e)
        if now:
            yield _span_batch([now[0]], [now[1]], [now[2]])

    block = F.shiftright("start", 16).alias("block")
    dealt = spans.select("td", block, "start", "end").repartition("td", "block").sortWithinPartitions("td", "block", "start")
    return dealt.select("td", "start", "end").mapInArrow(run, _SPAN)


def _may_be_in(docs: DataFrame, ids: DataFrame, out: str) -> DataFrame:
    """docs (td, ...) with the column `out`: whether td is among ids (td, distinct). Up to
    BROADCAST_ROWS ids are broadcast; of more a Bloom filter is, and some others pass too."""
    n = ids.count()
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(ids.select("td", F.lit(True).alias(out))), "td", "left").withColumn(out, F.coalesce(out, F.lit(False)))
    filt = bloom.member_filter(ids.select(F.xxhash64("td").alias("x")), "x", n)
    return docs.withColumn(out, _in(F.col("td"), filt, docs.sparkSession))


def _in(column: Column, filt: np.ndarray, spark) -> Column:
    held = spark.sparkContext.broadcast(filt)

    @F.pandas_udf("boolean")
    def might(x: pd.Series) -> pd.Series:
        return pd.Series(bloom.has(held.value, x.to_numpy(np.int64).view(np.uint64)))

    return might(F.xxhash64(column))


def repeated_spans(docs: DataFrame, depth: int = DEPTH, hot_digit: int = HOT_DIGIT, words: int | None = None) -> DataFrame:
    """cover: for each text's digest td with repeated bytes its spans (array of start and
    end), those of `words` word codes (word_spans), or, if several rows have that text, `whole`."""
    spark = docs.sparkSession
    ship(spark)
    made = len(tables_made(spark))
    marked = docs.withColumn("td", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))
    copied = table(exact_dedup(docs).filter("group_size > 1").groupBy(F.substring("digest", 1, 16).alias("td")).agg(F.min("keep_id").alias("keep_id")), "copied")
    # of equal texts one row takes part: that of the kept id, and if ids repeat, any number
    # of them do no harm, since copied texts are decided as a whole
    one = marked.join(maybe_broadcast(copied.withColumnRenamed("td", "ctd"), copied.count()), F.col("td") == F.col("ctd"), "left").filter(F.col("ctd").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("td", "text")
    before = len(tables_made(spark))
    spans = _found_spans(one.filter(F.octet_length("text") >= depth), depth, hot_digit, byte_codes, np.uint8).withColumn("of_words", F.lit(False))
    if words:
        # tables of one search go before the next makes its own
        spans = table(spans, "spans")
        drop_tables(spark, tables_made(spark)[before:-1])
        spans = spans.unionByName(_found_spans(one.filter(F.octet_length("text") >= 2 * words - 1), words, hot_digit, word_codes, np.uint32).withColumn("of_words", F.lit(True)))
    span = F.struct("start", "end")
    spans = spans.select("td", F.when(~F.col("of_words"), span).alias("span"), F.when(F.col("of_words"), span).alias("word_span"), F.lit(False).alias("whole"))
    none = F.lit(None).cast("struct<start:bigint,end:bigint>")
    whole = copied.select("td", none.alias("span"), none.alias("word_span"), F.lit(True).alias("whole"))
    return last_table(spans.unionByName(whole).groupBy("td").agg(F.collect_list("span").alias("spans"), F.collect_list("word_span").alias("word_spans"), F.max("whole").alias("whole")), "cover", made)


def _found_spans(one: DataFrame, depth: int, hot_digit: int, code: Callable[[list[bytes]], list[np.ndarray]], kind: type) -> DataFrame:
    """(td, start, end) of the strings of `depth` symbols of coded texts (td, text) that start
    twice or more."""

    def pass_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            symbols = code([text for _, text in held])
            digits, ids, places, own = first_digits([(td, x) for (td, _), x in zip(held, symbols, strict=True)], depth)
            n = len(own)
            cols = [pa.array([*digits.view(np.int64).tolist(), *[None] * n], pa.int64()), pa.array([*ids, *[x[0] for x in own]], pa.binary()), pa.array([*places.tolist(), *[x[1] for x in own]], pa.int64()), pa.array([*[None] * len(ids), *[x[2] for x in own]], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["digit", "td", "place", "end"])

        for b in batches:
            for td, text in zip(b.column(0), b.column(1), strict=True):
                held.append((td.as_py(), text.as_py().encode()))
                size += len(held[-1][1])
                if size > _BUFFER:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted digits, those found twice, with their number up to a row (n)."""
        before, n = None, 0  # the row before, and its place in its run
        for b in batches:
            if not b.num_rows:
                continue
            digit = b.column(0).to_numpy()
            new = np.ones(len(digit), bool)
            new[1:] = digit[1:] != digit[:-1]
            new[0] = before is None or before[0] != digit[0]
            at = np.arange(len(digit))
            place = at - np.maximum.accumulate(np.where(new, at, 0)) + 1
            if not new[0]:
                run = np.flatnonzero(new)
                place[: run[0] if len(run) else len(place)] += n
            followed = np.append(~new[1:], False)
            keep = (place > 1) | followed
            last = len(digit) - 1
            late = before is not None and n == 1 and not new[0]  # the row before has a twin after all
            keep[last] = place[last] > 1  # whether it is followed shows in the next batch
            cols = [b.column(0), b.column(1), b.column(2), pa.array(place, pa.int64())]
            out = pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in cols], ["digit", "td", "place", "n"])
            if late:
                yield pa.RecordBatch.from_arrays([pa.array([before[0]], pa.int64()), pa.array([before[1]], pa.binary()), pa.array([before[2]], pa.int64()), pa.array([1], pa.int64())], ["digit", "td", "place", "n"])
            yield out
            before, n = (int(digit[last]), b.column(1)[last].as_py(), b.column(2)[last].as_py()), int(place[last])

    found = table(one.mapInArrow(pass_one, "digit long, td binary, place long, end long"), "digits")
    own = found.filter("end IS NOT NULL").select("td", F.col("place").alias("start"), "end")
    found = found.filter("end IS NULL").select("digit", "td", "place")
    # digits of a large share of all anchors are found before these are dealt; of the others, rows
    # are numbered in their run, so one row tells that a digit is too frequent
    suspects = heavy_candidates(found, found.count(), column="digit", kind="long")
    heavy = table(found.join(F.broadcast(suspects), "digit").groupBy("digit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot_digit).select("digit"), "heavy")
    dealt = found.join(F.broadcast(heavy), "digit", "left_anti").repartition("digit").sortWithinPartitions("digit")
    known = found.join(F.broadcast(heavy), "digit", "left_semi").withColumn("n", F.lit(hot_digit).cast("long"))
    kept = table(dealt.select("digit", "td", "place").mapInArrow(twice, "digit long, td binary, place long, n long").unionByName(known), "anchors")
    hot = table(kept.filter(F.col("n") == hot_digit).select("digit").distinct(), "hot")
    any_hot = hot.count()  # at most anchors / hot_digit
    by_text = kept.groupBy("td").agg(F.collect_list(F.struct("digit", "place")).alias("places"))
    by_text = table(by_text, "places")
    placed = _may_be_in(one, by_text.select("td"), "placed").filter("placed")

    def pass_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            d, t, s, f, c = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.binary()), pa.array(s, pa.int64()), pa.array(f, pa.int64()), pa.array(c, pa.binary())], ["digit", "td", "start", "far", "part"])

        for b in batches:
            for td, text, places in zip(*b.columns, strict=True):
                td, text, places = td.as_py(), code([text.as_py().encode()])[0], places.as_py()
                for x, (start, far, part) in zip(places, contexts(text, [x["place"] for x in places], depth), strict=True):
                    out.append((x["digit"], td, start, far, part.tobytes()))
                    size += part.nbytes
                if size > 4 * _BUFFER:
                    yield done()
                    out, size = [], 0
        if out:
            yield done()

    shipped = placed.join(by_text.hint("merge"), "td").select("td", "text", "places").mapInArrow(pass_two, "digit long, td binary, start long, far long, part binary")
    if any_hot:
        shipped = table(shipped, "shipped")
        spans = _spans_of_cold(shipped.join(F.broadcast(hot), "digit", "left_anti") if any_hot <= 100_000 else shipped.join(hot, "digit", "left_anti"), depth, kind)
        spans = spans.unionByName(_spans_of_hot(shipped.join(maybe_broadcast(hot, any_hot), "digit", "left_semi"), depth, kind))
    else:
        spans = _spans_of_cold(shipped, depth, kind)
    return spans.unionByName(own)


#: Columns that remove_repeated adds, and those that it adds with `words`.
ADDED, OF_WORDS = ("n_bytes", "n_removed", "n_spans", "kept"), ("n_passages", "passage_bytes")


def _widened(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of UTF-8 bytes with the whole of the characters at their ends."""
    out = []
    for a, b in spans:
        while a and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        out.append((a, b))
    return merged(out)


def _judged(docs: DataFrame, depth: int, hot_digit: int, words: int | None, remove_words: bool, whole_characters: bool) -> DataFrame:
    """(row: struct of docs' columns, text, *ADDED, *OF_WORDS); see remove_repeated."""
    td = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cover = repeated_spans(plain.select("doc_id", "text"), depth, hot_digit, words)
    marked = plain.select("row", "text", td.alias("td"))
    marked = _may_be_in(marked, cover.select("td"), "touched")
    marked = marked.withColumn("in", F.col("touched") & (F.octet_length("text") >= (min(depth, 2 * words - 1) if words else depth))).drop("touched")
    numbers = (*ADDED[:3], *OF_WORDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[tuple[int, ...]] = []
            kept = []
            for text, spans, by_word, whole in zip(*(b.column(c) for c in ("text", "spans", "word_spans", "whole")), strict=True):
                text = text.as_py().encode()
                if whole.as_py():
                    all_of_it = [(0, len(text))]
                    gone = all_of_it if len(text) >= depth else []
                    passages = all_of_it if words and len(words_of(np.frombuffer(text, np.uint8))[0]) >= words else []
                else:
                    gone, passages = ([(x["start"], x["end"]) for x in s.as_py() or ()] for s in (spans, by_word))
                    gone, passages = merged(gone), merged(word_spans(text, passages))
                if remove_words:
                    gone = merged(gone + passages)
                if whole_characters:
                    gone = _widened(text, gone)
                at, parts = 0, []
                for a, e in gone:
                    parts.append(text[at:a])
                    at = e
                parts.append(text[at:])
                kept.append(b"".join(parts))
                counts.append((len(text), len(text) - len(kept[-1]), len(gone), len(passages), sum(e - a for a, e in passages)))
            cols = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)] or [pa.array([], pa.int64())] * len(numbers)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), *cols, pa.array(kept, pa.binary())], ["row", "text", *numbers, "kept"])

    schema = StructType([plain.schema["row"], StructField("text", StringType()), *[StructField(n, LongType()) for n in numbers], StructField("kept", BinaryType())])
    changed = marked.filter("in").join(cover.hint("merge"), "td", "left").select("row", "text", "spans", "word_spans", "whole").mapInArrow(cut, schema)
    none = F.lit(0).cast("long")
    same = marked.filter("NOT in").select("row", "text", F.octet_length("text").cast("long").alias("n_bytes"), *[none.alias(n) for n in numbers[1:]], F.col("text").cast("binary").alias("kept"))
    return changed.unionByName(same)


def remove_repeated(docs: DataFrame, depth: int = DEPTH, hot_digit: int = HOT_DIGIT, words: int | None = None, remove_words: bool = True) -> DataFrame:
    """All columns of docs (with doc_id and text, null: empty), and n_bytes, n_removed,
    n_spans (maximal removed runs) and kept (binary: the remaining bytes).

    A byte goes if a string of `depth` bytes that covers it also starts anywhere else in
    the texts' UTF-8 bytes, in the same text too (overlaps count). Every occurrence goes, the
    first too; matches never cross texts and are judged on the input. Rows with a null or
    repeated doc_id are texts of their own, so repeated rows are copies. Shorter texts
    stay as they are. Columns of docs named like the new ones are replaced.

    With `words`, passages of so many words that occur elsewhere are found too, however
    short; their blanks and the ASCII punctuation at words' ends may differ. n_passages and
    passage_bytes count them, and unless remove_words is false they go as well."""
    added = (*ADDED, *(OF_WORDS if words else ()))
    found = _judged(docs, depth, hot_digit, words, bool(words) and remove_words, False)
    return found.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


def without_repeated(docs: DataFrame, depth: int = DEPTH, words: int | None = None, hot_digit: int = HOT_DIGIT) -> DataFrame:
    """docs with texts that lack what remove_repeated finds; characters of which only a part
    would stay go as a whole. Rows of which nothing stays go, and so do no others: empty
    texts stay. All columns stay as they are, but n_chars, if there, counts a changed text."""
    found = _judged(docs, depth, hot_digit, words, bool(words), True).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    changed = F.col("n_removed") > 0
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    of = {c: F.col(f"row.`{c}`") for c in docs.columns}
    new = {"text": F.col("kept").cast("string"), "n_chars": F.length(F.col("kept").cast("string"))}
    out = [F.when(changed, new[c].cast(kinds[c])).otherwise(of[c]).alias(c) if c in new else of[c].alias(c) for c in docs.columns]
    return found.select(*out)


#: Words of a repeated passage that op9 reports beside the contract's bytes: more than 50.
PASSAGE = 51


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns look at 400 bytes alone; n_passages and passage_bytes tell of
    repeated passages of PASSAGE words, which may be shorter."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = remove_repeated(docs, words=PASSAGE, remove_words=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *OF_WORDS)
