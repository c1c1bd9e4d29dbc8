"""Toxicity: a logistic classifier with counterfactual regularisation.

Features are the words of a text and their beginnings, and whether these occur twice or
three times. Training looks at a
bounded sample of labelled texts. For each of these that names a group of people, copies
with the term swapped for another are made, and differences between the scores of a text
and its copies are penalised, so that a neutral mention of a group counts for nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import tokens
from .common import free_name, ship, table, text_or_empty

#: Labelled texts used for training at most (those with the smallest hashed ids).
MAX_TRAIN = 8_000
#: Most features of the classifier, and how far (in standard errors) a feature's log odds
#: must lie from zero.
MAX_FEATURES, LEAST_Z = 20_000, 3.5
BITS = 22
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
PENALTY, RIDGE, ROUNDS = 1.0, 2e-5, 500

#: Groups of people, by language and form: terms of one row can stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "black", "white", "asian", "african", "european", "gay", "straight", "transgender", "disabled", "deaf", "blind"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("frauen", "männer", "christen", "muslime", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "chrétiens", "musulmans", "juifs", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "cristianos", "musulmanes", "judíos", "extranjeros", "refugiados"),
)

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def stems_of(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    parts = ["w" + word, *[f"p{word[:n]}" for n in PREFIXES if len(word) > n]]
    return [xxhash.xxh32_intdigest(p.encode()) >> (32 - BITS) for p in parts]


def features_of(found: Counter) -> set[int]:
    """4 * stem + level: a stem's levels are once, twice and three times or more."""
    n: Counter = Counter()
    for word, times in found.items():
        for stem in stems_of(word):
            n[stem] += times
    return {4 * stem + level for stem, times in n.items() for level in range(min(3, times))}


def swaps(found: Counter, terms=IDENTITY_TERMS) -> Iterator[Counter]:
    """Copies of a text in which an identity term is another of its row."""
    for row in terms:
        for i, term in enumerate(row):
            if term in found:
                for j in {(i + 1) % len(row), (i + len(row) // 2) % len(row)} - {i}:
                    copy = Counter(found)
                    copy[row[j]] += copy.pop(term)
                    yield copy


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -30.0

    def scorer(self):
        """A function of texts; a bounded table keeps the features of words seen."""
        weights, known = self.weights, {}
        stems = {f // 4 for f in weights}

        def of(text: str | None) -> float:
            n: Counter = Counter()
            if len(known) > 300_000:
                known.clear()
            for word, times in words(text).items():
                own = known.get(word)
                if own is None:
                    own = known[word] = tuple(x for x in stems_of(word) if x in stems)
                for stem in own:
                    n[stem] += times
            found = {4 * stem + level for stem, times in n.items() for level in range(min(3, times))}
            get = lambda f: weights.get(f, 0.0)
            z = self.bias + sum(map(get, sorted(found)))
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return of


def fit(labels: np.ndarray, rows: list[np.ndarray], pairs: list[tuple[list[int], list[int]]]) -> Model:
    """labels 0/1; rows: feature numbers of each text; pairs: the features that only the
    text has and those that only its copy with a swapped term has."""
    pos = float(labels.sum())
    if not pos or pos == len(labels):  # one class only: its share, smoothed
        p = (pos + 1) / (len(labels) + 2) if len(labels) else 1e-9
        return Model({}, float(np.log(p / (1 - p))))
    seen = np.unique(np.concatenate(rows))
    counts = [np.zeros(len(seen)), np.zeros(len(seen))]
    for y, r in zip(labels, rows, strict=True):
        counts[int(y)][np.searchsorted(seen, r)] += 1
    n = [len(labels) - pos, pos]
    odds = [np.log((c + 0.5) / (m - c + 0.5)) for c, m in zip(counts, n, strict=True)]
    error = np.sqrt(sum(1 / (c + 0.5) + 1 / (m - c + 0.5) for c, m in zip(counts, n, strict=True)))
    z = np.abs(odds[1] - odds[0]) / error
    z[counts[0] + counts[1] < 3] = 0
    best = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    chosen = np.sort(seen[best[z[best] >= LEAST_Z]])
    number = {f: i for i, f in enumerate(chosen.tolist())}
    cols = [np.flatnonzero(np.isin(chosen, r)) for r in rows]
    of_row, col = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate([*cols, np.empty(0, int)]).astype(int)
    d_row, d_col, d_val = [], [], []
    for k, (only, other) in enumerate(pairs):
        for value, feats in ((1.0, only), (-1.0, other)):
            for f in feats:
                if f in number:
                    d_row.append(k), d_col.append(number[f]), d_val.append(value)
    d_row, d_col, d_val = np.array(d_row, int), np.array(d_col, int), np.array(d_val)
    w, b = np.zeros(len(chosen)), float(np.log(pos / n[0]))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        score = b + np.bincount(of_row, w[col], len(cols))
        err = 1 / (1 + np.exp(-np.clip(score, -500, 500))) - labels
        g = np.bincount(col, err[of_row], len(w)) / len(cols) + RIDGE * w
        if len(d_row):
            gap = np.bincount(d_row, d_val * w[d_col], len(pairs))
            g += 2 * PENALTY * np.bincount(d_col, d_val * gap[d_row], len(w)) / len(pairs)
        gb = err.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 / (1 - 0.9**t) * np.sqrt(1 - 0.999**t)
        w, b = w - rate * m / (np.sqrt(v) + 1e-10), b - rate * mb / (np.sqrt(vb) + 1e-10)
    return Model(dict(zip(chosen.tolist(), w.tolist(), strict=True)), float(b))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from at most max_train labelled texts that are not held out. Labels null or
    other than 0 and 1 are left out; of several for an id the largest counts."""
    ship(docs.sparkSession)
    use = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = table(use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, only, other = [], [], []
            for text in b.column(1):
                found = words(text.as_py())
                own = features_of(found)
                rows.append(sorted(own))
                a, o = [], []
                for swapped in swaps(found):
                    copy = features_of(swapped)
                    a.append(sorted(own - copy)), o.append(sorted(copy - own))
                only.append(a), other.append(o)
            nested = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array(only, nested), pa.array(other, nested)], ["toxic", "own", "a", "o"])

    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    # of documents that share an id one, the least text, takes part
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("toxic", "text")
    seen = table(texts.mapInArrow(extract, "toxic int, own array<int>, a array<array<int>>, o array<array<int>>"), "features")
    y, rows, pairs = [], [], []
    for r in seen.toLocalIterator():  # max_train rows at most
        y.append(r["toxic"])
        rows.append(np.array(r["own"], np.int32))
        pairs += list(zip(r["a"], r["o"], strict=True))
    return fit(np.array(y, float), rows, pairs)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out`: 0 to 1, higher for toxic texts. Every row, whole texts,
    one pass without a shuffle; null counts as empty. A column of that name is replaced."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        of = held.value.scorer()
        for b in batches:
            scores = pa.array([of(t.as_py()) for t in b.column(len(fields))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], [*[f.name for f in fields], out])

    plain = docs.select(*[f"`{f.name}`" for f in fields], text_or_empty(text).alias(free_name(docs, "text")))
    return plain.mapInArrow(run, StructType([*fields, StructField(out, DoubleType())]))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
