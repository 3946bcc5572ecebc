"""Quality classifier on supervised subword embeddings.

Each white-space word, each pair of consecutive words and each byte n-gram of 2 and 3 bytes is hashed to a row of an
embedding table (all pairs of one word with itself share a row, so that repetition is a feature of its own); a document
is the mean of its rows, a softmax over the two classes reads that mean, and both are trained by stochastic gradient descent
in numpy. At scoring the softmax weights are multiplied into the table once, so a document's logit is the mean of one
number per feature: the same value, with one gather per feature.

Training uses at most ``per_class`` whole documents of each class, those of least hash among labelled rows that are not
held out; that bound is all the driver ever holds. They are cut by a bound on the hash that follows from the class's
count, and only what passes it (some times per_class) is ranked. Scoring is a map over whole texts with no shuffle. A
text's features end at its own last byte and weights are summed as whole numbers, so its score depends on the text and
the model alone, whatever rows stand beside it.

Null and empty texts score the model's bias (0.5 when nothing could be trained, as with no labels or a single class
label only). Labels other than 0 and 1 are ignored; of several labels of a document the smallest counts, of several
texts of a labelled doc_id the least. Repeated rows are scored row by row; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.grid import NOT_SPACE, Grid, grids, mix, sliced

BITS, ORDERS = 18, (2, 3)
#: Weights are whole multiples of 2**-POINT.
POINT = 24


def features(grid: Grid) -> list[np.ndarray]:
    """Buckets of the words, of the pairs that end at each word (a document's first word pairs with nothing), then of the
    n-grams that begin at each byte (an array for each order)."""
    h = grid.hashes
    before = np.concatenate([[np.uint64(0)], h[:-1]]) if len(h) else h
    before[grid.first[:-1][np.diff(grid.first) > 0]] = 0
    pair = np.where(before == h, np.uint64(0), mix(before * np.uint64(3) + h))
    out = [(h >> np.uint64(64 - BITS)).astype(np.int32), (pair >> np.uint64(64 - BITS)).astype(np.int32)]
    padded = np.concatenate([grid.buf, np.full(max(ORDERS), 10, np.uint8)])
    for n in ORDERS:
        h = np.full(len(grid.buf), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + padded[k : k + len(grid.buf)]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def grams(grid: Grid, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of the n-grams of each document: they lie in its text and the byte that closes it."""
    return grid.at[:-1], np.maximum(grid.at[1:] - n + 1, grid.at[:-1])


class Classifier:
    """The folded model: one number per bucket (in steps of 2**-POINT), and the bias."""

    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = np.rint(weight.astype(np.float64) * (1 << POINT)).astype(np.int64), float(bias)

    def logits(self, grid: Grid) -> np.ndarray:
        """One per document."""
        words, pairs, *chars = features(grid)
        sums, count = np.zeros(len(grid.at) - 1, np.int64), 2 * np.diff(grid.first)
        places = [(self.weight[words] + self.weight[pairs], grid.first[:-1], grid.first[1:])]
        for n, bucket in zip(ORDERS, chars, strict=True):
            begin, end = grams(grid, n)
            places.append((self.weight[bucket], begin, end))
            count += end - begin
        for values, begin, end in places:
            total = np.zeros(len(values) + 1, np.int64)
            np.cumsum(values, out=total[1:])
            sums += total[end] - total[begin]
        return sums / (np.maximum(count, 1) * float(1 << POINT)) + self.bias


def own_features(grid: Grid, d: int, found: list[np.ndarray]) -> np.ndarray:
    """All buckets of document d, from features()."""
    words, pairs, *chars = found
    a, b = grid.first[d], grid.first[d + 1]
    return np.concatenate([words[a:b], pairs[a:b], *(c[begin[d] : end[d]] for c, (begin, end) in zip(chars, (grams(grid, n) for n in ORDERS), strict=True))])


def train(texts: list[bytes], labels: list[int], dim: int = 12, epochs: int = 8, rate: float = 2.0, seed: int = 7) -> Classifier:
    """Plain SGD, a document at a time in an order drawn anew each epoch, with a falling rate."""
    rng = np.random.default_rng(seed)
    if not texts:
        return Classifier(np.zeros(1 << BITS), 0.0)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim)), np.zeros(2)
    bags, targets = [], []
    for keys, grid in grids([(labels, texts)], NOT_SPACE):
        found = features(grid)
        for d, label in enumerate(keys):
            at, count = np.unique(own_features(grid, d, found), return_counts=True)
            if len(at):
                bags.append((at, (count / count.sum()).astype(np.float32)))
                targets.append(label)
    share = np.bincount(targets, minlength=2) / max(1, len(targets))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(bags)):
            at, part = bags[i]
            mean = part @ table[at]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[targets[i]] -= 1
            p *= 0.5 / max(share[targets[i]], 1e-9)  # both classes weigh the same
            pull = p @ out
            out -= step * np.outer(p, mean)
            bias -= 0.05 * step * p
            table[at] -= step * np.outer(part, pull).astype(np.float32) * 10
    return Classifier(table @ (out[1] - out[0]).astype(np.float32), bias[1] - bias[0])


def held_out() -> F.Column:
    """Whether a document's crc32(doc_id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, label: str = "quality") -> Classifier:
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label")).where(~held_out())
    size = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    near = F.lit(False)
    for value, n in size.items():
        near |= (F.col("label") == value) & below("doc_id", per_class, n)
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.where(near).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_class).select("doc_id", "label")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    return train(sample.column("text").to_pylist(), sample.column("label").to_pylist())


def below(key: str, most: int, n: int) -> F.Column:
    """Whether key's hash is among the lowest part of n keys that holds most of them with room to spare (a few times as
    many, so that fewer pass with a probability of less than 1e-20)."""
    share = (3 * most + 100) / max(n, 1)
    return F.lit(True) if share >= 1 else F.xxhash64(key) < F.lit(int(-(1 << 63) + share * (1 << 64)))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """Per row of docs: doc_id and score, the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            parts = [1 / (1 + np.exp(-held.value.logits(grid))) for _, grid in grids([(texts, texts)], NOT_SPACE)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts or [np.zeros(0)]), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(scored, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 1000) -> DataFrame:
    """Fit on labelled rows that are not held out; return doc_id, held_out, score and predicted of every row."""
    found = score(docs, fit(docs, labels, per_class))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
