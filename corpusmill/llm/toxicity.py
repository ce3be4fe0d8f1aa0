"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (3 to 5 bytes of the lower-cased words,
joined and framed by one space), hashed to 2^``BITS``.  It is trained on labelled rows, at
most ``SAMPLE`` of each label, the first by a hash of the id, and one text an id:

1. counts of documents by feature and label, summed over the sample's partitions,
   give each feature's log-count ratio and its chi-square statistic;
2. every feature whose statistic is ``LEAST`` or more (one in 10^4 by chance) is used, scaled by its ratio;
3. a logistic regression with an L2 penalty is fitted to them, and its intercept
   moved to the share of labels outside the balanced sample.

The used features of 2 ``SAMPLE`` texts at most come to the driver, two bytes each, whatever the input, and are worked through in
slices of ``SLICE``.  Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.text import kept, mix, perhaps_id, prepare, words

GRAMS, BITS = (3, 4, 5), 18
SAMPLE, LEAST = 10_000, 15.0
STEPS, PENALTY, SLICE = 150, 1e-3, 1 << 20


def features(text: str | None) -> np.ndarray:
    """The hashed n-grams, repeated ones too."""
    raw = np.frombuffer(b" " + b" ".join(words(text, lower=True)) + b" ", np.uint8).astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(raw) >= n:
            g = raw[: len(raw) - n + 1].copy()
            for k in range(1, n):
                g = (g << np.uint64(8)) | raw[k : len(raw) - n + 1 + k]
            out.append(mix(g + np.uint64(n << 56)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


class Model:
    """Weights by feature (0: unused), an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, text: str | None) -> float:
        f = features(text)
        f = f[self.weights[f] != 0]
        z = float(self.weights[np.unique(f)].sum()) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of label 1 from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1).

    With one label alone, or none, every text has the score of that label.  An id of both labels counts for both;
    of rows that repeat an id the first text counts.  Rows without an id or a label are not learnt from.
    """
    prepare(docs.sparkSession)
    labels = kept(labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).distinct())
    n = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(np.zeros(1 << BITS), 30.0 if n.get(1) else -30.0)
    first = [labels.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample) for k in n]  # a top-k: ``sample`` is its bound
    chosen = kept(first[0].union(first[1]))
    some = perhaps_id(docs.select("doc_id", "text"), chosen, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = kept(some.join(chosen, "doc_id").select("label", "text").mapInArrow(_extract, "label int, f binary"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for y, f in zip(*b.columns, strict=True):
                sums[y.as_py(), np.frombuffer(f.as_py(), np.uint32)] += 1
        at = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["f", "n0", "n1"])

    of = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(of) < 2:
        return Model(np.zeros(1 << BITS), float(np.log(n[1] / n[0])))
    table = rows.mapInArrow(counted, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = np.zeros((2, 1 << BITS))
    counts[0, table.f], counts[1, table.f] = table.n0, table.n1
    n0, n1 = of[0], of[1]
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    both, all_ = counts.sum(axis=0), n0 + n1
    odds = counts[1] * (n0 - counts[0]) - counts[0] * (n1 - counts[1])
    chi = all_ * odds**2 / np.maximum(both * (all_ - both) * n0 * n1, 1)
    used = np.flatnonzero(chi >= LEAST)
    place_of = np.full(1 << BITS, -1, np.int32)
    place_of[used] = np.arange(len(used))

    kind = np.uint16 if len(used) < 1 << 16 else np.uint32

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [place_of[np.frombuffer(x.as_py(), np.uint32)] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[x >= 0].astype(kind).tobytes() for x in f], pa.binary())], ["label", "f"])

    # One buffer, a row behind the other: two bytes a feature (four where there are more than 65,535 of them).
    buffer, ends, y = bytearray(), [0], []
    for r in rows.mapInArrow(reduced, "label int, f binary").toLocalIterator():
        buffer += r.f
        ends.append(len(buffer) // np.dtype(kind).itemsize)
        y.append(r.label)
    col, ends, y = np.frombuffer(buffer, kind), np.array(ends), np.array(y, float)
    # Slices end with a row; a row that is longer than a slice is one.
    cuts = [0]
    while cuts[-1] < len(y):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + SLICE, "right")) - 1))
    x = ratio[used]
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, STEPS + 1):  # Adam on the whole sample
        g, gb, wx = np.zeros(len(used)), 0.0, w * x
        for lo, hi in zip(cuts, cuts[1:]):
            c, length = col[ends[lo] : ends[hi]], np.diff(ends[lo : hi + 1])
            some = np.flatnonzero(length)
            z = np.full(hi - lo, b)
            if len(some):
                z[some] += np.add.reduceat(wx[c], (ends[lo:hi] - ends[lo])[some])
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lo:hi]
            g += np.bincount(c, np.repeat(e, length), len(used))
            gb += e.sum()
        g, gb = g * x / len(y) + PENALTY * w, gb / len(y)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = w * x
    return Model(weights, b + float(np.log(n[1] / n[0]) - np.log(n1 / n0)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(features(t.as_py())).astype(np.uint32).tobytes() for t in b.column(1)], pa.binary())], ["label", "f"])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt from: crc32 of the id as text leaves 2 by 4."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text); ``labels`` has doc_id and label.

    Labels of held-out ids are not read.  Null and empty texts have the features of two spaces, none of use, and the
    intercept's score.  Rows without a doc_id are scored like all others.  Repeated rows score alike.  No rows
    give none.  Other columns are ignored.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
