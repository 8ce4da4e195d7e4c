"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, their prefixes of 4 to 6 characters (for inflected words),
pairs of neighbouring words and pairs with one word skipped, all hashed to 2 ** BITS coordinates. FTRL gives every
coordinate its own learning rate, and the L1 term leaves most weights at exactly zero, so the model is
a short list of (coordinate, weight): its size is bounded by 2 ** BITS, and it is broadcast.

Training reads a bounded sample: at most `max_rows` labelled rows, those of least
hash(doc_id), with features made on all executors and FTRL run in one task over them. Scoring
reads every whole text and shuffles nothing.

Nulls, empties, ties: a null text counts as empty and scores the intercept alone. A doc_id with
several labels counts as toxic if one of them is; null labels and ids teach nothing. Every row
of docs gives one row, repeated or not. Extra columns are ignored. Without a
labelled row of either kind the score is the share of toxic labels (0.5 if there are none).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 22
MAX_ROWS = 8_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
#: Words whose hashes a worker keeps; the cache starts anew when it is full.
CACHE = 200_000
#: Words of a text that are hashed at once; bounds memory for very long texts.
CHUNK = 1 << 16
WORD = re.compile(r"\w+")
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


class Hasher:
    """Distinct feature coordinates of texts."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.table = np.zeros((1024, 1 + len(PREFIXES)), dtype=np.uint64)

    def number(self, word: str) -> int:
        n = len(self.of)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        row = [xxhash.xxh64_intdigest(word, 1)]
        row += [xxhash.xxh64_intdigest(word[:k], 1 + k) if len(word) >= k else row[0] for k in PREFIXES]
        self.table[n] = row
        self.of[word] = n
        return n

    def features(self, text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
        """Distinct coordinates of a text; of those that `wanted` marks, where it is given."""
        words = WORD.findall((text or "").lower())
        if len(self.of) > CACHE:
            self.clear()
        shift, found = np.uint64(64 - BITS), []
        for start in range(0, len(words), CHUNK):
            of, number = self.of, self.number
            part = words[start : start + CHUNK + 2]
            ids = np.array([of[w] if w in of else number(w) for w in part], dtype=np.int32)
            rows = self.table[ids]
            h = rows[:, 0]
            near, next_but_one = h[:-1] * ODD[1] + h[1:], h[:-2] * ODD[2] + h[2:] * ODD[3]
            at = (np.concatenate([rows.ravel(), near, next_but_one]) * ODD[0] >> shift).astype(np.int32)
            found.append(at if wanted is None else at[wanted[at]])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, coordinates, weights) after some passes over (features, label) rows. The intercept has no penalty."""
    size = 1 << BITS
    seen = np.zeros(size, dtype=np.int32)
    for f, _ in rows:
        seen[f] += 1
    rows = [(f[seen[f] > 1], y) for f, y in rows]
    z, n = np.zeros(size, np.float64), np.zeros(size, np.float64)
    rate = min(max(sum(y for _, y in rows) / max(len(rows), 1), 0.01), 0.99)
    start = float(np.log(rate / (1 - rate)))
    shift, shift_n = 0.0, 1.0

    def weights(zf: np.ndarray, nf: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zf) <= l1, 0.0, (np.sign(zf) * l1 - zf) / ((beta + np.sqrt(nf)) / alpha + l2))

    for _ in range(epochs):
        for f, y in rows:
            zf, nf = z[f], n[f]
            w = weights(zf, nf)
            p = 1 / (1 + np.exp(-np.clip(start + shift + w.sum(), -35, 35)))
            g = p - y
            sigma = (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha
            z[f], n[f] = zf + g - sigma * w, nf + g * g
            shift_n += g * g
            shift -= 0.05 * g / np.sqrt(shift_n)
    at = np.flatnonzero(np.abs(z) > l1)
    return start + shift, at, weights(z[at], n[at])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """The model of docs(doc_id, text) and labels(doc_id, label), on at most max_rows of the labelled rows."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for i in range(batch.num_rows):
                f = hasher.features(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([f.tobytes()]), batch.column(2).slice(i, 1)], names=["h", "f", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        rows = [(h, np.frombuffer(f, np.int32), y) for b in batches for h, f, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2]))
        if not rows:
            return
        bias, at, w = ftrl([(f, y) for _, f, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([bias, *w.tolist()], pa.float64())], names=["at", "w"])

    # The sample has at most max_rows rows of two numbers: small enough to send to every executor.
    taught = docs.join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string"), "y")
    found = taught.mapInArrow(extract, "h bigint, f binary, y int").repartition(1).mapInArrow(fit, "at int, w double").toPandas()
    if found.empty:
        return 0.0, np.zeros(0, np.int64), np.zeros(0)
    found = found.sort_values("at")
    return float(found.w.iloc[0]), found["at"].to_numpy()[1:], found.w.to_numpy()[1:]


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score, the probability of label 1, for each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, w = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        wanted = dense != 0
        hasher = Hasher()
        for batch in batches:
            sums = np.array([bias + dense[hasher.features(t.as_py(), wanted)].sum() for t in batch.column(1)])
            found = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) for each row of docs; learns from rows not held out."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))), max_rows=max_rows)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
