"""Quality classifier: a factorisation machine (operator 2).

Features are hashed words (each distinct word of a text, scaled by the root of their number), structure statistics and
the text's size, the last two as indicators of bins.  The pairwise interactions are scored in linear time: half of the
square of the sum of the factors less the sum of their squares.

The machine is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hashes of doc_id among the rows whose
crc32(doc_id) is no multiple of 5; every text is scored whole.  Labels, lang, source and doc_id are no features.

Defined results: a null or empty text is scored as a text with no words; without labelled rows of both classes, the
score is the share of label 1 (one half if there are none); repeated rows are scored alike; of several labels or texts
of one id the smallest is learned; a row whose doc_id is null is scored like any other, is never learned from, and its
held_out is false.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.memory import hash_sample, in_frames, release, small_batches

SAMPLE = 4000
BUCKETS, FACTORS, BINS = 4096, 8, 12
EPOCHS, RATE, DECAY = 12, 0.02, 1e-4
THRESHOLD = 0.3
FOLDS = 5

#: class of each byte: 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sentence marks, 6 high
BYTE_CLASS = np.zeros(256, np.uint8)
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58] = 1, 2, 3
BYTE_CLASS[[9, 10, 11, 12, 13, 32]], BYTE_CLASS[[44, 46, 39, 45, 59, 58]], BYTE_CLASS[128:] = 4, 5, 6


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Words(dict):
    """Bucket of each word; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = out = crc32(word.lower().encode()) % BUCKETS
        return out


WORDS = Words()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Structure statistics, and the buckets of the distinct words."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.zeros(7, np.int64)
    for k in range(0, len(raw), 1 << 20):
        kinds += np.bincount(BYTE_CLASS[raw[k : k + (1 << 20)]], minlength=7)
    words = text.split()
    count = Counter(words)
    n, size, lines = max(1, len(words)), max(1, len(raw)), text.split("\n")
    letters = max(1, kinds[1] + kinds[2])
    stats = np.array(
        [
            np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), kinds[0] / size, kinds[5] / size, kinds[3] / size,
            kinds[2] / letters, len(count) / n, len(count) / n**0.8, max(count.values(), default=0) / n, len(text) / n,
            len(set(lines)) / len(lines), count["|"] / n, sum(c for w, c in count.items() if c > 2) / n,
        ]
    )
    return stats, np.fromiter({WORDS[w] for w in count}, np.int32)


class Machine:
    """Parameters of a fitted machine; small enough to travel with the task."""

    def __init__(self, stats: np.ndarray, words: list[np.ndarray], labels: np.ndarray, seed: int = 7):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.fitted = len(labels) > 0 and 0 < self.prior < 1
        if not self.fitted:
            return
        self.edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
        rng = np.random.default_rng(seed)
        size = BUCKETS + stats.shape[1] * BINS
        self.bias, self.w, self.v = float(np.log(self.prior / (1 - self.prior))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
        rows = [self.row(s, w) for s, w in zip(stats, words)]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.v)]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for batch in np.array_split(order, max(1, len(order) // 64)):
                step += 1
                index = np.concatenate([rows[k][0] for k in batch])
                value = np.concatenate([rows[k][1] for k in batch])
                lengths = np.array([len(rows[k][0]) for k in batch])
                owner = np.repeat(np.arange(len(batch)), lengths)
                at = np.cumsum(lengths) - lengths
                part = self.v[index] * value[:, None]
                total = np.add.reduceat(part, at)
                raw = self.bias + np.add.reduceat(self.w[index] * value, at) + 0.5 * (total**2 - np.add.reduceat(part**2, at)).sum(1)
                error = (1 / (1 + np.exp(-raw.clip(-30, 30))) - labels[batch]) / len(batch)
                self.bias -= RATE * error.sum()
                g = error[owner] * value
                used, place = np.unique(index, return_inverse=True)
                gw = np.bincount(place, g) + DECAY * self.w[used]
                gv = DECAY * self.v[used]
                np.add.at(gv, place, g[:, None] * (total[owner] - part))
                for p, grad, (m, s) in zip((self.w, self.v), (gw, gv), moments):
                    m[used] = 0.9 * m[used] + 0.1 * grad
                    s[used] = 0.999 * s[used] + 0.001 * grad**2
                    p[used] -= RATE * (m[used] / (1 - 0.9**step)) / (np.sqrt(s[used] / (1 - 0.999**step)) + 1e-8)

    def row(self, stats: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = (stats[None, :] > self.edges).sum(0) + BUCKETS + np.arange(len(stats)) * BINS
        # the statistics together weigh as much as the words together
        return np.concatenate([words, bins]), np.concatenate([np.full(len(words), max(1, len(words)) ** -0.5), np.full(len(bins), len(bins) ** -0.5)])

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return self.prior
        index, value = self.row(*features(text))
        part = self.v[index] * value[:, None]
        raw = self.bias + self.w[index] @ value + 0.5 * float((part.sum(0) ** 2 - (part**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = hash_sample(known.groupBy("id").agg(F.min("quality").alias("quality")), F.xxhash64("id"), sample)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            stats, words = zip(*map(features, frame["text"])) if len(frame) else ((), ())
            yield pd.DataFrame({"id": frame["id"], "quality": frame["quality"], "stats": [s.tolist() for s in stats], "words": [np.sort(w).tolist() for w in words]})

    # at most ``sample`` ids: a bounded broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).join(F.broadcast(known), "id")
    rows = rows.groupBy("id", "quality").agg(F.min("text").alias("text"))
    got = in_frames(rows, work, "id long, quality int, stats array<double>, words array<int>").toPandas().sort_values("id")
    stats = np.array(got["stats"].tolist()) if len(got) else np.empty((0, 1))
    return Machine(stats, [np.array(w, np.int32) for w in got["words"]], got["quality"].to_numpy(float))


def score(docs: DataFrame, machine: Machine, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """docs' columns (or some) and a double column of that name."""
    kept = columns if columns is not None else docs.columns
    schema = docs.select(*kept).schema.add(name, "double")
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([machine.score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores], [*kept, name])
        release()

    # the columns go through as they are
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(work, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, sample), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
