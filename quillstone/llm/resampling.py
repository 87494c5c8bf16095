"""Importance resampling towards a target distribution, in two Arrow passes (operator 13).

Features of a text are its words and pairs of neighbouring words (A-Z lowered), repeats counted, in 10,000 hashed buckets.
The first pass counts the buckets of a partition by ``np.bincount``; ``treeReduce`` merges the vectors, of the raw table
and of the target.  A bucket's gain is the floored logarithm, in thousandths, of the ratio of its smoothed shares.  The
second pass looks the gains up and sums them for each document by ``np.bincount`` with weights; their floored mean is the
document's weight.  With Gumbel noise keyed by the id, the highest scores are a draw without replacement.

At scale: both passes read the texts where they lie, and one vector of 80 kB a partition moves.  Ranks come from the table
of scores and their numbers, whose size is bounded (weights and noise are whole numbers of some ten thousands) and from
the order of ids inside a score; noise of about a thousand scores' width keeps any score to a few rows in ten thousand.
Rows that are equal in id and weight are counted before they are ranked, so a repeated row is no hot key.

Defined results: a null or empty text has no features and weight 0; documents with fewer words than ``least_words`` have
no rank; rows that repeat an id are ranked as rows; a null id draws the noise of the empty string and comes last among
ties; an empty table gives no rows, an empty target gains from smoothing alone; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.components import cut
from quillstone.llm.memory import small_batches

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: bytes of a text under work at a time
PIECE = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def crcs(text: str | None) -> Iterator[tuple[int, list[int]]]:
    """(number of words, checksums of features) of the parts of a text, which are cut beside words."""
    raw, start, before = (text or "").encode(), 0, None
    while start < len(raw):
        end = BREAK.search(raw, start + PIECE) if len(raw) - start > PIECE else None
        stop = end.end() if end else len(raw)
        words = WORD.findall(raw[start:stop].lower())
        start = stop
        if words:
            one = list(map(crc32, words))
            spaced = [b" " + w for w in words]
            # a pair's checksum goes on from that of its first word
            two = list(map(crc32, spaced[1:], one)) if before is None else list(map(crc32, spaced, [before, *one]))
            before = one[-1]
            yield len(words), one + two


def features(texts: list[str | None], buckets: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, number of words, buckets of features) of the parts of texts."""
    for i, text in enumerate(texts):
        for n, found in crcs(text):
            yield i, n, np.array(found, np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column text) fall in each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(batch.column("text").to_pylist(), buckets):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select("text").mapInArrow(work, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    return vectors.treeReduce(np.add, depth=3) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target over share in the raw table)) of each bucket, both with one added."""
    buckets, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """Per document: doc_id, n_words, n_features and weight, the floored mean of its features' gains."""
    table = docs.sparkSession.sparkContext.broadcast(gains)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in batches:
            n = batch.num_rows
            words, count, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            held: list[tuple[int, np.ndarray]] = []

            def add() -> None:
                row = np.repeat([i for i, _ in held], [len(x) for _, x in held])
                found = np.concatenate([x for _, x in held])
                count[:] += np.bincount(row, minlength=n)
                # sums of whole numbers below 2^53 are exact
                total[:] += np.bincount(row, weights=gain[found], minlength=n).astype(np.int64)
                held.clear()

            size = 0
            for i, some, found in features(batch.column("text").to_pylist(), len(gain)):
                words[i] += some
                held.append((i, found))
                size += len(found)
                if size >= PIECE:
                    add()
                    size = 0
            if held:
                add()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, count, np.where(count > 0, total // np.maximum(count, 1), 0)))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 8 hex digits of sha256 of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank (1 is the highest score; null if it is not drawn).

    Of the documents with ``least_words`` words, floor(percent * N / 100) are drawn; ties go to the smaller doc_id.
    """
    small_batches(docs.sparkSession)
    gains = gains_of(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weights(docs, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("long", F.col("n_words") >= least_words)
    # equal rows as one with their number
    key = ("doc_id", "n_features", "weight", "score", "long")
    scored = cut(scored.groupBy(*key).agg(F.count(F.lit(1)).alias("m")))
    levels = scored.where("long").groupBy("score").agg(F.sum("m").alias("here"))
    # one row for each score, so one task
    above = levels.select("score", (F.sum("here").over(Window.orderBy(F.desc("score"))) - F.col("here")).alias("above"), F.floor(F.sum("here").over(Window.partitionBy(F.lit(0))) * percent / 100).alias("most"))
    inside = Window.partitionBy("score", "long").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = scored.join(above, "score", "left").withColumn("before", F.when(F.col("long"), F.col("above") + F.coalesce(F.sum("m").over(inside), F.lit(0))))
    rank = F.col("before") + F.col("k")
    return placed.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("k")).select("doc_id", "n_features", "weight", "score", F.when(rank <= F.col("most"), rank).alias("rank"))
