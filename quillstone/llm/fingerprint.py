"""Document fingerprints: a homomorphic multiset hash (operator 8).

A text's paragraphs (lines, and long lines cut every eight words) are a multiset.  Each is hashed to a wide vector: four
64-bit words, summed modulo 2^64, and 256 signs, summed modulo 2^32.  Sums don't depend on order, and a paragraph is
added or taken out by adding or subtracting its vector.  Equal multisets have equal fingerprints; the signs' sums also
estimate how alike two multisets are, since the dot product of two such sums estimates that of the multiplicities; this
holds below 2^31 paragraphs, more than a text of 2 GB has.

Defined results: a null text counts as empty; an empty text has no paragraphs, and two such texts are alike (1.0);
repeated rows of one doc_id follow each other in the order of their texts; a row whose doc_id is null has no place in the
order: it has its own fingerprint, and no edited text or likeness (nulls).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.memory import in_frames, small_batches

WIDE, SIGNS, WORDS = 4, 256, 8


def paragraphs(text: str) -> Iterator[str]:
    for line in text.split("\n"):
        words = line.split()
        for k in range(0, len(words), WORDS):
            yield " ".join(words[k : k + WORDS])


class Fingerprint:
    """Sums of wide vectors; ``add`` and ``remove`` take paragraphs in any order."""

    __slots__ = ("wide", "signs")

    def __init__(self, parts: Iterable[str] = ()):
        self.wide, self.signs = np.zeros(WIDE, np.uint64), np.zeros(SIGNS, np.uint32)
        self.add(parts)

    def _sums(self, parts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held = []
        for p in parts:
            held.append(hashlib.blake2b(p.encode(), digest_size=64).digest())
            if len(held) == 4096:
                yield self._summed(held)
                held = []
        if held:
            yield self._summed(held)

    @staticmethod
    def _summed(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), 64)
        wide = np.ascontiguousarray(raw[:, 32:]).view("<u8").sum(0, dtype=np.uint64)
        ones = np.unpackbits(raw[:, :32], axis=1).sum(0, dtype=np.int64)
        return wide, (2 * ones - len(held)).astype(np.uint32)

    def add(self, parts: Iterable[str]) -> None:
        for wide, signs in self._sums(parts):
            self.wide += wide
            self.signs += signs

    def remove(self, parts: Iterable[str]) -> None:
        for wide, signs in self._sums(parts):
            self.wide -= wide
            self.signs -= signs

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.wide == other.wide).all() and (self.signs == other.signs).all())

    def text(self) -> str:
        return self.wide.astype("<u8").tobytes().hex() + self.signs.astype("<u4").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """Twice the dot product over the sum of the squared lengths: 1 for equal multisets, about 0 for disjoint ones."""
        if self == other:
            return 1.0
        a, b = self.signs.view(np.int32).astype(float), other.signs.view(np.int32).astype(float)
        return float(np.clip(2 * (a @ b) / max(1.0, a @ a + b @ b), 0.0, 1.0))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
#: stretches of doc_id for each shuffle partition
STRETCHES = 8


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is the next document's beginning.

    Documents are dealt by stretches of doc_id that hold about as many rows each (cut at quantiles), and read in
    descending order, so the next one is at hand; each stretch also gets the largest document below it.  The texts are
    shuffled once, and a task holds two of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    named = base.where(F.col("doc_id").isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = STRETCHES * parts
    # both lists at the driver have one entry a stretch: their number is bounded by the number of partitions
    edges = sorted({float(x) for x in named.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 20 * blocks)).first()[0] or ()})
    place = Bucketizer(splits=[-float("inf"), *(edges or [0.0]), float("inf")], inputCol="as_double", outputCol="b").transform
    dealt = place(named.withColumn("as_double", F.col("doc_id").cast("double"))).withColumn("b", F.col("b").cast("long")).drop("as_double")
    tops = sorted(tuple(r) for r in dealt.groupBy("b").agg(F.max("doc_id")).collect())
    follow = [(top, tops[k + 1][0]) for k, (_, top) in enumerate(tops[:-1])] + [(tops[-1][1], tops[0][0])] if tops else []
    extra = named.join(F.broadcast(spark.createDataFrame(follow, "doc_id long, b long")), "doc_id").select("doc_id", "text", "b", F.lit(1).alias("extra"))
    rows = dealt.select("doc_id", "text", "b", F.lit(0).alias("extra")).unionByName(extra)
    rows = rows.repartition(parts, "b").sortWithinPartitions("b", "extra", F.desc("doc_id"), "text")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        done: list = []
        for frame in frames:
            for doc, text, b, is_extra in zip(frame["doc_id"], frame["text"], frame["b"], frame["extra"]):
                text = text or ""
                if held and held[3] != b:
                    held = None
                # of several rows with the id that follows a stretch, the first counts
                if is_extra and not held:
                    continue
                own = Fingerprint(paragraphs(text))
                if held:
                    doc0, text0, own0, _ = held
                    n = len(text0)
                    edited = text0[: n - n // 3] + text[: n // 3]
                    new = Fingerprint(paragraphs(edited))
                    done.append((doc0, n, hashlib.sha256(edited.encode()).hexdigest(), own0.text(), new.text(), own0.likeness(new), own0.likeness(own)))
                held = None if is_extra else (doc, text, own, b)
                if len(done) >= 1000:
                    yield pd.DataFrame(done, columns=COLUMNS)
                    done = []
        yield pd.DataFrame(done, columns=COLUMNS)

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [(None, len(t or ""), None, Fingerprint(paragraphs(t or "")).text(), None, None, None) for t in frame["text"]]
            yield pd.DataFrame(done, columns=COLUMNS)

    return in_frames(rows, work, RESULT).unionByName(in_frames(base.where(F.col("doc_id").isNull()), alone, RESULT))
