"""A substring index over document numbers: positional trigrams, in memory or as files.

A string of three characters or more is looked for by the rarest of its trigrams; where that one occurs, the rest of the
string is compared in its place.  So no number is read that lacks a trigram of the asked string, and nothing is compared
with every number.  Shorter strings find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.retrieval import bounded

SIZE = 3


def grams(c: Column) -> Column:
    """The (at, gram) of a string, from place 0; none of a string that is too short."""
    places = F.when(F.length(c) >= SIZE, F.sequence(F.lit(0), F.length(c) - SIZE)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.substring(c, i + 1, F.lit(SIZE)).alias("gram")))


def gram_postings(docs: DataFrame) -> DataFrame:
    """(gram, at, id, number): one row for each trigram of the lower-case numbers of documents (id, circular_no)."""
    rows = docs.select("id", F.lower("circular_no").alias("number"))
    return rows.select("id", "number", F.inline(grams(F.col("number")))).select("gram", "at", "id", "number")


def frequencies(postings: DataFrame) -> DataFrame:
    """(gram, n): how many postings each trigram has."""
    return postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def rarest(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(qid, ref, gram, offset): of each asked string (qid, ref), lowered, the trigram with the fewest postings."""
    rows = asked.select("qid", F.lower("ref").alias("ref")).distinct().select("qid", "ref", F.inline(grams(F.col("ref"))))
    rows = rows.withColumnRenamed("at", "offset").join(counts, "gram", "left")
    first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "gram"))
    return rows.groupBy("qid", "ref").agg(first.alias("x")).select("qid", "ref", "x.gram", "x.offset")


def matched(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """(qid, id) of numbers that hold an asked string where its chosen trigram is."""
    start = F.col("at") - F.col("offset")
    same = F.substring("number", start + 1, F.length("ref")) == F.col("ref")
    return postings.join(bounded(chosen), "gram").where((start >= 0) & same).select("qid", "id").distinct()


def containing(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, id) of documents (id, circular_no) whose number contains an asked string (qid, ref), whatever the case."""
    postings = gram_postings(docs)
    wanted = asked.select(F.inline(grams(F.lower("ref")))).select("gram").distinct()
    counts = frequencies(postings.join(bounded(wanted), "gram", "left_semi"))
    return matched(postings, rarest(asked, counts))


def write_grams(docs: DataFrame, folder: str, buckets: int = 64) -> None:
    """The index as files: postings and frequencies, both by a hash of the trigram, so that a search reads few of them."""
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("bucket")
    postings = gram_postings(docs)
    # a frequent trigram is written by several tasks
    spread = F.pmod(F.xxhash64("id"), F.lit(16))
    postings.select("*", bucket).repartition("bucket", spread).write.partitionBy("bucket").mode("errorifexists").parquet(f"{folder}/postings")
    written = docs.sparkSession.read.parquet(f"{folder}/postings")
    frequencies(written).select("*", bucket, F.lit(buckets).alias("buckets")).repartition(1, "bucket").write.partitionBy("bucket").mode("errorifexists").parquet(f"{folder}/frequencies")


def containing_stored(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """:func:`containing` over a written index: only the buckets of the asked strings' trigrams are read."""
    counts = spark.read.parquet(f"{folder}/frequencies")
    first = counts.select("buckets").first()
    if first is None:
        return asked.select("qid", F.lit(None).cast("long").alias("id")).limit(0)
    bucket = F.pmod(F.xxhash64("gram"), F.lit(first["buckets"]))
    # no more buckets than the index has
    read = lambda rows: [r[0] for r in rows.select(bucket.alias("bucket")).distinct().collect()]
    wanted = asked.select(F.inline(grams(F.lower("ref")))).select("gram").distinct()
    chosen = rarest(asked, counts.where(F.col("bucket").isin(read(wanted))).select("gram", "n"))
    postings = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(read(chosen)))
    return matched(postings, chosen)
