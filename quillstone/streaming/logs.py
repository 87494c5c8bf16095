"""The query log as a sink: each batch is one folder, so a batch that runs again replaces what it wrote.

Rows that come again within the watermark are dropped by their id; feedback refers to a row's id, the latest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: characters of a comment that are kept; fixed value
COMMENT = 500
LOG = "id string, user_id long, query string, rewritten_json string, retrieved_ids string, excluded_ids string, answerable boolean, top_score double, confidence string, latency_ms long, sources_ms long, topic string, cluster string, created_at timestamp"


def log_rows(asked: DataFrame, sources: DataFrame, excluded: DataFrame) -> DataFrame:
    """One log row for each answered question.

    asked: id, user_id, query, rewritten_json, answerable, confidence, latency_ms, sources_ms, topic, created_at.
    sources: id, place, doc, chunk, no, score, cluster (what was shown).  excluded: id, place, doc, no.
    A refused question has low confidence.
    """
    listed = lambda *fields: F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields))))
    shown = sources.groupBy("id").agg(listed("doc", "chunk", "no").alias("retrieved_ids"), F.max("score").alias("top_score"), F.min_by("cluster", "place").alias("cluster"))
    gone = excluded.groupBy("id").agg(listed("doc", "no").alias("excluded_ids"))
    rows = asked.join(shown, "id", "left").join(gone, "id", "left")
    none = lambda c: F.coalesce(c, F.lit("[]")).alias(c)
    return rows.select(
        F.col("id").cast("string").alias("id"), "user_id", "query", "rewritten_json", none("retrieved_ids"), none("excluded_ids"), "answerable", "top_score",
        F.when(F.col("answerable"), F.col("confidence")).otherwise("LOW").alias("confidence"), "latency_ms", "sources_ms", "topic", "cluster", "created_at",
    )


def append_batch(folder: str):
    """A writer for ``foreachBatch``: the batch's folder is written anew, so a replay changes nothing."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def append_log(rows: DataFrame, folder: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Appends a stream of log rows (id, created_at, ...) to a folder, each id once; processes what there is, and ends."""
    once = rows.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
    return once.writeStream.foreachBatch(append_batch(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("batch")


def feedback_json(rating: Column, comment: Column) -> Column:
    return F.to_json(F.struct(rating.alias("rating"), F.substring(F.coalesce(comment, F.lit("")), 1, COMMENT).alias("comment")))


def with_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """log (id, ...) with the latest feedback (id, rating, comment, created_at) on each row; on others it is null."""
    given = feedback_json(F.col("rating"), F.col("comment"))
    last = feedback.groupBy(F.col("id").cast("string").alias("id")).agg(F.max_by(given, F.struct("created_at", "rating", "comment")).alias("feedback"))
    return log.join(last, "id", "left")
