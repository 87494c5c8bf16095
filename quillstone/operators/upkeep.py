"""Keeping a corpus up to date: documents replaced with all that hangs on them, and refreshes of what an edit touches.

Both are plans over whole tables that read what they must: a replaced document takes its chunks, its unverified relations
and the summaries that name it along; a refresh follows the edits to the statuses, summaries and vectors that depend on
them, and leaves the others as they were.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.validity import cut, resolve_targets, with_status


class Corpus(NamedTuple):
    """documents (id, circular_no, ...), chunks (id, chunk_index, ...), relations (id, source_doc_id, ..., verified),
    summaries (old_doc_id, new_doc_id, ...)."""

    documents: DataFrame
    chunks: DataFrame
    relations: DataFrame
    summaries: DataFrame


def ids(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("id").alias(name)).distinct()


def replaced(old: Corpus, documents: DataFrame, chunks: DataFrame, relations: DataFrame) -> Corpus:
    """old with ingested documents (circular_no, ...), their chunks (circular_no, ...) and found relations (circular_no, ...).

    A document whose number is known keeps its id, a new one gets the next; of several under one number the last by file
    counts.  The replaced one's chunks, unverified relations and all summaries that name it go; verified relations stay.
    A found relation that is there already, verified or not, isn't found again; ids of new rows follow the largest.
    """
    known = old.documents.select("circular_no", F.col("id").alias("old_id"))
    one = documents.groupBy("circular_no").agg(F.max_by(F.struct(*[c for c in documents.columns if c != "circular_no"]), F.col("file")).alias("x")).select("circular_no", "x.*")
    joined = one.join(known, "circular_no", "left")
    fresh = numbered(joined.where("old_id is null").drop("old_id"), old.documents, "circular_no")
    again = joined.where("old_id is not null").withColumnRenamed("old_id", "id")
    # new documents start without a status; a replaced one keeps its own until the next refresh
    rows = again.join(old.documents.select("id", "status"), "id").unionByName(fresh.withColumn("status", F.lit("UNKNOWN")), allowMissingColumns=True)
    now = old.documents.join(ids(again, "id"), "id", "left_anti").unionByName(rows.select(*[c for c in old.documents.columns if c in rows.columns]), allowMissingColumns=True)
    placed = rows.select("circular_no", "id")
    parts = old.chunks.join(ids(rows, "id"), "id", "left_anti").unionByName(chunks.join(placed, "circular_no").drop("circular_no").select(*old.chunks.columns))
    dropped = old.relations.where("verified = 0").join(ids(again, "source_doc_id"), "source_doc_id", "left_semi").select("id")
    left = old.relations.join(dropped, "id", "left_anti")
    key = ["source_doc_id", "target_ref_text", "relation_type"]
    found = relations.join(placed.withColumnRenamed("id", "source_doc_id"), "circular_no").drop("circular_no").dropDuplicates(key).join(left.select(*key), key, "left_anti")
    edges = left.unionByName(numbered(found.withColumn("verified", F.lit(0)), old.relations, *key), allowMissingColumns=True)
    gone = ids(again, "d")
    notes = old.summaries.join(gone.withColumnRenamed("d", "old_doc_id"), "old_doc_id", "left_anti").join(gone.withColumnRenamed("d", "new_doc_id"), "new_doc_id", "left_anti")
    return Corpus(now.select(*old.documents.columns), parts, edges.select(*old.relations.columns), notes.select(*old.summaries.columns))


def numbered(rows: DataFrame, table: DataFrame, *order: str) -> DataFrame:
    """rows with ids after the largest of a table, in the order of some columns.

    Places are counted for ranges of the order, so no task sorts all rows: a range's rows follow those of the ranges before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # written, so that every reader finds a row in the same range
    part = cut(dealt.withColumn("__part", F.spark_partition_id()))
    placed = part.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    # one row for each range, and one for the largest id
    largest = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__largest"))
    out = placed.join(F.broadcast(before), "__part").crossJoin(F.broadcast(largest))
    return out.withColumn("id", (F.col("__largest") + F.col("__before") + F.col("__k")).cast("long")).drop("__part", "__k", "__before", "__largest")


def decided(relations: DataFrame, decisions: DataFrame, docs: DataFrame) -> DataFrame:
    """relations after decisions (id, action, scope, target_ref_text): an edit of the reference looks its target up anew.

    approve, reject and reset set the state; edit sets the fields that are given, an empty text clears them.
    """
    named = docs.select(F.col("circular_no").alias("new_ref"), F.col("id").alias("new_target"))
    new = decisions.select("id", "action", F.col("scope").alias("new_scope"), F.col("target_ref_text").alias("new_ref")).join(named, "new_ref", "left")
    rows = relations.join(new, "id", "left")
    state = F.when(F.col("action") == "approve", 1).when(F.col("action") == "reject", -1).when(F.col("action") == "reset", 0).otherwise(F.col("verified"))
    edited = F.coalesce(F.col("action") == "edit", F.lit(False))
    scope = F.when(edited & F.col("new_scope").isNotNull(), F.nullif("new_scope", F.lit(""))).otherwise(F.col("scope"))
    other = edited & F.col("new_ref").isNotNull()
    out = rows.withColumn("verified", state.cast("int")).withColumn("scope", scope)
    out = out.withColumn("target_doc_id", F.when(other, F.col("new_target")).otherwise(F.col("target_doc_id"))).withColumn("target_ref_text", F.when(other, F.nullif("new_ref", F.lit(""))).otherwise(F.col("target_ref_text")))
    return out.select(*relations.columns)


def touched(documents: DataFrame, relations: DataFrame, old_relations: DataFrame, edited: DataFrame) -> DataFrame:
    """(id) of the documents whose status an edit may change.

    edited: id of documents that were edited or are new.  They are those themselves, what their relations act on (now and
    before), and the targets of relations that were added, removed or changed.
    """
    acts = relations.select("source_doc_id", "target_doc_id").unionByName(old_relations.select("source_doc_id", "target_doc_id")).where("target_doc_id is not null")
    near = acts.join(ids(edited, "source_doc_id"), "source_doc_id", "left_semi").select(F.col("target_doc_id").alias("id"))
    digest = lambda df: df.select("target_doc_id", F.xxhash64("id", "source_doc_id", "target_doc_id", "relation_type", "effective_date", "verified").alias("h"))
    now, before = digest(relations), digest(old_relations)
    changed = now.join(before.select("h"), "h", "left_anti").unionByName(before.join(now.select("h"), "h", "left_anti")).where("target_doc_id is not null").select(F.col("target_doc_id").alias("id"))
    return edited.select("id").unionByName(near).unionByName(changed).distinct().join(documents.select("id"), "id", "left_semi")


def dated(documents: DataFrame, relations: DataFrame, since: str, as_of: str) -> DataFrame:
    """(id) of the documents on which a date after ``since`` and up to ``as_of`` may act: their own, or one of what acts on them."""
    def passed(*columns: str) -> Column:
        return F.exists(F.array(*columns), lambda d: F.coalesce((d > F.lit(since).cast("date")) & (d <= F.lit(as_of).cast("date")), F.lit(False)))

    own = documents.where(passed("effective_date", "expiry_date")).select("id")
    sources = documents.where(passed("effective_date", "issue_date")).select(F.col("id").alias("source_doc_id"))
    by_source = relations.join(sources, "source_doc_id", "left_semi").select(F.col("target_doc_id").alias("id"))
    return own.unionByName(by_source).unionByName(relations.where(passed("effective_date")).select(F.col("target_doc_id").alias("id"))).where("id is not null").distinct()


def refreshed_statuses(documents: DataFrame, relations: DataFrame, old_relations: DataFrame, edited: DataFrame, as_of: str, now: str, since: str | None = None) -> DataFrame:
    """documents with the statuses of what an edit touches worked out anew; the others are as they were.

    documents: id, circular_no, ..., status, status_reason, updated_at, as they were at ``since`` (if not given, at
    ``as_of``).  Equal to a full refresh: only the touched documents, those on which a date has come since, the relations
    that act on them and the sources of these are read for the statuses.
    """
    few = touched(documents, relations, old_relations, edited)
    if since is not None:
        few = few.unionByName(dated(documents, relations, since, as_of)).distinct()
    few = cut(few)
    acting = relations.join(few.withColumnRenamed("id", "target_doc_id"), "target_doc_id", "left_semi")
    bare = documents.drop("status", "status_reason", "updated_at")
    sources = bare.join(acting.select(F.col("source_doc_id").alias("id")).distinct(), "id", "left_semi")
    own = bare.join(few, "id", "left_semi")
    new = with_status(sources.unionByName(own).dropDuplicates(["id"]), acting, as_of).join(few, "id", "left_semi").select("id", F.col("status").alias("s"), F.col("status_reason").alias("r"))
    rows = documents.join(new, "id", "left")
    changed = F.col("s").isNotNull() & ~(F.col("s").eqNullSafe(F.col("status")) & F.col("r").eqNullSafe(F.col("status_reason")))
    pick = {"status": F.col("s"), "status_reason": F.col("r"), "updated_at": F.lit(now).cast("timestamp_ntz")}
    return rows.select(*(F.when(changed, pick[c]).otherwise(F.col(c)).alias(c) if c in pick else F.col(c) for c in documents.columns))


class Due(NamedTuple):
    """What a refresh has to make: relations without a summary, chunks without a vector; and what it drops."""

    summaries: DataFrame
    vectors: DataFrame
    dropped: DataFrame


def due(corpus: Corpus, vectors: DataFrame) -> Due:
    """Verified amendments and replacements that have no summary, chunks that have no vector, summaries whose relation is
    not verified any more. vectors: id, chunk_index."""
    live = corpus.relations.where("verified = 1 and target_doc_id is not null and relation_type in ('SUPERSEDES', 'AMENDS')").select(F.col("target_doc_id").alias("old_doc_id"), F.col("source_doc_id").alias("new_doc_id")).distinct()
    key = ["old_doc_id", "new_doc_id"]
    return Due(live.join(corpus.summaries.select(*key), key, "left_anti"), corpus.chunks.join(vectors.select("id", "chunk_index"), ["id", "chunk_index"], "left_anti").select("id", "chunk_index"), corpus.summaries.select(*key).join(live, key, "left_anti"))


def ingested(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file, level, message): the log of a batch of files (file, n_pages, n_blank); found: file, circular_no, n_chunks.

    Files of another kind and those without any text are errors; the others give a line with their chunks.
    """
    rows = files.join(found, "file", "left")
    kind = F.lower(F.substring_index("file", ".", -1))
    level = F.when(~kind.isin("pdf", "txt"), "error").when(F.col("n_pages") <= F.col("n_blank"), "error").otherwise("info")
    message = (
        F.when(~kind.isin("pdf", "txt"), "Only PDF and text files are supported.")
        .when(F.col("n_pages") <= F.col("n_blank"), "No text found on any page.")
        .otherwise(F.concat("circular_no", F.lit(": "), F.coalesce("n_chunks", F.lit(0)).cast("string"), F.lit(" chunks")))
    )
    return rows.select("file", level.alias("level"), message.alias("message"))


def resolved(corpus: Corpus) -> Corpus:
    return corpus._replace(relations=resolve_targets(corpus.documents, corpus.relations).select(*corpus.relations.columns))
