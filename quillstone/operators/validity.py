"""Validity: status cascade, relation merges, decisions, lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import malay_date

RECORD_TYPES = ("minutes", "report")
DEFAULT_STATUSES, HISTORICAL_STATUSES = ("IN_FORCE", "AMENDED", "UNKNOWN", "RECORD"), ("CANCELLED", "ONE_OFF")


def allowed_statuses(history: bool) -> tuple[str, ...]:
    return DEFAULT_STATUSES + HISTORICAL_STATUSES if history else DEFAULT_STATUSES


def secure(df: DataFrame, clearance: int) -> DataFrame:
    return df.where(F.col("classification_level") <= clearance)


def incoming_effects(docs: DataFrame, relations: DataFrame, as_of: str) -> DataFrame:
    """Per target: the latest canceller that is in effect, and the amenders in relation order."""
    date = F.lit(as_of).cast("date")
    source = docs.select(F.col("id").alias("source_doc_id"), F.col("circular_no").alias("source_no"), F.coalesce("effective_date", "issue_date").alias("source_when"))
    edges = relations.where("verified = 1 and target_doc_id is not null").join(source, "source_doc_id")
    when = F.coalesce("effective_date", "source_when")
    cancels = F.col("relation_type").isin("CANCELS", "SUPERSEDES") & (when <= date)
    amends = (F.col("relation_type") == "AMENDS") & F.coalesce(when <= date, F.lit(True))
    return edges.groupBy(F.col("target_doc_id").alias("id")).agg(
        F.max_by(F.when(cancels, F.col("source_no")), F.when(cancels, F.struct(when.alias("w"), F.col("source_no").alias("n")))).alias("canceller"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(amends, F.struct("id", "source_no")))), lambda x: x["source_no"])), ", ").alias("amenders"),
    )


def with_status(docs: DataFrame, relations: DataFrame, as_of: str) -> DataFrame:
    """docs with status and status_reason at a date; the first rule that holds decides."""
    date = F.lit(as_of).cast("date")
    joined = docs.join(incoming_effects(docs, relations, as_of), "id", "left")
    rules: list[tuple[Column, str, Column]] = [
        (F.col("doc_type").isin(*RECORD_TYPES), "RECORD", F.concat(F.lit("Rekod bertarikh "), malay_date(F.col("issue_date")))),
        (F.col("canceller").isNotNull(), "CANCELLED", F.concat(F.lit("Dibatalkan oleh "), F.col("canceller"))),
        (F.col("one_off"), "ONE_OFF", F.lit("Sekali sahaja")),
        (F.col("expiry_date") <= date, "CANCELLED", F.lit("Tamat tempoh")),
        (F.col("amenders") != "", "AMENDED", F.concat(F.lit("Dipinda oleh "), F.col("amenders"))),
        (F.col("effective_date") <= date, "IN_FORCE", F.lit("Berkuat kuasa")),
        (F.col("effective_date").isNotNull(), "UNKNOWN", F.concat(F.lit("Belum berkuat kuasa (mulai "), malay_date(F.col("effective_date")), F.lit(")"))),
    ]
    status = reason = F.when(F.lit(False), F.lit(""))
    for holds, name, why in rules:
        status, reason = status.when(holds, name), reason.when(holds, why)
    return joined.withColumn("status", status.otherwise("UNKNOWN")).withColumn("status_reason", reason.otherwise("Belum disahkan")).drop("canceller", "amenders")


def resolve_targets(docs: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations without a target get the document that their reference names."""
    named = docs.select(F.col("circular_no").alias("target_ref_text"), F.col("id").alias("named_id"))
    return relations.join(named, "target_ref_text", "left").withColumn("target_doc_id", F.coalesce("target_doc_id", "named_id")).drop("named_id")


def merge_ground_truth(relations: DataFrame, truth: DataFrame) -> DataFrame:
    """Verified rows replace extracted ones by (source, reference), whatever the type; the oldest row's id is kept.

    truth: source_doc_id, target_doc_id, target_ref_text, relation_type, scope, effective_date.
    """
    key = ["source_doc_id", "target_ref_text"]
    first = relations.groupBy(*key).agg(F.min("id").alias("id"))
    merged = truth.join(first, key, "left").withColumn("verified", F.lit(1)).withColumn("confidence", F.lit(1.0))
    columns = ["id", "source_doc_id", "target_doc_id", "target_ref_text", "relation_type", "scope", "effective_date", "verified", "confidence"]
    return relations.join(truth.select(*key), key, "left_anti").select(*columns).unionByName(merged.select(*columns))


def store_extracted(relations: DataFrame, found: DataFrame) -> DataFrame:
    """Extracted relations that aren't there yet, as pending rows; rejected rows block their like."""
    key = ["source_doc_id", "target_ref_text", "relation_type"]
    new = found.dropDuplicates(key).join(relations.select(*key), key, "left_anti")
    return relations.unionByName(new.withColumn("verified", F.lit(0)), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key isn't in new, and new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def decide(relations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approve, reject or reset relations; an edit replaces the fields that it gives, and an empty text clears them."""
    state = F.when(F.col("action") == "approve", 1).when(F.col("action") == "reject", -1).when(F.col("action") == "reset", 0).otherwise(F.col("verified"))
    joined = relations.join(decisions.select(F.col("id"), "action", F.col("scope").alias("new_scope")), "id", "left")
    scope = F.when(F.col("new_scope").isNull(), F.col("scope")).otherwise(F.nullif(F.col("new_scope"), F.lit("")))
    return joined.withColumn("verified", state.cast("int")).withColumn("scope", scope).drop("action", "new_scope")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rank = 1").drop("__rank")


def checkpoints(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; local sessions may go without one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder of :func:`checkpoints`."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """:func:`cut` for tables with texts: compressed, and by columns, so that readers of a few columns leave the others.

    A checkpoint holds plain rows, several times as large.  The files lie in the same folder.
    """
    path = f"{checkpoints(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: nodes that a task remembers while it contracts its edges
MOST_NODES = 1_000_000


def contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (up, down) of a partition as stars round the least node that is reached inside it.

    What is remembered is bounded: a full table is given out as stars and forgotten, which loses no connection.
    """
    above: dict[int, int] = {}

    def least(x: int) -> int:
        path = []
        while (y := above.get(x, x)) != x:
            path.append(x)
            x = y
        for step in path:
            above[step] = x
        return x

    def stars() -> pd.DataFrame:
        ends = [(x, least(x)) for x in list(above)]
        return pd.DataFrame(ends, columns=["up", "down"], dtype="int64")

    for frame in frames:
        for a, b in frame.drop_duplicates().itertuples(index=False):
            a, b = sorted((least(a), least(b)))
            if a != b:
                above[b] = a
        if len(above) > MOST_NODES:
            yield stars()
            above.clear()
    yield stars()


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of undirected edges (a, b); component is the smallest node that is reached.

    Partitions turn their own edges into stars first, so a hub has one edge a partition for each of its neighbours and a
    chain inside a partition is gone.  Rounds of two steps go on until nothing changes: each node ties its larger
    neighbours to the least node it knows, and then its smaller ones.  Trees flatten as they grow, so the rounds grow with
    the logarithm of a component's size.
    """
    edges = edges.where("a is not null and b is not null")
    alone = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    now, before = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("up"), F.least("a", "b").alias("down")).mapInPandas(contracted, "up long, down long").distinct()), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("up", "down").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        every = now.unionByName(now.select(F.col("down").alias("up"), F.col("up").alias("down")))
        known = every.groupBy("up").agg(F.least(F.col("up"), F.min("down")).alias("least"))
        larger = every.join(known, "up").where("down > up and least <> down").select(F.col("down").alias("up"), F.col("least").alias("down")).distinct()
        known = larger.groupBy("up").agg(F.min("down").alias("least"))
        smaller = larger.join(known, "up").select(F.when(F.col("down") == F.col("least"), F.col("up")).otherwise(F.col("down")).alias("up"), F.col("least").alias("down"))
        now = cut(smaller.unionByName(known.select("up", F.col("least").alias("down"))).distinct())
    both = now.select(F.col("up").alias("id"), F.col("down").alias("component")).unionByName(now.select(F.col("down").alias("id"), F.col("down").alias("component")))
    return both.unionByName(alone).groupBy("id").agg(F.min("component").alias("component"))
