"""Keeping records: deletions that cascade, edits, status updates, notices, installed packs; and loose JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.retrieval import top
from quillstone.operators.upkeep import numbered

#: fields of a document that an edit may set; fixed values
EDITABLE = ("circular_no", "title", "doc_type", "jurisdiction", "cluster", "issue_date", "effective_date", "expiry_date", "one_off", "classification_level")
#: a model's thoughts and a code fence round its reply; fixed formats
THOUGHT, FENCE = r"(?s)<think>.*?</think>", r"^```(?:json)?\s*|\s*```$"


def delete_documents(docs: DataFrame, chunks: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents gone (id).

    Their chunks (document_id) and outgoing relations go with them; relations to them stay without a target.
    """
    named = lambda c: gone.select(F.col("id").alias(c)).distinct()
    left = relations.join(named("source_doc_id"), "source_doc_id", "left_anti")
    lost = named("target_doc_id").withColumn("lost", F.lit(True))
    left = left.join(lost, "target_doc_id", "left").withColumn("target_doc_id", F.when(F.col("lost").isNull(), F.col("target_doc_id"))).drop("lost")
    return docs.join(named("id"), "id", "left_anti"), chunks.join(named("document_id"), "document_id", "left_anti"), left.select(*relations.columns)


def patched(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the editable fields that edits (id, ...) give; an edited document counts as verified by its owner."""
    fields = [c for c in EDITABLE if c in docs.columns and c in edits.columns]
    new = edits.select("id", *(F.col(c).alias(f"new_{c}") for c in fields), F.lit(True).alias("edited"))
    rows = docs.join(new, "id", "left")
    kept = [F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in docs.columns if c != "owner_verified"]
    return rows.select(*kept, F.coalesce("edited", F.col("owner_verified") if "owner_verified" in docs.columns else F.lit(False), F.lit(False)).alias("owner_verified"))


def refreshed(docs: DataFrame, statuses: DataFrame, now: str) -> DataFrame:
    """docs (id, status, status_reason, updated_at) with new statuses; only what changed gets the new time."""
    new = statuses.select("id", F.col("status").alias("s"), F.col("status_reason").alias("r"))
    same = F.col("s").eqNullSafe(F.col("status")) & F.col("r").eqNullSafe(F.col("status_reason"))
    rows = docs.join(new, "id")
    return rows.select("id", F.col("s").alias("status"), F.col("r").alias("status_reason"), F.when(same, F.col("updated_at")).otherwise(F.lit(now).cast("timestamp_ntz")).alias("updated_at"))


def put_installed(installed: DataFrame, new: DataFrame) -> DataFrame:
    """Installed packs (tier, ...) with those of the new ones in place of their tiers'."""
    return installed.join(new.select("tier"), "tier", "left_anti").unionByName(new)


def mark_read(notices: DataFrame, seen: DataFrame) -> DataFrame:
    """Notices (id, user_id, read) marked for seen (user_id, id); an id of null marks all of a user's."""
    one = seen.where("id is not null").select("user_id", "id", F.lit(True).alias("by_id")).distinct()
    every = seen.where("id is null").select("user_id", F.lit(True).alias("by_user")).distinct()
    rows = notices.join(one, ["user_id", "id"], "left").join(every, "user_id", "left")
    return rows.select("id", "user_id", (F.col("read") | F.coalesce("by_id", "by_user", F.lit(False))).alias("read"))


def replacements(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, new_id, new_no): of each target, the first verified relation that cancels, replaces or amends it."""
    acting = relations.where("verified = 1 and target_doc_id is not null and relation_type in ('CANCELS', 'SUPERSEDES', 'AMENDS')")
    first = acting.groupBy(F.col("target_doc_id").alias("id")).agg(F.min_by("source_doc_id", "id").alias("new_id"))
    return first.join(docs.select(F.col("id").alias("new_id"), F.col("circular_no").alias("new_no")), "new_id", "left").select("id", "new_id", "new_no")


def without_thoughts(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, THOUGHT, ""), r"^\s+|\s+$", "")


def loose_json(c: Column, schema: str) -> Column:
    """The first JSON value in a model's reply: without thoughts and fences, else between its outermost braces or brackets."""
    bare = F.regexp_replace(without_thoughts(c), FENCE, "")
    inner = lambda a, b: F.regexp_extract(bare, rf"(?s)({a}.*{b})", 1)
    tries = [bare, inner(r"\{", r"\}"), inner(r"\[", r"\]")]
    read = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
    return F.coalesce(*map(read, tries))


def unwrapped(c: Column, item: str) -> Column:
    """A list of items: the text's own, or the first list inside an object."""
    inside = F.filter(F.map_values(F.from_json(c, "map<string,string>")), lambda x: x.startswith("["))
    return F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, f"array<{item}>")), F.from_json(F.get(inside, F.lit(0)), f"array<{item}>"))


def relations_queue(relations: DataFrame, docs: DataFrame, verified: bool | None = None) -> DataFrame:
    """Relations with their documents' numbers and what they do to the target, in the order of a publisher's work: those that
    were rejected, those that wait, those that hold, the newest first; place counts from 1.

    verified asks for those that hold (True) or wait (False); None is all, and only there rejected ones are seen.  Relations
    whose source is gone aren't shown.
    """
    if verified is not None:
        relations = relations.where(F.col("verified") == int(verified))
    source = docs.select(F.col("id").alias("source_doc_id"), F.col("circular_no").alias("source_no"))
    target = docs.select(F.col("id").alias("target_doc_id"), F.col("circular_no").alias("target_no"), F.col("status").alias("target_status"))
    effect = F.when(F.col("relation_type").isin("CANCELS", "SUPERSEDES"), "CANCELLED").when(F.col("relation_type") == "AMENDS", "AMENDED")
    rows = relations.join(source, "source_doc_id").join(target, "target_doc_id", "left")
    rows = rows.select(F.col("id").alias("rel_id"), F.negative("id").alias("newest"), "source_no", "target_no", "target_status", "relation_type", "verified", effect.alias("effect"))
    nothing = rows.sparkSession.range(0)
    return numbered(rows, nothing, "verified", "newest").select("rel_id", "source_no", "target_no", "target_status", "relation_type", "verified", "effect", F.col("id").alias("place"))


def alerts(notices: DataFrame, users: DataFrame, most: int = 50) -> DataFrame:
    """(user_id, id, place, read, unread): each user's newest notices that their clearance allows, with how many are unread.

    notices: id, user_id, tier, read; users: id, clearance_level.  A notice without a tier is for all; unread counts only
    what is shown, and a null read is unread.
    """
    own = notices.join(users.select(F.col("id").alias("user_id"), "clearance_level"), "user_id").where(F.col("tier").isNull() | (F.col("tier") <= F.col("clearance_level")))
    rows = top(own, "user_id", most, F.desc("id"), name="place").withColumn("read", F.coalesce("read", F.lit(False)))
    return rows.select("user_id", "id", "place", "read", F.count_if(~F.col("read")).over(Window.partitionBy("user_id")).alias("unread"))


def safe_file_name(c: Column) -> Column:
    """Letters, digits, dots, blanks, hyphens and underscores of the last part of a path."""
    return F.regexp_replace(F.regexp_extract(c, r"[^/\\]*$", 0), r"[^\p{L}\p{N}. _-]", "_")


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
