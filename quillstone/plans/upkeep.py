"""Named queries over ingested batches and refreshes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import upkeep as U
from quillstone.operators import validity as V
from quillstone.plans import catalogue as C
from quillstone.plans.catalogue import query
from quillstone.sources import policy as P
from quillstone.sources.policy import AS_OF, AS_OF_OLD, POL, status_sql

# a batch: every seventh document again, and one new document for every fiftieth
BATCH = (
    POL
    + """, ag AS (SELECT * FROM pd WHERE id % 7 = 0), nw AS (SELECT 'NX ' || id || '/2030' AS circular_no, (SELECT max(id) FROM pd) + row_number() OVER (ORDER BY 'NX ' || id || '/2030') AS id FROM pd WHERE id % 50 = 3)"""
)


def corpus(spark, folder) -> U.Corpus:
    docs = P.policy_documents(spark, folder).select("id", "circular_no", "doc_type", F.lit("IN_FORCE").alias("status"))
    chunks = C.table(spark, folder, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("chunk_index"), "text")
    rels = P.policy_relations(spark, folder).select("id", "source_doc_id", "target_doc_id", "target_ref_text", "relation_type", "verified")
    notes = rels.where("verified = 1 and target_doc_id is not null").select(F.col("target_doc_id").alias("old_doc_id"), F.col("source_doc_id").alias("new_doc_id"))
    return U.Corpus(docs, chunks, rels, notes)


def after_batch(spark, folder) -> U.Corpus:
    old = corpus(spark, folder)
    again = old.documents.where("id % 7 = 0").select("id", "circular_no", F.lit("policy").alias("doc_type"))
    new = old.documents.where("id % 50 = 3").select(F.concat(F.lit("NX "), F.col("id").cast("string"), F.lit("/2030")).alias("circular_no"), F.lit("circular").alias("doc_type"))
    docs = again.select("circular_no", "doc_type", F.lit("b.pdf").alias("file")).unionByName(new.withColumn("file", F.lit("a.pdf")))
    # an earlier file of the same numbers, which does not count
    docs = docs.unionByName(again.select("circular_no", F.lit("report").alias("doc_type"), F.lit("a.pdf").alias("file")))
    chunk = lambda df, k: df.select("circular_no", F.lit(k).cast("long").alias("chunk_index"), F.lit("baharu").alias("text"))
    known = old.relations.join(again.select(F.col("id").alias("source_doc_id"), "circular_no"), "source_doc_id").select("circular_no", "target_ref_text", "relation_type")
    found = again.select("circular_no", F.lit("PP 1/1999").alias("target_ref_text"), F.lit("CANCELS").alias("relation_type")).unionByName(known)
    return U.replaced(old, docs, chunk(again, 0).unionByName(chunk(again, 1)).unionByName(chunk(new, 0)), found)


@query(BATCH + " SELECT id, circular_no, doc_type, 'IN_FORCE' AS status FROM pd WHERE id % 7 <> 0 UNION ALL SELECT id, circular_no, 'policy', 'IN_FORCE' FROM ag UNION ALL SELECT id, circular_no, 'circular', 'UNKNOWN' FROM nw")
def replace_documents(spark, folder):
    return after_batch(spark, folder).documents


@query(BATCH + " SELECT conv_id AS id, turn AS chunk_index, text FROM conversations WHERE conv_id NOT IN (SELECT id FROM ag) AND conv_id NOT IN (SELECT id FROM nw) UNION ALL SELECT id, unnest([0, 1]), 'baharu' FROM ag UNION ALL SELECT id, 0, 'baharu' FROM nw")
def replace_chunks(spark, folder):
    return after_batch(spark, folder).chunks


@query(
    BATCH
    + """, lf AS (SELECT id, source_doc_id, target_ref_text, relation_type, verified FROM pr WHERE NOT (verified = 0 AND source_doc_id IN (SELECT id FROM ag))),
fd AS (SELECT id AS source_doc_id, 'PP 1/1999' AS target_ref_text, 'CANCELS' AS relation_type FROM ag UNION SELECT source_doc_id, target_ref_text, relation_type FROM pr WHERE source_doc_id IN (SELECT id FROM ag))
SELECT * FROM lf UNION ALL SELECT (SELECT max(id) FROM pr) + row_number() OVER (ORDER BY source_doc_id, target_ref_text, relation_type), *, 0 FROM fd WHERE NOT EXISTS (SELECT 1 FROM lf WHERE lf.source_doc_id = fd.source_doc_id AND lf.target_ref_text = fd.target_ref_text AND lf.relation_type = fd.relation_type)"""
)
def replace_relations(spark, folder):
    return after_batch(spark, folder).relations.select("id", "source_doc_id", "target_ref_text", "relation_type", "verified")


@query(BATCH + " SELECT target_doc_id AS old_doc_id, source_doc_id AS new_doc_id FROM pr WHERE verified = 1 AND target_doc_id IS NOT NULL AND target_doc_id % 7 <> 0 AND source_doc_id % 7 <> 0")
def replace_summaries(spark, folder):
    return after_batch(spark, folder).summaries


@query(POL + """, ne AS (SELECT pr.*, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN '' ELSE (SELECT circular_no FROM pd WHERE pd.id = pr.id - 2) END END AS new_ref FROM pr)
SELECT id, CASE id % 4 WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE verified END AS verified, CASE WHEN new_ref IS NULL THEN target_doc_id ELSE (SELECT pd.id FROM pd WHERE circular_no = new_ref) END AS target_doc_id, CASE WHEN new_ref IS NULL THEN target_ref_text ELSE NULLIF(new_ref, '') END AS target_ref_text, CASE WHEN id % 12 = 0 THEN NULL ELSE scope END AS scope FROM ne""")
def decide_relations(spark, folder):
    """Approvals, rejections, resets, and edits whose reference names another document, or none."""
    rels, docs = P.policy_relations(spark, folder), P.policy_documents(spark, folder).select("id", "circular_no")
    n = F.col("id")
    other = rels.where("id % 8 = 4").select(n, (n - 2).alias("named")).join(docs.select(n.alias("named"), F.col("circular_no").alias("ref")), "named", "left").select("id", "ref")
    action = F.when(n % 4 == 1, "approve").when(n % 4 == 2, "reject").when(n % 4 == 3, "reset").otherwise("edit")
    rows = rels.select("id", action.alias("action"), F.when(n % 12 == 0, "").alias("scope")).join(other, "id", "left")
    return U.decided(rels, rows.withColumn("target_ref_text", F.when(n % 8 == 0, "").otherwise(F.col("ref"))), docs).select("id", "verified", "target_doc_id", "target_ref_text", "scope")


#: edits: every thirty-first document is one-off where it wasn't, every thirty-seventh relation is approved
EDITED = POL.replace("doc_id % 17 = 0 AS one_off", "(doc_id % 17 = 0) <> (doc_id % 31 = 0) AS one_off").replace("CASE WHEN doc_id % 5 = 0 THEN 0", "CASE WHEN doc_id % 37 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN 0")


@query(EDITED + status_sql("st", AS_OF) + " SELECT id, status, status_reason FROM st")
def refresh_touched(spark, folder):
    """Statuses of two years ago, brought to the date: only what edits or dates touch is worked out, and equals a full refresh."""
    docs, rels = P.policy_documents(spark, folder), P.policy_relations(spark, folder)
    stored = V.with_status(docs, rels, AS_OF_OLD).withColumn("updated_at", F.lit(AS_OF_OLD).cast("timestamp_ntz"))
    edits = stored.withColumn("one_off", F.col("one_off") != (F.col("id") % 31 == 0))
    now = rels.withColumn("verified", F.when(F.col("id") % 37 == 0, 1).otherwise(F.col("verified")))
    return U.refreshed_statuses(edits, now, rels, docs.where("id % 31 = 0").select("id"), AS_OF, AS_OF, AS_OF_OLD).select("id", "status", "status_reason")


@query(POL + """, lv AS (SELECT DISTINCT target_doc_id AS old_doc_id, source_doc_id AS new_doc_id FROM pr WHERE verified = 1 AND target_doc_id IS NOT NULL AND relation_type IN ('SUPERSEDES', 'AMENDS')), sm AS (SELECT DISTINCT target_doc_id AS old_doc_id, source_doc_id AS new_doc_id FROM pr WHERE target_doc_id IS NOT NULL AND id % 2 = 0)
SELECT 'make' AS what, * FROM (SELECT * FROM lv EXCEPT SELECT * FROM sm) UNION ALL SELECT 'drop', * FROM (SELECT * FROM sm EXCEPT SELECT * FROM lv)""")
def summaries_due(spark, folder):
    """Summaries that a refresh makes, and those that it drops; every second relation has one."""
    old = corpus(spark, folder)
    some = old._replace(summaries=old.relations.where("target_doc_id is not null and id % 2 = 0").select(F.col("target_doc_id").alias("old_doc_id"), F.col("source_doc_id").alias("new_doc_id")).distinct())
    work = U.due(some, old.chunks.select("id", "chunk_index"))
    return work.summaries.select(F.lit("make").alias("what"), "old_doc_id", "new_doc_id").unionByName(work.dropped.select(F.lit("drop").alias("what"), "old_doc_id", "new_doc_id"))
