"""Named queries of a publisher's desk: queues, alerts, uploads, views of changes, recognised pages; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import analytics as A
from quillstone.operators import records as K
from quillstone.operators.changes import change_views
from quillstone.operators.chunking import recognised
from quillstone.plans import catalogue as C
from quillstone.plans.catalogue import query
from quillstone.plans.passages import head
from quillstone.plans.revisions import REVISED, revised_clauses, revised_pairs
from quillstone.sources import policy as P
from quillstone.sources.policy import POL

QUEUE = "SELECT '{0}' AS asked, r.id AS rel_id, s.circular_no AS source_no, t.circular_no AS target_no, t.status AS target_status, relation_type, verified, CASE relation_type WHEN 'CANCELS' THEN 'CANCELLED' WHEN 'SUPERSEDES' THEN 'CANCELLED' WHEN 'AMENDS' THEN 'AMENDED' END AS effect, row_number() OVER (ORDER BY verified, r.id DESC) AS place FROM pr r JOIN pd s ON s.id = r.source_doc_id LEFT JOIN st t ON t.id = r.target_doc_id WHERE {1}"


@query(C.ST + QUEUE.format("all", "TRUE") + " UNION ALL " + QUEUE.format("true", "verified = 1") + " UNION ALL " + QUEUE.format("false", "verified = 0"))
def relations_queue(spark, folder):
    """All relations, those that hold, and those that wait, each in the order of a publisher's work."""
    docs, rels = C.statuses(spark, folder).select("id", "circular_no", "status"), P.policy_relations(spark, folder)
    rows = None
    for name, verified in (("all", None), ("true", True), ("false", False)):
        one = K.relations_queue(rels, docs, verified).withColumn("asked", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


#: notices: each search that was shown a document tells of it; a sixth is for all, the others are for the document's level
NOTICES = "nt AS (SELECT lg.id, user_id, CASE WHEN lg.id % 6 <> 0 THEN pd.classification_level END AS tier, topic = 'view' AS read FROM lg JOIN pd ON pd.id = lg.doc_ref)"


@query(POL + f""", {NOTICES}, nk AS (SELECT user_id, nt.id, row_number() OVER (PARTITION BY user_id ORDER BY nt.id DESC) AS place, read FROM nt JOIN us ON us.id = user_id WHERE tier IS NULL OR tier <= clearance_level)
SELECT user_id, id, place, read, count(*) FILTER (NOT read) OVER (PARTITION BY user_id) AS unread FROM nk WHERE place <= 50""")
def user_alerts(spark, folder):
    """Each user's newest fifty notices that their clearance allows, and how many of them are unread."""
    log = P.search_log(spark, folder)
    level = P.policy_documents(spark, folder).select(F.col("id").alias("doc_ref"), "classification_level")
    notices = log.join(level, "doc_ref").select("id", "user_id", F.when(F.col("id") % 6 != 0, F.col("classification_level")).alias("tier"), (F.col("topic") == "view").alias("read"))
    return K.alerts(notices, P.users(spark, folder))


def uploads(spark, folder):
    """Usage reports as texts, one a user: every fifth is of another kind, every seventh has no list, all name the user."""
    entry = F.struct("query", "topic", "confidence", F.col("user_id").alias("who"))
    rows = P.search_log(spark, folder).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))), lambda x: x["e"]).alias("queries"))
    kind = F.when(F.col("user_id") % 5 == 0, "other").otherwise(A.REPORT_KIND)
    # strings and numbers are no searches
    listed = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit('["x", 3, '), F.substring(F.to_json("queries"), 2, 1 << 30)))
    text = F.concat(F.lit('{"kind": "'), kind, F.lit('", "user": '), F.col("user_id").cast("string"), F.lit(', "queries": '), F.coalesce(listed, F.lit("null")), F.lit("}"))
    return rows.select(F.col("user_id").alias("id"), text.alias("text"))


VALID = "user_id % 5 <> 0 AND user_id % 7 <> 0"


@query(POL + f" SELECT user_id AS id, {VALID} AS ok, count(*) FILTER ({VALID}) AS n_queries FROM lg GROUP BY 1, 2")
def report_uploads(spark, folder):
    """Whether each uploaded report is one, and how many searches it holds."""
    ok, _ = A.imported_reports(uploads(spark, folder))
    return ok.withColumn("n_queries", F.col("n_queries").cast("long"))


@query(POL + f" SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY id) - 1 AS place, 3 AS n_fields, query, topic, confidence FROM lg WHERE {VALID}")
def report_searches(spark, folder):
    """The searches of uploaded reports, with the known fields alone."""
    _, rows = A.imported_reports(uploads(spark, folder))
    return rows.select("id", "place", F.size("search").alias("n_fields"), *(F.col("search")[c].alias(c) for c in ("query", "topic", "confidence")))


VIEWS = REVISED + """, dd AS (SELECT pair, count(*) AS n_changes, string_agg(COALESCE(clause_old, '') || '>' || COALESCE(clause_new, '') || ' ' || kind, '|' ORDER BY place) AS changes, string_agg(COALESCE(clause_new, clause_old), ',' ORDER BY place) AS clauses FROM dp GROUP BY 1),
vw AS (SELECT rl.*, o.circular_no AS ono, n.circular_no AS nno, CASE WHEN o.id IS NULL OR n.id IS NULL THEN 'DOCUMENT' WHEN pair % 6 = 0 THEN 'SUMMARY' ELSE 'OK' END AS code FROM rl LEFT JOIN (SELECT id, circular_no FROM pd WHERE classification_level <= 1) o ON o.id = doc LEFT JOIN (SELECT id, circular_no FROM pd WHERE classification_level <= 1) n ON n.id = new_doc)
SELECT doc AS old_id, new_doc AS new_id, code, CASE WHEN code = 'OK' THEN ono END AS old_no, CASE WHEN code = 'OK' THEN nno END AS new_no, CASE WHEN code = 'OK' THEN 'Perubahan ' || pair END AS summary_ms, CASE WHEN code = 'OK' THEN 'Change ' || pair END AS summary_en,
 CASE WHEN code = 'OK' AND pair % 10 <> 9 THEN relation_type END AS relation_type, CASE WHEN code = 'OK' THEN CASE WHEN pair % 10 = 9 THEN '' ELSE COALESCE(clauses, '') END END AS clauses, CASE WHEN code = 'OK' THEN CASE WHEN pair % 10 = 9 THEN '' ELSE COALESCE(changes, '') END END AS changes,
 CASE WHEN code = 'OK' AND pair % 10 <> 9 THEN 'semua pegawai' END AS who_is_affected FROM vw LEFT JOIN dd USING (pair)"""


@query(VIEWS)
def change_payload(spark, folder):
    """The view of each pair of documents from its stored changes; every sixth pair has none, every tenth can't be read."""
    pairs = revised_pairs(spark, folder).select("pair", F.col("id").alias("old_doc_id"), F.col("new_id").alias("new_doc_id"), "relation_type")
    listed = F.array_sort(F.collect_list(F.struct("place", "clause_old", "clause_new", "kind")))
    stored = revised_clauses(spark, folder).groupBy("pair").agg(listed.alias("l"))
    rows = pairs.join(stored, "pair", "left").where("pair % 6 <> 0")
    empty = F.array().cast("array<struct<place:int,clause_old:string,clause_new:string,kind:string>>")
    each = F.coalesce("l", empty)
    payload = F.to_json(F.struct("relation_type", F.transform(each, lambda x: F.coalesce(x["clause_new"], x["clause_old"])).alias("clauses"), F.transform(each, lambda x: F.struct(x["clause_old"].alias("clause_old"), x["clause_new"].alias("clause_new"), x["kind"].alias("kind"))).alias("changes"), F.lit("semua pegawai").alias("who_is_affected")))
    named = lambda word: F.concat(F.lit(f"{word} "), F.col("pair").cast("string"))
    summaries = rows.select("old_doc_id", "new_doc_id", named("Perubahan").alias("summary_ms"), named("Change").alias("summary_en"), F.when(F.col("pair") % 10 == 9, "{broken").otherwise(payload).alias("payload"))
    asked = pairs.select(F.col("old_doc_id").alias("old_id"), F.col("new_doc_id").alias("new_id"))
    out = change_views(asked, summaries, P.policy_documents(spark, folder), 1)
    each = F.transform("changes", lambda x: F.concat(F.coalesce(x["clause_old"], F.lit("")), F.lit(">"), F.coalesce(x["clause_new"], F.lit("")), F.lit(" "), x["kind"]))
    return out.select("old_id", "new_id", "code", "old_no", "new_no", "summary_ms", "summary_en", "relation_type", F.array_join("clauses", ",").alias("clauses"), F.array_join(each, "|").alias("changes"), "who_is_affected")


#: pages of a text, 1,500 characters each; those under 200 count as read by recognition
PAGE, SHORT = 1500, 200


@query(POL + head(C.MINUTES, "c2") + f" SELECT c2.id, chunk_index, COALESCE(length(whole) % {PAGE} BETWEEN 1 AND {SHORT - 1}, FALSE) AS ocr FROM c2 JOIN (SELECT id AS did, text AS whole FROM pd) ON did = c2.id")
def recognised_chunks(spark, folder):
    """Chunks of minutes with whether any page of their document was short, and so read by recognition."""
    docs = P.policy_documents(spark, folder).where("doc_type = 'minutes'")
    pages = docs.select("id", F.explode(F.regexp_extract_all("text", F.lit(rf"[\s\S]{{1,{PAGE}}}"), F.lit(0))).alias("page")).select("id", (F.length("page") < SHORT).alias("ocr"))
    return recognised(C.chunk_minutes(spark, folder), pages).select("id", "chunk_index", "ocr")
