"""Named queries over records, lists and replies, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import records as K
from quillstone.operators import retrieval as R
from quillstone.operators import validity as V
from quillstone.plans import catalogue as C
from quillstone.plans.catalogue import query
from quillstone.sources import policy as P
from quillstone.sources.policy import POL


@query(POL + "SELECT id, source_doc_id, CASE WHEN target_doc_id % 5 <> 1 THEN target_doc_id END AS target_doc_id FROM pr WHERE source_doc_id % 5 <> 1")
def cascade_relations(spark, folder):
    docs, rels = P.policy_documents(spark, folder), P.policy_relations(spark, folder)
    return K.delete_documents(docs, docs.select(F.col("id").alias("document_id")), rels, docs.where("id % 5 = 1").select("id"))[2].select("id", "source_doc_id", "target_doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 5 <> 1")
def cascade_chunks(spark, folder):
    docs, rels = P.policy_documents(spark, folder), P.policy_relations(spark, folder)
    chunks = C.table(spark, folder, "conversations").select(F.col("conv_id").alias("document_id"), "turn")
    gone = chunks.where("document_id % 5 = 1").select(F.col("document_id").alias("id"))
    return K.delete_documents(docs, chunks, rels, gone)[1].select(F.col("document_id").alias("conv_id"), "turn")


@query(POL + "SELECT id, CASE WHEN id % 6 = 0 THEN 'policy' ELSE doc_type END AS doc_type, CASE WHEN id % 12 = 0 THEN 2 ELSE classification_level END AS classification_level, id % 6 = 0 AS owner_verified FROM pd")
def patch_documents(spark, folder):
    docs = P.policy_documents(spark, folder).select("id", "doc_type", "classification_level")
    edits = docs.where("id % 6 = 0").select("id", F.lit("policy").alias("doc_type"), F.when(F.col("id") % 12 == 0, 2).alias("classification_level"), F.lit("no").alias("secret_field"))
    return K.patched(docs, edits)


@query(POL + P.status_sql("v1", P.AS_OF_OLD) + P.status_sql("v2", P.AS_OF) + "SELECT v2.id, v2.status, v2.status_reason, CASE WHEN v1.status = v2.status AND v1.status_reason = v2.status_reason THEN TIMESTAMP '2022-06-30' ELSE TIMESTAMP '2024-06-30' END AS updated_at FROM v2 JOIN v1 USING (id)")
def refresh_validity(spark, folder):
    docs, rels = P.policy_documents(spark, folder), P.policy_relations(spark, folder)
    old = V.with_status(docs, rels, P.AS_OF_OLD).withColumn("updated_at", F.lit("2022-06-30").cast("timestamp_ntz"))
    return K.refreshed(old.select("id", "status", "status_reason", "updated_at"), V.with_status(docs, rels, P.AS_OF), P.AS_OF)


@query(POL + "SELECT id, user_id, event_type = 'view' OR id % 3 = 0 OR user_id % 10 = 1 AS read FROM (SELECT event_id AS id, user_id, event_type FROM events)")
def notices_read(spark, folder):
    notices = C.table(spark, folder, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_type") == "view").alias("read"))
    some = notices.where("id % 3 = 0").select("user_id", "id")
    every = notices.where("user_id % 10 = 1").select("user_id", F.lit(None).cast("long").alias("id")).distinct()
    return K.mark_read(notices, some.unionByName(every))


@query(POL + "SELECT f.target_doc_id AS id, f.new_id, s.circular_no AS new_no FROM (SELECT target_doc_id, min_by(source_doc_id, id) AS new_id FROM pr WHERE verified = 1 AND target_doc_id IS NOT NULL AND relation_type IN ('CANCELS','SUPERSEDES','AMENDS') GROUP BY 1) f LEFT JOIN pd s ON s.id = f.new_id")
def replacement_lookup(spark, folder):
    return K.replacements(P.policy_relations(spark, folder), P.policy_documents(spark, folder))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def loose_replies(spark, folder):
    """Replies with thoughts, fences or chatter round their JSON; every seventh has none."""
    n = F.col("event_id")
    told = F.when(n % 7 == 0, F.lit("sorry {")).when(n % 3 == 0, F.concat(F.lit("<think>{1}\nhm</think>\n```json\n"), F.col("props"), F.lit("\n```"))).when(n % 3 == 1, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" - done"))).otherwise(F.col("props"))
    return C.table(spark, folder, "events").select("event_id", K.loose_json(told, "k long")["k"].alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS n_items, event_id AS first_item FROM events")
def unwrapped_lists(spark, folder):
    n = F.col("event_id").cast("string")
    told = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"note": "x", "items": ['), n, F.lit(", 5]}"))).otherwise(F.concat(F.lit("["), n, F.lit("]")))
    items = K.unwrapped(told, "bigint")
    return C.table(spark, folder, "events").select("event_id", F.size(items).alias("n_items"), F.get(items, F.lit(0)).alias("first_item"))


@query("SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))), 5) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distance(spark, folder):
    v = C.table(spark, folder, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select("vec_id", F.round(K.distance(F.col("embedding"), F.col("next")), 5).alias("distance"))


@query(POL + "SELECT id, issue_date, place FROM (SELECT id, issue_date, row_number() OVER (PARTITION BY jurisdiction ORDER BY issue_date DESC, id) AS place FROM pd) WHERE place <= 20")
def latest_by_jurisdiction(spark, folder):
    docs = P.policy_documents(spark, folder).select("id", "issue_date", "jurisdiction")
    return R.top(docs, "jurisdiction", 20, F.desc("issue_date"), F.asc("id"), name="place").select("id", "issue_date", "place")


@query(POL + "SELECT id, role, clearance_level FROM us WHERE role = 'OFFICER' ORDER BY id")
def users_listing(spark, folder):
    return P.users(spark, folder).where("role = 'OFFICER'").select("id", "role", "clearance_level")


@query(C.JUR + ", cp AS (SELECT qid, min_by('S' || place, place) FILTER (NOT other AND doc_type NOT IN ('minutes','report')) AS mine, min_by('S' || place, place) FILTER (other) AS other_id FROM (SELECT js.*, doc_type, row_number() OVER (PARTITION BY qid ORDER BY other, pos) AS place FROM (SELECT qid, id, other, pos, conflict FROM js) js JOIN pd USING (id)) WHERE conflict GROUP BY 1) SELECT qid, mine, other_id FROM cp WHERE mine IS NOT NULL AND other_id IS NOT NULL")
def comparison_payload(spark, folder):
    """Where both sides have strong rules: the first source of the user's side, and the first of the other."""
    kinds = P.policy_documents(spark, folder).select("id", "doc_type")
    rows = C.jurisdiction_places(spark, folder).where("conflict").join(kinds, "id").withColumn("source", F.concat(F.lit("S"), F.col("place").cast("string")))
    mine = (F.col("role") == "primary") & ~F.col("doc_type").isin("minutes", "report")
    first = lambda where: F.min_by(F.when(where, F.col("source")), F.when(where, F.col("place")))
    return rows.groupBy("qid").agg(first(mine).alias("mine"), first(F.col("role") == "comparison").alias("other_id")).where("mine is not null and other_id is not null")


@query(f"""SELECT qid, id, xs.score FROM ({C.FUSED.replace(C.NOW, C.ALL)}, ex AS (SELECT qid, fu.id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS k FROM fu) fu JOIN st ON st.id = fu.id WHERE k <= 10 AND status = 'CANCELLED')
 SELECT ex.qid, ex.id, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, t)) / (len(q) + 2) END, 6) AS score FROM ex JOIN (SELECT item_id AS qid, list_distinct({C.tokens_sql('text')}) AS q FROM benchmark) USING (qid) JOIN (SELECT doc_id AS id, list_distinct({C.tokens_sql('text')}) AS t FROM documents) USING (id)) xs
JOIN ({C.JUR} SELECT qid, max(score) AS best FROM js GROUP BY 1) tp USING (qid) WHERE xs.score >= greatest(0.12, 0.6 * best)""")
def exclusion_bar(spark, folder):
    """Cancelled documents that are worth a word: as alike as 0.12, and as 0.6 of the best passage shown."""
    found = C.excluded_documents(spark, folder).select("qid", "id")
    asked = C.table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    texts = C.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("passage"))
    rows = found.join(asked, "qid").join(texts, "id").select("qid", "id", F.round(R.overlap(F.col("question"), F.col("passage")), 6).alias("score"))
    best = C.jurisdiction_places(spark, folder).groupBy("qid").agg(F.max("score").alias("best"))
    return rows.join(best, "qid").where(F.col("score") >= F.greatest(F.lit(R.MEDIUM), 0.6 * F.col("best"))).select("qid", "id", "score")
