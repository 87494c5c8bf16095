"""Named queries over asking: rungs of rerankers, thresholds by kind, prompts and events, each beside its SQL.

Models are stood in for by tables that Spark derives: stored vectors for the rung of vectors, a formula of the ids for raw
scores, and replies made of the question.  Every seventeenth search fails, every thirteenth question has no pack, every
fifth model stops.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import answers as ANS
from quillstone.operators import asking as K
from quillstone.operators import retrieval as R
from quillstone.operators import validity as V
from quillstone.operators.passages import PASSAGE_WORDS, shown_text
from quillstone.plans import catalogue as C
from quillstone.plans.catalogue import query
from quillstone.sources import policy as P
from quillstone.sources.tables import table

RAW = "(id * 7 + qid * 3) % 41 / 10.0 - 2"
LADDER = C.RANKED + f""", po AS (SELECT qid, id, 1 / (60 + rank) AS rrf, rank AS place FROM kw WHERE rank <= 20),
b0 AS (SELECT qid, id, score FROM rk WHERE qid % 4 = 0), b1 AS (SELECT qid, id, CASE WHEN {RAW} BETWEEN 0 AND 1 THEN {RAW} ELSE round(1 / (1 + exp(-({RAW}))), 6) END AS score FROM po WHERE qid % 4 = 1 AND id % 5 <> 0),
b2 AS (SELECT qid, po.id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM po JOIN embeddings q ON q.vec_id = qid * 5 JOIN embeddings v ON v.vec_id = po.id WHERE qid % 4 = 2),
ld AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rrf DESC, place) AS pos FROM (
 SELECT po.*, CASE WHEN qid IN (SELECT qid FROM b0) THEN 'words' WHEN qid IN (SELECT qid FROM b1) THEN 'crossencoder' WHEN qid IN (SELECT qid FROM b2) THEN 'embedding' ELSE 'none' END AS kind,
  CASE WHEN qid IN (SELECT qid FROM b0) THEN COALESCE(b0.score, 0) WHEN qid IN (SELECT qid FROM b1) THEN COALESCE(b1.score, 0) WHEN qid IN (SELECT qid FROM b2) THEN COALESCE(b2.score, 0) ELSE rrf END AS score
 FROM po LEFT JOIN b0 USING (qid, id) LEFT JOIN b1 USING (qid, id) LEFT JOIN b2 USING (qid, id)))"""


def laddered(spark, folder):
    # few rows, which the rungs share: the texts are searched once
    shown = V.cut(C.keyword_hits(spark, folder))
    pool = shown.select("qid", "id", (1 / (R.RRF_K + F.col("rank"))).alias("rrf"), F.col("rank").alias("place"))
    backend = C.reranked(spark, folder, shown).where("qid % 4 = 0").select("qid", "id", "score")
    raw = (F.col("id") * 7 + F.col("qid") * 3) % 41 / 10.0 - 2
    some = pool.where((F.col("qid") % 4 == 1) & (F.col("id") % 5 != 0) & (F.col("place") <= R.POOL))
    model = some.select("qid", "id", raw.alias("raw")).select("qid", "id", F.round(K.squashed(F.col("raw")), 6).alias("score"))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = R.bounded(pool.where("qid % 4 = 2").select("qid").distinct().withColumn("named", F.col("qid") * 5).join(vectors.select(F.col("id").alias("named"), F.col("vec").alias("qvec")), "named"))
    stored = pool.where(F.col("place") <= R.POOL).join(asked, "qid").join(vectors, "id").select("qid", "id", F.round(R.dot(F.col("qvec"), F.col("vec")), 6).alias("score"))
    return K.ladder(pool, [("words", backend), ("crossencoder", model), ("embedding", stored)])


@query(LADDER + " SELECT qid, id, kind, round(score, 6) AS score, pos FROM ld")
def rerank_ladder(spark, folder):
    """Each question by the first rung that knows it: shared words, a model's squashed scores, stored vectors, else as fused."""
    return laddered(spark, folder).withColumn("score", F.round("score", 6))


def kind_sql(values: dict[str, float]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


@query(LADDER + f""" SELECT qid, kind, count(*) AS n_shown, round(max(score), 6) AS top_score, CASE WHEN max(score) >= {kind_sql(K.HIGH)} THEN 'HIGH' WHEN max(score) >= {kind_sql(K.MEDIUM)} THEN 'MEDIUM' ELSE 'LOW' END AS band
FROM ld WHERE score >= {kind_sql(K.FLOORS)} GROUP BY 1, 2""")
def confidence_by_kind(spark, folder):
    """What each question shows over the floor of its kind of score, and how sure that makes."""
    best = K.over_floor(laddered(spark, folder)).groupBy("qid", "kind").agg(F.count(F.lit(1)).alias("n_shown"), F.max("score").alias("top"))
    return best.select("qid", "kind", "n_shown", F.round("top", 6).alias("top_score"), K.confidence(F.col("top"), F.col("kind")).alias("band"))


WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
SOURCES = C.JUR + f""", so AS (SELECT js.qid, js.id, js.score, conflict, CASE WHEN other THEN 'comparison' ELSE 'primary' END AS role, row_number() OVER (PARTITION BY js.qid ORDER BY other, js.pos) AS place, circular_no, doc_type, jurisdiction, status, status_reason, issue_date,
 CASE WHEN len({WORDS}) > {PASSAGE_WORDS} THEN array_to_string({WORDS}[1:{PASSAGE_WORDS}], ' ') || ' ...' ELSE text END AS text FROM js JOIN (SELECT id, circular_no, doc_type, jurisdiction, status, status_reason, issue_date, text FROM st) st ON st.id = js.id)"""


def sources(spark, folder):
    facts = C.statuses(spark, folder).select("id", "circular_no", "doc_type", "jurisdiction", "status", "status_reason", "issue_date", shown_text(F.col("text")).alias("text"))
    return C.jurisdiction_places(spark, folder).join(facts, "id")


def prompt_sql(status: str) -> str:
    block = f"'[S' || place || '] ' || circular_no || ' | Dokumen ' || id || ' | ' || doc_type || ' | ' || jurisdiction || ' | ' || {status} || ' | ' || {P.malay_sql('issue_date')} || ' | ' || CASE WHEN id % 7 = 0 THEN '-' ELSE (id % 9 + 1) || '.1' END || ' | page ' || (id % 3 + 1) || chr(10) || COALESCE(text, '')"
    grade, scheme = "CASE WHEN qid % 2 = 0 THEN 'N' || (19 + qid % 30) ELSE 'tidak dinyatakan' END", "CASE WHEN qid % 3 = 0 THEN 'Pentadbiran' ELSE 'tidak dinyatakan' END"
    return f"'USER_PROFILE: jurisdiction=SARAWAK; grade=' || {grade} || '; scheme=' || {scheme} || chr(10) || 'QUESTION: ' || any_value(b.text) || chr(10) || 'CONTEXT:' || chr(10) || string_agg({block.replace('COALESCE(text', 'COALESCE(so.text')}, chr(10) || chr(10) ORDER BY place)"


@query(SOURCES + f""" SELECT qid, length({prompt_sql("CASE WHEN status IN ('CANCELLED','AMENDED','ONE_OFF') THEN status || ' (' || status_reason || ')' ELSE status END")}) AS n_chars,
 md5({prompt_sql("CASE WHEN status IN ('CANCELLED','AMENDED','ONE_OFF') THEN status || ' (' || status_reason || ')' ELSE status END")}) AS message_md5, md5({prompt_sql("'-'")}) AS hidden_md5 FROM so JOIN benchmark b ON b.item_id = qid GROUP BY qid""")
def prompt_messages(spark, folder):
    """What a model is told for each question, with the sources' statuses and without."""
    n, q = F.col("id"), F.col("item_id")
    rows = sources(spark, folder).withColumn("title", F.concat(F.lit("Dokumen "), n.cast("string"))).withColumn("clause_ref", F.when(n % 7 != 0, F.concat((n % 9 + 1).cast("string"), F.lit(".1")))).withColumn("page", n % 3 + 1)
    grade, scheme = F.when(q % 2 == 0, F.concat(F.lit("N"), (19 + q % 30).cast("string"))), F.when(q % 3 == 0, "Pentadbiran").when(q % 3 == 1, "")
    asked = table(spark, folder, "benchmark").select(q.alias("qid"), F.col("text").alias("question"), F.lit("SARAWAK").alias("jurisdiction"), grade.alias("grade"), scheme.alias("scheme"))
    digest = lambda name: F.md5(F.col("message").cast("binary")).alias(name)
    plain = K.messages(rows, asked).select("qid", F.length("message").cast("long").alias("n_chars"), digest("message_md5"))
    return plain.join(K.messages(rows, asked, True).select("qid", digest("hidden_md5")), "qid")


ACTIONS = "\nACTIONS:\n- baca dahulu [S1]\n- simpan [S8]\n- hantar [ s2 ]"


def replies(spark, folder):
    """(qid, seq, section, text): what the models said, as the parser gives it."""
    q = F.col("item_id")
    said = F.when(q % 5 == 0, F.concat(F.lit("ANSWERABLE: NO\n"), "text")).when(q % 5 == 1, F.concat(F.lit("ANSWERABLE: YES\n"), "text", F.lit(" [S9]"))).when(q % 5 == 2, F.concat(F.lit("ANSWERABLE: YES\n"), "text")).otherwise(F.concat(F.lit("ANSWERABLE: YES\n"), "text", F.lit(" [S1, S2]." + ACTIONS)))
    pieces = table(spark, folder, "benchmark").select(q.alias("id"), F.posexplode(F.regexp_extract_all(said, F.lit(r"[\s\S]{1,9}"), F.lit(0))).alias("seq", "piece"))
    parts = F.array(*(F.struct(F.lit(name).alias("section"), F.col(name).alias("text")) for name in ("answer", "actions")))
    rows = ANS.fold_streams(pieces).select(F.col("id").alias("qid"), F.posexplode(parts).alias("seq", "p"))
    return rows.select("qid", F.col("seq").cast("long").alias("seq"), "p.section", "p.text").where("text <> ''")


EVENTS = SOURCES + f""", aq AS (SELECT item_id AS qid, regexp_replace(text, '^\\s+', '') AS said, CASE WHEN item_id % 13 = 5 THEN 0 ELSE 2 END AS n_packs, item_id % 17 = 3 AS lost FROM benchmark),
sl AS (SELECT qid, list({{'id': 'S' || place, 'n': CAST(place AS INTEGER), 'document_id': id, 'circular_no': circular_no, 'status': status, 'role': role, 'score': score4}} ORDER BY place) AS sources, count(*) AS n_sources, max(score4) AS best, bool_or(conflict) AS conflict FROM (SELECT *, round(score, 4) AS score4 FROM so JOIN aq USING (qid) WHERE n_packs > 0 AND NOT lost) GROUP BY 1),
qe AS (SELECT aq.*, sources, COALESCE(n_sources, 0) AS n, COALESCE(conflict, FALSE) AS conflict, CASE WHEN best >= 0.3 THEN 'HIGH' WHEN best >= 0.12 THEN 'MEDIUM' ELSE 'LOW' END AS band, qid % 5 >= 3 AND n_sources > 0 AS ok, qid % 5 = 2 AND n_sources > 0 AS stopped FROM aq LEFT JOIN sl USING (qid) WHERE NOT lost),
tk AS (SELECT qid, 'answer' AS section, CASE qid % 5 WHEN 1 THEN said || ' [S9]' WHEN 2 THEN said ELSE said || ' [S1, S2].' END AS text, 1 AS seq FROM qe WHERE n > 0 AND qid % 5 <> 0
 UNION ALL SELECT qid, 'actions', '- baca dahulu [S1]\n- simpan [S8]\n- hantar [ s2 ]', 2 FROM qe WHERE ok),
fi AS (SELECT *, CASE WHEN ok THEN regexp_replace(regexp_replace(said || CASE WHEN n > 1 THEN ' [S1][S2].' ELSE ' [S1].' END, '[ \\t]+([.,;:])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g') WHEN NOT COALESCE(stopped, FALSE) THEN '{K.REFUSAL.replace("'", "''")}' END AS answer FROM qe)
SELECT qid, 0 AS seq, 'error' AS event, '{{"message":"Carian gagal"}}' AS payload FROM aq WHERE lost
UNION ALL SELECT qid, 0, 'sources', to_json({{'sources': COALESCE(sources, []), 'jurisdiction_conflict': conflict, 'confidence': band, 'rerank': 'words'}}) FROM qe
UNION ALL SELECT qid, seq, 'token', to_json({{'section': section, 'text': text}}) FROM tk
UNION ALL SELECT qid, (SELECT count(*) FROM tk WHERE tk.qid = fi.qid) + 1, 'final', to_json({{'answer': answer, 'answerable': COALESCE(ok, FALSE), 'refusal': NOT COALESCE(ok OR stopped, FALSE),
 'citations': CASE WHEN NOT COALESCE(ok, FALSE) THEN [] WHEN n > 1 THEN ['S1', 'S2'] ELSE ['S1'] END,
 'actions': CASE WHEN NOT COALESCE(ok, FALSE) THEN [] WHEN n > 1 THEN [{{'text': 'baca dahulu', 'citations': ['S1']}}, {{'text': 'hantar', 'citations': ['S2']}}] ELSE [{{'text': 'baca dahulu', 'citations': ['S1']}}] END,
 'confidence': CASE WHEN ok THEN band ELSE 'LOW' END,
 'warnings': CASE WHEN n_packs = 0 THEN [{{'code': 'no_packs', 'message': '{K.NO_PACKS[1]}'}}] WHEN stopped THEN [{{'code': 'llm_failed', 'message': 'tamat masa'}}] ELSE [] END}}) FROM fi"""


@query(EVENTS)
def ask_events(spark, folder):
    """What each question's reader is sent: sources, tokens, the final event with its gate; or an error."""
    q = F.col("item_id")
    packs = F.when(q % 13 == 5, 0).otherwise(2)
    asked = table(spark, folder, "benchmark").select(q.alias("qid"), packs.alias("n_packs"), F.lit("words").alias("kind"), F.when(q % 17 == 3, "Carian gagal").alias("search_failure"), F.when(q % 5 == 2, "tamat masa").alias("model_failure"))
    rows = sources(spark, folder).withColumn("score", F.round("score", 4)).join(R.bounded(asked.where("n_packs > 0 and search_failure is null").select("qid")), "qid")
    sides = rows.groupBy("qid").agg(F.bool_or("conflict").alias("conflict"))
    asked = asked.join(sides, "qid", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    return K.answer_events(asked, rows.select("qid", F.col("place").cast("int").alias("place"), "id", "circular_no", "status", "role", "score"), replies(spark, folder))
