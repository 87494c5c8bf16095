"""Named queries over chunks in packs, each beside its SQL.

Packs are the three levels of documents; a reader of level 1 searches two of them.  Questions are the benchmark's texts as
rewritten: expansions join the words, numbers name documents, and those that ask for former rules see them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import passages as S
from quillstone.operators import questions as Q
from quillstone.operators import retrieval as R
from quillstone.operators.changes import hash_embed
from quillstone.operators.validity import cut, kept
from quillstone.plans import catalogue as C
from quillstone.plans.catalogue import query
from quillstone.plans.library import ASKED, ENTRIES, SPOKEN
from quillstone.sources import policy as P
from quillstone.sources.policy import POL

CLEARANCE, SIDE = 1, "SARAWAK"


def chunks(spark, folder):
    """Chunks of rule documents and minutes in the packs that a reader may open, with what is known of their documents."""
    docs = C.statuses(spark, folder).select("id", "circular_no", "doc_type", "jurisdiction", "status", "classification_level", F.col("classification_level").alias("tier")).where(F.col("tier") <= CLEARANCE)
    # both are by document where docs meet them, so that texts aren't shuffled for it
    rows = C.chunk_rules(spark, folder, docs).unionByName(C.chunk_minutes(spark, folder).join(docs, "id"))
    return kept(rows.withColumn("chunk_id", F.col("id") * 100000 + F.col("chunk_index")))


def asked(spark, folder):
    text = F.concat("text", F.when(F.col("qid") % 3 == 1, " di Sarawak").when(F.col("qid") % 3 == 2, " peraturan lama persekutuan").otherwise(""))
    glossary = spark.createDataFrame([(k, i, t) for k, ts in ENTRIES.items() for i, t in enumerate(ts, 1)], "entry string, place int, term string")
    return cut(Q.rewritten(P.questions(spark, folder).withColumn("text", text), glossary))


def head(sql: str, name: str) -> str:
    """The common table expressions of a query over POL, and its last select as one more."""
    body = sql.removeprefix(POL)
    at = body.rindex("\nSELECT id, row_number()")
    return f"{body[:at]}, {name} AS ({body[at:].strip()})"


#: chunks, questions and what they ask; everything but the lists
CHUNKS = (
    C.ST + head(C.RULES, "c1") + head(C.MINUTES, "c2")
    + f""", ck AS (SELECT c.*, c.id * 100000 + chunk_index AS chunk_id, classification_level AS tier, status, doc_type, jurisdiction, circular_no FROM (SELECT id, chunk_index, clause_ref, breadcrumb, text FROM c1 UNION ALL SELECT id, chunk_index, clause_ref, breadcrumb, text FROM c2) c JOIN (SELECT id AS sid, classification_level, status, doc_type, jurisdiction, circular_no FROM st) ON sid = id WHERE classification_level <= {CLEARANCE}),
{ASKED}, qw AS (SELECT *, list_filter({SPOKEN}, lambda w: length(w) > 1 AND NOT list_contains({C.STOP}, w)) AS w FROM qx),
qr AS (SELECT qid, text, qid % 3 = 2 AS history, concat_ws(' ', text, NULLIF(array_to_string(w[1:5], ' '), ''), CASE WHEN qid % 3 = 2 THEN 'rule regulation' END, CASE WHEN qid % 4 = 0 THEN 'Pekeliling Perkhidmatan Bilangan ' || (qid * 5) || ' Tahun ' || (2015 + qid * 5 % 11) END) AS said, trim(text || chr(10) || array_to_string(w[1:5], ' ')) AS embedded,
 CASE qid % 3 WHEN 2 THEN 'FEDERAL' ELSE 'SARAWAK' END AS target FROM qw)"""
)
SHOWN = f"JOIN ck USING (chunk_id) JOIN qr USING (qid) WHERE status IN {C.NOW} OR history AND status IN {C.ALL}"
KEYWORD = f""", ctm AS (SELECT chunk_id, tier, {C.terms_sql('text')} AS terms FROM ck),
ci AS (SELECT chunk_id, tier, dl, term, count(*) AS tf FROM (SELECT chunk_id, tier, len(terms) AS dl, unnest(terms) AS term FROM ctm) GROUP BY ALL),
cz AS (SELECT tier, count(*) AS n, avg(COALESCE(len(terms), 0)) AS avgdl FROM ctm GROUP BY 1),
cq AS (SELECT qid, unnest({C.query_terms_sql('said')}) AS term FROM qr), cd AS (SELECT tier, term, count(*) AS df FROM ci WHERE term IN (SELECT term FROM cq) GROUP BY 1, 2),
cb AS (SELECT qid, tier, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM ci JOIN cd USING (tier, term) JOIN cz USING (tier) JOIN cq USING (term) GROUP BY 1, 2, 3),
kr AS (SELECT qid, tier, chunk_id, score, row_number() OVER (PARTITION BY qid, tier ORDER BY score DESC, chunk_id) AS raw_rank FROM cb),
kl AS (SELECT qid, tier, chunk_id, score, row_number() OVER (PARTITION BY qid, tier ORDER BY raw_rank) AS rank FROM (SELECT qid, kr.tier, chunk_id, score, raw_rank FROM kr {SHOWN}) WHERE raw_rank <= 100 QUALIFY rank <= 30)"""


def keyword(spark, folder, rows, questions, history: bool = False):
    hits = S.keyword_top(rows.select("chunk_id", "tier", "text"), questions.select("qid", F.col("rerank_text").alias("text")))
    return S.shown(hits, rows, questions, CLEARANCE, history)


@query(CHUNKS + KEYWORD + " SELECT qid, tier, chunk_id, rank FROM kl")
def passage_keywords(spark, folder):
    """The keyword list of each pack, by its own number of chunks and lengths."""
    return keyword(spark, folder, chunks(spark, folder), asked(spark, folder))


NAMED = f""", nd AS (SELECT qid, ck.tier, chunk_id, row_number() OVER (PARTITION BY qid, ck.tier ORDER BY chunk_index DESC, chunk_id) AS raw_rank FROM (SELECT qid, 'PP ' || (qid * 5) || '/' || (2015 + qid * 5 % 11) AS ref FROM qr WHERE qid % 4 = 0 AND qid < 200) JOIN ck ON contains(lower(circular_no), lower(ref))),
nl AS (SELECT qid, tier, chunk_id, row_number() OVER (PARTITION BY qid, tier ORDER BY raw_rank) AS rank FROM (SELECT qid, nd.tier, chunk_id, raw_rank FROM nd {SHOWN}) QUALIFY rank <= 30)"""


def named(spark, folder, rows, questions, history: bool = False):
    refs = questions.select("qid", F.explode("refs").alias("ref"))
    return S.shown(S.named_hits(rows, refs), rows, questions, CLEARANCE, history)


@query(CHUNKS + NAMED + " SELECT qid, tier, chunk_id, rank FROM nl")
def passage_named(spark, folder):
    """Chunks of the documents that a question names, the last ones first, whatever part of the number it names."""
    return named(spark, folder, chunks(spark, folder), asked(spark, folder))


def unit_sql(name: str, source: str, key: str, text: str) -> str:
    """Tables with the hashed unit vectors of a table's texts."""
    return f""", {name}_w AS (SELECT {key}, word, count(*) AS n FROM (SELECT {key}, unnest({C.tokens_sql(text)}) AS word FROM {source}) GROUP BY ALL),
{name}_f AS (SELECT {key}, '=' || word AS f, 2.0 * n AS weight FROM {name}_w UNION ALL SELECT {key}, '~' || substr('^' || word || '$', i, 3), 0.5 * n FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM {name}_w)),
{name}_b AS (SELECT {key}, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % 1024 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(f), 9, 1) AS INTEGER) % 2 = 0 THEN weight ELSE -weight END) AS v FROM {name}_f GROUP BY ALL HAVING v <> 0),
{name} AS (SELECT {key}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {name}_b UNION ALL SELECT {key}, 0, 1.0 FROM {source} WHERE {key} NOT IN (SELECT {key} FROM {name}_w))"""


VECTOR = (
    ", cv AS (SELECT chunk_id, COALESCE(breadcrumb, '') || chr(10) || text AS whole FROM ck)" + unit_sql("uc", "cv", "chunk_id", "whole") + unit_sql("uq", "qr", "qid", "embedded")
    + f""", dt2 AS (SELECT qid, chunk_id, sum(uc.v * uq.v) AS s FROM uc JOIN uq USING (bucket) GROUP BY 1, 2),
vr AS (SELECT qr.qid, ck.tier, ck.chunk_id, row_number() OVER (PARTITION BY qr.qid, ck.tier ORDER BY round(COALESCE(s, 0), 6) DESC, ck.chunk_id) AS raw_rank FROM qr CROSS JOIN ck LEFT JOIN dt2 ON dt2.qid = qr.qid AND dt2.chunk_id = ck.chunk_id),
vl AS (SELECT qid, tier, chunk_id, row_number() OVER (PARTITION BY qid, tier ORDER BY raw_rank) AS rank FROM (SELECT qid, vr.tier, chunk_id, raw_rank FROM vr {SHOWN}) WHERE raw_rank <= 100 QUALIFY rank <= 30)"""
)


def vector(spark, folder, rows, questions, history: bool = False):
    vectors = hash_embed(questions.select(F.col("qid").alias("id"), F.col("embedding_text").alias("text")), "double").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    return S.shown(S.vector_hits(S.chunk_entries(rows), vectors), rows, questions, CLEARANCE, history)


FUSED = CHUNKS + KEYWORD + NAMED + VECTOR + """, al AS (SELECT qid, tier, chunk_id, rank, 0 AS l, 'vector' AS list FROM vl UNION ALL SELECT qid, tier, chunk_id, rank, 1, 'keyword' FROM kl UNION ALL SELECT qid, tier, chunk_id, rank, 2, 'trigram' FROM nl),
fz AS (SELECT qid, tier, chunk_id, round(sum(1 / (60 + rank)), 9) AS rrf, string_agg(list || ' ' || rank, ', ' ORDER BY l) AS ranks, min((l, rank)) AS first FROM al GROUP BY 1, 2, 3),
fp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, tier, first) AS place FROM fz)"""


def fused(spark, folder, rows, questions, history: bool = False):
    return S.fused({"vector": vector(spark, folder, rows, questions, history), "keyword": keyword(spark, folder, rows, questions, history), "trigram": named(spark, folder, rows, questions, history)})


@query(FUSED + " SELECT qid, tier, chunk_id, rrf, ranks, place FROM fp")
def passage_fusion(spark, folder):
    """Three lists of each pack, fused; of equal scores the passage that a list named first."""
    return fused(spark, folder, chunks(spark, folder), asked(spark, folder))


RANKED = FUSED + f""", pr2 AS (SELECT fp.qid, chunk_id, id, place, list_distinct({C.tokens_sql('said')}) AS q, list_distinct({C.tokens_sql("circular_no || ' | ' || COALESCE(breadcrumb, '') || chr(10) || ck.text")}) AS t FROM fp JOIN ck USING (chunk_id) JOIN qr ON qr.qid = fp.qid WHERE place <= 20),
ps AS (SELECT qid, chunk_id, id, place, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, t)) / (len(q) + 2) END, 6) AS score FROM pr2),
pp AS (SELECT qid, chunk_id AS id, id AS doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, place) AS pos FROM ps QUALIFY score >= 0.06)"""
#: the places of each question's context: the user's side, or the one that the question names, first
CONTEXT = RANKED + """, jr AS (SELECT pp.*, CASE WHEN target = 'SARAWAK' THEN jurisdiction = 'FEDERAL' ELSE jurisdiction = 'SARAWAK' END AS other, score >= 0.12 AND doc_type NOT IN ('minutes','report') AS strong FROM pp JOIN ck ON ck.chunk_id = pp.id JOIN qr USING (qid)),
""" + C.JUR[C.JUR.index("fa AS (SELECT qid, max(score)") :]


def places(spark, folder, rows, questions, ranked):
    meta = rows.select("chunk_id", "jurisdiction", "doc_type")
    target = questions.select("qid", F.coalesce("jurisdiction_hint", F.lit(SIDE)).alias("target"))
    pool = R.few(ranked).join(meta, "chunk_id").join(R.bounded(target), "qid").withColumnRenamed("id", "doc").withColumnRenamed("chunk_id", "id")
    return R.apply_jurisdiction(pool, None).withColumnRenamed("id", "chunk_id")


@query(CONTEXT + " SELECT qid, id AS chunk_id, score, CASE WHEN other THEN 'comparison' ELSE 'primary' END AS role, conflict, row_number() OVER (PARTITION BY qid ORDER BY other, pos) AS place FROM js")
def passage_context(spark, folder):
    """The fused pool by shared words, without what is under the floor; the user's side first."""
    rows, questions = chunks(spark, folder), asked(spark, folder)
    pool = fused(spark, folder, rows, questions).where(F.col("place") <= R.POOL)
    return places(spark, folder, rows, questions, S.reranked(pool, rows, questions))


#: relations with evidence: every third one quotes the start of its document's second chunk, the others what no chunk says
EVIDENCE = """, ee AS (SELECT pr.*, CASE WHEN pr.id % 2 = 0 THEN replace((SELECT c.text FROM ck c WHERE c.chunk_id = pr.source_doc_id * 100000 + 1), chr(10), ' ')[5:60] ELSE '' END AS evidence FROM pr),
am AS (SELECT r.id AS rel_id, r.target_doc_id AS target, r.scope, min_by(c.chunk_id, (CASE WHEN length(evidence) > 0 AND contains(replace(c.text, chr(10), ' '), evidence[1:40]) THEN 0 ELSE 1 END, c.chunk_index)) AS new_id FROM ee r JOIN ck c ON c.id = r.source_doc_id JOIN pd t ON t.id = r.target_doc_id
 WHERE r.verified = 1 AND r.relation_type = 'AMENDS' AND t.classification_level <= c.classification_level_own AND (length(evidence) > 0 AND contains(replace(c.text, chr(10), ' '), evidence[1:40]) OR contains(lower(c.text), 'dipinda')) GROUP BY 1, 2, 3)"""


def relations(spark, folder, rows):
    second = rows.where("chunk_index = 1").select(F.col("id").alias("source_doc_id"), F.substring(F.translate("text", "\n", " "), 5, 56).alias("quote"))
    rels = P.policy_relations(spark, folder).join(second, "source_doc_id", "left")
    return rels.withColumn("evidence", F.when(F.col("id") % 2 == 0, F.col("quote")).otherwise("")).drop("quote")


@query(CHUNKS + EVIDENCE.replace("c.classification_level_own", "c.tier") + " SELECT rel_id, target, scope, new_id, ck.status FROM am JOIN ck ON ck.chunk_id = new_id")
def amending_passages(spark, folder):
    """Of each amendment the chunk that holds its evidence, or that speaks of amending."""
    rows = chunks(spark, folder)
    return S.amending(rows, relations(spark, folder, rows)).select("rel_id", "target", "scope", "new_id", "status")


@query(FUSED.replace(C.NOW, C.ALL) + " SELECT qid, chunk_id, id, place FROM (SELECT fp.qid, chunk_id, id, place, row_number() OVER (PARTITION BY fp.qid, id ORDER BY place) AS k FROM fp JOIN ck USING (chunk_id) WHERE place <= 10 AND status = 'CANCELLED') WHERE k = 1")
def excluded_passages(spark, folder):
    """The best chunk of each cancelled document that would have been among the first ten."""
    rows, questions = chunks(spark, folder), asked(spark, folder)
    return S.excluded(fused(spark, folder, rows, questions, True), rows)


def retrieve(spark, folder, history: bool = False, baseline: bool = False):
    """(qid, chunk_id, origin, place): what a question gets to read.

    All three lists of each pack by the rewritten question, fused, by shared words, over the floor; then the user's side
    first and amendments beside what they amend.  history shows former rules to all; the baseline is a plain search, with
    every status, and takes the first passages as they are.
    """
    rows, questions = chunks(spark, folder), asked(spark, folder)
    pool = fused(spark, folder, rows, questions, history or baseline).where(F.col("place") <= R.POOL)
    ranked = S.reranked(pool, rows, questions)
    if baseline:
        return ranked.where(F.col("pos") <= R.CONTEXT).select("qid", "chunk_id", F.lit("selected").alias("origin"), F.col("pos").alias("place"))
    context = cut(R.few(places(spark, folder, rows, questions, ranked)).join(rows.select("chunk_id", "id"), "chunk_id").join(R.bounded(questions.select("qid", "wants_history")), "qid"))
    selected = context.select("qid", "chunk_id", "id", F.col("place").alias("pos"), F.col("wants_history") | F.lit(history))
    return S.with_amending(selected.toDF("qid", "chunk_id", "id", "pos", "wants_history"), rows, relations(spark, folder, rows), CLEARANCE)


NUMBERS = "list_transform(string_split({}, '.'), lambda x: CAST(x AS INTEGER))"
READABLE = r"regexp_matches(clause_ref, '^\d+(\.\d+)*(-\d+(\.\d+)*)?$')"
#: whether a scope's clause lies in a passage's clause or range; true where either can't be read
TOUCHES = f"CASE WHEN scope = 'whole' OR NOT {READABLE} THEN TRUE ELSE {NUMBERS.format('lo')} <= {NUMBERS.format('t')} AND {NUMBERS.format('t')} <= {NUMBERS.format('hi')} OR {NUMBERS.format('t')}[1:len({NUMBERS.format('lo')})] = {NUMBERS.format('lo')} END"
RETRIEVED = (
    CONTEXT + EVIDENCE.replace("c.classification_level_own", "c.tier")
    + f""", sel AS (SELECT qid, js.id, doc, row_number() OVER (PARTITION BY qid ORDER BY other, pos) AS pos, ck.status, clause_ref, history FROM js JOIN ck ON ck.chunk_id = js.id JOIN qr USING (qid)),
ed AS (SELECT qid, id, pos, new_id, rel_id FROM (SELECT sel.qid, sel.id, sel.pos, am.new_id, am.rel_id, am.scope, clause_ref, replace(am.scope, 'clauses: ', '') AS t, string_split(clause_ref, '-')[1] AS lo, string_split(clause_ref, '-')[-1] AS hi, sel.history, nc.status AS new_status FROM sel JOIN am ON am.target = sel.doc JOIN (SELECT chunk_id, status FROM ck) nc ON nc.chunk_id = am.new_id WHERE sel.status = 'AMENDED') WHERE (new_status IN {C.NOW} OR history AND new_status IN {C.ALL}) AND {TOUCHES}),
""" + C.INJECT[C.INJECT.index("pl AS (SELECT * FROM") :].replace("SELECT * FROM (SELECT qid, id, origin", "SELECT qid, id AS chunk_id, origin, place FROM (SELECT qid, id, origin")
)


@query(RETRIEVED)
def passage_retrieval(spark, folder):
    """What each question gets to read, from the rewritten question to the amended context."""
    return retrieve(spark, folder)


@query(RANKED.replace(C.NOW, C.ALL) + " SELECT qid, id AS chunk_id, 'selected' AS origin, pos AS place FROM pp WHERE pos <= 5")
def passage_retrieval_baseline(spark, folder):
    """The same search without statuses, sides or amendments."""
    return retrieve(spark, folder, baseline=True)
