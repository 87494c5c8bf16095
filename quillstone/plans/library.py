"""More named queries: metadata, questions, relations from sentences, packs and evaluation, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import analytics as A
from quillstone.operators import evaluation as E
from quillstone.operators import metadata as M
from quillstone.operators import questions as Q
from quillstone.operators import relations as L
from quillstone.operators import retrieval as R
from quillstone.operators import snapshots as S
from quillstone.operators import validity as V
from quillstone.plans import catalogue as C
from quillstone.plans.catalogue import query
from quillstone.sources import policy as P
from quillstone.sources.policy import AS_OF, AS_OF_OLD, POL

# -------------------------------------------------------------------------------------------------------- metadata
#: what the generated headers hold, by formula; the SQL never reads them
HEADERS = f"""hd AS (SELECT id, id % 7 AS k, 1 + id % 900 AS num, 2015 + id % 11 AS y, issue_date, 'doc_' || id || '.pdf' AS file FROM pd),
hm AS (SELECT *, CASE k WHEN 0 THEN 'PP ' || num || '/' || y WHEN 1 THEN 'SPP ' || num || '/' || y WHEN 2 THEN 'PAS ' || num || '/' || y WHEN 3 THEN 'MMJKD ' || num || '/' || y WHEN 5 THEN 'SOP-KEW ' || num || '/' || y WHEN 4 THEN 'GP ' || num || '/' || y ELSE 'doc_' || id END AS no FROM hd)
SELECT id, no AS circular_no,
 CASE WHEN id % 11 = 0 THEN 'Tajuk manual' WHEN k = 3 THEN 'Minit Mesyuarat Jawatankuasa Kerja dan Dasar Bil. ' || num || '/' || y WHEN k = 6 THEN CASE WHEN id % 4 = 1 THEN 'Model title' ELSE no END WHEN k = 5 THEN 'Tuntutan Perjalanan' ELSE 'Pengurusan Cuti Rehat dan Gantian (Hrmis)' END AS title,
 CASE k WHEN 3 THEN 'Mesyuarat Jawatankuasa Kerja dan Dasar' WHEN 6 THEN NULL WHEN 5 THEN 'Prosedur Operasi Standard' ELSE 'Kerajaan Malaysia' END AS issuer,
 CASE k WHEN 3 THEN 'minutes' WHEN 4 THEN 'guideline' WHEN 5 THEN 'sop' ELSE 'circular' END AS doc_type,
 CASE k WHEN 0 THEN 'FEDERAL' WHEN 1 THEN 'FEDERAL' WHEN 2 THEN 'SARAWAK' ELSE CASE WHEN k = 6 AND id % 4 = 1 THEN 'FEDERAL' ELSE 'UNKNOWN' END END AS jurisdiction,
 CASE WHEN k <> 6 THEN issue_date END AS issue_date, CASE WHEN k IN (0, 1, 2) THEN issue_date + 30 WHEN k IN (4, 5) THEN issue_date END AS effective_date,
 CAST(k = 1 AS INTEGER) AS one_off, CASE WHEN id % 11 = 0 THEN 2 WHEN k <> 6 AND id % 5 = 0 THEN 1 ELSE 0 END AS classification_level,
 CASE WHEN k IN (0, 1, 2) THEN 'Pekeliling ini terpakai kepada semua pegawai.' END AS applicability FROM hm
"""


def header_pages(spark, folder):
    """(id, file, head, full): generated header texts of seven kinds."""
    from quillstone.functions.text import malay_date

    docs = P.policy_documents(spark, folder)
    n = F.col("id")
    k, number, year = n % 7, (1 + n % 900).cast("string"), (2015 + n % 11).cast("string")
    long = F.when(k == 0, "PEKELILING PERKHIDMATAN").when(k == 1, "SURAT PEKELILING PERKHIDMATAN").when(k == 2, "PEKELILING AM SARAWAK").otherwise("GARIS PANDUAN")
    numbered = F.concat_ws("\n", F.lit("KERAJAAN MALAYSIA"), F.concat(long, F.lit(" BILANGAN "), number, F.lit(" TAHUN "), year), F.lit("PENGURUSAN CUTI REHAT DAN GANTIAN (HRMIS)"))
    meeting = F.concat(F.lit("MINIT MESYUARAT JAWATANKUASA KERJA DAN DASAR BIL. "), number, F.lit("/"), year)
    sop = F.concat(F.lit("PROSEDUR OPERASI STANDARD\nSOP-KEW "), number, F.lit("/"), year, F.lit("\nTUNTUTAN PERJALANAN"))
    top = F.when(k == 3, meeting).when(k == 5, sop).when(k == 6, F.lit("Nota ringkas\nisi")).otherwise(numbered)
    mark = F.when(n % 5 == 0, F.lit("TERHAD"))
    dated = F.concat(F.lit("Tarikh: "), malay_date(F.col("issue_date")))
    rules = F.concat(F.lit("1. PEMAKAIAN\n1.1 Pekeliling ini terpakai\nkepada semua pegawai.\n2. TARIKH KUAT KUASA\n2.1 Pekeliling ini berkuat kuasa mulai "), malay_date(F.date_add("issue_date", 30)), F.lit("."))
    body = F.when(k < 3, F.concat(rules, F.when(k == 1, "\nBayaran sekali sahaja.").otherwise("")))
    head = F.when(k == 6, top).otherwise(F.concat_ws("\n", top, mark, dated))
    return docs.select("id", F.concat(F.lit("doc_"), n.cast("string"), F.lit(".pdf")).alias("file"), head.alias("head"), F.concat_ws("\n", head, body).alias("full"))


@query(POL + ", " + HEADERS)
def extract_metadata(spark, folder):
    """Header patterns, a model's answers for gaps (every fourth document) and overrides (every eleventh file)."""
    found = M.header_metadata(header_pages(spark, folder))
    docs = found.select("id", "file")
    model = docs.where("id % 4 = 1").select("id", F.lit("Model title").alias("title"), F.lit("FEDERAL").alias("jurisdiction")).where("id % 7 = 6")
    overrides = docs.where("id % 11 = 0").select("file", F.lit("Tajuk manual").alias("title"), F.lit(2).alias("classification_level"))
    out = M.complete_metadata(found, overrides, model)
    return out.select("id", "circular_no", "title", "issuer", "doc_type", "jurisdiction", "issue_date", "effective_date", "one_off", "classification_level", "applicability")


# ------------------------------------------------------------------------------------------------------- questions
ASKED = "qx AS (SELECT item_id AS qid, text || CASE WHEN item_id % 4 = 0 THEN ' PP ' || (item_id * 5) || '/' || (2015 + item_id * 5 % 11) ELSE '' END || CASE item_id % 3 WHEN 1 THEN ' di Sarawak' WHEN 2 THEN ' peraturan lama persekutuan' ELSE '' END AS text FROM benchmark)"
SPOKEN = f"regexp_extract_all({C.FOLD.format('text')}, '[\\p{{L}}\\p{{N}}_/]+')"
ENTRIES = {"cuti": ("leave",), "law": ("the rule", "act"), "peraturan": ("rule", "regulation")}


@query(f"""WITH {ASKED}, qw AS (SELECT *, list_filter({SPOKEN}, lambda w: length(w) > 1 AND NOT list_contains({C.STOP}, w)) AS w FROM qx)
SELECT qid, CASE WHEN qid % 4 = 0 THEN 'PP ' || (qid * 5) || '/' || (2015 + qid * 5 % 11) ELSE '' END AS refs,
 CASE qid % 3 WHEN 1 THEN 'SARAWAK' WHEN 2 THEN 'FEDERAL' END AS jurisdiction_hint, array_to_string(w[1:3], ' ') AS topic, array_to_string(w[1:5], ' ') AS query, regexp_matches(text, '{Q.HISTORY}') AS wants_history,
 concat_ws(', ', CASE WHEN qid % 3 = 2 THEN 'rule, regulation' END, CASE WHEN qid % 4 = 0 THEN 'Pekeliling Perkhidmatan Bilangan ' || (qid * 5) || ' Tahun ' || (2015 + qid * 5 % 11) END) AS expansions,
 trim(text || chr(10) || array_to_string(w[1:5], ' ')) AS embedding_text FROM qw""")
def rewrite_questions(spark, folder):
    text = F.concat("text", F.when(F.col("qid") % 3 == 1, " di Sarawak").when(F.col("qid") % 3 == 2, " peraturan lama persekutuan").otherwise(""))
    glossary = spark.createDataFrame([(k, i, t) for k, ts in ENTRIES.items() for i, t in enumerate(ts, 1)], "entry string, place int, term string")
    rows = Q.rewritten(P.questions(spark, folder).withColumn("text", text), glossary)
    return rows.select("qid", F.array_join("refs", ", ").alias("refs"), "jurisdiction_hint", "topic", "query", "wants_history", F.array_join("expansions", ", ").alias("expansions"), "embedding_text")


# ------------------------------------------------------------------------------------------------------- relations
def relation_pages(spark, folder):
    """Pages whose second clause names another document, and whose third cancels it."""
    clause = P.policy_clauses(spark, folder)
    k = F.col("id") - 1 - F.col("id") % 7
    last = F.concat(F.lit("Dengan ini Pekeliling Perkhidmatan Bilangan "), (1 + k % 900).cast("string"), F.lit(" Tahun "), (2015 + k % 11).cast("string"), F.lit(" dibatalkan: Lihat lampiran."))
    text = F.concat(F.lit("1. TUJUAN\n1.1 Dasar ini terpakai; Ia kekal.\n"), F.col("text"), F.lit(" Perkara lain kekal.\n2. PEMBATALAN\n2.1 "), last)
    return clause.select("id", "page", text.alias("text"))


CLAUSES = POL + ", ks AS (SELECT pc.*, pc.id - 1 - pc.id % 7 AS k FROM pc)"


@query(CLAUSES + """ SELECT id, page, unnest(['Dasar ini terpakai;', 'Ia kekal.'] || CASE WHEN k % 5 = 2 THEN ['SE Bil.', replace(text, 'SE Bil. ', '')] ELSE [trim(text)] END || ['Perkara lain kekal.', 'Dengan ini Pekeliling Perkhidmatan Bilangan ' || (1 + k % 900) || ' Tahun ' || (2015 + k % 11) || ' dibatalkan:', 'Lihat lampiran.']) AS sentence FROM ks""")
def page_sentences(spark, folder):
    return L.sentences(relation_pages(spark, folder)).select("id", "page", "sentence")


@query(CLAUSES + f""", sn AS (SELECT id, page, text AS sentence, CASE k % 5 WHEN 0 THEN 'PP' WHEN 1 THEN 'SPP' WHEN 3 THEN 'PEKELILING PERBENDAHARAAN' WHEN 4 THEN 'PAS' END AS series, CAST(k AS VARCHAR) AS n, 2015 + k % 11 AS y FROM ks WHERE k % 5 <> 2 AND k < 1000 AND id % 4 <> 3
 UNION ALL SELECT id, page, 'Dengan ini Pekeliling Perkhidmatan Bilangan ' || (1 + k % 900) || ' Tahun ' || (2015 + k % 11) || ' dibatalkan:', 'PP', CAST(1 + k % 900 AS VARCHAR), 2015 + k % 11 FROM ks)
SELECT sn.id, page, CASE sn.series WHEN 'PEKELILING PERBENDAHARAAN' THEN 'PB' ELSE sn.series END || ' ' || n || '/' || y AS ref, sentence, {C.EFFECT_SQL.replace('text', 'sentence')} AS relation FROM sn JOIN pd ON pd.id = sn.id WHERE doc_type NOT IN ('minutes', 'report') AND CASE sn.series WHEN 'PEKELILING PERBENDAHARAAN' THEN 'PB' ELSE sn.series END || ' ' || n || '/' || y <> circular_no""")
def sentence_relations(spark, folder):
    return L.candidates(relation_pages(spark, folder), P.policy_documents(spark, folder))


@query(C.POL.replace("WITH pd", "WITH RECURSIVE pd", 1) + ", " + C.LINKS + """, ed AS (SELECT source_doc_id AS a, target_doc_id AS b FROM lk UNION SELECT target_doc_id, source_doc_id FROM lk), re AS (SELECT DISTINCT a AS id, a AS root FROM ed UNION SELECT ed.b, re.root FROM re JOIN ed ON ed.a = re.id)
SELECT component, id, row_number() OVER (PARTITION BY component ORDER BY issue_date, id) AS place FROM (SELECT id, min(root) AS component FROM re GROUP BY 1) JOIN pd USING (id)""")
def lineage_nodes(spark, folder):
    nodes = C.lineage_component(spark, folder).join(P.policy_documents(spark, folder).select("id", "issue_date"), "id")
    return nodes.select("component", "id", F.row_number().over(Window.partitionBy("component").orderBy("issue_date", "id")).alias("place"))


# ----------------------------------------------------------------------------------------------------------- packs
PACKS = C.POL + P.status_sql("o1", AS_OF_OLD) + P.status_sql("n1", AS_OF) + """,
pk AS (SELECT t AS tier, 1 AS version, o1.* FROM o1, range(0, 3) r(t) WHERE classification_level <= t UNION ALL SELECT t, 2, n1.* FROM n1, range(0, 3) r(t) WHERE classification_level <= t)"""


def packs(spark, folder):
    """Two versions of three tiers: each holds the documents up to its level, with their statuses at a date."""
    docs, rels = P.policy_documents(spark, folder), P.policy_relations(spark, folder)
    both = [V.with_status(docs, rels, day).withColumn("version", F.lit(k)) for k, day in ((1, AS_OF_OLD), (2, AS_OF))]
    return both[0].unionByName(both[1]).withColumn("tier", F.explode(F.sequence(F.col("classification_level"), F.lit(2))))


@query(PACKS + " SELECT tier, version, count(*) AS n, sum(CAST('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), circular_no, status)), 1, 8) AS BIGINT))::BIGINT AS checksum FROM pk GROUP BY 1, 2")
def pack_manifest(spark, folder):
    return S.pack_hashes(packs(spark, folder), ["tier", "version"])


SUMMED = "sum(CAST('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), circular_no, status)), 1, 8) AS BIGINT))::BIGINT AS checksum"
#: what is listed, what the files hold, and the first check that fails
VERIFIED = PACKS + f""", en AS (SELECT tier, version, {SUMMED} FROM pk GROUP BY 1, 2 UNION ALL SELECT 3, 1, 0),
fi AS (SELECT tier, version, CASE WHEN tier = 1 AND version = 1 THEN 0 ELSE tier END AS own_tier, CASE WHEN tier = 2 AND version = 1 THEN 'old' ELSE 'bge' END AS model, checksum AS own FROM (SELECT tier, version, {SUMMED} FROM pk WHERE NOT (tier = 0 AND version = 2 AND id = 1) GROUP BY 1, 2)),
vf AS (SELECT tier, version, CASE WHEN own IS NULL THEN 'unreadable' WHEN own <> checksum THEN 'checksum' WHEN own_tier <> tier THEN 'manifest' WHEN model <> 'bge' THEN 'embedding_model' ELSE 'ok' END AS code FROM en LEFT JOIN fi USING (tier, version))"""


@query(VERIFIED + " SELECT tier, version, code FROM vf")
def pack_verify(spark, folder):
    """Listed packs against what their files hold: one lacks a document, one is of another tier, one of another model, one is missing."""
    hashes = S.pack_hashes(packs(spark, folder), ["tier", "version"])
    missing = spark.createDataFrame([(3, 1, 0)], "tier int, version int, checksum long")
    entries = hashes.select("tier", "version", "checksum").unionByName(missing)
    spoilt = packs(spark, folder).where("not (tier = 0 and version = 2 and id = 1)")
    own = S.pack_hashes(spoilt, ["tier", "version"]).withColumn("own_tier", F.when(F.expr("tier = 1 and version = 1"), 0).otherwise(F.col("tier")))
    files = own.select("tier", "version", "own_tier", F.col("version").alias("own_version"), F.when(F.expr("tier = 2 and version = 1"), "old").otherwise("bge").alias("embedding_model"), "checksum")
    return S.verified(entries, files, "bge")


@query(VERIFIED + ", ig AS (SELECT * FROM (VALUES (1, 1), (2, 2)) t(tier, previous)) SELECT tier, max(version) AS version, any_value(previous) AS previous FROM vf LEFT JOIN ig USING (tier) WHERE code = 'ok' GROUP BY tier HAVING any_value(previous) IS NULL OR max(version) > any_value(previous)")
def pack_install(spark, folder):
    """Newest packs that pass: tier 0 has nothing installed, tier 1 version 1, tier 2 is up to date."""
    installed = spark.createDataFrame([(1, 1), (2, 2)], "tier int, version int")
    return S.installable(pack_verify(spark, folder), installed)


@query(PACKS + " SELECT id, max(tier) AS tier, max_by(status, tier) AS status FROM pk WHERE (version = 2) = (tier = 2) GROUP BY 1")
def packs_united(spark, folder):
    """Tiers 0 and 1 in their first version and tier 2 in its second: the last pack that has a document counts."""
    return S.united(packs(spark, folder).where("(version = 2) = (tier = 2)").select("id", "tier", "status"))


# ------------------------------------------------------------------------------------------------------ evaluation
MODES = ("BASELINE", "COMPLETE")
SCORED = C.JUR + """, gd AS (SELECT qid, min(r.id) AS eid FROM raw r JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = r.id AND contains(d.text, b.text) GROUP BY 1),
gs AS (SELECT item_id AS qid, ['direct', 'trap_cancelled', 'access', 'unanswerable'][item_id % 4 + 1] AS type, CASE WHEN item_id % 4 <> 3 THEN st.id END AS eid, CASE WHEN item_id % 4 = 1 AND status <> 'IN_FORCE' THEN st.id END AS bad FROM benchmark LEFT JOIN gd ON gd.qid = item_id LEFT JOIN st ON st.id = gd.eid),
so AS (SELECT 'BASELINE' AS mode, qid, id, place FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY raw_rank) AS place FROM raw JOIN st USING (id) WHERE classification_level <= 1) WHERE place <= 5 UNION ALL SELECT 'COMPLETE', qid, id, row_number() OVER (PARTITION BY qid ORDER BY other, pos) FROM js),
sc AS (SELECT mode, gs.qid, type, count(place) > 0 AS answered, min(place) FILTER (id = eid AND place <= 5) AS rank, CASE WHEN eid IS NOT NULL THEN COALESCE(bool_or(id = eid AND place <= 5), FALSE) END AS recalled,
 CASE WHEN eid IS NOT NULL THEN COALESCE(bool_or(id = eid AND place <= 5 AND id % 2 = 0), FALSE) END AS clause_hit, CASE WHEN eid IS NOT NULL THEN COALESCE(bool_or(id = eid AND place <= 2), FALSE) END AS cited_expected,
 COALESCE(bool_or(id = bad AND place <= 2), FALSE) AS cited_cancelled, COALESCE(bool_or(level > CASE WHEN gs.qid % 5 = 0 THEN 0 ELSE 1 END), FALSE) AS leak FROM gs CROSS JOIN (VALUES ('BASELINE'), ('COMPLETE')) m(mode) LEFT JOIN (SELECT so.*, classification_level AS level FROM so JOIN (SELECT id, classification_level FROM st) USING (id)) so USING (mode, qid) GROUP BY mode, gs.qid, type, eid)
"""


def golden(spark, folder):
    """The benchmark's texts as questions, expecting the first hit that holds the text; every clause is n.1 of n = id % 9 + 1.

    Every fifth reader's clearance is under the level of the lists, which leaks by design.
    """
    hits = C.bm25_hits(spark, folder)
    asked = C.table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    texts = C.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    held = hits.join(asked, "qid").join(texts, "id").where(F.contains("text", "question")).groupBy("qid").agg(F.min("id").alias("id"))
    named = held.join(C.statuses(spark, folder).select("id", "circular_no", "status"), "id")
    kind = F.element_at(F.array(*map(F.lit, ("direct", "trap_cancelled", "access", "unanswerable"))), (F.col("qid") % 4 + 1).cast("int"))
    rows = asked.select("qid", kind.alias("type")).join(named, "qid", "left")
    # odd documents expect a clause that their passages don't have
    clause = F.concat(F.when(F.col("id") % 2 == 0, F.col("id") % 9 + 1).otherwise(77).cast("string"), F.lit(".1"))
    has = F.col("type") != "unanswerable"
    return rows.select("qid", "type", F.when(has, F.col("circular_no")).alias("expected_doc"), F.when(has, clause).alias("expected_clause"), F.when((F.col("type") == E.TRAP) & (F.col("status") != "IN_FORCE"), F.col("circular_no")).alias("must_not_cite"), F.when(F.col("qid") % 5 == 0, 0).otherwise(1).alias("clearance"))


def shown_sources(spark, folder):
    """(mode, qid, place, ...): the sources of each question in both modes."""
    st = C.statuses(spark, folder).select("id", "circular_no", "classification_level")
    hits = C.bm25_hits(spark, folder)
    plain = R.top(hits.join(V.secure(st, 1), "id"), "qid", R.CONTEXT, F.asc("raw_rank"), name="place").select(F.lit(MODES[0]).alias("mode"), "qid", "id", "place")
    full = C.jurisdiction_places(spark, folder).select(F.lit(MODES[1]).alias("mode"), "qid", "id", "place")
    return plain.unionByName(full).join(st, "id").select("mode", "qid", "place", "circular_no", F.concat((F.col("id") % 9 + 1).cast("string"), F.lit(".1-"), (F.col("id") % 9 + 1).cast("string"), F.lit(".4")).alias("clause_ref"), F.col("classification_level").alias("tier"), (F.col("place") <= 2).alias("cited"))


def scored_questions(spark, folder):
    return E.scores(golden(spark, folder), shown_sources(spark, folder), MODES)


@query(SCORED + " SELECT mode, qid, type, answered, rank, recalled, clause_hit, cited_expected, cited_cancelled, leak FROM sc")
def eval_scores(spark, folder):
    return scored_questions(spark, folder)


SUMMARY = """, sm AS (SELECT mode, round(avg(CAST(recalled AS INTEGER)), 6) AS recall_doc, round(avg(CAST(clause_hit AS INTEGER)), 6) AS recall_clause, round(avg(CASE WHEN recalled IS NOT NULL THEN COALESCE(1 / rank, 0) END), 6) AS mrr,
 round(avg(CASE WHEN answered AND recalled IS NOT NULL THEN CAST(cited_expected AS INTEGER) END), 6) AS citation_accuracy, round(avg(CASE WHEN type = 'trap_cancelled' THEN CAST(cited_cancelled AS INTEGER) END), 6) AS cancelled_citations,
 round(avg(CASE WHEN type IN ('unanswerable', 'access') OR type = 'trap_cancelled' AND recalled IS NULL THEN CAST(NOT answered AS INTEGER) END), 6) AS refusal_accuracy, round(avg(CASE WHEN recalled IS NOT NULL THEN CAST(NOT answered AS INTEGER) END), 6) AS false_refusals, CAST(count(*) FILTER (leak) AS DOUBLE) AS leaks FROM sc GROUP BY 1)
"""


@query(SCORED + SUMMARY + " SELECT * FROM sm")
def eval_summary(spark, folder):
    return E.summary(scored_questions(spark, folder))


@query(SCORED + SUMMARY + " SELECT metric, max(value) FILTER (mode = 'BASELINE') AS BASELINE, max(value) FILTER (mode = 'COMPLETE') AS COMPLETE FROM (UNPIVOT (SELECT * FROM sm) ON " + ", ".join(E.METRICS) + " INTO NAME metric VALUE value) GROUP BY 1")
def eval_by_mode(spark, folder):
    return E.by_mode(scored_questions(spark, folder), MODES)


@query(POL + "SELECT count(*) AS total, count(*) FILTER (NOT answerable) AS unanswered, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (NOT answerable) / count(*), 3) ELSE 0 END AS rate FROM lg")
def usage_overall(spark, folder):
    rows = A.usage_report(P.search_log(spark, folder)).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("answerable")).alias("unanswered"))
    return rows.withColumn("rate", A.rate(F.col("unanswered"), F.col("total")))


@query(SCORED + """, aa AS (SELECT mode, so.qid, a AS action, (a - 1) % 5 + 1 AS place FROM (SELECT DISTINCT mode, qid FROM so) so, (VALUES (1), (2), (3)) v(a) UNION ALL SELECT mode, qid, 3, 1 FROM (SELECT DISTINCT mode, qid FROM so)),
ok AS (SELECT mode, qid, action, bool_or(COALESCE(so.id = eid, FALSE)) AS ok FROM aa LEFT JOIN so USING (mode, qid, place) LEFT JOIN gs USING (qid) GROUP BY 1, 2, 3) SELECT mode, count(*) AS n_actions, round(avg(CAST(ok AS INTEGER)), 6) AS share FROM ok GROUP BY 1""")
def eval_actions(spark, folder):
    """Three actions of each answered question: they cite the first source, the second, and the third with the first."""
    gold = golden(spark, folder).select("qid", "expected_doc")
    sources = V.cut(shown_sources(spark, folder))
    answered = sources.select("mode", "qid").distinct()
    cited = F.array(*(F.struct(F.lit(k).alias("place"), F.array(*map(F.lit, c)).alias("citations")) for k, c in ((1, [1]), (2, [2]), (3, [3, 1]))))
    return E.action_accuracy(answered.select("mode", "qid", F.inline(cited)), sources, gold)
