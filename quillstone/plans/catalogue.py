"""Named queries over the shared tables, each with the same query in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import analytics as A
from quillstone.operators import answers as ANS
from quillstone.operators import retrieval as R
from quillstone.operators import snapshots as S
from quillstone.operators import trigrams as TG
from quillstone.operators import validity as V
from quillstone.sources import policy as P
from quillstone.sources.policy import AS_OF, AS_OF_OLD, POL, status_sql
from quillstone.sources.tables import spread, table
from quillstone.streaming.logs import feedback_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ST = POL + status_sql("st", AS_OF)
#: statuses that are shown, and with history
NOW, ALL = ("(" + ",".join(f"'{x}'" for x in V.allowed_statuses(h)) + ")" for h in (False, True))


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def statuses(spark: SparkSession, folder: str, as_of: str = AS_OF) -> DataFrame:
    return V.with_status(P.policy_documents(spark, folder), P.policy_relations(spark, folder), as_of)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of all documents, for queries that take texts apart."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


STOP = "[" + ",".join(f"'{w}'" for w in X.STOPWORDS) + "]"
FOLD = "lower(strip_accents({}))"


def terms_sql(column: str) -> str:
    found = f"regexp_extract_all({FOLD.format(column)}, '[\\p{{L}}\\p{{N}}_/]+')"
    return f"list_filter(list_transform({found}, lambda w: trim(w, '/')), lambda w: length(w) >= 2 AND NOT list_contains({STOP}, w) AND NOT contains(w, '/'))"


def query_terms_sql(column: str) -> str:
    t = terms_sql(column)
    return f"list_filter({t}, lambda w, i: list_position({t}, w) = i)[1:{X.MAX_TERMS}]"


def stem_sql(w: str) -> str:
    return "CASE " + " ".join(f"WHEN length({w}) > {len(s) + 3} AND suffix({w}, '{s}') THEN {w}[:-{len(s) + 1}]" for s in X.SUFFIXES) + f" ELSE {w} END"


def tokens_sql(column: str) -> str:
    plain = f"regexp_extract_all({FOLD.format(column)}, '[a-z0-9]+')"
    return f"list_transform(list_filter({plain}, lambda w: NOT list_contains({STOP}, w)), lambda w: {stem_sql('w')})"


BM = f"""
dt AS (SELECT doc_id AS id, {terms_sql('text')} AS terms FROM documents),
ix AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM dt) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(COALESCE(len(terms), 0)) AS avgdl FROM dt),
qt AS (SELECT item_id AS qid, unnest({query_terms_sql('text')}) AS term FROM benchmark),
dfs AS (SELECT term, count(*) AS df FROM ix WHERE term IN (SELECT term FROM qt) GROUP BY 1),
bm AS (SELECT qid, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM ix JOIN dfs USING (term) JOIN qt USING (term), tot GROUP BY 1, 2)
"""


def bm25_hits(spark: SparkSession, folder: str, name: str = "raw_rank") -> DataFrame:
    """(qid, id, score) of the best hundred documents of each question, with their rank."""
    docs = texts(spark, folder).select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), "text")
    # few rows, which several joins read
    return V.cut(R.bm25_top(docs, asked, R.LIST_CUT).withColumnRenamed("rank", name))


# ------------------------------------------------------------------------------------------------- scans and lists
@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def scan_project_documents(spark, folder):
    return table(spark, folder, "documents").where("lang = 'en' and n_chars > 500").select("doc_id", "lang", "source", "n_chars")


@query(r"""SELECT page_id, len(lines) AS n_lines, len(list_filter(lines, lambda x: upper(x) = x AND regexp_matches(x, '\p{L}') AND length(x) <= 120)) AS n_headings, md5(array_to_string(lines, chr(10))) AS text_md5
FROM (SELECT page_id, list_filter(list_transform(string_split(replace(replace(html, chr(173), ''), chr(13), ''), chr(10)), lambda x: regexp_replace(x, '[ \t]+$', '')), lambda x: trim(x) <> '') AS lines FROM pages)""")
def clean_text_lines(spark, folder):
    lines = F.filter(F.split(X.clean(F.col("html")), "\n"), lambda x: x != "")
    return table(spark, folder, "pages").select("page_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, X.is_heading)).cast("long").alias("n_headings"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("text_md5"))


@query(POL + "SELECT id, circular_no, doc_type, jurisdiction, issue_date FROM pd WHERE doc_type IN ('circular','policy') AND jurisdiction IN ('FEDERAL','SARAWAK') AND cluster IN ('src4','src5','src6','src7')")
def list_filtered_documents(spark, folder):
    docs = P.policy_documents(spark, folder)
    return docs.where(F.col("doc_type").isin("circular", "policy") & F.col("jurisdiction").isin("FEDERAL", "SARAWAK") & F.col("cluster").isin("src4", "src5", "src6", "src7")).select("id", "circular_no", "doc_type", "jurisdiction", "issue_date")


@query(ST + "SELECT id, circular_no, status, classification_level FROM st WHERE classification_level <= 1 AND status IN ('IN_FORCE','AMENDED','UNKNOWN','RECORD')")
def secure_documents(spark, folder):
    return V.secure(statuses(spark, folder), 1).where(F.col("status").isin(*V.allowed_statuses(False))).select("id", "circular_no", "status", "classification_level")


@query(ST + "SELECT id, circular_no, status, status_reason FROM st")
def status_cascade(spark, folder):
    return statuses(spark, folder).select("id", "circular_no", "status", "status_reason")


@query(POL + "SELECT r.id, s.circular_no AS source_no, t.circular_no AS target_no, r.relation_type, r.verified, CASE r.relation_type WHEN 'CANCELS' THEN 'CANCELLED' WHEN 'SUPERSEDES' THEN 'CANCELLED' WHEN 'AMENDS' THEN 'AMENDED' END AS effect, row_number() OVER (PARTITION BY r.source_doc_id % 64 ORDER BY r.verified, r.id DESC) AS place FROM pr r JOIN pd s ON s.id = r.source_doc_id LEFT JOIN pd t ON t.id = r.target_doc_id")
def relations_listing(spark, folder):
    docs, rels = P.policy_documents(spark, folder), P.policy_relations(spark, folder)
    source = docs.select(F.col("id").alias("source_doc_id"), F.col("circular_no").alias("source_no"))
    target = docs.select(F.col("id").alias("target_doc_id"), F.col("circular_no").alias("target_no"))
    effect = F.when(F.col("relation_type").isin("CANCELS", "SUPERSEDES"), "CANCELLED").when(F.col("relation_type") == "AMENDS", "AMENDED")
    page = F.row_number().over(Window.partitionBy(F.col("source_doc_id") % 64).orderBy("verified", F.desc("id")))
    return rels.join(source, "source_doc_id").join(target, "target_doc_id", "left").select("id", "source_no", "target_no", "relation_type", "verified", effect.alias("effect"), page.alias("place"))


@query(POL + "SELECT r.id, s.circular_no AS new_no, t.circular_no AS old_no, r.relation_type FROM pr r JOIN pd s ON s.id = r.source_doc_id JOIN pd t ON t.id = r.target_doc_id WHERE r.verified = 1 AND r.relation_type IN ('SUPERSEDES','AMENDS')")
def supersede_pairs(spark, folder):
    docs = P.policy_documents(spark, folder)
    rels = P.policy_relations(spark, folder).where("verified = 1 and relation_type in ('SUPERSEDES', 'AMENDS')")
    return rels.join(docs.select(F.col("id").alias("source_doc_id"), F.col("circular_no").alias("new_no")), "source_doc_id").join(docs.select(F.col("id").alias("target_doc_id"), F.col("circular_no").alias("old_no")), "target_doc_id").select("id", "new_no", "old_no", "relation_type")


@query(POL + "SELECT id, source_doc_id, target_doc_id FROM pr p WHERE target_doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pr r WHERE r.verified = 1 AND r.relation_type IN ('SUPERSEDES','AMENDS') AND r.source_doc_id = p.source_doc_id AND r.target_doc_id = p.target_doc_id)")
def orphan_summaries(spark, folder):
    rels = P.policy_relations(spark, folder)
    live = rels.where("verified = 1 and relation_type in ('SUPERSEDES', 'AMENDS')").select("source_doc_id", "target_doc_id")
    return rels.where("target_doc_id is not null").select("id", "source_doc_id", "target_doc_id").join(live, ["source_doc_id", "target_doc_id"], "left_anti")


@query(POL + "SELECT pd.id, COALESCE(n, 0) AS n_turns, COALESCE(u, 0) AS n_user_turns, longest FROM pd LEFT JOIN (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS u, max(length(text)) AS longest FROM conversations GROUP BY 1) c ON c.conv_id = pd.id")
def document_counters(spark, folder):
    counts = table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("u"), F.max(F.char_length("text")).cast("long").alias("longest"))
    return P.policy_documents(spark, folder).join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_turns"), F.coalesce("u", F.lit(0)).alias("n_user_turns"), "longest")


@query(ST + "SELECT classification_level, count(*) AS n, count(*) FILTER (status IN ('CANCELLED','ONE_OFF')) AS n_historical, count(*) FILTER (status = 'AMENDED') AS n_amended FROM st GROUP BY 1")
def tier_summary(spark, folder):
    return statuses(spark, folder).groupBy("classification_level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(*V.HISTORICAL_STATUSES)).alias("n_historical"), F.count_if(F.col("status") == "AMENDED").alias("n_amended"))


MANIFEST = "mf AS (SELECT id, classification_level AS tier, 1 + id % 23 AS version FROM pd), ins AS (SELECT tier, max(version) - 2 AS installed FROM mf WHERE tier < 2 GROUP BY 1)"


def manifest_rows(spark, folder):
    return P.policy_documents(spark, folder).select("id", F.col("classification_level").alias("tier"), (1 + F.col("id") % 23).alias("version"))


@query(POL + ", " + MANIFEST + " SELECT * FROM (SELECT m.tier, m.id, m.version, installed, row_number() OVER (PARTITION BY m.tier ORDER BY m.version DESC, m.id) AS k FROM mf m LEFT JOIN ins USING (tier)) WHERE k = 1 AND (installed IS NULL OR version > installed)")
def latest_versions(spark, folder):
    rows = manifest_rows(spark, folder)
    installed = rows.where("tier < 2").groupBy("tier").agg((F.max("version") - 2).alias("installed"))
    newest = R.top(rows, "tier", 1, F.desc("version"), F.asc("id"), name="k")
    return newest.join(installed, "tier", "left").where("installed is null or version > installed").select("tier", "id", "version", "installed", "k")


@query(POL + ", " + MANIFEST + " SELECT tier, version, lag(version) OVER (PARTITION BY tier ORDER BY version) AS previous FROM (SELECT DISTINCT tier, version FROM mf)")
def previous_versions(spark, folder):
    return manifest_rows(spark, folder).select("tier", "version").distinct().withColumn("previous", F.lag("version").over(Window.partitionBy("tier").orderBy("version")))


@query(POL + "SELECT r.id, COALESCE(r.target_doc_id, d.id) AS target_doc_id, r.target_ref_text FROM pr r LEFT JOIN pd d ON d.circular_no = r.target_ref_text")
def resolve_targets(spark, folder):
    return V.resolve_targets(P.policy_documents(spark, folder), P.policy_relations(spark, folder)).select("id", "target_doc_id", "target_ref_text")


TRUTH = "tr AS (SELECT DISTINCT source_doc_id, target_doc_id, target_ref_text, 'CANCELS' AS relation_type, 'whole' AS scope, effective_date FROM pr WHERE source_doc_id % 9 = 0 UNION ALL SELECT id, NULL, 'PP 1/1999', 'REFERENCES', 'whole', NULL FROM pd WHERE id % 50 = 7)"


@query(POL + ", " + TRUTH + " SELECT id, source_doc_id, target_doc_id, target_ref_text, relation_type, scope, effective_date, verified, confidence FROM pr r WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.source_doc_id = r.source_doc_id AND tr.target_ref_text = r.target_ref_text) UNION ALL SELECT (SELECT min(id) FROM pr r WHERE tr.source_doc_id = r.source_doc_id AND tr.target_ref_text = r.target_ref_text), source_doc_id, target_doc_id, target_ref_text, relation_type, scope, effective_date, 1, 1.0 FROM tr")
def ground_truth_merge(spark, folder):
    rels = P.policy_relations(spark, folder)
    known = rels.where("source_doc_id % 9 = 0").select("source_doc_id", "target_doc_id", "target_ref_text", F.lit("CANCELS").alias("relation_type"), F.lit("whole").alias("scope"), "effective_date").distinct()
    new = P.policy_documents(spark, folder).where("id % 50 = 7").select(F.col("id").alias("source_doc_id"), F.lit(None).cast("long").alias("target_doc_id"), F.lit("PP 1/1999").alias("target_ref_text"), F.lit("REFERENCES").alias("relation_type"), F.lit("whole").alias("scope"), F.lit(None).cast("date").alias("effective_date"))
    return V.merge_ground_truth(rels, known.unionByName(new))


@query(POL + "SELECT id, circular_no, doc_type FROM pd WHERE id % 7 <> 0 UNION ALL SELECT id, circular_no, CASE WHEN id % 2 = 0 THEN 'policy' ELSE doc_type END FROM pd WHERE id % 7 = 0")
def upsert_documents(spark, folder):
    docs = P.policy_documents(spark, folder).select("id", "circular_no", "doc_type")
    edit = docs.where("id % 7 = 0").select("id", "circular_no", F.coalesce(F.when(F.col("id") % 2 == 0, "policy"), F.col("doc_type")).alias("doc_type"))
    return V.upsert(docs, edit, "circular_no").select("id", "circular_no", "doc_type")


@query(POL + "SELECT r.id, COALESCE(CASE WHEN r.id % 4 = 1 AND r.verified = 0 THEN 1 WHEN r.id % 4 = 2 THEN -1 WHEN r.id % 4 = 3 THEN 0 END, r.verified) AS verified, CASE WHEN r.id % 4 = 0 THEN NULL ELSE scope END AS scope FROM pr r")
def verify_decisions(spark, folder):
    rels = P.policy_relations(spark, folder)
    k = F.col("id") % 4
    action = F.when((k == 1) & (F.col("verified") == 0), "approve").when(k == 2, "reject").when(k == 3, "reset").otherwise("edit")
    return V.decide(rels, rels.select("id", action.alias("action"), F.when(k == 0, "").alias("scope"))).select("id", "verified", "scope")


# ------------------------------------------------------------------------------------------------------- snapshots
@query(POL + "SELECT r.id, greatest(s.classification_level, COALESCE(t.classification_level, s.classification_level)) AS tier FROM pr r JOIN pd s ON s.id = r.source_doc_id LEFT JOIN pd t ON t.id = r.target_doc_id WHERE r.verified = 1")
def pack_visibility(spark, folder):
    return S.relation_tiers(P.policy_documents(spark, folder), P.policy_relations(spark, folder)).select("id", "tier")


@query(ST + ", hid AS (SELECT r.target_doc_id AS id, max_by(s.circular_no, r.id) AS no FROM pr r JOIN pd s ON s.id = r.source_doc_id JOIN pd t ON t.id = r.target_doc_id WHERE r.verified = 1 AND s.classification_level > t.classification_level GROUP BY 1) SELECT st.id, CASE WHEN no IS NULL THEN status_reason ELSE replace(status_reason, no, 'dokumen bertaraf keselamatan lebih tinggi') END AS status_reason FROM st LEFT JOIN hid USING (id)")
def redact_reasons(spark, folder):
    return S.redacted(statuses(spark, folder), P.policy_relations(spark, folder)).select("id", "status_reason")


COMPARE = POL + status_sql("v1", AS_OF_OLD, "pd.id % 29 <> 7").replace("(SELECT * FROM pd WHERE pd.id % 29 <> 7)", "(SELECT * FROM pd WHERE id % 29 <> 7)") + status_sql("v2", AS_OF) + """
, cmp AS (SELECT COALESCE(b.id, a.id) AS id, COALESCE(b.circular_no, a.circular_no) AS circular_no, CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' ELSE 'STATUS_CHANGE' END AS change, a.status AS old_status, b.status AS new_status, b.status_reason, b."cluster"
 FROM v1 a FULL JOIN v2 b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status)
"""


def changes(spark, folder):
    docs, rels = P.policy_documents(spark, folder), P.policy_relations(spark, folder)
    old = docs.where("id % 29 <> 7")
    return S.compare(V.with_status(old, rels, AS_OF_OLD), V.with_status(docs, rels, AS_OF))


@query(COMPARE + "SELECT id, circular_no, change, old_status, new_status FROM cmp")
def pack_compare(spark, folder):
    return changes(spark, folder).select("id", "circular_no", "change", "old_status", "new_status")


STATUS_NAMES = {c: "map {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}" for c, names in (("ms", S.STATUS_MS), ("en", S.STATUS_EN))}
#: every seventh search names a document in small letters
SEARCHES = "sq AS (SELECT user_id, doc_ref, created_at, query || CASE WHEN id % 7 = 0 THEN ': adakah ' || lower(['PP','SPP','SE','PB','PAS'][id % 397 % 5 + 1] || ' ' || (id % 397) || '/' || (2015 + id % 397 % 11)) || ' masih sah?' ELSE '' END AS query FROM lg)"
DAYS = 10


def searches(spark, folder):
    n = F.col("id") % 397
    named = F.concat(F.lit(": adakah "), F.lower(P.circular_no(n)), F.lit(" masih sah?"))
    return P.search_log(spark, folder).select("user_id", "doc_ref", "created_at", F.concat("query", F.when(F.col("id") % 7 == 0, named).otherwise("")).alias("query"))


@query(COMPARE + f""", {SEARCHES}, o AS (SELECT * FROM us WHERE role = 'OFFICER' AND clearance_level >= 0), rec AS (SELECT DISTINCT user_id, doc_ref, query FROM sq WHERE created_at >= (SELECT max(created_at) - INTERVAL {DAYS} DAY FROM sq)),
hits AS (SELECT o.id AS user_id, c.id AS document_id FROM cmp c JOIN o ON c."cluster" = o.sub_cluster WHERE change <> 'REMOVED' UNION SELECT o.id, c.id FROM cmp c JOIN o ON c.circular_no = o.sub_circular WHERE change <> 'REMOVED'
 UNION SELECT o.id, c.id FROM cmp c JOIN rec ON rec.doc_ref = c.id OR contains(lower(rec.query), lower(c.circular_no)) JOIN o ON o.id = rec.user_id WHERE change = 'STATUS_CHANGE'),
ra AS (SELECT * FROM pr WHERE verified = 1 AND id % 2 = 0), tg AS (SELECT target_doc_id AS id, min_by(source_doc_id, id) AS rel FROM ra WHERE relation_type IN ('CANCELS','SUPERSEDES','AMENDS') GROUP BY 1), sr AS (SELECT source_doc_id AS id, min_by(target_doc_id, id) AS rel FROM ra GROUP BY 1)
SELECT user_id, document_id, c.circular_no, CASE change WHEN 'ADDED' THEN 'NEW_DOCUMENT' ELSE change END AS change_type, CASE change WHEN 'ADDED' THEN sr.rel ELSE tg.rel END AS related_doc_id,
 CASE change WHEN 'ADDED' THEN 'Dokumen baharu: ' || c.circular_no || ' - Dokumen ' || document_id || '.' ELSE c.circular_no || ': ' || {STATUS_NAMES['ms']}[old_status] || ' -> ' || {STATUS_NAMES['ms']}[new_status] || ' (' || status_reason || ').' || CASE WHEN tg.rel % 4 = 0 THEN ' Ringkasan ' || tg.rel ELSE '' END END AS summary_ms,
 CASE change WHEN 'ADDED' THEN 'New document: ' || c.circular_no || ' - Dokumen ' || document_id || '.' ELSE c.circular_no || ': ' || {STATUS_NAMES['en']}[old_status] || ' -> ' || {STATUS_NAMES['en']}[new_status] || ' (' || status_reason || ').' || CASE WHEN tg.rel % 4 = 0 THEN ' Summary ' || tg.rel ELSE '' END END AS summary_en
 FROM hits h JOIN cmp c ON c.id = h.document_id LEFT JOIN tg ON tg.id = document_id LEFT JOIN sr ON sr.id = document_id""")
def notifications(spark, folder):
    """Followers and searchers of what changed, with what replaces it; every fourth replacement has a summary."""
    added = P.policy_relations(spark, folder).where("verified = 1 and id % 2 = 0")
    named = lambda word: F.concat(F.lit(f"{word} "), F.col("source_doc_id").cast("string"))
    pairs = added.where("source_doc_id % 4 = 0 and target_doc_id is not null").select(F.col("target_doc_id").alias("old_doc_id"), F.col("source_doc_id").alias("new_doc_id"), named("Ringkasan").alias("summary_ms"), named("Summary").alias("summary_en"))
    told = changes(spark, folder).withColumn("title", F.concat(F.lit("Dokumen "), F.col("id").cast("string")))
    return S.notified(told, P.users(spark, folder), searches(spark, folder), 0, DAYS, added, pairs)


@query(POL + ", " + MANIFEST + ", dev AS (SELECT COALESCE(max(clearance_level), 0) AS c FROM us WHERE role = 'OFFICER') SELECT tier, max(version) AS version, max(version) > 21 AS fresh FROM mf, dev WHERE tier <= c GROUP BY 1")
def device_updates(spark, folder):
    clearance = P.users(spark, folder).where("role = 'OFFICER'").agg(F.coalesce(F.max("clearance_level"), F.lit(0)).alias("c"))
    rows = manifest_rows(spark, folder).groupBy("tier").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(clearance), F.col("tier") <= F.col("c")).select("tier", "version", (F.col("version") > 21).alias("fresh"))


@query(POL + ", " + MANIFEST + " SELECT tier, version, previous, previous IS NOT NULL AS can_roll_back FROM (SELECT tier, max(version) AS version FROM mf GROUP BY 1) JOIN (SELECT tier, max(version) AS previous FROM mf m WHERE version < (SELECT max(version) FROM mf x WHERE x.tier = m.tier) GROUP BY 1) USING (tier)")
def rollback_pointer(spark, folder):
    two = R.top(manifest_rows(spark, folder).select("tier", "version").distinct(), "tier", 2, F.desc("version"), name="k")
    out = two.groupBy("tier").agg(F.max("version").alias("version"), F.min(F.when(F.col("k") == 2, F.col("version"))).alias("previous"))
    return out.withColumn("can_roll_back", F.col("previous").isNotNull())


@query(POL + ", " + MANIFEST + " SELECT id, tier, version, CASE WHEN tier > 1 THEN 'CLEARANCE' WHEN id % 6 = 0 THEN 'MODEL' WHEN version <= 3 THEN 'NOT_NEWER' ELSE 'OK' END AS code FROM mf")
def pack_open_check(spark, folder):
    code = F.when(F.col("tier") > 1, "CLEARANCE").when(F.col("id") % 6 == 0, "MODEL").when(F.col("version") <= 3, "NOT_NEWER").otherwise("OK")
    return manifest_rows(spark, folder).select("id", "tier", "version", code.alias("code"))


@query(POL + "SELECT user_id, count(*) AS n, count(*) FILTER (answerable) AS unread FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS k FROM lg WHERE doc_ref IS NULL OR doc_ref % 3 <= user_id % 3) WHERE k <= 50 GROUP BY 1")
def alerts_feed(spark, folder):
    log = P.search_log(spark, folder).where(F.col("doc_ref").isNull() | (F.col("doc_ref") % 3 <= F.col("user_id") % 3))
    return R.top(log, "user_id", 50, F.desc("id"), name="k").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("answerable").alias("unread"))


@query(POL + "SELECT id AS user_id, sub_cluster AS target FROM us WHERE id % 4 <> 1 UNION SELECT id, sub_circular FROM us UNION SELECT id, 'src0' FROM us WHERE id % 5 = 0")
def subscription_update(spark, folder):
    users = P.users(spark, folder)
    cluster = users.select(F.col("id").alias("user_id"), F.col("sub_cluster").alias("target"))
    removed = users.where("id % 4 = 1").select(F.col("id").alias("user_id"), F.col("sub_cluster").alias("target"))
    added = users.where("id % 5 = 0").select(F.col("id").alias("user_id"), F.lit("src0").alias("target"))
    kept = cluster.join(removed, ["user_id", "target"], "left_anti")
    return kept.unionByName(users.select(F.col("id").alias("user_id"), F.col("sub_circular").alias("target"))).unionByName(added).distinct()


@query(ST + "SELECT classification_level AS tier, count(*) AS n_docs, count(vec_id) AS n_vectors, count(*) FILTER (vec_id IS NULL) AS n_missing FROM st LEFT JOIN embeddings e ON e.vec_id = st.id GROUP BY 1")
def pack_payload(spark, folder):
    docs = P.policy_documents(spark, folder).join(table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("has")), "id", "left")
    return docs.groupBy(F.col("classification_level").alias("tier")).agg(F.count(F.lit(1)).alias("n_docs"), F.count("has").alias("n_vectors"), F.count_if(F.col("has").isNull()).alias("n_missing"))


# --------------------------------------------------------------------------------------------------------- lineage
LINKS = "lk AS (SELECT r.* FROM pr r JOIN pd s ON s.id = r.source_doc_id JOIN pd t ON t.id = r.target_doc_id WHERE r.verified = 1 AND r.relation_type <> 'REFERENCES' AND s.classification_level <= 1 AND t.classification_level <= 1)"


def lineage_edges(spark, folder):
    docs = V.secure(P.policy_documents(spark, folder), 1).select("id")
    rels = P.policy_relations(spark, folder).where("verified = 1 and relation_type <> 'REFERENCES'")
    return rels.join(docs.select(F.col("id").alias("source_doc_id")), "source_doc_id", "left_semi").join(docs.select(F.col("id").alias("target_doc_id")), "target_doc_id", "left_semi")


@query(POL.replace("WITH pd", "WITH RECURSIVE pd", 1) + ", " + LINKS + ", ed AS (SELECT source_doc_id AS a, target_doc_id AS b FROM lk UNION SELECT target_doc_id, source_doc_id FROM lk), re AS (SELECT DISTINCT a AS id, a AS root FROM ed UNION SELECT ed.b, re.root FROM re JOIN ed ON ed.a = re.id) SELECT id, min(root) AS component FROM re GROUP BY 1")
def lineage_component(spark, folder):
    return V.component_labels(lineage_edges(spark, folder).select(F.col("source_doc_id").alias("a"), F.col("target_doc_id").alias("b")))


@query(POL + ", " + LINKS + " SELECT lk.target_doc_id, lk.source_doc_id, lk.relation_type, s.id IS NOT NULL AS has_diff FROM lk LEFT JOIN (SELECT * FROM pr WHERE id % 2 = 0) s ON s.id = lk.id")
def lineage_links(spark, folder):
    summaries = P.policy_relations(spark, folder).where("id % 2 = 0").select("id", F.lit(True).alias("has"))
    return lineage_edges(spark, folder).join(summaries, "id", "left").select("target_doc_id", "source_doc_id", "relation_type", F.col("has").isNotNull().alias("has_diff"))


@query(POL + "SELECT id, json_extract_string(props, '$.k') AS change, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM lg WHERE json_extract_string(props, '$.k') IS NOT NULL")
def change_view(spark, folder):
    log = P.search_log(spark, folder).withColumn("payload", F.from_json("props", "map<string,string>"))
    return log.where(F.col("payload")["k"].isNotNull()).select("id", F.col("payload")["k"].alias("change"), (F.col("payload")["k"].cast("long") % 2 == 0).alias("even"))


# ------------------------------------------------------------------------------------------------------- retrieval
@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def token_terms(spark, folder):
    t = texts(spark, folder).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"WITH {BM} SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 100")
def bm25_topk(spark, folder):
    return bm25_hits(spark, folder, "rank")


KEYWORD = f"""{ST}, {BM}, raw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS raw_rank FROM bm) WHERE raw_rank <= 100),
kw AS (SELECT * FROM (SELECT qid, raw.id, score, row_number() OVER (PARTITION BY qid ORDER BY raw_rank) AS rank FROM raw JOIN st ON st.id = raw.id WHERE status IN {NOW} AND classification_level <= 1) WHERE rank <= 30)
"""


def keyword_hits(spark, folder, history: bool = False):
    return R.shown_list(bm25_hits(spark, folder), statuses(spark, folder), V.allowed_statuses(history), 1)


@query(KEYWORD + "SELECT qid, id, score, rank FROM kw")
def bm25_postfilter(spark, folder):
    return keyword_hits(spark, folder).select("qid", "id", "score", "rank")


@query(KEYWORD + "SELECT qid, kw.id, rank, circular_no, doc_type, n_chars, CASE WHEN len(w) > 20 THEN array_to_string(w[1:20], ' ') || ' ...' ELSE d.text END AS passage FROM kw JOIN st ON st.id = kw.id JOIN (SELECT doc_id, text, n_chars, regexp_split_to_array(trim(text, ' '), '\\s+') AS w FROM documents) d ON d.doc_id = kw.id")
def bm25_passages(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "n_chars", X.first_words(F.col("text"), 20).alias("passage"))
    meta = P.policy_documents(spark, folder).select("id", "circular_no", "doc_type")
    return keyword_hits(spark, folder).join(meta, "id").join(docs, "id").select("qid", "id", "rank", "circular_no", "doc_type", "n_chars", "passage")


#: strings cut from anywhere in the numbers of every twentieth document; every third of them is too short to find anything
CUT_NUMBERS = "qn AS (SELECT id AS qid, CASE WHEN id % 60 = 40 THEN circular_no[1:2] ELSE circular_no[2 + id % 3:5 + id % 3 + id % 5] END AS ref FROM pd WHERE id % 20 = 0)"


@query(POL + f", {CUT_NUMBERS} SELECT qid, id, circular_no FROM qn JOIN pd ON length(ref) >= 3 AND contains(lower(circular_no), lower(ref))")
def substring_ref_search(spark, folder):
    """Documents whose number contains a string."""
    docs = P.policy_documents(spark, folder).select("id", "circular_no")
    n, no = F.col("id"), F.col("circular_no")
    ref = F.when(n % 60 == 40, F.substring(no, 1, 2)).otherwise(F.substring(no, (2 + n % 3).cast("int"), (4 + n % 5).cast("int")))
    return TG.containing(docs, docs.where("id % 20 = 0").select(n.alias("qid"), ref.alias("ref"))).join(docs, "id").select("qid", "id", "circular_no")


VEC = "qv AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0), vs AS (SELECT qid, vec_id AS id, round(list_sum(list_transform(list_zip(qe, embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM qv, embeddings)"


def vector_hits(spark, folder, k: int = R.LIST_CUT):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = vectors.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return R.nearest(vectors, queries, k)


@query(f"WITH {VEC} SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs) WHERE rank <= 100")
def vector_topk(spark, folder):
    return vector_hits(spark, folder)


#: vector lists after the filters; the vector with id 20 q belongs to question q
SHOWN_VECTORS = f"""{VEC}, vk AS (SELECT qid // 20 AS qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY raw_rank) AS rank
 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS raw_rank FROM vs) v JOIN st USING (id) WHERE raw_rank <= 100 AND status IN {NOW} AND classification_level <= 1 QUALIFY rank <= 30)"""


def shown_vectors(spark, folder, history: bool = False):
    hits = vector_hits(spark, folder).withColumnRenamed("rank", "raw_rank").withColumn("qid", F.expr("qid div 20"))
    return R.shown_list(hits, statuses(spark, folder), V.allowed_statuses(history), 1)


@query(ST + f", {SHOWN_VECTORS} SELECT qid, id, score, rank FROM vk")
def vector_postfilter(spark, folder):
    return shown_vectors(spark, folder).select("qid", "id", "score", "rank")


#: documents that a question names, the last ones first
NAMED = f"""{P.QUESTIONS}, rq AS (SELECT DISTINCT qid, upper(s) || ' ' || CAST(n AS INTEGER) || '/' || y AS ref FROM (SELECT qid, regexp_extract(text, '{X.QUERY_REFERENCE}', 1) AS s, regexp_extract(text, '{X.QUERY_REFERENCE}', 2) AS n, regexp_extract(text, '{X.QUERY_REFERENCE}', 3) AS y FROM qs) WHERE n <> ''),
sb AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id DESC) AS rank FROM (SELECT DISTINCT qid, id FROM rq JOIN st ON contains(lower(circular_no), lower(ref)) WHERE status IN {NOW} AND classification_level <= 1) QUALIFY rank <= 30)"""


def named_documents(spark, folder, history: bool = False):
    asked = P.questions(spark, folder).select("qid", F.explode(F.array_distinct(X.references(F.col("text"), X.QUERY_REFERENCE))).alias("ref"))
    docs = statuses(spark, folder)
    found = TG.containing(docs.select("id", "circular_no"), asked).withColumn("raw_rank", -F.col("id"))
    return R.shown_list(found, docs, V.allowed_statuses(history), 1)


@query(ST + f", {NAMED} SELECT qid, id, rank FROM sb")
def named_reference_list(spark, folder):
    return named_documents(spark, folder).select("qid", "id", "rank")


FUSED = KEYWORD + f""", {SHOWN_VECTORS}, {NAMED},
fu AS (SELECT qid, id, round(sum(1 / (60 + rank)), 9) AS rrf, count(*) AS n_lists, string_agg(list || ' ' || rank, ', ' ORDER BY list) AS ranks
 FROM (SELECT qid, id, rank, 'keyword' AS list FROM kw UNION ALL SELECT qid, id, rank, 'vector' FROM vk UNION ALL SELECT qid, id, rank, 'substring' FROM sb) GROUP BY 1, 2)
"""


def fused(spark, folder, history: bool = False):
    lists = {"keyword": keyword_hits(spark, folder, history), "vector": shown_vectors(spark, folder, history), "substring": named_documents(spark, folder, history)}
    parts = [df.select("qid", "id", F.lit(name).alias("list"), "rank") for name, df in lists.items()]
    return R.fuse(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(FUSED + "SELECT qid, id, rrf, n_lists, ranks FROM fu")
def rrf_fusion(spark, folder):
    return fused(spark, folder)


@query(FUSED.replace(NOW, ALL) + "SELECT qid, fu.id, circular_no, status, status_reason, rrf FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS k FROM fu) fu JOIN st ON st.id = fu.id WHERE k <= 10 AND status = 'CANCELLED'")
def excluded_documents(spark, folder):
    first = R.top(fused(spark, folder, True), "qid", 10, F.desc("rrf"), F.asc("id"), name="k")
    return first.join(statuses(spark, folder).where("status = 'CANCELLED'").select("id", "circular_no", "status", "status_reason"), "id").select("qid", "id", "circular_no", "status", "status_reason", "rrf")


RANKED = KEYWORD + f""", ov AS (SELECT kw.qid, kw.id, rank, CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, t)) / (len(q) + 2) END AS score FROM kw
 JOIN (SELECT item_id AS qid, list_distinct({tokens_sql('text')}) AS q FROM benchmark) USING (qid) JOIN (SELECT doc_id AS id, list_distinct({tokens_sql('text')}) AS t FROM documents) USING (id) WHERE rank <= 20),
rk AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, rank) AS pos FROM ov)
"""


def reranked(spark, folder, shown: DataFrame | None = None):
    """The first places of the keyword list, or of one that is there already, by shared words."""
    # few rows, so that the texts stay where they lie
    pool = R.few((keyword_hits(spark, folder) if shown is None else shown).where(F.col("rank") <= R.POOL).select("qid", "id", "rank"))
    asked = R.bounded(table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")))
    passages = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("passage"))
    scored = passages.join(pool, "id").join(asked, "qid").select("qid", "id", "rank", F.round(R.overlap(F.col("question"), F.col("passage")), 6).alias("score"))
    return scored.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank"))).select("qid", "id", "score", "pos")


@query(RANKED + "SELECT qid, id, score, pos FROM rk")
def overlap_rerank(spark, folder):
    return reranked(spark, folder)


@query(RANKED + "SELECT qid, max(score) AS top_score, count(*) FILTER (score >= 0.06) AS n_shown, CASE WHEN max(score) >= 0.3 THEN 'HIGH' WHEN max(score) >= 0.12 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM rk GROUP BY 1")
def confidence_bands(spark, folder):
    best = reranked(spark, folder).groupBy("qid").agg(F.max("score").alias("top_score"), F.count_if(F.col("score") >= R.FLOOR).alias("n_shown"))
    return best.withColumn("band", R.confidence(F.col("top_score")))


JUR = RANKED + """, jr AS (SELECT rk.*, jurisdiction IN ('FEDERAL') AS other, score >= 0.12 AND doc_type NOT IN ('minutes','report') AS strong FROM rk JOIN pd ON pd.id = rk.id),
fa AS (SELECT qid, max(score) AS top, min_by(score, pos) FILTER (strong AND other) AS so, min_by(score, pos) FILTER (strong AND NOT other) AS sm, count(*) FILTER (strong AND other) AS n_so, count(*) FILTER (NOT other) AS n_mine FROM jr GROUP BY 1),
jp AS (SELECT jr.*, COALESCE(so >= 0.75 * top AND sm >= 0.75 * top, FALSE) AS conflict, least(2, n_so) AS res, n_mine, row_number() OVER (PARTITION BY qid, other ORDER BY pos) AS side_pos, row_number() OVER (PARTITION BY qid, strong AND other ORDER BY pos) AS strong_pos FROM jr JOIN fa USING (qid)),
js AS (SELECT * FROM jp WHERE CASE WHEN conflict THEN (NOT other AND side_pos <= 5 - res) OR (strong AND other AND strong_pos <= res) ELSE (NOT other AND side_pos <= 5) OR (other AND n_mine + side_pos <= 5) END)
"""


def jurisdiction_places(spark, folder):
    meta = P.policy_documents(spark, folder).select("id", "jurisdiction", "doc_type")
    return R.apply_jurisdiction(reranked(spark, folder).join(meta, "id"), "SARAWAK")


@query(JUR + "SELECT qid, id, score, CASE WHEN other THEN 'comparison' ELSE 'primary' END AS role, conflict, row_number() OVER (PARTITION BY qid ORDER BY other, pos) AS place FROM js")
def jurisdiction_policy(spark, folder):
    return jurisdiction_places(spark, folder)


@query(JUR + "SELECT qid, 'S' || row_number() OVER (PARTITION BY qid ORDER BY other, pos) AS source_id, js.id, circular_no, status, round(score, 4) AS score FROM js JOIN st ON st.id = js.id")
def source_payload(spark, folder):
    meta = statuses(spark, folder).select("id", "circular_no", "status")
    return jurisdiction_places(spark, folder).join(meta, "id").select("qid", F.concat(F.lit("S"), F.col("place").cast("string")).alias("source_id"), "id", "circular_no", "status", F.round("score", 4).alias("score"))


@query(f"WITH qs AS (SELECT item_id, {query_terms_sql('text')} AS terms, text FROM benchmark) SELECT item_id, len(terms) AS n_terms, array_to_string(list_transform(terms, lambda t: '\"' || t || '\"'), ' OR ') AS match_text, regexp_matches(text, '(?i)\\b(sejarah|previous|older|cancelled|history|historical)\\b') AS wants_history FROM qs")
def question_hints(spark, folder):
    t = X.query_terms(F.col("text"))
    rows = table(spark, folder, "benchmark").select("item_id", t.alias("terms"), "text")
    return rows.select("item_id", F.size("terms").cast("long").alias("n_terms"), F.array_join(F.transform("terms", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ").alias("match_text"), F.col("text").rlike(r"(?i)\b(sejarah|previous|older|cancelled|history|historical)\b").alias("wants_history"))


GLOSSARY = {"law": ("the", "rule", "act"), "person": ("that", "human"), "time": ("der", "zeit", "tempo"), "place": ("que", "lugar")}
GLOSSARY_SQL = "gl AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, ts in GLOSSARY.items() for t in ts) + ") t(entry, term))"


@query(f"WITH {GLOSSARY_SQL}, w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({FOLD.format('text')}, '[a-z0-9]+')) AS word FROM benchmark), hit AS (SELECT DISTINCT item_id, entry FROM w JOIN gl ON gl.term = w.word) SELECT item_id, entry, term FROM hit JOIN gl USING (entry) WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.item_id = hit.item_id AND w.word = gl.term)")
def glossary_expand(spark, folder):
    """An entry with a term in the question adds its other terms; an equal join on words, no nested loop."""
    entries = spark.createDataFrame([(k, t) for k, ts in GLOSSARY.items() for t in ts], "entry string, term string")
    found = table(spark, folder, "benchmark").select("item_id", F.explode(F.regexp_extract_all(X.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).distinct()
    hit = found.join(entries, "term").select("item_id", "entry").distinct()
    return hit.join(entries, "entry").join(found, ["item_id", "term"], "left_anti").select("item_id", "entry", "term")


INJECT = ST + """, sel AS (SELECT id // 5 AS qid, id, id % 5 AS pos, status, ((id % 9) + 1) || '.1' AS clause FROM st),
ed AS (SELECT sel.qid, sel.id, sel.pos, r.source_doc_id AS new_id, r.id AS rel_id FROM sel JOIN pr r ON r.target_doc_id = sel.id AND r.verified = 1 AND r.relation_type = 'AMENDS' WHERE sel.status = 'AMENDED' AND (r.scope = 'whole' OR replace(r.scope, 'clauses: ', '') = sel.clause)),
pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, new_id ORDER BY pos, rel_id) AS k FROM ed) WHERE k = 1),
pn AS (SELECT pl.*, s.id IS NULL AS is_new FROM pl LEFT JOIN sel s ON s.qid = pl.qid AND s.id = pl.new_id),
ct AS (SELECT qid, count(*) AS n_placed, count(*) FILTER (is_new) AS n_new FROM pn GROUP BY 1),
ba AS (SELECT sel.*, COALESCE(n_new, 0) AS n_new, n_placed, row_number() OVER (PARTITION BY sel.qid ORDER BY sel.pos) AS bp FROM sel LEFT JOIN ct USING (qid) WHERE NOT EXISTS (SELECT 1 FROM pn WHERE pn.qid = sel.qid AND pn.new_id = sel.id)),
ke AS (SELECT * FROM ba WHERE n_new = 0 OR bp <= greatest(1, 5 - n_placed)),
ot AS (SELECT qid, id, pos AS hp, -1 AS sub, 'selected' AS origin FROM ke UNION ALL SELECT pn.qid, pn.new_id, ke.pos, pn.rel_id, 'amendment' FROM pn JOIN ke ON ke.qid = pn.qid AND ke.id = pn.id)
SELECT * FROM (SELECT qid, id, origin, row_number() OVER (PARTITION BY qid ORDER BY hp, sub) AS place FROM ot) WHERE place <= 5
"""


@query(INJECT)
def amendment_injection(spark, folder):
    """All documents, as the passages of questions that found five neighbours each."""
    st = statuses(spark, folder)
    sel = st.select(F.expr("id div 5").alias("qid"), "id", (F.col("id") % 5).alias("pos"), "status", F.concat((F.col("id") % 9 + 1).cast("string"), F.lit(".1")).alias("clause"))
    return R.inject_amendments(sel, P.policy_relations(spark, folder), st.select("id"))


#: the same steps over the passages that retrieval gives each benchmark item, in their places
INJECT_RETRIEVED = JUR + """, sel AS (SELECT qid, js.id, row_number() OVER (PARTITION BY qid ORDER BY other, pos) AS pos, status, ((js.id % 9) + 1) || '.1' AS clause FROM js JOIN st ON st.id = js.id),
""" + INJECT[INJECT.index("ed AS (SELECT sel.qid") :]


@query(INJECT_RETRIEVED)
def amendment_injection_retrieved(spark, folder):
    st = statuses(spark, folder).select("id", "status")
    places = jurisdiction_places(spark, folder).join(st, "id")
    sel = places.select("qid", "id", F.col("place").alias("pos"), "status", F.concat((F.col("id") % 9 + 1).cast("string"), F.lit(".1")).alias("clause"))
    return R.inject_amendments(sel, P.policy_relations(spark, folder), st.select("id"))


# ------------------------------------------------------------------------------------- references, dates, functions
#: both patterns in one; a generated clause names one document
REF_SQL = X.REFERENCE.replace(r"\b(?:spp|pp|se)\b)", r"\b(?:spp|pp|se)\b|pekeliling\s+am\s+sarawak|\bpas\b)")
SERIES_SQL = "CASE WHEN starts_with(s, 'surat pekeliling perkhidmatan') THEN 'SPP' WHEN starts_with(s, 'pekeliling perkhidmatan') THEN 'PP' WHEN starts_with(s, 'pekeliling perbendaharaan') THEN 'PB' WHEN starts_with(s, 'pekeliling am sarawak') THEN 'PAS' ELSE upper(s) END"
REFS = POL + f", rf AS (SELECT id, text, lower(regexp_extract(text, '{REF_SQL}', 1)) AS s, regexp_extract(text, '{REF_SQL}', 2) AS n, regexp_extract(text, '{REF_SQL}', 3) AS y FROM pc), rn AS (SELECT id, text, {SERIES_SQL} || ' ' || CAST(n AS INTEGER) || '/' || y AS ref FROM rf WHERE n <> '')"


@query(REFS + " SELECT id, ref FROM rn")
def extract_refs(spark, folder):
    return P.policy_clauses(spark, folder).select("id", F.explode(X.references(F.col("text"))).alias("ref"))


EFFECT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(v)}') THEN '{k}'" for k, v in X.EFFECTS.items()) + " ELSE 'REFERENCES' END"
TRIGGER_SQL = "|".join(p for v in X.EFFECTS.values() for p in v)


@query(REFS + f" SELECT rn.id, ref, {EFFECT_SQL} AS relation FROM rn JOIN pd ON pd.id = rn.id WHERE ref <> circular_no AND regexp_matches(lower(rn.text), '{TRIGGER_SQL}')".replace("lower(text)", "lower(rn.text)"))
def relation_candidates(spark, folder):
    found = P.policy_clauses(spark, folder).where(X.has_trigger(F.col("text"))).select("id", "text", F.explode(F.array_distinct(X.references(F.col("text")))).alias("ref"))
    own = P.policy_documents(spark, folder).select("id", "circular_no")
    return found.join(own, "id").where("ref <> circular_no").select("id", "ref", X.relation_effect(F.col("text")).alias("relation"))


@query(REFS + f" SELECT id, ref, COALESCE(CASE WHEN id % 4 = 1 THEN 'AMENDS' END, {EFFECT_SQL}) AS relation, CAST(COALESCE(CASE WHEN id % 4 = 1 THEN 0.9 END, 0.5) AS DOUBLE) AS confidence FROM rn")
def llm_fallback_merge(spark, folder):
    found = P.policy_clauses(spark, folder).select("id", "text", F.explode(X.references(F.col("text"))).alias("ref"))
    model = found.where("id % 4 = 1").select("id", F.lit("AMENDS").alias("m_relation"), F.lit(0.9).alias("m_confidence"))
    return found.join(model, "id", "left").select("id", "ref", F.coalesce("m_relation", X.relation_effect(F.col("text"))).alias("relation"), F.coalesce("m_confidence", F.lit(0.5)).alias("confidence"))


@query(POL + f"SELECT id, {P.malay_sql('effective_date')} AS shown, effective_date AS parsed, TRY_CAST('2024-02-' || (id % 32) AS DATE) AS lenient FROM pd".replace("'2024-02-' || (id % 32)", "'2024-02-' || lpad(CAST(id % 32 AS VARCHAR), 2, '0')"))
def date_functions(spark, folder):
    shown = X.malay_date(F.col("effective_date"))
    rows = P.policy_documents(spark, folder).select("id", shown.alias("shown"))
    return rows.select("id", "shown", X.parse_malay_date(F.concat(F.lit("mulai "), F.col("shown"), F.lit("."))).alias("parsed"), X.lenient_date(F.concat(F.lit("2024-02-"), F.lpad((F.col("id") % 32).cast("string"), 2, "0"), F.lit("T00:00"))).alias("lenient"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm, round(1 / (1 + exp(-list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))))), 5) AS squashed FROM embeddings")
def vector_math(spark, folder):
    v = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return table(spark, folder, "embeddings").select("vec_id", F.round(F.sqrt(R.dot(v, v)), 5).alias("norm"), F.round(1 / (1 + F.exp(-total)), 5).alias("squashed"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS parsed FROM events")
def json_functions(spark, folder):
    broken = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.col("props"))
    rows = table(spark, folder, "events").withColumn("m", F.from_json(broken, "map<string,bigint>"))
    return rows.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.when(F.size("m") > 0, 1).otherwise(0).alias("parsed"))


@query("SELECT doc_id, CAST(ceil(n / 500.0) AS BIGINT) AS n_slices, n - (ceil(n / 500.0) - 1) * 500 AS last_words FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)")
def fixed_word_slices(spark, folder):
    slices = texts(spark, folder).select("doc_id", X.word_slices(F.col("text")).alias("s"))
    return slices.select("doc_id", F.size("s").cast("long").alias("n_slices"), F.size(F.split(F.element_at("s", -1), " ")).cast("double").alias("last_words"))


@query("SELECT doc_id, len(f) AS n_fragments, len(list_filter(f, lambda x: length(x) >= 12)) AS n_long FROM (SELECT doc_id, list_transform(range(0, len(w), 7), lambda i: array_to_string(w[i + 1:i + 7], ' '))[1:80] AS f FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents))")
def highlight_fragments(spark, folder):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    f = F.slice(F.transform(F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: (i % 7 == 0) & (i < F.size("w"))), lambda i: F.array_join(F.slice("w", i + 1, F.lit(7)), " ")), 1, 80)
    rows = texts(spark, folder).select("doc_id", w.alias("w")).select("doc_id", f.alias("f"))
    return rows.select("doc_id", F.size("f").cast("long").alias("n_fragments"), F.size(F.filter("f", lambda x: F.length(x) >= 12)).cast("long").alias("n_long"))


@query(POL + "SELECT pc.id, CASE WHEN regexp_matches(text, '(?i)^surat') THEN 'letter' WHEN regexp_matches(text, '(?i)^se ') THEN 'notice' ELSE 'circular' END AS kind, CASE WHEN pc.id % 4 = 0 THEN 'override' ELSE regexp_extract(text, '^(.*?) (Bilangan|Bil\\.)', 1) END AS title, COALESCE(CASE WHEN pc.id % 4 = 0 THEN 2 END, 0) AS classification_level FROM pc")
def header_metadata(spark, folder):
    """Metadata by precedence: overrides, then what the header's pattern gives, then defaults."""
    t = F.col("text")
    found = P.policy_clauses(spark, folder).select("id", F.when(t.rlike("(?i)^surat"), "letter").when(t.rlike("(?i)^se "), "notice").otherwise("circular").alias("kind"), F.regexp_extract(t, r"^(.*?) (Bilangan|Bil\.)", 1).alias("title"))
    override = found.where("id % 4 = 0").select("id", F.lit("override").alias("o_title"), F.lit(2).alias("o_level"))
    return found.join(override, "id", "left").select("id", "kind", F.coalesce("o_title", "title").alias("title"), F.coalesce("o_level", F.lit(0)).alias("classification_level"))


# ------------------------------------------------------------------------------------------------------- analytics
@query(POL + "SELECT id, CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour, query, topic, \"cluster\", answerable, confidence, doc_ref AS excluded FROM lg")
def usage_export(spark, folder):
    return A.usage_report(P.search_log(spark, folder))


@query(POL + "SELECT \"cluster\", count(*) AS total, count(*) FILTER (NOT answerable) AS unanswered, round(count(*) FILTER (NOT answerable) / count(*), 3) AS rate FROM lg GROUP BY 1")
def usage_dashboard_clusters(spark, folder):
    return A.by_cluster(A.usage_report(P.search_log(spark, folder)))


TOPS = " UNION ALL ".join(f"SELECT '{c}' AS kind, value, n FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, min(id) AS seen FROM lg WHERE {c} IS NOT NULL AND ({w}) GROUP BY 1 ORDER BY n DESC, seen LIMIT 10)" for c, w in (("query", "NOT answerable"), ("topic", "TRUE"), ("doc_ref", "TRUE")))


@query(POL + TOPS)
def usage_dashboard_top(spark, folder):
    report = A.usage_report(P.search_log(spark, folder)).withColumnRenamed("excluded", "doc_ref")
    parts = [A.most_common(report.where("not answerable") if c == "query" else report, c).select(F.lit(c).alias("kind"), "value", "n") for c in ("query", "topic", "doc_ref")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(POL + "SELECT id, query FROM lg WHERE answerable AND confidence = 'LOW' ORDER BY id LIMIT 10")
def usage_dashboard_low(spark, folder):
    return A.usage_report(P.search_log(spark, folder)).where("answerable and confidence = 'LOW'").orderBy("id").limit(10).select("id", "query")


@query(POL + "SELECT user_id, max_by('{\"rating\":\"' || confidence || '\",\"comment\":\"' || left(repeat(query || ' ', 40 + CAST(id % 20 AS INTEGER)), 500) || '\"}', (created_at, id)) AS feedback, count(*) AS n FROM lg GROUP BY 1")
def feedback_latest(spark, folder):
    """Each user's last feedback as it is stored: a long comment is cut."""
    comment = F.repeat(F.concat("query", F.lit(" ")), (40 + F.col("id") % 20).cast("int"))
    return P.search_log(spark, folder).groupBy("user_id").agg(F.max_by(feedback_json(F.col("confidence"), comment), F.struct("created_at", "id")).alias("feedback"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_rows, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n_valid, sum(CAST(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE)) AS total FROM events")
def usage_import(spark, folder):
    k = F.from_json("props", "k long")["k"]
    return table(spark, folder, "events").agg(F.count(F.lit(1)).alias("n_rows"), F.count(k).alias("n_valid"), F.sum(k.cast("double")).alias("total"))


QS = (0.5, 0.95, 0.99)


@query("WITH s AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events) " + " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, value FROM s WHERE k = round_even({q} * (n - 1), 0) + 1" for q in QS))
def eval_latency_percentiles(spark, folder):
    return A.nearest_rank(table(spark, folder, "events"), "value", QS)


GOLD = KEYWORD + ", gold AS (SELECT b.item_id AS qid, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), rr AS (SELECT qid, min(raw_rank) AS rank FROM raw JOIN gold USING (qid, id) GROUP BY 1)"


def expected_ranks(spark, folder):
    """The best rank of a document that holds the question; candidates come from shared words, then the text decides."""
    # few rows, so that the texts stay where they lie
    hits = R.bounded(bm25_hits(spark, folder))
    asked = R.bounded(table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    held = texts.join(hits, "id").join(asked, "qid").where(F.contains("text", "question"))
    return held.groupBy("qid").agg(F.min("raw_rank").alias("rank"))


@query(GOLD + " SELECT item_id AS qid, rank, round(COALESCE(1 / rank, 0), 6) AS reciprocal, COALESCE(rank <= 5, FALSE) AS in_five FROM benchmark LEFT JOIN rr ON rr.qid = item_id")
def eval_retrieval(spark, folder):
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"))
    return asked.join(expected_ranks(spark, folder), "qid", "left").select("qid", "rank", F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 6).alias("reciprocal"), F.coalesce(F.col("rank") <= 5, F.lit(False)).alias("in_five"))


@query(GOLD + " SELECT 'keyword' AS mode, count(*) AS n, round(avg(COALESCE(1 / rank, 0)), 6) AS mrr, round(avg(CAST(COALESCE(rank <= 5, FALSE) AS INTEGER)), 6) AS recall_5 FROM benchmark LEFT JOIN rr ON rr.qid = item_id")
def eval_citations(spark, folder):
    rows = eval_retrieval(spark, folder)
    return rows.agg(F.lit("keyword").alias("mode"), F.count(F.lit(1)).alias("n"), F.round(F.avg("reciprocal"), 6).alias("mrr"), F.round(F.avg(F.col("in_five").cast("int")), 6).alias("recall_5"))


RERANK_VECTORS = f"WITH {VEC}, pool AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs) WHERE rank <= 20) SELECT pool.qid, pool.id, rank, COALESCE(CASE WHEN pool.id % 3 <> 0 THEN score END, 0.0) AS score, row_number() OVER (PARTITION BY pool.qid ORDER BY COALESCE(CASE WHEN pool.id % 3 <> 0 THEN score END, 0.0) DESC, rank) AS pos FROM pool"


@query(RERANK_VECTORS)
def rerank_vectors(spark, folder):
    """Stored vectors rerank the pool; a passage without one scores 0."""
    pool = vector_hits(spark, folder, R.POOL)
    stored = pool.where("id % 3 <> 0").select("qid", "id", F.col("score").alias("own"))
    rows = pool.select("qid", "id", "rank").join(stored, ["qid", "id"], "left").withColumn("score", F.coalesce("own", F.lit(0.0)))
    return rows.select("qid", "id", "rank", "score", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank")).alias("pos"))


# ---------------------------------------------------------------------------------------- answers, chunks, changes
def turns(spark, folder):
    """Conversation turns as answers over three sources; every second one gets citations, real and not."""
    c = table(spark, folder, "conversations").where("text is not null")
    n = F.col("conv_id") * 100 + F.col("turn")
    tail = F.when(n % 2 == 0, F.lit(" [S1, S2] and [S7; s2,  3] .\n- do this [ S2 ].\n- and that\n* last [S1][S9]")).otherwise("")
    return c.select(n.alias("id"), F.lit(3).alias("n_sources"), F.concat("text", tail).alias("text"))


TURNS = """tn AS (SELECT conv_id * 100 + turn AS id, 3 AS n_sources, text || CASE WHEN (conv_id * 100 + turn) % 2 = 0 THEN ' [S1, S2] and [S7; s2,  3] .\n- do this [ S2 ].\n- and that\n* last [S1][S9]' ELSE '' END AS text FROM conversations WHERE text IS NOT NULL)"""


def checked_sql(source: str, name: str) -> str:
    """Tables with the validated text, used and removed sources of a table with id, n_sources and text."""
    return f"""{name}_g AS (SELECT *, list_transform(regexp_extract_all(text, '{ANS.GROUP}'), lambda g: list_transform(regexp_extract_all(g, '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT))) AS gs, string_split_regex(text, '{ANS.GROUP}') AS ps FROM {source}),
{name} AS (SELECT * EXCLUDE (gs, ps, text), regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || COALESCE(array_to_string(list_transform(list_filter(gs[i], lambda x: x BETWEEN 1 AND n_sources), lambda x: '[S' || x || ']'), ''), '')), ''), '[ \\t]+([.,;:])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text,
 list_filter(flatten(gs), lambda x: x BETWEEN 1 AND n_sources) AS valid, list_filter(flatten(gs), lambda x: NOT COALESCE(x BETWEEN 1 AND n_sources, FALSE)) AS removed FROM {name}_g)"""


CHECKED = f"WITH {TURNS}, {checked_sql('tn', 'ck')}"


@query(CHECKED + " SELECT id, text, array_to_string(list_filter(valid, lambda x, i: list_position(valid, x) = i), ',') AS used, array_to_string(removed, ',') AS removed, len(valid) > 0 AS accepted FROM ck")
def citation_validate(spark, folder):
    rows = turns(spark, folder).select("id", ANS.validated(F.col("text"), F.col("n_sources")).alias("v"))
    return rows.select("id", "v.text", F.array_join("v.used", ",").alias("used"), F.array_join("v.removed", ",").alias("removed"), (F.size("v.used") > 0).alias("accepted"))


ACTIONS = f"""WITH {TURNS}, ln AS (SELECT id, n_sources, unnest(list_transform(l, lambda x, i: {{'pos': i, 'line': regexp_replace(x, '^\\s+|\\s+$', '', 'g')}}), recursive := true) FROM (SELECT *, string_split_regex(text, '{ANS.LINE_END}') AS l FROM tn)),
bl AS (SELECT id, n_sources, pos, regexp_replace(line, '{ANS.BULLET}', '') AS text FROM ln WHERE regexp_matches(line, '{ANS.BULLET}')), {checked_sql('bl', 'ck')},
ac AS (SELECT id, pos, regexp_extract(text, '{ANS.ENDING}', 1) AS ending, regexp_replace(regexp_replace(regexp_replace(text, '{ANS.ENDING}', ''), '^\\s+|\\s+$', '', 'g'), '[.;,]+$', '') AS action FROM ck)
SELECT id, place, action, array_to_string(regexp_extract_all(ending, '[0-9]+'), ',') AS citations FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS place FROM ac WHERE ending <> '' AND action <> '') WHERE place <= 5"""


@query(ACTIONS)
def actions_parse(spark, folder):
    return ANS.actions(turns(spark, folder)).withColumn("citations", F.array_join("citations", ","))


@query(f"WITH {TURNS} SELECT id, id % 3 <> 0 AS answerable, CASE WHEN id % 3 <> 0 THEN regexp_replace(regexp_replace(text || chr(10), '^\\s+', ''), '\\**\\s*$', '') ELSE '' END AS answer, CASE WHEN id % 3 <> 0 THEN '- go [S1]' ELSE '' END AS actions FROM tn")
def stream_fold(spark, folder):
    whole = turns(spark, folder).select("id", F.concat(F.when(F.col("id") % 3 == 0, "ANSWERABLE: NO\n").otherwise("ANSWERABLE: YES\n"), F.col("text"), F.lit("\nACTIONS: - go [S1]")).alias("text"))
    pieces = whole.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\s\S]{1,7}"), F.lit(0))).alias("seq", "piece"))
    return ANS.fold_streams(pieces)


def structured(spark, folder, version: int = 1):
    """Documents as numbered rule texts: two headings, clauses and items cut from the text's lines."""
    line = F.expr("transform(filter(split(text, '[.\\n]'), x -> trim(x) <> ''), x -> trim(x))")
    docs = spread(P.policy_documents(spark, folder).select("id", "circular_no", "issue_date", "doc_type", "text")).select("id", "circular_no", "issue_date", "doc_type", line.alias("l"))
    numbered = F.transform("l", lambda x, i: F.when(i % 9 == 8, F.concat(F.lit("(a) "), x)).otherwise(F.concat((i / 6 + 1).cast("int").cast("string"), F.lit("."), (i % 6 + version).cast("string"), F.lit(" "), x)))
    headed = F.flatten(F.transform(numbered, lambda x, i: F.when(i % 6 == 0, F.array(F.concat((i / 6 + 1).cast("int").cast("string"), F.lit(". TUJUAN DAN PEMAKAIAN")), x)).otherwise(F.array(x))))
    return docs.select("id", F.lit(1).alias("page"), "circular_no", "issue_date", "doc_type", F.array_join(headed, "\n").alias("text"))


#: what chunking the generated rule texts must give, from the lines' places: six lines a section, sections 1 to 99 numbered
RULES = POL + """, ln AS (SELECT id, circular_no, unnest(list_transform(l, lambda x, k: {'i': k - 1, 'x': x}), recursive := true) FROM (SELECT id, circular_no, list_filter(list_transform(string_split_regex(text, '[.\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM pd WHERE doc_type <> 'minutes')),
lp AS (SELECT id, circular_no, i, i // 6 + 1 AS sec, i % 9 = 8 AS item, CASE WHEN i % 9 = 8 THEN '(a) ' || x ELSE (i // 6 + 1) || '.' || (i % 6 + 1) || ' ' || x END AS line FROM ln),
pu AS (SELECT *, CASE WHEN sec > 99 THEN 592 WHEN item THEN i - 1 ELSE i END AS u,
 CASE WHEN sec > 99 AND i % 6 = 0 THEN ' ' || sec || '. TUJUAN DAN PEMAKAIAN' ELSE '' END || CASE WHEN item THEN chr(10) WHEN sec > 99 THEN ' ' ELSE '' END || line AS piece FROM lp),
un AS (SELECT id, circular_no, u, u // 6 + 1 AS sec, (u // 6 + 1) || '.' || (u % 6 + 1) AS ref, string_agg(piece, '' ORDER BY i) AS text FROM pu GROUP BY ALL),
wd AS (SELECT *, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words FROM un),
gr AS (SELECT id, sec, list(u ORDER BY u) AS us, list_reduce(list([CAST(words AS BIGINT)] ORDER BY u), lambda a, w: CASE WHEN a[1] > 0 AND a[1] + w[1] > 500 THEN [w[1], a[2] + 1] || a[3:] || [a[2] + 1] ELSE [a[1] + w[1], a[2]] || a[3:] || [a[2]] END, [CAST(0 AS BIGINT), CAST(0 AS BIGINT)])[3:] AS gs FROM wd GROUP BY 1, 2),
gu AS (SELECT id, unnest(us) AS u, unnest(gs) AS g FROM gr),
ch AS (SELECT id, circular_no, sec, g, min_by(ref, u) AS lo, max_by(ref, u) AS hi, string_agg(text, chr(10) ORDER BY u) AS body FROM wd JOIN gu USING (id, u) GROUP BY ALL),
cr AS (SELECT *, CASE WHEN lo = hi THEN lo ELSE lo || '-' || hi END AS clause_ref FROM ch)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY sec, g) - 1 AS chunk_index, clause_ref, circular_no || ' > Tujuan Dan Pemakaian > ' || clause_ref AS breadcrumb, 1 AS page_start, 1 AS page_end, sec || '. TUJUAN DAN PEMAKAIAN' || chr(10) || body AS text FROM cr"""


@query(RULES)
def chunk_rules(spark, folder, about=None):
    from quillstone.operators.chunking import chunk_rules as run

    rows = structured(spark, folder).where(~F.col("doc_type").eqNullSafe("minutes"))
    return run(rows.select("id", "page", "text"), rows.select("id", "circular_no"), about)


MINUTES = POL + f""", mn AS (SELECT id, circular_no || ' (' || {P.malay_sql('issue_date')} || ')' AS lead, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' ') AS body FROM pd WHERE doc_type = 'minutes'),
mw AS (SELECT id, lead, string_split('PERKARA 1: Laporan' || chr(10) || body, ' ') AS w FROM mn WHERE body <> ''),
mu AS (SELECT id, 1 AS unit, 0 AS k, 'Kehadiran' AS clause_ref, lead || ' > Kehadiran' AS breadcrumb, 'KEHADIRAN: all' AS text FROM mn
 UNION ALL SELECT id, 2, k, 'Perkara 1', lead || ' > Perkara 1: Laporan', array_to_string(w[500 * k + 1:500 * k + 500], ' ') FROM (SELECT *, unnest(range(0, (len(w) - 1) // 500 + 1)) AS k FROM mw)
 UNION ALL SELECT id, 3, 0, 'Perkara 1 - Keputusan', lead || ' > Perkara 1: Laporan > Keputusan', 'PERKARA 1: Laporan - KEPUTUSAN: setuju' FROM mn
 UNION ALL SELECT id, 4, 0, 'Perkara 1 - Tindakan', lead || ' > Perkara 1: Laporan > Tindakan', 'PERKARA 1: Laporan - TINDAKAN: Unit A laksana' FROM mn)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY unit, k) - 1 AS chunk_index, clause_ref, breadcrumb, 1 AS page_start, 1 AS page_end, text FROM mu"""


@query(MINUTES)
def chunk_minutes(spark, folder):
    from quillstone.operators.chunking import chunk_minutes as run

    rows = P.policy_documents(spark, folder).where("doc_type = 'minutes'")
    text = F.concat(F.lit("KEHADIRAN: all\nPERKARA 1: Laporan\n"), F.coalesce("text", F.lit("")), F.lit("\nKEPUTUSAN: setuju\nTINDAKAN: Unit A\nlaksana"))
    return run(rows.select("id", F.lit(1).alias("page"), text.alias("text")), rows.select("id", "circular_no", "issue_date"))


@query(MINUTES.replace("\nSELECT id, row_number()", "\nSELECT id, chunk_index FROM (SELECT id, row_number()") + ") WHERE (id + chunk_index) % 7 = 0")
def unembedded_chunks(spark, folder):
    """Chunks that have no vector yet; every seventh one."""
    chunks = chunk_minutes(spark, folder).select("id", "chunk_index")
    vectors = chunks.where("(id + chunk_index) % 7 <> 0")
    return chunks.join(vectors, ["id", "chunk_index"], "left_anti")


EMBED = f"""WITH w AS (SELECT id, word, count(*) AS n FROM (SELECT doc_id AS id, unnest({tokens_sql('text')}) AS word FROM documents) GROUP BY ALL),
f AS (SELECT id, '=' || word AS f, 2.0 * n AS weight FROM w UNION ALL SELECT id, '~' || substr('^' || word || '$', i, 3), 0.5 * n FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
b AS (SELECT id, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % 1024 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(f), 9, 1) AS INTEGER) % 2 = 0 THEN weight ELSE -weight END) AS v FROM f GROUP BY ALL HAVING v <> 0),
u AS (SELECT id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM b UNION ALL SELECT doc_id, 0, 1.0 FROM documents WHERE doc_id NOT IN (SELECT id FROM w))
SELECT id, count(*) AS n_set, md5(string_agg(bucket || ':' || CAST(round(v * 10000) AS BIGINT), ',' ORDER BY bucket)) AS vector_md5 FROM u GROUP BY 1"""


@query(EMBED)
def hash_embed(spark, folder):
    from quillstone.operators.changes import hash_embed as run

    # doubles: a float's last digits can turn the rounding
    rows = run(texts(spark, folder).select(F.col("doc_id").alias("id"), "text"), "double")
    entry = lambda x, i: F.when(x != 0, F.concat(i.cast("string"), F.lit(":"), F.round(x * 10000).cast("long").cast("string")))
    entries = F.filter(F.transform("embedding", entry), lambda x: x.isNotNull())
    return rows.select("id", F.size(entries).cast("long").alias("n_set"), F.md5(F.array_join(entries, ",").cast("binary")).alias("vector_md5"))
