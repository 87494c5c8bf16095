"""Policy views derived from the documents table by integer arithmetic on doc_id, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.tables import table

AS_OF, AS_OF_OLD = "2024-06-30", "2022-06-30"
SERIES = ("PP", "SPP", "SE", "PB", "PAS")
#: long names of the series; fixed values
LONG_SERIES = {"PP": "Pekeliling Perkhidmatan", "SPP": "Surat Pekeliling Perkhidmatan", "PB": "Pekeliling Perbendaharaan", "PAS": "Pekeliling Am Sarawak"}


def pick(n: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def circular_no(n: Column) -> Column:
    return F.concat(pick(n, SERIES), F.lit(" "), n.cast("string"), F.lit("/"), (2015 + n % 11).cast("string"))


def days(n: Column) -> Column:
    return n.cast("int")


def policy_documents(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    issue = F.date_add(F.lit("2015-01-01").cast("date"), days(n * 37 % 4200))
    kind = F.when(n % 10 == 0, "minutes").when(n % 10 == 1, "report").when(n % 10 == 2, "sop").when(n % 10 == 3, "guideline").when(n % 10 == 4, "policy").otherwise("circular")
    return table(spark, folder, "documents").select(
        n.alias("id"), pick(n, SERIES).alias("series"), circular_no(n).alias("circular_no"), kind.alias("doc_type"),
        F.when(F.col("lang") == "en", "FEDERAL").when(F.col("lang") == "fr", "SARAWAK").when(F.col("lang") == "de", "FEDERAL_SARAWAK").otherwise("UNKNOWN").alias("jurisdiction"),
        F.col("source").alias("cluster"), issue.alias("issue_date"),
        F.when(n % 11 != 0, F.date_add(issue, days(n % 60))).alias("effective_date"),
        F.when(n % 13 == 0, F.date_add(issue, days(365 * (1 + n % 5)))).alias("expiry_date"),
        (n % 17 == 0).alias("one_off"),
        F.when(n % 10 == 9, 1).when(n % 50 == 48, 2).otherwise(0).alias("classification_level"), "text",
    )


def policy_relations(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    target = n - 1 - n % 7
    issue = F.date_add(F.lit("2015-01-01").cast("date"), days(n * 37 % 4200))
    return table(spark, folder, "documents").where((n % 3 == 0) & (n >= 8)).select(
        n.alias("id"), n.alias("source_doc_id"), F.when(n % 19 != 0, target).alias("target_doc_id"),
        circular_no(target).alias("target_ref_text"), pick(n, ("SUPERSEDES", "CANCELS", "AMENDS", "REFERENCES")).alias("relation_type"),
        F.when(n % 8 == 2, F.concat(F.lit("clauses: "), (1 + n % 9).cast("string"), F.lit(".1"))).otherwise("whole").alias("scope"),
        F.when(n % 6 == 0, F.date_add(issue, days(n % 400))).alias("effective_date"),
        F.when(n % 5 == 0, 0).when(n % 23 == 0, -1).otherwise(1).alias("verified"), ((n % 10) / 10).alias("confidence"),
    )


def policy_clauses(spark: SparkSession, folder: str) -> DataFrame:
    n, k = F.col("doc_id"), F.col("doc_id") - 1 - F.col("doc_id") % 7
    year = (2015 + k % 11).cast("string")
    long = F.when(k % 5 == 2, F.concat(F.lit("SE Bil. "), k.cast("string"), F.lit("/"), year)).otherwise(
        F.concat(pick(k, ("Pekeliling Perkhidmatan", "Surat Pekeliling Perkhidmatan", "", "Pekeliling Perbendaharaan", "Pekeliling Am Sarawak")), F.lit(" Bilangan "), k.cast("string"), F.lit(" Tahun "), year)
    )
    ending = pick(n, ("adalah digantikan.", "adalah dibatalkan.", "adalah dipinda.", "dirujuk."))
    return table(spark, folder, "documents").where((n % 3 == 0) & (n >= 8)).select(n.alias("id"), n.alias("document_id"), (1 + n % 3).cast("int").alias("page"), F.concat(long, F.lit(" "), ending).alias("text"))


def search_log(spark: SparkSession, folder: str) -> DataFrame:
    """The events table read as a log of queries."""
    v = F.col("value")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), (F.col("event_type") != "error").alias("answerable"),
        F.col("event_type").alias("topic"), F.when(v < 20, "LOW").when(v < 60, "MEDIUM").otherwise("HIGH").alias("confidence"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("cluster"),
        F.concat(F.lit("question "), (F.col("event_id") % 37).cast("string")).alias("query"),
        F.from_json("props", "k long")["k"].alias("doc_ref"), v.alias("latency"), "props",
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, folder, "events").select("user_id").distinct().select(
        u.alias("id"), F.when(u % 10 == 0, "PUBLISHER").otherwise("OFFICER").alias("role"), (u % 3).cast("int").alias("clearance_level"),
        F.concat(F.lit("src"), (u % 20).cast("string")).alias("sub_cluster"), circular_no(u).alias("sub_circular"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, text): the benchmark's texts, every fourth one with the number of a document."""
    n = F.col("item_id") * 5
    named = F.concat(F.lit(" PP "), n.cast("string"), F.lit("/"), (2015 + n % 11).cast("string"))
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.concat("text", F.when(F.col("item_id") % 4 == 0, named).otherwise("")).alias("text"))


QUESTIONS = "qs AS (SELECT item_id AS qid, text || CASE WHEN item_id % 4 = 0 THEN ' PP ' || (item_id * 5) || '/' || (2015 + item_id * 5 % 11) ELSE '' END AS text FROM benchmark)"

POL = """
WITH pd AS (
  SELECT doc_id AS id, ['PP','SPP','SE','PB','PAS'][doc_id % 5 + 1] AS series,
    ['PP','SPP','SE','PB','PAS'][doc_id % 5 + 1] || ' ' || doc_id || '/' || (2015 + doc_id % 11) AS circular_no,
    CASE doc_id % 10 WHEN 0 THEN 'minutes' WHEN 1 THEN 'report' WHEN 2 THEN 'sop' WHEN 3 THEN 'guideline' WHEN 4 THEN 'policy' ELSE 'circular' END AS doc_type,
    CASE lang WHEN 'en' THEN 'FEDERAL' WHEN 'fr' THEN 'SARAWAK' WHEN 'de' THEN 'FEDERAL_SARAWAK' ELSE 'UNKNOWN' END AS jurisdiction,
    source AS "cluster", DATE '2015-01-01' + CAST(doc_id * 37 % 4200 AS INTEGER) AS issue_date,
    CASE WHEN doc_id % 11 <> 0 THEN DATE '2015-01-01' + CAST(doc_id * 37 % 4200 + doc_id % 60 AS INTEGER) END AS effective_date,
    CASE WHEN doc_id % 13 = 0 THEN DATE '2015-01-01' + CAST(doc_id * 37 % 4200 + 365 * (1 + doc_id % 5) AS INTEGER) END AS expiry_date,
    doc_id % 17 = 0 AS one_off,
    CASE WHEN doc_id % 10 = 9 THEN 1 WHEN doc_id % 50 = 48 THEN 2 ELSE 0 END AS classification_level, text
  FROM documents),
pr AS (
  SELECT doc_id AS id, doc_id AS source_doc_id, CASE WHEN doc_id % 19 <> 0 THEN doc_id - 1 - doc_id % 7 END AS target_doc_id,
    ['PP','SPP','SE','PB','PAS'][(doc_id - 1 - doc_id % 7) % 5 + 1] || ' ' || (doc_id - 1 - doc_id % 7) || '/' || (2015 + (doc_id - 1 - doc_id % 7) % 11) AS target_ref_text,
    ['SUPERSEDES','CANCELS','AMENDS','REFERENCES'][doc_id % 4 + 1] AS relation_type,
    CASE WHEN doc_id % 8 = 2 THEN 'clauses: ' || (1 + doc_id % 9) || '.1' ELSE 'whole' END AS scope,
    CASE WHEN doc_id % 6 = 0 THEN DATE '2015-01-01' + CAST(doc_id * 37 % 4200 + doc_id % 400 AS INTEGER) END AS effective_date,
    CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 23 = 0 THEN -1 ELSE 1 END AS verified, (doc_id % 10) / 10 AS confidence
  FROM documents WHERE doc_id % 3 = 0 AND doc_id >= 8),
pc AS (
  SELECT doc_id AS id, doc_id AS document_id, CAST(1 + doc_id % 3 AS INTEGER) AS page,
    CASE WHEN (doc_id - 1 - doc_id % 7) % 5 = 2 THEN 'SE Bil. ' || (doc_id - 1 - doc_id % 7) || '/' || (2015 + (doc_id - 1 - doc_id % 7) % 11)
      ELSE ['Pekeliling Perkhidmatan','Surat Pekeliling Perkhidmatan','','Pekeliling Perbendaharaan','Pekeliling Am Sarawak'][(doc_id - 1 - doc_id % 7) % 5 + 1]
        || ' Bilangan ' || (doc_id - 1 - doc_id % 7) || ' Tahun ' || (2015 + (doc_id - 1 - doc_id % 7) % 11) END
      || ' ' || ['adalah digantikan.','adalah dibatalkan.','adalah dipinda.','dirujuk.'][doc_id % 4 + 1] AS text
  FROM documents WHERE doc_id % 3 = 0 AND doc_id >= 8),
lg AS (
  SELECT event_id AS id, user_id, ts AS created_at, event_type <> 'error' AS answerable, event_type AS topic,
    CASE WHEN value < 20 THEN 'LOW' WHEN value < 60 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, 'src' || (user_id % 20) AS "cluster",
    'question ' || (event_id % 37) AS query, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_ref, value AS latency, props FROM events),
us AS (
  SELECT DISTINCT user_id AS id, CASE WHEN user_id % 10 = 0 THEN 'PUBLISHER' ELSE 'OFFICER' END AS role, CAST(user_id % 3 AS INTEGER) AS clearance_level,
    'src' || (user_id % 20) AS sub_cluster, ['PP','SPP','SE','PB','PAS'][user_id % 5 + 1] || ' ' || user_id || '/' || (2015 + user_id % 11) AS sub_circular FROM events)
"""


def status_sql(name: str, as_of: str, where: str = "TRUE") -> str:
    """A common table expression with each document's status at a date."""
    return f"""
, {name}_in AS (
  SELECT r.target_doc_id AS id,
    max_by(s.circular_no, (COALESCE(r.effective_date, s.effective_date, s.issue_date), s.circular_no)) FILTER (r.relation_type IN ('CANCELS','SUPERSEDES') AND COALESCE(r.effective_date, s.effective_date, s.issue_date) <= DATE '{as_of}') AS canceller,
    string_agg(s.circular_no, ', ' ORDER BY r.id) FILTER (r.relation_type = 'AMENDS' AND COALESCE(COALESCE(r.effective_date, s.effective_date, s.issue_date) <= DATE '{as_of}', TRUE)) AS amenders
  FROM pr r JOIN pd s ON s.id = r.source_doc_id WHERE r.verified = 1 AND r.target_doc_id IS NOT NULL AND ({where.replace("pd.id", "s.id")}) GROUP BY 1),
{name} AS (
  SELECT d.*, CASE WHEN doc_type IN ('minutes','report') THEN 'RECORD' WHEN canceller IS NOT NULL THEN 'CANCELLED' WHEN one_off THEN 'ONE_OFF'
      WHEN expiry_date <= DATE '{as_of}' THEN 'CANCELLED' WHEN amenders IS NOT NULL THEN 'AMENDED' WHEN effective_date <= DATE '{as_of}' THEN 'IN_FORCE' ELSE 'UNKNOWN' END AS status,
    CASE WHEN doc_type IN ('minutes','report') THEN 'Rekod bertarikh ' || {{issue}} WHEN canceller IS NOT NULL THEN 'Dibatalkan oleh ' || canceller WHEN one_off THEN 'Sekali sahaja'
      WHEN expiry_date <= DATE '{as_of}' THEN 'Tamat tempoh' WHEN amenders IS NOT NULL THEN 'Dipinda oleh ' || amenders WHEN effective_date <= DATE '{as_of}' THEN 'Berkuat kuasa'
      WHEN effective_date IS NOT NULL THEN 'Belum berkuat kuasa (mulai ' || {{effective}} || ')' ELSE 'Belum disahkan' END AS status_reason
  FROM (SELECT * FROM pd WHERE {where}) d LEFT JOIN {name}_in USING (id))
""".replace("{issue}", malay_sql("issue_date")).replace("{effective}", malay_sql("effective_date"))


def malay_sql(column: str) -> str:
    return f"COALESCE(day({column}) || ' ' || ['Januari','Februari','Mac','April','Mei','Jun','Julai','Ogos','September','Oktober','November','Disember'][month({column})] || ' ' || year({column}), 'tarikh tidak diketahui')"
