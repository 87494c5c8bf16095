"""Evaluation of retrieval and answers against a golden set, by mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import clause_key

#: types of questions that should be refused, and the trap type; fixed values
REFUSING, TRAP = ("unanswerable", "access"), "trap_cancelled"
RANGE, NUMBER = r"^(\d+(?:\.\d+)*)-(\d+(?:\.\d+)*)$", r"^\d+(?:\.\d+)*$"
METRICS = ("recall_doc", "recall_clause", "mrr", "citation_accuracy", "cancelled_citations", "refusal_accuracy", "false_refusals", "leaks")


def clause_match(expected: Column, got: Column) -> Column:
    """Whether a passage's clause or range of clauses answers for the expected one; no expected clause always matches."""
    part = lambda c: F.substring_index(c, ".", 1)
    inside = (clause_key(F.regexp_extract(got, RANGE, 1)) <= clause_key(expected)) & (clause_key(expected) <= clause_key(F.regexp_extract(got, RANGE, 2)))
    whole = (part(expected) == part(got)) & ~got.contains(".")
    return (
        F.when(F.coalesce(expected, F.lit("")) == "", True)
        .when(F.coalesce(got, F.lit("")) == "", False)
        .when(got.startswith(expected) | expected.startswith(F.concat(got, F.lit(" "))), True)
        .when(got.rlike(RANGE) & expected.rlike(NUMBER), inside)
        .otherwise(whole)
    )


def scores(golden: DataFrame, sources: DataFrame, modes: tuple[str, ...], n: int = 5) -> DataFrame:
    """One row for each mode and question.

    golden: qid, type, expected_doc, expected_clause, must_not_cite, clearance. sources: mode, qid, place, circular_no,
    clause_ref, tier, cited. What has no expected document has null ranks; a question without sources is refused.
    """
    asked = golden.select("*", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    found = asked.join(sources, ["mode", "qid"], "left")
    has, first = F.col("expected_doc").isNotNull(), F.col("place") <= n
    hit = first & (F.col("circular_no") == F.col("expected_doc"))
    yes = lambda c: F.coalesce(F.max(c), F.lit(False))
    rows = found.groupBy("mode", "qid", "type", has.alias("has")).agg(
        F.min(F.when(hit, F.col("place"))).alias("rank"),
        yes(hit & clause_match(F.col("expected_clause"), F.col("clause_ref"))).alias("clause_hit"),
        yes(F.col("cited") & (F.col("circular_no") == F.col("expected_doc"))).alias("cited_expected"),
        yes(F.col("cited") & (F.col("circular_no") == F.col("must_not_cite"))).alias("cited_cancelled"),
        yes(F.col("tier") > F.col("clearance")).alias("leak"),
        (F.count("place") > 0).alias("answered"),
    )
    expected = lambda c: F.when(F.col("has"), c)
    return rows.select("mode", "qid", "type", "answered", "rank", expected(F.col("rank").isNotNull()).alias("recalled"), expected(F.col("clause_hit")).alias("clause_hit"), expected(F.col("cited_expected")).alias("cited_expected"), "cited_cancelled", "leak")


def summary(rows: DataFrame) -> DataFrame:
    """One row a mode: shares (null where nothing counts) and the number of leaks."""
    share = lambda c, where=None: F.round(F.avg((F.when(where, c) if where is not None else c).cast("double")), 6)
    has = F.col("recalled").isNotNull()
    should_refuse = F.col("type").isin(*REFUSING) | ((F.col("type") == TRAP) & ~has)
    return rows.groupBy("mode").agg(
        share(F.col("recalled")).alias("recall_doc"), share(F.col("clause_hit")).alias("recall_clause"),
        F.round(F.avg(F.when(has, F.coalesce(1 / F.col("rank"), F.lit(0.0)))), 6).alias("mrr"),
        share(F.col("cited_expected"), F.col("answered") & has).alias("citation_accuracy"), share(F.col("cited_cancelled"), F.col("type") == TRAP).alias("cancelled_citations"),
        share(~F.col("answered"), should_refuse).alias("refusal_accuracy"), share(~F.col("answered"), has).alias("false_refusals"), F.count_if("leak").cast("double").alias("leaks"),
    )


def by_mode(rows: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """One row a metric, one column a mode."""
    long = summary(rows).select("mode", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))).alias("x"))
    return long.select("mode", "x.*").groupBy("metric").pivot("mode", list(modes)).agg(F.first("value"))


def action_accuracy(actions: DataFrame, sources: DataFrame, golden: DataFrame) -> DataFrame:
    """(mode, n_actions, share): of the actions that answers advise, those that cite the expected document.

    actions: mode, qid, place, citations (numbers of sources); sources: mode, qid, place, circular_no; golden: qid, expected_doc.
    """
    cited = actions.select("mode", "qid", F.col("place").alias("action"), F.explode_outer("citations").alias("place"))
    rows = cited.join(sources.select("mode", "qid", "place", "circular_no"), ["mode", "qid", "place"], "left").join(golden.select("qid", "expected_doc"), "qid", "left")
    each = rows.groupBy("mode", "qid", "action").agg(F.coalesce(F.max(F.col("circular_no") == F.col("expected_doc")), F.lit(False)).alias("ok"))
    return each.groupBy("mode").agg(F.count(F.lit(1)).alias("n_actions"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("share"))


def write_results(rows: DataFrame, table: DataFrame, folder: str) -> None:
    """results (a row for each mode and question) and summary (a row for each metric) as CSV files with a header."""
    rows.orderBy("mode", "qid").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/results")
    table.orderBy("metric").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")
