"""Sentences of documents, and the references in them that may state a relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import has_trigger, references, relation_effect

#: a heading's line, a clause number before a line, and where sentences part; fixed formats
HEADING = r"^(\d{1,2}(?:\.\d{1,2})*\.?\s+)?[A-Z][A-Z0-9 ,'()/&\-]{2,}:?$"
CLAUSE, SENTENCE = r"^(\d{1,2}(?:\.\d{1,2})*\.?|\(\w{1,3}\))\s+", r"(?<=[.;:])\s+(?=[A-Z0-9(])"
#: types whose texts state no relations; fixed values
SILENT = ("minutes", "report")
BREAK = "\x01"


def sentences_of(c: Column) -> Column:
    """Sentences in order: headings and clause numbers part them and belong to none."""
    lines = F.filter(F.transform(F.split(F.translate(c, BREAK, " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.when(x.rlike(HEADING), BREAK).when(x.rlike(CLAUSE), F.concat(F.lit(BREAK), F.regexp_replace(x, CLAUSE, ""))).otherwise(x))
    blocks = F.split(F.array_join(marked, " "), BREAK)
    return F.filter(F.flatten(F.transform(blocks, lambda b: F.transform(F.split(F.trim(b), SENTENCE), lambda s: F.trim(s)))), lambda s: s != "")


def sentences(pages: DataFrame) -> DataFrame:
    """(id, page, at, sentence) of pages (id, page, text)."""
    return pages.select("id", "page", F.posexplode(sentences_of(F.col("text"))).alias("at", "sentence"))


def candidates(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, page, ref, sentence, relation): sentences that speak of an effect and name another document.

    docs: id, circular_no, doc_type. Minutes and reports state none; a sentence names a reference once.
    """
    speaking = docs.where(~F.col("doc_type").isin(*SILENT)).select("id", "circular_no")
    found = sentences(pages).where(has_trigger(F.col("sentence"))).join(speaking, "id")
    rows = found.select("id", "page", "circular_no", "sentence", F.explode(F.array_distinct(references(F.col("sentence")))).alias("ref")).where("ref <> circular_no")
    return rows.groupBy("id", "ref", "sentence").agg(F.min("page").alias("page")).select("id", "page", "ref", "sentence", relation_effect(F.col("sentence")).alias("relation"))
