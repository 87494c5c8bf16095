"""Questions rewritten for retrieval: references, hints, long forms, and terms of a glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import QUERY_REFERENCE, STOPWORDS, fold, references, words

#: words that ask for former rules, or for one side; fixed values
HISTORY = r"(?i)\b(dahulu|terdahulu|sebelum ini|(?:peraturan|pekeliling|kadar|had|versi) lama|dibatalkan|sejarah|previous|older|old (?:rule|circular|rate|limit|version)s?|cancelled|history|historical)\b"
STATE, FEDERAL = r"(?i)\b(sarawak|negeri sarawak|perkhidmatan awam negeri|state service)\b", r"(?i)\b(persekutuan|federal)\b"
#: long names of series; fixed values
LONG_FORMS = {"PP": "Pekeliling Perkhidmatan", "SPP": "Surat Pekeliling Perkhidmatan", "PAS": "Pekeliling Am Sarawak", "PB": "Pekeliling Perbendaharaan", "SE": "Surat Edaran"}
SHORT_REFERENCE = r"^([A-Z]+)\s+(\d+)/(\d{4})$"


def asked_references(c: Column) -> Column:
    """References of a question in their short form, those in short form first, each once."""
    return F.array_distinct(F.concat(references(c, QUERY_REFERENCE), references(c)))


def long_form(ref: Column) -> Column:
    """How documents cite each other; null for series without a long name."""
    names = F.create_map(*(F.lit(x) for item in LONG_FORMS.items() for x in item))
    name = F.try_element_at(names, F.regexp_extract(ref, SHORT_REFERENCE, 1))
    return F.concat(name, F.lit(" Bilangan "), F.regexp_extract(ref, SHORT_REFERENCE, 2), F.lit(" Tahun "), F.regexp_extract(ref, SHORT_REFERENCE, 3))


def glossary_terms(questions: DataFrame, glossary: DataFrame) -> DataFrame:
    """(qid, expansions): terms of the entries that a question names, less those it holds. glossary: entry, place, term.

    An entry's name is one of its terms.  Terms may have several words: candidates come from an equal join on a term's
    first word, then the folded text decides.
    """
    folded = questions.select("qid", F.concat(F.lit(" "), fold(F.col("text")), F.lit(" ")).alias("q"))
    named = glossary.select("entry", F.lit(0).alias("place"), F.col("entry").alias("term")).distinct().unionByName(glossary.select("entry", "place", "term"))
    named = named.select("entry", "place", "term", fold(F.col("term")).alias("plain"))
    first = F.get(F.regexp_extract_all("plain", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lit(0))
    spoken = folded.select("qid", "q", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word"))
    padded = F.regexp_replace("q", r"[^\p{L}\p{N}_]", " ")
    hit = spoken.join(named.withColumn("word", first), "word").where(F.contains(padded, F.concat(F.lit(" "), F.regexp_replace("plain", r"[^\p{L}\p{N}_]", " "), F.lit(" ")))).select("qid", "q", "entry").distinct()
    more = hit.join(named, "entry").where(~F.contains("q", "plain")).groupBy("qid", "term").agg(F.min(F.struct("entry", "place")).alias("k"))
    return more.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("expansions"))


def rewritten(questions: DataFrame, glossary: DataFrame) -> DataFrame:
    """One row a question (qid, text): references, hints, topic, keyword query, expansions, and what is embedded."""
    spoken = F.filter(words(F.col("text")), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))
    rows = questions.join(glossary_terms(questions, glossary), "qid", "left").withColumn("w", spoken).withColumn("refs", asked_references(F.col("text")))
    side = F.when(F.col("text").rlike(STATE), "SARAWAK").when(F.col("text").rlike(FEDERAL), "FEDERAL")
    query = F.array_join(F.slice("w", 1, 5), " ")
    longer = F.filter(F.transform("refs", long_form), lambda x: x.isNotNull())
    expansions = F.concat(F.coalesce("expansions", F.array().cast("array<string>")), longer)
    return rows.select(
        "qid", "refs", side.alias("jurisdiction_hint"), F.array_join(F.slice("w", 1, 3), " ").alias("topic"), query.alias("query"),
        F.col("text").rlike(HISTORY).alias("wants_history"), expansions.alias("expansions"), F.trim(F.concat_ws("\n", "text", F.nullif(query, F.lit("")))).alias("embedding_text"),
        F.concat_ws(" ", "text", F.nullif(query, F.lit("")), F.nullif(F.array_join(expansions, " "), F.lit(""))).alias("rerank_text"),
    )
