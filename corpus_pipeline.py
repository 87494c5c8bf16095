"""A corpus pipeline of five stages: quality, near-duplicates, repeated substrings, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of docs, whatever their names.  No stage samples documents; the classifier is fitted on a bounded sample of labelled
rows.  A document whose doc_id is null is scored, stays as what it is in the two stages that compare documents, and is
packed with a null doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.components import cut
from quillstone.llm.memory import free_name
from quillstone.llm.neardup import near_duplicates
from quillstone.llm.packing import pack_in_order
from quillstone.llm.pii import drawn_key, pseudonymise
from quillstone.llm.quality import THRESHOLD, fit, score
from quillstone.llm.substrings import dedup_substrings
from quillstone.sources.tables import spread

#: the stages end in a packing that SQL can't express
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; an empty text is scored like any other."""
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs.columns, "score")
    return score(docs, machine, name=name).where(F.col(name) >= THRESHOLD).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; all rows of a kept id stay, and so do rows without an id."""
    gone = near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a smaller document has; a character that is cut goes with them."""
    # a prefix under which no column of docs has its name
    prefix = next(p for k in range(len(docs.columns) + 1) if not any(c.lower().startswith(p := f"__{k}_") for c in docs.columns))
    out = dedup_substrings(docs, carry=tuple(docs.columns), prefix=prefix, as_text=True)
    return with_sizes(out.withColumn("text", F.when(F.col(f"{prefix}n_removed") > 0, F.col(f"{prefix}kept")).otherwise(F.col("text"))), docs)


def with_sizes(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; a number in n_chars counts the characters of the new text."""
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType):
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_sizes(pseudonymise(docs, drawn_key(spark)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_in_order(docs)


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("substrings", substrings), ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else cut(docs), sf_dir)
    return docs
