"""Readers: Parquet tables, page files, override and golden-set CSV, glossary and manifest JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: rows of tables that may be dealt anew
SPREAD_ROWS = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it is a small table in fewer files than cores: one task reads a file's row group.

    Larger tables, and those of many files, are read as they lie; nothing but the layout depends on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df.limit(SPREAD_ROWS + 1).count() <= SPREAD_ROWS:
        return df.repartition(cores)
    return df


def raw_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """Files of a folder as (path, length, content); only names that match the pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length", "content")


def text_pages(files: DataFrame) -> DataFrame:
    """Pages of text files, split at form feeds and numbered from 1; short pages keep a null text for recognition later."""
    pages = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("i", "raw"))
    return pages.select("path", (F.col("i") + 1).alias("number"), F.when(F.length("raw") >= 30, F.col("raw")).alias("text"), F.lit(False).alias("ocr"))


def overrides(spark: SparkSession, path: str, numbers: tuple[str, ...] = ("classification_level", "one_off")) -> DataFrame:
    """Metadata overrides by file: a blank cell means no override; the last row of a file wins."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    cells = raw.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.columns))
    cells = cells.select(*(F.col(c).try_cast("int").alias(c) if c in numbers else F.col(c) for c in cells.columns))
    last = cells.withColumn("__at", F.monotonically_increasing_id()).groupBy("file").agg(*(F.max_by(c, "__at").alias(c) for c in cells.columns if c != "file"))
    return last


def golden_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return rows.limit(limit) if limit else rows


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(entry, term) of a JSON object of lists; keys that start with an underscore, and values that are no lists, are left out."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    entries = text.select(F.explode("m").alias("entry", "terms")).where(~F.col("entry").startswith("_") & F.col("terms").startswith("["))
    return entries.select("entry", F.explode(F.from_json("terms", "array<string>")).alias("term"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def known_relations(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """Relations of a CSV file, by the numbers of documents (id, circular_no): what a merge of verified relations takes.

    Rows whose source isn't known are left out; a target that isn't known keeps its number.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"').csv(path)
    raw = raw.toDF(*(c.lstrip("\ufeff").strip() for c in raw.columns))
    cell = lambda c: F.nullif(F.trim(c), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.select(
        F.trim("source_circular_no").alias("source_no"), F.trim("target_circular_no").alias("target_ref_text"), F.upper(F.trim("relation_type")).alias("relation_type"),
        F.coalesce(cell("scope"), F.lit("whole")).alias("scope"), F.try_to_date(cell("effective_date"), "yyyy-MM-dd").alias("effective_date"),
        cell("evidence_text").alias("evidence"), cell("evidence_page").try_cast("int").alias("evidence_page"),
    )
    named = lambda a, b: docs.select(F.col("circular_no").alias(a), F.col("id").alias(b))
    return rows.join(named("source_no", "source_doc_id"), "source_no").join(named("target_ref_text", "target_doc_id"), "target_ref_text", "left").drop("source_no")
