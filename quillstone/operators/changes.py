"""Clause changes between two versions of a document, their summaries, and the hashed embedding that aligns clauses."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import clause_key, tokens
from quillstone.operators.diffing import shares, word_changes
from quillstone.operators.validity import cut

#: size of embeddings, least share of equal characters under one number, least cosine of renumbered clauses; fixed values
DIM, SAME_NUMBER, SAME_MEANING = 1024, 0.4, 0.80
#: a numbered clause's line; fixed format
CLAUSE = r"^(\d{1,2}(?:\.\d{1,2})*)\.?\s+(.+)$"
#: how an amendment speaks of its clause, and characters of its evidence that find the clause; fixed values
AMENDING, LEAD = "dipinda|pindaan", 40
#: texts whose vectors a worker holds
HELD = 500


def clauses(texts: DataFrame) -> DataFrame:
    """(id, ref, text): numbered lines; what follows a numbered heading is its clause. texts: id, text."""
    rows = texts.select("id", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("line", F.trim("raw"))
    number = F.regexp_extract("line", CLAUSE, 1)
    body = F.regexp_extract("line", CLAUSE, 2)
    heading = (number != "") & (F.upper(body) == body) & body.rlike(r"\p{L}")
    rows = rows.withColumn("mark", F.when(number != "", F.when(heading, number).otherwise("")))
    under = F.last("mark", ignorenulls=True).over(Window.partitionBy("id").orderBy("at"))
    rows = rows.withColumn("ref", F.when((number != "") & ~heading, number).when((number == "") & (under != ""), under))
    kept = rows.where("ref is not null").withColumn("text", F.when(number != "", body).otherwise(F.col("line")))
    parts = kept.groupBy("id", "ref").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return parts.select("id", "ref", F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"))


#: letters of words and the marks of their ends
LETTERS = "^$0123456789abcdefghijklmnopqrstuvwxyz"
#: features that are summed at a time
SUMMED = 2_000_000


def features(names: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and signs of features."""
    digests = np.frombuffer(b"".join(hashlib.md5(n.encode()).digest() for n in names), np.uint8).reshape(-1, 16)
    return digests[:, :4].copy().view(">u4")[:, 0].astype(np.int64) % DIM, 1.0 - 2.0 * (digests[:, 4] >> 4 & 1)


@functools.cache
def triples() -> tuple[np.ndarray, np.ndarray]:
    """:func:`features` of all triples of letters, in order."""
    return features("~" + "".join(t) for t in itertools.product(LETTERS, repeat=3))


def unit_rows(texts: pa.ListArray) -> np.ndarray:
    """The unit vectors of texts, lists of words of a-z and 0-9; without any word, the first unit vector.

    A word itself weighs 2, each triple of its letters, with its ends, a half.  A batch's words are hashed once each, and
    all triples of letters once a worker; sums of halves are exact, whatever their order.
    """
    out, coded = np.zeros((len(texts), DIM)), texts.flatten().dictionary_encode()
    if len(coded):
        known, word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy())
        size = np.fromiter(map(len, known), np.int64, len(known))
        start = np.cumsum(size + 2) - size - 2
        codes = np.zeros(128, np.int64)
        codes[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(len(LETTERS))
        line = codes[np.frombuffer(f"^{'$^'.join(known)}$".encode(), np.uint8)]
        at = (line[:-2] * len(LETTERS) + line[1:-1]) * len(LETTERS) + line[2:]
        buckets, weights = triples()[0][at], 0.5 * triples()[1][at]
        # a word's triples start at each of its letters' places but the last; there, its own feature stands
        buckets, weights = np.append(buckets, 0), np.append(weights, 0)
        buckets[start + size], own = features(f"={w}" for w in known)
        weights[start + size] = 2.0 * own
        n = (size + 1)[word]
        ends = np.cumsum(n)
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(SUMMED, int(ends[-1]), SUMMED)), len(word)])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            some = n[lo:hi]
            place = np.repeat(start[word[lo:hi]] - np.cumsum(some) + some, some) + np.arange(some.sum())
            out += np.bincount(np.repeat(row[lo:hi] * DIM, some) + buckets[place], weights[place], out.size).reshape(out.shape)
    norm = np.sqrt(np.sum(out**2, axis=1))
    out[norm == 0, 0] = 1
    return out / np.where(norm == 0, 1, norm)[:, None]


def unit_vector(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values that are not 0 of the unit vector of some words."""
    row = unit_rows(pa.array([words], pa.list_(pa.string())))[0]
    return np.flatnonzero(row), row[row != 0]


def text_words(text: Column) -> Column:
    return F.coalesce(tokens(text), F.array().cast("array<string>"))


def hashed(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, buckets, weights): the unit vectors of texts (key, text), as the entries that are not 0.

    Words are told apart by Spark; features are hashed and summed where the rows are, so nothing is shuffled.
    """
    rows = texts.select(*key, text_words(F.col("text")).alias("words"))
    schema = T.StructType([*(texts.schema[c] for c in key), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, HELD) for b in batches for a in range(0, b.num_rows, HELD)):
            made = unit_rows(batch.column("words"))
            row, bucket = np.nonzero(made)
            offsets = pa.array(np.searchsorted(row, np.arange(len(made) + 1)), pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((bucket, pa.int32()), (made[row, bucket], pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), *arrays], [*key, "buckets", "weights"])

    return rows.mapInArrow(work, schema)


def hash_vectors(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, bucket, value): one row for each entry of :func:`hashed`."""
    return hashed(texts, key).select(*key, F.inline(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("weights").alias("value"))))


def hash_embed(texts: DataFrame, kind: str = "float", key: tuple[str, ...] = ("id",)) -> DataFrame:
    """(key, embedding) of (key, text): :func:`hashed` with the zeros between its entries."""
    rows = hashed(texts, [*key])
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    before = lambda i: F.when(i > 0, F.get("buckets", i - 1)).otherwise(-1)
    filled = F.transform(F.arrays_zip("buckets", "weights"), lambda x, i: F.concat(zeros(x["buckets"] - before(i) - 1), F.array(x["weights"])))
    dense = F.flatten(F.concat(filled, F.array(zeros(DIM - 1 - F.element_at("buckets", -1)))))
    return rows.select(*key, dense.cast(f"array<{kind}>").alias("embedding"))


@F.pandas_udf(T.BooleanType())
def same_number(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([shares(a, b, SAME_NUMBER) for a, b in zip(old, new)], dtype="bool")


@F.pandas_udf(T.ArrayType(T.StringType()))
def inline_changes(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for old, new in pairs:
        yield pd.Series([word_changes(a, b) for a, b in zip(old, new)], dtype=object)


NEAR = "score double, old_ref string, new_ref string"


def one_to_one(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a pair's (score, old_ref, new_ref), the likeliest first, then by numbers, those that are free on both sides."""
    number = lambda ref: tuple(map(int, ref.split(".")))
    order = sorted(range(len(frame)), key=lambda k: (-frame["score"].iat[k], number(frame["old_ref"].iat[k]), number(frame["new_ref"].iat[k])))
    old, new, kept = set(), set(), []
    for k in order:
        a, b = frame["old_ref"].iat[k], frame["new_ref"].iat[k]
        if a not in old and b not in new:
            old.add(a)
            new.add(b)
            kept.append(k)
    return frame.iloc[kept]


def clause_changes(old: DataFrame, new: DataFrame, scope_pairs: DataFrame | None = None) -> DataFrame:
    """Changes between texts of (id, text) with equal ids: pair, clause_old, clause_new, kind, old_text, new_text, inline.

    Stated pairs (pair, old_ref, new_ref) come first, then equal numbers whose texts share enough characters, then the
    nearest in meaning, one to one; what is left was removed or added.  Clauses meet by equal joins on the pair of
    documents and the number or an entry of their vectors; a pair's clauses are at most 100 to the depth of their numbers.
    Where an amendment states pairs, it changes these alone: the rest of the old text still applies.
    """
    # each is read by many joins, and small beside the texts
    a = cut(clauses(old).select(F.col("id").alias("pair"), F.col("ref").alias("old_ref"), F.col("text").alias("old_text")))
    b = cut(clauses(new).select(F.col("id").alias("pair"), F.col("ref").alias("new_ref"), F.col("text").alias("new_text")))
    found = None
    free_a, free_b = a, b
    if scope_pairs is not None:
        found = scope_pairs.join(a.select("pair", "old_ref"), ["pair", "old_ref"], "left_semi").join(b.select("pair", "new_ref"), ["pair", "new_ref"], "left_semi").select("pair", "old_ref", "new_ref")
        free_a, free_b = a.join(found, ["pair", "old_ref"], "left_anti"), b.join(found, ["pair", "new_ref"], "left_anti")
    same = free_a.join(free_b.withColumn("old_ref", F.col("new_ref")), ["pair", "old_ref"])
    same = same.where(same_number("old_text", "new_text")).select("pair", "old_ref", "new_ref")
    found = cut(same if found is None else found.unionByName(same))
    free_a, free_b = a.join(found, ["pair", "old_ref"], "left_anti"), b.join(found, ["pair", "new_ref"], "left_anti")
    va = hash_vectors(free_a.withColumnRenamed("old_text", "text"), ["pair", "old_ref"]).withColumnRenamed("value", "x")
    vb = hash_vectors(free_b.withColumnRenamed("new_text", "text"), ["pair", "new_ref"]).withColumnRenamed("value", "y")
    # rounded, so that the order of a sum doesn't matter
    score = F.round(F.sum(F.col("x") * F.col("y")), 9)
    scores = va.join(vb, ["pair", "bucket"]).groupBy("pair", "old_ref", "new_ref").agg(score.alias("score")).where(F.col("score") >= SAME_MEANING)
    schema = T.StructType([a.schema["pair"], *T.StructType.fromDDL(NEAR)])
    near = scores.select("pair", "score", "old_ref", "new_ref").groupBy("pair").applyInPandas(one_to_one, schema).drop("score")
    found = cut(found.unionByName(near))
    both = found.join(a, ["pair", "old_ref"]).join(b, ["pair", "new_ref"]).where("old_text <> new_text")
    blank, none = F.lit(""), F.array().cast("array<string>")
    changed = both.select("pair", F.col("old_ref").alias("clause_old"), F.col("new_ref").alias("clause_new"), F.lit("CHANGED").alias("kind"), "old_text", "new_text", inline_changes("old_text", "new_text").alias("inline"))
    gone = a.join(found, ["pair", "old_ref"], "left_anti").select("pair", F.col("old_ref").alias("clause_old"), F.lit(None).cast("string").alias("clause_new"), F.lit("REMOVED").alias("kind"), "old_text", blank.alias("new_text"), none.alias("inline"))
    more = b.join(found, ["pair", "new_ref"], "left_anti").select("pair", F.lit(None).cast("string").alias("clause_old"), F.col("new_ref").alias("clause_new"), F.lit("ADDED").alias("kind"), blank.alias("old_text"), "new_text", none.alias("inline"))
    out = changed.unionByName(gone).unionByName(more)
    if scope_pairs is None:
        return out
    stated = scope_pairs.select("pair", F.col("old_ref").alias("clause_old"), F.col("new_ref").alias("clause_new")).distinct()
    free = out.join(stated.select("pair").distinct(), "pair", "left_anti")
    return free.unionByName(out.join(stated, ["pair", "clause_old", "clause_new"], "left_semi").select(*free.columns))


def placed(changes: DataFrame) -> DataFrame:
    """changes with their place in a pair: by clause number, the new one's if there is one."""
    order = F.struct(clause_key(F.coalesce("clause_new", "clause_old")), F.col("clause_old").isNull(), clause_key(F.col("clause_old")))
    return changes.withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy(order)))


def scope_pairs(relations: DataFrame, new: DataFrame) -> DataFrame:
    """(pair, old_ref, new_ref): clauses that an amendment's scope names, with the clause of the new text that amends them.

    relations: pair, scope, evidence. The holder is the first clause with the evidence's beginning, else the first that
    names one of the scope's clauses and speaks of amending.
    """
    targets = F.regexp_extract_all(F.coalesce("scope", F.lit("")), F.lit(r"\d{1,2}(?:\.\d{1,2})+"), F.lit(0))
    asked = relations.select("pair", targets.alias("targets"), F.substring("evidence", 1, LEAD).alias("lead")).where("size(targets) > 0")
    held = asked.join(clauses(new).withColumnRenamed("id", "pair"), "pair")
    by_text = F.coalesce((F.col("lead") != "") & F.contains("text", "lead"), F.lit(False))
    by_word = F.exists("targets", lambda t: F.contains(F.col("text"), t)) & F.col("text").rlike(AMENDING)
    order = F.struct(F.when(by_text, 0).otherwise(1), clause_key(F.col("ref")))
    holder = held.where(by_text | by_word).groupBy("pair").agg(F.min_by("ref", order).alias("new_ref"), F.first("targets").alias("targets"))
    return holder.select("pair", F.explode("targets").alias("old_ref"), "new_ref")


def change_summaries(changes: DataFrame, pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row a pair (pair, old_no, new_no): the changed clauses in order, and a sentence in both languages.

    known: pairs that have a summary, which are left out.
    """
    if known is not None:
        pairs = pairs.join(known.select("pair"), "pair", "left_anti")
    ref = F.coalesce("clause_new", "clause_old")
    listed = F.array_sort(F.collect_list(F.struct(clause_key(ref).alias("k"), ref.alias("ref"))))
    lists = changes.groupBy("pair").agg(F.count(F.lit(1)).alias("n_changes"), F.array_join(F.transform(listed, lambda x: x["ref"]), ", ").alias("listed"))
    rows = pairs.join(lists, "pair", "left").withColumn("listed", F.coalesce("listed", F.lit("-")))
    sentence = lambda verb, than: F.concat(F.col("new_no"), F.lit(f" {verb} "), F.col("listed"), F.lit(f" {than} "), F.col("old_no"), F.lit("."))
    return rows.select("pair", F.coalesce("n_changes", F.lit(0)).alias("n_changes"), sentence("mengubah perenggan", "berbanding").alias("summary_ms"), sentence("changes paragraphs", "compared with").alias("summary_en"))


def change_views(asked: DataFrame, summaries: DataFrame, docs: DataFrame, clearance: int) -> DataFrame:
    """What is shown of pairs (old_id, new_id): both numbers, the sentences, and the parts of the stored changes.

    summaries: old_doc_id, new_doc_id, summary_ms, summary_en, payload (JSON). code tells why nothing is shown: a document
    that isn't there or is above the clearance, or no summary of the pair.  A payload that can't be read has no clauses.
    """
    seen = docs.where(F.col("classification_level") <= clearance)
    old, new = (seen.select(F.col("id").alias(f"{w}_id"), F.col("circular_no").alias(f"{w}_no")) for w in ("old", "new"))
    rows = asked.join(old, "old_id", "left").join(new, "new_id", "left")
    own = summaries.select(F.col("old_doc_id").alias("old_id"), F.col("new_doc_id").alias("new_id"), "summary_ms", "summary_en", "payload", F.lit(True).alias("has"))
    rows = rows.join(own, ["old_id", "new_id"], "left")
    code = F.when(F.col("old_no").isNull() | F.col("new_no").isNull(), "DOCUMENT").when(F.col("has").isNull(), "SUMMARY").otherwise("OK")
    p = F.from_json("payload", "relation_type string, clauses array<string>, changes array<struct<clause_old:string,clause_new:string,kind:string>>, who_is_affected string, effective_date string")
    shown = lambda c: F.when(F.col("code") == "OK", c)
    rows = rows.withColumn("code", code).withColumn("p", p)
    fields = [shown(F.col(c)).alias(c) for c in ("old_no", "new_no", "summary_ms", "summary_en")]
    lists = [shown(F.coalesce(F.col("p")[c], F.array().cast(t))).alias(c) for c, t in (("clauses", "array<string>"), ("changes", "array<struct<clause_old:string,clause_new:string,kind:string>>"))]
    return rows.select("old_id", "new_id", "code", *fields, shown(F.col("p")["relation_type"]).alias("relation_type"), *lists, shown(F.col("p")["who_is_affected"]).alias("who_is_affected"), shown(F.col("p")["effective_date"]).alias("effective_date"))
