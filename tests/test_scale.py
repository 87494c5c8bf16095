"""Results that larger tables could turn, and what the searches may hold or move, on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import changes, chunking, snapshots
from quillstone.operators import passages as S
from quillstone.operators import retrieval as R
from quillstone.plans import asking, catalogue, passages  # noqa: F401  the others add their queries to the catalogue's


def test_hashed_vectors_round_as_doubles(spark, tmp_path):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bcdfghk" for b in "aeiou" for c in "klmnrt"]
    texts = [[rng.choice(words) for _ in range(rng.randrange(20, 400))] for _ in range(1500)]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def digest(text, kind):
        at, value = changes.unit_vector(text)
        return hashlib.md5(",".join(f"{i}:{int(np.copysign(np.floor(abs(x) * 10000 + 0.5), x))}" for i, x in zip(at, value.astype(kind).astype(float))).encode()).hexdigest()

    plain = [[w for w in t if w not in catalogue.X.STOPWORDS] for t in texts]
    assert [digest(t, np.float32) for t in plain] != [digest(t, np.float64) for t in plain]
    got = {r.id: r.vector_md5 for r in catalogue.hash_embed(spark, str(tmp_path)).collect()}
    assert got == {i: digest(t, np.float64) for i, t in enumerate(plain)}


def some_chunks(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, " ".join(rng.choice(["cuti", "elaun", "gaji", "bonus", "rehat", f"x{i % 7}"]) for _ in range(i % 12)), "b") for i in range(300)]
    return spark.createDataFrame(rows, "chunk_id long, tier int, text string, breadcrumb string").repartition(5)


ASKED = [(1, "cuti rehat"), (2, "elaun x3 gaji"), (3, "tiada di sini"), (4, "yang dan"), (5, "bonus"), (None, "gaji")]


def test_best_scores_are_those_of_all_scores(spark):
    """In blocks of few texts and few queries at a time, and by joins, with ties and null ids."""
    chunks, asked = some_chunks(spark), spark.createDataFrame(ASKED, "qid long, text string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    want = rows(S.keyword_hits(S.keyword_scores(chunks, asked)))
    assert want and rows(S.keyword_top(chunks, asked)) == want
    docs = chunks.select(F.when(F.col("chunk_id") != 7, F.col("chunk_id")).alias("id"), "text")
    want = rows(R.top(R.bm25(docs, asked), "qid", 9, F.desc("score"), F.asc("id")).select("qid", "id", "score", "rank"))
    assert rows(R.bm25_top(docs, asked, 9)) == want
    index = R.postings(docs, R.asked_terms(asked).select("term").distinct())
    sizes = R.corpus_totals(index, docs.count()).withColumnRenamed("n_docs", "n")
    assert rows(R.best_scored(index, sizes, asked, 9, asked=2, block=40)) == want


def test_a_task_counts_no_more_texts_on_larger_tables(spark, monkeypatch):
    wanted = spark.createDataFrame([("cuti",)], "term string")
    monkeypatch.setattr(R, "TEXTS", 20)
    counted = R.wanted_counts(some_chunks(spark), ["chunk_id", "tier"], wanted)
    assert counted.rdd.getNumPartitions() == 15 and counted.count() == 300


def test_nearest_by_entries(spark, monkeypatch):
    chunks = some_chunks(spark)
    asked = S.chunk_vectors(chunks.where("chunk_id % 20 = 0")).selectExpr("chunk_id as qid", "vec as qvec")
    rows = lambda df: {tuple(r) for r in S.vector_hits(df, asked).collect()}
    want = rows(S.chunk_vectors(chunks))
    assert rows(S.chunk_entries(chunks)) == want
    monkeypatch.setattr(R, "BLOCK", 3000)
    assert rows(S.chunk_entries(chunks)) == want


def test_followers_hear_once(spark, monkeypatch):
    """Documents and users of several rows; in rounds of officers no pair is lost or told twice."""
    told = spark.createDataFrame([(1, "A 1", "STATUS_CHANGE", "s1"), (1, "A 1", "STATUS_CHANGE", "s2"), (2, "A 2", "ADDED", "s1"), (3, "A 3", "STATUS_CHANGE", None)], "id long, circular_no string, change string, cluster string")
    told = told.select("*", F.lit("t").alias("title"), F.lit("UNKNOWN").alias("old_status"), F.lit("IN_FORCE").alias("new_status"), F.lit("r").alias("status_reason"))
    users = spark.createDataFrame([(7, "s1", "A 2"), (7, "s2", "A 3"), (8, None, "A 1"), (9, "s1", "A 1")], "id long, sub_cluster string, sub_circular string").select("*", F.lit("OFFICER").alias("role"), F.lit(0).alias("clearance_level"))
    log = spark.createDataFrame([(8, "a 3?", 2), (9, "x", 2)], "user_id long, query string, doc_ref long").withColumn("created_at", F.current_timestamp())
    want = sorted([(7, 1)] * 2 + [(9, 1)] * 2 + [(7, 2), (9, 2), (7, 3), (8, 3)] + [(8, 1)] * 2)
    for most in (200_000, 1):
        monkeypatch.setattr(snapshots, "BROADCAST_ROWS", most)
        got = snapshots.notified(told, users, log, 0)
        assert sorted((r.user_id, r.document_id) for r in got.collect()) == want


def test_words_are_hashed_once_a_batch(spark, monkeypatch):
    """Unit vectors of many texts are those of a plain sum, whatever is summed at a time; no vector leaves a task of a search."""
    rng = random.Random(7)
    texts = [[rng.choice(["cuti", "a", "z9", f"w{rng.randrange(60_000)}"]) for _ in range(rng.randrange(40))] for _ in range(200)]
    want = np.zeros((len(texts), changes.DIM))
    for at, words in enumerate(texts):
        for name, weight in ((n, w) for x in words for n, w in [(f"={x}", 2.0), *(("~" + f"^{x}$"[i : i + 3], 0.5) for i in range(len(x)))]):
            digest = hashlib.md5(name.encode()).digest()
            want[at, int.from_bytes(digest[:4], "big") % changes.DIM] += weight if digest[4] >> 4 & 1 == 0 else -weight
        want[at] = want[at] / np.sqrt(np.sum(want[at] ** 2)) if want[at].any() else np.eye(1, changes.DIM)[0]
    changes.triples()
    hashes, plain = [], hashlib.md5
    monkeypatch.setattr(changes.hashlib, "md5", lambda x: (hashes.append(x), plain(x))[1])
    words = changes.pa.array(texts, changes.pa.list_(changes.pa.string()))
    assert (changes.unit_rows(words) == want).all() and len(hashes) == len({w for t in texts for w in t})
    monkeypatch.setattr(changes, "SUMMED", 50)
    assert (changes.unit_rows(words.slice(20, 90)) == want[20:110]).all()
    assert S.chunk_entries(some_chunks(spark)).columns == ["chunk_id", "tier", "words"]


@pytest.mark.parametrize("name", ["bm25_postfilter", "confidence_bands", "confidence_by_kind", "eval_retrieval", "eval_citations"])
def test_one_search_in_parts_of_texts(spark, data, monkeypatch, name):
    """The query's texts are counted once, in parts of so many texts, and no row for each question and text is ranked."""
    parts, counted, ranked = [], R.wanted_counts, R.top
    monkeypatch.setattr(R, "TEXTS", 10)

    def seen(*args):
        parts.append((out := counted(*args)).rdd.getNumPartitions())
        return out

    def least(df, *args, **more):
        assert "raw_rank" in df.columns or df.columns == ["qid", "id", "score"] and "MapInArrow" in df._jdf.queryExecution().toString()
        return ranked(df, *args, **more)

    monkeypatch.setattr(R, "wanted_counts", seen)
    monkeypatch.setattr(R, "top", least)
    catalogue.QUERIES[name](spark, data)
    assert parts == [20]


@pytest.mark.parametrize("name", ["confidence_bands", "eval_retrieval", "eval_citations"])
def test_texts_stay_where_they_lie(spark, data, name):
    """The documents' texts meet the few hits by a broadcast of the hits; nothing shuffles or sorts the texts for it."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = [spark.conf.get(x) for x in names]
    try:
        for x, value in zip(names, ("-1", "false")):
            spark.conf.set(x, value)
        lines = [re.sub(r"^[\s:+-]*(\*\(\d+\) )?", "", x) for x in catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString().splitlines()]
    finally:
        for x, value in zip(names, before):
            spark.conf.set(x, value)
    # of each scan of texts the first node above it that does more than choose rows and columns
    scans = [i for i, x in enumerate(lines) if x.startswith("FileScan") and "doc_id" in x and re.search(r"\btext#", x)]
    above = [next(x for x in reversed(lines[:i]) if not re.match("Project|Filter|ColumnarToRow", x)) for i in scans]
    assert above and all(x.startswith("BroadcastHashJoin") for x in above)


def plain_plan(spark, df):
    """The lines of the plan, as it is without broadcasts by size and changes while it runs."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = [spark.conf.get(x) for x in names]
    try:
        for x, value in zip(names, ("-1", "false")):
            spark.conf.set(x, value)
        return df().queryExecution().executedPlan().toString().splitlines()
    finally:
        for x, value in zip(names, before):
            spark.conf.set(x, value)


PAGES = [(i, p, "\n".join(["MUKA", "1. TUJUAN", f"1.1 satu {i}", "(a) dua", "kata " * (40 * i), f"1.2 {p} tiga", "PERKARA 1: LAPORAN", "isi", "KEPUTUSAN: ya"][i % 3 :])) for i in range(1, 12) for p in (2, 1)]


def test_pages_are_shuffled_once_for_chunks(spark):
    """Of each table that chunking joins one shuffle, and what is known of documents comes without another one of the texts."""
    pages = spark.createDataFrame([*PAGES, (None, 1, "1. A"), (12, 1, None)], "id long, page int, text string")
    numbers = spark.createDataFrame([(i, f"PP {i}/2020", None) for i in range(1, 14)], "id long, circular_no string, issue_date date")
    about = spark.createDataFrame([(i, i % 2) for i in range(1, 14, 2)] + [(3, 7)], "id long, tier int")
    for make, tables in ((chunking.chunk_rules, 2), (chunking.chunk_minutes, 2), (lambda *x: chunking.chunk_rules(*x, about), 3)):
        assert sum("Exchange" in x for x in plain_plan(spark, lambda: make(pages, numbers)._jdf)) == tables
    plain = chunking.chunk_rules(pages, numbers)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(chunking.chunk_rules(pages, numbers, about)) == rows(plain.join(about, "id"))
    # pages in their order, a unit over two pages, an item on its own line; sections of each page
    assert [(r.chunk_index, r.clause_ref, r.page_start, r.page_end, r.text[:40]) for r in plain.where("id = 4").orderBy("chunk_index").collect()] == [
        (0, "1.1-1.2", 1, 1, "1. TUJUAN\n1.1 satu 4\n(a) dua kata kata k"), (1, "1.1-1.2", 2, 2, "1. TUJUAN\n1.1 satu 4\n(a) dua kata kata k"),
    ]


@pytest.mark.parametrize("name", ["passage_keywords", "passage_context", "passage_retrieval", "passage_retrieval_baseline"])
def test_tables_with_texts_are_kept_small(spark, data, monkeypatch, name):
    """Chunks and their counted terms are written by columns, compressed; plain rows are left to small tables."""
    large, plain = [], type(spark.range(1)).checkpoint

    def seen(df, *args):
        large.extend({"text", "hits"} & set(df.columns) if "qid" not in df.columns else ())
        return plain(df, *args)

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", seen)
    catalogue.QUERIES[name](spark, data)
    assert not large


def test_followers_are_told_by_all_cores(spark, data):
    """The changes are dealt over all cores before their followers join them, and what is said of one is made before."""
    told = catalogue.notifications(spark, data)
    assert told.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    lines = plain_plan(spark, lambda: catalogue.notifications(spark, data)._jdf)
    join = next(i for i, x in enumerate(lines) if "BroadcastHashJoin [cluster#" in x)
    assert not any("concat" in x for x in lines[:join])
