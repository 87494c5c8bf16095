"""Replacing documents, refreshing what edits touch, and numbers inside texts, on small tables."""

from pyspark.sql import functions as F

from quillstone.operators import mentions as M
from quillstone.operators import snapshots as S
from quillstone.operators import upkeep as U


def corpus(spark):
    docs = spark.createDataFrame([(1, "A", "x", "IN_FORCE"), (2, "B", "x", "AMENDED")], "id long, circular_no string, doc_type string, status string")
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "id long, chunk_index long, text string")
    rels = spark.createDataFrame([(5, 1, "B", "AMENDS", 1), (6, 1, "Z", "CANCELS", 0), (7, 2, "A", "REFERENCES", 0), (8, 1, "Q", "CANCELS", -1)], "id long, source_doc_id long, target_ref_text string, relation_type string, verified int")
    return U.Corpus(docs, chunks, rels, spark.createDataFrame([(2, 1, "s"), (2, 9, "t")], "old_doc_id long, new_doc_id long, summary string"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_a_document_is_replaced_with_all_that_hangs_on_it(spark):
    docs = spark.createDataFrame([("A", "new", "2.pdf"), ("A", "old", "1.pdf"), ("C", "c", "1.pdf"), ("D", "d", "1.pdf")], "circular_no string, doc_type string, file string")
    chunks = spark.createDataFrame([("A", 0, "z"), ("C", 0, "y")], "circular_no string, chunk_index long, text string")
    found = spark.createDataFrame([("A", "Z", "CANCELS"), ("A", "B", "AMENDS"), ("A", "Q", "CANCELS"), ("C", "A", "AMENDS"), ("C", "A", "AMENDS")], "circular_no string, target_ref_text string, relation_type string")
    out = U.replaced(corpus(spark), docs, chunks, found)
    assert rows(out.documents, "id", "circular_no", "doc_type", "status") == [(1, "A", "new", "IN_FORCE"), (2, "B", "x", "AMENDED"), (3, "C", "c", "UNKNOWN"), (4, "D", "d", "UNKNOWN")]
    assert rows(out.chunks, "id", "chunk_index", "text") == [(1, 0, "z"), (2, 0, "c"), (3, 0, "y")]
    # verified and rejected relations stay, and block their like; unverified ones of the document are found anew
    assert rows(out.relations, "id", "source_doc_id", "target_ref_text", "verified") == [(10, 3, "A", 0), (5, 1, "B", 1), (7, 2, "A", 0), (8, 1, "Q", -1), (9, 1, "Z", 0)]
    assert rows(out.summaries, "summary") == [("t",)]
    same = U.replaced(corpus(spark), docs.limit(0), chunks.limit(0), found.limit(0))
    assert all(rows(a, *a.columns) == rows(b, *b.columns) for a, b in zip(same, corpus(spark)))


def test_new_ids_follow_the_largest(spark):
    frame = spark.range(500).select(F.format_string("k%04d", F.col("id")).alias("k")).repartition(7)
    got = U.numbered(frame, spark.createDataFrame([(41,)], "id long"), "k").orderBy("k").collect()
    assert [r.id for r in got] == list(range(42, 542))
    assert U.numbered(frame.limit(0), spark.createDataFrame([], "id long"), "k").count() == 0


def test_log_of_a_batch(spark):
    files = spark.createDataFrame([("a.pdf", 3, 0), ("b.doc", 1, 0), ("c.PDF", 2, 2), ("d.txt", 1, 0)], "file string, n_pages int, n_blank int")
    found = spark.createDataFrame([("a.pdf", "PP 1/2020", 4), ("d.txt", "PP 2/2020", None)], "file string, circular_no string, n_chunks int")
    assert [(r.level, r.message[:12]) for r in U.ingested(files, found).orderBy("file").collect()] == [("info", "PP 1/2020: 4"), ("error", "Only PDF and"), ("error", "No text foun"), ("info", "PP 2/2020: 0")]


def test_numbers_are_found_inside_texts(spark):
    numbers = spark.createDataFrame([("PP 3/2018",), ("SPP 3/2018",), ("GP 1",), ("",), (None,), ("pp 3/2018",)], "number string")
    texts = spark.createDataFrame([(1, "adakah spp 3/2018 sah?"), (2, "GP 11 dan gp 1"), (3, ""), (4, None), (5, "PP 3/201")], "id long, text string")
    want = [(1, "PP 3/2018"), (1, "SPP 3/2018"), (1, "pp 3/2018"), (2, "GP 1")]
    for most in (100, 1):
        assert sorted(map(tuple, M.mentions(texts, numbers, most).collect())) == want
    assert M.mentions(texts, numbers.limit(0)).count() == 0


def test_who_is_told(spark):
    changes = spark.createDataFrame([(1, "PP 1/2020", "T1", "STATUS_CHANGE", "c1", "IN_FORCE", "CANCELLED", "why"), (2, "PP 2/2020", "T2", "ADDED", "c2", None, "IN_FORCE", None), (3, "PP 3/2020", "T3", "REMOVED", "c1", "IN_FORCE", None, None)], "id long, circular_no string, title string, change string, cluster string, old_status string, new_status string, status_reason string")
    users = spark.createDataFrame([(1, "OFFICER", 1, "c1", "-"), (2, "OFFICER", 1, "-", "PP 2/2020"), (3, "OFFICER", 1, "-", "-"), (4, "OFFICER", 1, "-", "-"), (5, "OFFICER", 0, "c1", "-"), (6, "PUBLISHER", 2, "c1", "-"), (7, "OFFICER", 2, "-", "-")], "id long, role string, clearance_level int, sub_cluster string, sub_circular string")
    log = spark.createDataFrame([(3, "masih sah pp 1/2020?", None, 40), (4, "x", 1, 40), (7, "pp 1/2020", None, 0), (3, "PP 2/2020", 2, 40), (1, None, None, 45)], "user_id long, query string, doc_ref long, d int").withColumn("created_at", F.expr("timestamp_ntz'2024-05-01' + make_interval(0, 0, 0, d)")).drop("d")
    rels = spark.createDataFrame([(1, 9, 1, "AMENDS"), (2, 8, 1, "CANCELS"), (3, 2, 7, "REFERENCES")], "id long, source_doc_id long, target_doc_id long, relation_type string")
    notes = spark.createDataFrame([(1, 9, "r", "s"), (1, 8, "no", "no")], "old_doc_id long, new_doc_id long, summary_ms string, summary_en string")
    got = {(r.user_id, r.document_id): r for r in S.notified(changes, users, log, 1, 30, rels, notes).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 1), (4, 1)}
    assert got[1, 1].summary_en == "PP 1/2020: In force -> Cancelled (why). s" and got[1, 1].summary_ms == "PP 1/2020: Berkuat kuasa -> Dibatalkan (why). r" and got[1, 1].related_doc_id == 9
    assert got[2, 2].summary_ms == "Dokumen baharu: PP 2/2020 - T2." and got[2, 2].related_doc_id == 7
