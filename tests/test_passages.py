"""Passages of packs on small tables: stored indexes with deltas, amending chunks, access."""

from pyspark.sql import functions as F

from quillstone.operators import passages as S
from quillstone.operators import retrieval as R

CHUNK = "chunk_id long, id long, tier int, chunk_index int, clause_ref string, breadcrumb string, text string, circular_no string, status string, classification_level int"


def chunk(n, doc, tier, text, status="IN_FORCE", ref="1.1"):
    return (n, doc, tier, n % 10, ref, "b", text, f"PP {doc}/2020", status, tier)


def table(spark, rows):
    return spark.createDataFrame([chunk(*r) for r in rows], CHUNK)


ROWS = [(10, 1, 0, "cuti rehat tahunan"), (11, 1, 0, "cuti sakit"), (20, 2, 0, "elaun perjalanan cuti"), (30, 3, 1, "cuti rehat cuti rehat"), (31, 3, 1, ""), (40, 4, 2, "cuti rahsia")]
ASKED = [(1, "cuti rehat"), (2, "elaun"), (3, "tiada di sini"), (4, "yang dan")]


def scores(frame):
    return {tuple(r) for r in frame.select("qid", "tier", "chunk_id", "score").collect()}


def test_an_index_is_merged_with_what_changed(spark, tmp_path):
    asked = spark.createDataFrame(ASKED, "qid long, text string")
    old = table(spark, ROWS)
    S.write_index(old, str(tmp_path), 1)
    want = scores(S.keyword_scores(old, asked))
    assert want and scores(S.stored_scores(spark, str(tmp_path), {0: 1, 1: 1, 2: 1}, asked)) == want
    # document 1 has other chunks now, document 2 is gone, document 5 is new
    fresh = [(12, 1, 0, "cuti rehat baharu"), (50, 5, 1, "elaun rehat")]
    changed = spark.createDataFrame([(1,), (2,), (5,)], "id long")
    S.write_index(table(spark, fresh), str(tmp_path), 2, 1, changed)
    now = table(spark, [r for r in ROWS if r[1] not in (1, 2)] + fresh)
    assert scores(S.stored_scores(spark, str(tmp_path), {0: 2, 1: 2, 2: 2}, asked)) == scores(S.keyword_scores(now, asked)) != want
    # a reader of the old version is not disturbed, and each tier has its own
    assert scores(S.stored_scores(spark, str(tmp_path), {0: 1, 1: 1, 2: 1}, asked)) == want
    mixed = scores(S.stored_scores(spark, str(tmp_path), {0: 1, 1: 2}, asked))
    assert {r for r in mixed if r[1] == 0} == {r for r in want if r[1] == 0} and not any(r[1] == 2 for r in mixed)


def test_scores_are_those_of_a_pack(spark):
    """A pack's scores don't change with what other packs hold."""
    asked = spark.createDataFrame(ASKED, "qid long, text string")
    alone = scores(S.keyword_scores(table(spark, [r for r in ROWS if r[2] == 0]), asked))
    assert alone == {r for r in scores(S.keyword_scores(table(spark, ROWS), asked)) if r[1] == 0}


def test_lists_show_what_may_be_seen(spark):
    rows = table(spark, [(10, 1, 0, "a"), (20, 2, 0, "b", "CANCELLED"), (30, 3, 1, "c"), (40, 4, 2, "d")])
    hits = spark.createDataFrame([(q, t, c, k) for q in (1, 2) for k, (c, t) in enumerate([(40, 2), (20, 0), (10, 0), (30, 1)], 1)], "qid long, tier int, chunk_id long, raw_rank int")
    asked = spark.createDataFrame([(1, False), (2, True)], "qid long, wants_history boolean")
    got = {(r.qid, r.chunk_id): r.rank for r in S.shown(hits, rows, asked, 1).collect()}
    assert got == {(1, 10): 1, (1, 30): 1, (2, 20): 1, (2, 10): 2, (2, 30): 1}
    assert (1, 20) in {(r.qid, r.chunk_id) for r in S.shown(hits, rows, asked, 1, True).collect()}


def test_fusion_takes_the_first_named(spark):
    one = lambda rows: spark.createDataFrame(rows, "qid long, tier int, chunk_id long, rank int")
    lists = {"keyword": one([(1, 0, 5, 1), (1, 0, 6, 2)]), "vector": one([(1, 0, 7, 1), (1, 1, 9, 1)]), "trigram": one([(1, 0, 6, 2)])}
    got = [(r.chunk_id, r.ranks) for r in S.fused(lists).orderBy("place").collect()]
    assert got == [(6, "keyword 2, trigram 2"), (7, "vector 1"), (5, "keyword 1"), (9, "vector 1")]


def test_amending_chunks(spark):
    rows = table(
        spark,
        [(10, 1, 0, "had asal", "AMENDED", "6.1-6.2"), (11, 1, 0, "lain", "AMENDED", "4.1"), (20, 2, 0, "kata dipinda"), (21, 2, 0, "Bahawa had\nbaharu ialah dua puluh hari bekerja setahun."), (30, 3, 0, "tiada kata"), (40, 4, 1, "rahsia dipinda"), (50, 5, 0, "x dipinda", "CANCELLED")],
    )
    rels = [(1, 2, 1, "clauses: 6.1", "had baharu ialah dua puluh hari bekerja setahun"), (2, 3, 1, "whole", "x"), (3, 4, 1, "whole", None), (4, 5, 1, "whole", None), (5, 2, 4, "whole", None)]
    relations = spark.createDataFrame([(*r, "AMENDS", 1) for r in rels] + [(6, 2, 1, "whole", None, "AMENDS", 0)], "id long, source_doc_id long, target_doc_id long, scope string, evidence string, relation_type string, verified int")
    got = {(r.rel_id, r.new_id) for r in S.amending(rows, relations).collect()}
    # the evidence decides, then the word; a lower level amending a higher one is in no pack
    assert got == {(1, 21), (3, 40), (4, 50)}
    selected = spark.createDataFrame([(1, 10, 1, 1, False), (1, 11, 1, 2, False), (2, 11, 1, 1, False)], "qid long, chunk_id long, id long, pos int, wants_history boolean")
    out = lambda clearance, n: [(r.qid, r.chunk_id, r.origin) for r in S.with_amending(selected, rows, relations, clearance, n).orderBy("qid", "place").collect()]
    assert out(1, 5) == [(1, 10, "selected"), (1, 21, "amendment"), (1, 40, "amendment"), (1, 11, "selected"), (2, 11, "selected"), (2, 40, "amendment")]
    assert out(0, 2) == [(1, 10, "selected"), (1, 21, "amendment"), (2, 11, "selected")]


def test_excluded_passages_are_one_for_each_document(spark):
    rows = table(spark, [(10, 1, 0, "a", "CANCELLED"), (11, 1, 0, "b", "CANCELLED"), (20, 2, 0, "c"), (30, 3, 0, "d", "CANCELLED")])
    ranked = spark.createDataFrame([(1, 11, 1), (1, 20, 2), (1, 10, 3), (1, 30, 11)], "qid long, chunk_id long, place int")
    assert [tuple(r) for r in S.excluded(ranked, rows).collect()] == [(1, 11, 1, 1)]
    assert S.chunk_vectors(rows).where(F.size("vec") == 1024).count() == 4


def test_scores_are_the_same_by_set_and_by_join(spark, monkeypatch):
    asked = spark.createDataFrame(ASKED, "qid long, text string")
    rows = table(spark, ROWS + [(60, 6, 1, None), (61, 6, 1, "cuti_lama a/b 'cuti' \\ yang"), (62, 6, 1, "yang dan")])
    docs = rows.select(F.col("chunk_id").alias("id"), "text")
    plain = lambda: {tuple(r) for r in R.bm25(docs, asked).collect()}
    by_set, packs = plain(), scores(S.keyword_scores(rows, asked))
    lengths = {r.id: r.dl for r in R.postings(docs, R.asked_terms(asked).select("term").distinct()).collect()}
    assert lengths[10] == 3 and lengths[60] == lengths[62] == 0 and by_set and packs
    nothing = spark.createDataFrame([(1, "yang dan")], "qid long, text string")
    assert R.bm25(docs, nothing).count() == 0 and R.bm25(docs.limit(0), asked).count() == 0
    monkeypatch.setattr(R, "SET_TERMS", 0)
    assert plain() == by_set and scores(S.keyword_scores(rows, asked)) == packs
