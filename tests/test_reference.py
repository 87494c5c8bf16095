"""Operators of the reference on small inputs, and the SQL of each query against Spark on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import passages as passage_lists
from quillstone.operators import answers, changes, chunking, diffing, retrieval, snapshots, trigrams, validity
from quillstone.plans import asking, catalogue, desk, library, passages, records, revisions, upkeep  # noqa: F401  the others add their queries to the catalogue's
from quillstone.streaming import usage


def value(spark, column, *args, schema="x string"):
    return spark.createDataFrame([args], schema).select(column).first()[0]


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def plain(x):
    import math

    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (int, float)):
        return float(f"{x:.9g}") if math.isfinite(x) else None
    return str(x).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(name, spark, data, duck):
    got = catalogue.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(map(plain, (r[c] for c in columns))) for r in got.collect()), key=str)
    assert rows == sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=str)


def test_text_functions(spark):
    assert value(spark, X.fold(F.col("x")), "Crème BRÛLÉE ñ ß") == "creme brulee n ß"
    assert value(spark, X.query_terms(F.col("x")), "What is the cuti rehat cuti PP 3/2018?") == ["cuti", "rehat", "pp"]
    assert value(spark, X.tokens(F.col("x")), "cutinya leaves the rehat") == ["cuti", "leav", "rehat"]
    assert value(spark, X.references(F.col("x")), "Surat Pekeliling Perkhidmatan Bilangan 05 Tahun 2011 dan SE Bil. 3/2019") == ["SPP 5/2011", "SE 3/2019"]
    assert value(spark, X.references(F.col("x"), X.QUERY_REFERENCE), "apa PP 3/2018 dan pas 4/2023") == ["PP 3/2018", "PAS 4/2023"]
    assert str(value(spark, X.parse_malay_date(F.col("x")), "pada 3 Mac 2021 dan 4 April 2022")) == "2021-03-03"
    assert value(spark, X.parse_malay_date(F.col("x")), "1 Mac 1850") is None and str(value(spark, X.parse_malay_date(F.col("x")), "1 Mac 1850, 2 Mei 1999")) == "1999-05-02"
    assert value(spark, X.references(F.col("x")), "PAS Bil. 4/2020 dan PP Bil. 3 Tahun 2018") == ["PP 3/2018", "PAS 4/2020"]
    assert value(spark, X.parse_malay_date(F.col("x")), "31 Februari 2021") is None and value(spark, X.lenient_date(F.col("x")), "2024-02-31") is None
    assert value(spark, X.clean(F.col("x"), "SALINAN"), "a  \r\n\nSALINAN rasmi\n b­ c ") == "a\n b c"
    assert value(spark, X.scope_touches(F.lit("clauses: 6.1"), F.col("x")), "6.1-6.4") and not value(spark, X.scope_touches(F.lit("clauses: 6.1"), F.col("x")), "4.1")
    assert value(spark, X.scope_touches(F.lit("whole"), F.col("x")), "4.1") and value(spark, X.scope_touches(F.lit("clauses: 6"), F.col("x")), "Kehadiran")
    assert value(spark, X.relation_effect(F.col("x")), "PP 1/2001 telah dimansuhkan") == "CANCELS"


DOCS = "id long, circular_no string, doc_type string, issue_date date, effective_date date, expiry_date date, one_off boolean, classification_level int"


def test_status_rules(spark):
    from datetime import date as d

    rows = [(1, "PP 1/2020", "circular", d(2020, 1, 1), d(2020, 1, 1), None, False, 0), (2, "PP 2/2021", "circular", d(2021, 1, 1), d(2021, 1, 1), None, False, 0), (3, "M 1", "minutes", d(2020, 5, 2), None, None, False, 0), (4, "PP 4/2020", "circular", d(2020, 1, 1), d(2030, 1, 1), None, False, 2), (5, "PP 5/2020", "circular", d(2020, 1, 1), d(2020, 1, 1), d(2021, 1, 1), True, 0), (6, "PP 6/2020", "circular", d(2020, 1, 1), d(2020, 1, 1), d(2021, 1, 1), False, 0), (7, "PP 7/2020", "circular", None, None, None, False, 0), (8, "PP 8/2020", "circular", d(2020, 1, 1), d(2020, 1, 1), None, False, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    rels = spark.createDataFrame([(1, 2, 1, "SUPERSEDES", None, 1), (2, 2, 3, "CANCELS", None, 1), (3, 4, 8, "AMENDS", d(2022, 1, 1), 1), (4, 7, 8, "AMENDS", None, 1), (5, 7, 2, "CANCELS", None, 1), (6, 2, 7, "CANCELS", d(2020, 1, 1), 0)], "id long, source_doc_id long, target_doc_id long, relation_type string, effective_date date, verified int")
    got = {r.id: (r.status, r.status_reason) for r in validity.with_status(docs, rels, "2024-06-30").collect()}
    assert got[1] == ("CANCELLED", "Dibatalkan oleh PP 2/2021") and got[3] == ("RECORD", "Rekod bertarikh 2 Mei 2020")
    assert got[4] == ("UNKNOWN", "Belum berkuat kuasa (mulai 1 Januari 2030)") and got[5][0] == "ONE_OFF" and got[6] == ("CANCELLED", "Tamat tempoh")
    assert got[7] == ("UNKNOWN", "Belum disahkan") and got[8] == ("AMENDED", "Dipinda oleh PP 4/2020, PP 7/2020") and got[2][0] == "IN_FORCE"
    redacted = {r.id: r.status_reason for r in snapshots.redacted(validity.with_status(docs, rels.where("id = 3"), "2024-06-30"), rels.where("id = 3")).collect()}
    assert redacted[8] == "Dipinda oleh " + snapshots.HIDDEN


def test_clearance_is_monotone(spark, data):
    docs = catalogue.P.policy_documents(spark, data)
    counts = [validity.secure(docs, c).count() for c in (0, 1, 2)]
    assert counts == sorted(counts) and counts[2] == docs.count()


def test_versions_are_written_and_pruned(spark, data, tmp_path):
    docs = catalogue.P.policy_documents(spark, data).drop("text")
    snapshots.write_version(docs, str(tmp_path), 1)
    with pytest.raises(Exception, match="(?i)exists"):
        snapshots.write_version(docs, str(tmp_path), 1)
    low = snapshots.read_version(spark, str(tmp_path), 1, 1)
    assert low.count() == docs.where("classification_level <= 1").count()
    assert snapshots.content_hash(docs) == snapshots.content_hash(docs.repartition(7)) != snapshots.content_hash(docs.where("id > 0"))


def test_rules_chunks(spark):
    text = "PEKELILING\n1. TUJUAN\n1.1 Pekeliling ini bertujuan\nmenerangkan cuti.\n(a) rehat\n1.2 Kedua\n2. Pegawai boleh memohon\nPEMBATALAN\nPP 1/2001 dibatalkan"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, "4. BESAR\n" + "\n".join(f"4.{k} " + "kata " * 200 for k in range(1, 5)))], "id long, page int, text string")
    numbers = spark.createDataFrame([(1, "PP 9/2020"), (2, "PP 8/2020")], "id long, circular_no string")
    rows = {(r.id, r.chunk_index): r for r in chunking.chunk_rules(pages, numbers).collect()}
    assert rows[1, 0].clause_ref == "1.1-1.2" and rows[1, 0].text == "1. TUJUAN\n1.1 Pekeliling ini bertujuan menerangkan cuti.\n(a) rehat\n1.2 Kedua"
    assert rows[1, 0].breadcrumb == "PP 9/2020 > Tujuan > 1.1-1.2" and rows[1, 1].clause_ref == "2" and rows[1, 1].breadcrumb == "PP 9/2020 > Perenggan 2 > 2"
    assert rows[1, 2].text == "PEMBATALAN\nPP 1/2001 dibatalkan" and [rows[2, k].clause_ref for k in (0, 1)] == ["4.1-4.2", "4.3-4.4"]


def test_minutes_chunks(spark):
    from datetime import date

    text = "MESYUARAT\nKEHADIRAN: Ali\nAbu\nPERKARA 1: LAPORAN AKHIR\nisi laporan\nKEPUTUSAN: setuju\nTINDAKAN: Unit A"
    pages = spark.createDataFrame([(1, 2, text)], "id long, page int, text string")
    rows = chunking.chunk_minutes(pages, spark.createDataFrame([(1, "M 1/2020", date(2020, 3, 1))], "id long, circular_no string, issue_date date")).orderBy("chunk_index").collect()
    assert [r.clause_ref for r in rows] == ["Kehadiran", "Perkara 1", "Perkara 1 - Keputusan", "Perkara 1 - Tindakan"]
    assert rows[0].text == "KEHADIRAN: Ali Abu" and rows[2].text == "PERKARA 1: LAPORAN AKHIR - KEPUTUSAN: setuju"
    assert rows[2].breadcrumb == "M 1/2020 (1 Mac 2020) > Perkara 1: Laporan Akhir > Keputusan"


def test_citations_actions_and_stream(spark):
    text = "Ya [S1, S3] dan [S9] .\n- Mohon dalam sistem [S1].\n- tanpa petikan\n* Hantar borang [S9][S2]"
    frame = spark.createDataFrame([(1, 3, text)], "id long, n_sources int, text string")
    got = frame.select(answers.validated(F.col("text"), F.col("n_sources")).alias("v")).first().v
    assert got.used == [1, 3, 2] and got.removed == [9, 9] and got.text.startswith("Ya [S1][S3] dan.")
    assert [(r.place, r.action, r.citations) for r in answers.actions(frame).collect()] == [(1, "Mohon dalam sistem", [1]), (2, "Hantar borang", [2])]
    whole = "ANSWERABLE: YES\nBoleh [S1].\n**ACTIONS:**\n- Mohon [S1]"
    pieces = [(k, s, whole[s : s + k + 1]) for k in range(1, 9) for s in range(0, len(whole), k + 1)]
    rows = answers.fold_streams(spark.createDataFrame(pieces, "id long, seq int, piece string")).collect()
    assert len(rows) == 8 and {(r.answerable, r.answer, r.actions) for r in rows} == {(True, "Boleh [S1].\n", "\n- Mohon [S1]")}
    fold = lambda x: tuple(spark.createDataFrame([(x,)], "x string").select(answers.sections(F.col("x")).alias("s")).first().s)
    assert fold("ANSWERABLE: no\nx") == (False, "", "") and fold("") == (False, "", "") and fold(" short") == (True, " short", "")


def test_groups_of_citations(spark):
    def check(text, n=3):
        v = spark.createDataFrame([(text, n)], "text string, n int").select(answers.validated(F.col("text"), F.col("n")).alias("v")).first().v
        return v.text, v.used, v.removed

    assert check("a [S1, S2, S3] b") == ("a [S1][S2][S3] b", [1, 2, 3], [])
    assert check("[S1; S2; S9]") == ("[S1][S2]", [1, 2], [9]) and check("x [ S1 ] and [s1, s2].") == ("x [S1] and [S1][S2].", [1, 2], [])
    assert check("[S03,1] [S4] , [S99999999999999999999]") == ("[S3][S1],", [3, 1], [4, None]) and check("plain [X1]") == ("plain [X1]", [], [])


def test_clause_changes(spark):
    old = spark.createDataFrame([(1, "4. CUTI\n4.1 had cuti rehat lima belas hari\n4.2 dibuang terus\n4.3 sama")], "id long, text string")
    new = spark.createDataFrame([(1, "4. CUTI\n4.1 had cuti rehat dua puluh hari\n4.3 sama\n5.1 perkara baharu sekali")], "id long, text string")
    rows = {(r.clause_old, r.clause_new): r for r in changes.clause_changes(old, new).collect()}
    assert {k: r.kind for k, r in rows.items()} == {("4.1", "4.1"): "CHANGED", ("4.2", None): "REMOVED", (None, "5.1"): "ADDED"}
    assert rows["4.1", "4.1"].inline == ["= had cuti rehat", "- lima belas", "+ dua puluh", "= hari"]


def test_scopes_and_summaries(spark):
    new = spark.createDataFrame([(1, "2.1 perenggan 4.2 adalah dipinda seperti berikut\n3.1 lain")], "id long, text string")
    old = spark.createDataFrame([(1, "4.1 kekal\n4.2 had lima hari")], "id long, text string")
    rels = spark.createDataFrame([(1, "clauses: 4.2", None)], "pair long, scope string, evidence string")
    pairs = changes.scope_pairs(rels, new)
    assert [tuple(r) for r in pairs.collect()] == [(1, "4.2", "2.1")]
    found = changes.clause_changes(old, new, pairs)
    assert {(r.clause_old, r.clause_new, r.kind) for r in found.collect()} == {("4.2", "2.1", "CHANGED")}
    assert {(r.clause_old, r.clause_new, r.kind) for r in changes.clause_changes(old, new, pairs.where("pair > 1")).collect()} == {("4.1", None, "REMOVED"), ("4.2", None, "REMOVED"), (None, "2.1", "ADDED"), (None, "3.1", "ADDED")}
    row = changes.change_summaries(found, spark.createDataFrame([(1, "PP 1/2001", "PP 2/2002"), (2, "A", "B")], "pair long, old_no string, new_no string")).orderBy("pair").collect()
    assert row[0].summary_en == "PP 2/2002 changes paragraphs 2.1 compared with PP 1/2001." and row[1].summary_ms == "B mengubah perenggan - berbanding A."


def test_holder_of_an_amendment(spark):
    new = spark.createDataFrame([(1, "1.1 perenggan 4.2 dipinda dahulu\n2.1 Bahawa had cuti rehat dipinda kepada dua puluh hari\n3.1 lain")], "id long, text string")
    rels = spark.createDataFrame([(1, "clauses: 4.2, 4.10", "had cuti rehat dipinda kepada dua puluh hari setahun")], "pair long, scope string, evidence string")
    assert sorted(map(tuple, changes.scope_pairs(rels, new).collect())) == [(1, "4.10", "2.1"), (1, "4.2", "2.1")]
    changed = spark.createDataFrame([(1, "10.1", None), (1, "9.2", "9.2"), (1, None, "2.1"), (1, "4.1", "4.10")], "pair long, clause_old string, clause_new string")
    assert [(r.clause_old, r.clause_new) for r in changes.placed(changed).orderBy("place").collect()] == [(None, "2.1"), ("4.1", "4.10"), ("9.2", "9.2"), ("10.1", None)]
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "c")], "pair long, old_no string, new_no string")
    assert [r.pair for r in changes.change_summaries(changed, pairs, pairs.where("pair = 2")).collect()] == [1]


def test_blocks_are_those_of_the_longest_runs():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(9)
    for n in range(400):
        size, letters = rng.randint(0, 60), "ab" if n % 3 else "abcdefgh "
        a = "".join(rng.choice(letters) for _ in range(size))
        b = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) if n % 2 else "".join(c for c in a if rng.random() < 0.9) + rng.choice(letters)
        want = SequenceMatcher(None, a, b, autojunk=False)
        assert diffing.matching(a, b) == [tuple(m) for m in want.get_matching_blocks()][:-1], (a, b)
        for least in (0.0, 0.2, 0.4, 0.77, 1.0):
            assert diffing.shares(a, b, least) == (want.ratio() >= least), (a, b, least)
        x, y = list(a.replace("a", "a ").split()), list(b.replace("a", "a ").split())
        assert diffing.matching(x, y) == [tuple(m) for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()][:-1]
    assert diffing.word_changes("a b c", "a x c d") == ["= a", "- b", "+ x", "= c", "+ d"] and diffing.word_changes("", "x") == ["+ x"] and diffing.word_changes("x", "x") == ["= x"]


def test_long_texts_are_compared_in_good_time():
    import random
    import time

    rng = random.Random(1)
    words = [f"w{rng.randrange(3000)}" for _ in range(100_000)]
    edited = [w for w in words if rng.random() > 0.0005]
    start = time.time()
    kept = sum(n for _, _, n in diffing.matching(words, edited))
    assert kept == len(edited) and time.time() - start < 60


def test_hashed_vectors(spark):
    import numpy as np

    rows = spark.createDataFrame([(1, "cuti rehat tahunan pegawai"), (2, "cuti rehat tahunan pegawai awam"), (3, ""), (4, "zzz qqq")], "id long, text string")
    v = {r.id: np.array(r.embedding) for r in changes.hash_embed(rows).collect()}
    assert all(len(x) == 1024 and abs(np.linalg.norm(x) - 1) < 1e-6 for x in v.values()) and v[3][0] == 1
    assert v[1] @ v[2] > 0.8 and abs(v[1] @ v[4]) < 0.2


def test_fusion_ignores_partitions(spark, data):
    lists = spark.createDataFrame([(1, i, n, r) for i, n, r in ((1, "a", 1), (2, "a", 2), (1, "b", 3), (3, "b", 1))], "qid long, id long, list string, rank int")
    one, many = (sorted(map(tuple, retrieval.fuse(lists.repartition(n)).collect())) for n in (1, 9))
    assert one == many and one[0] == (1, 1, round(1 / 61 + 1 / 63, 9), 2, "a 1, b 3")


def test_stream_equals_batch(spark, data, tmp_path):
    from quillstone.sources.tables import table

    events = table(spark, data, "events")
    late = events.agg(F.max("ts")).first()[0]
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = usage.hourly_usage(usage.log_stream(spark, str(tmp_path / "in"), events, 100))
    usage.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    done = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {tuple(r) for r in usage.hourly_usage(events).collect()}
    assert done <= whole and len(done) > 0.8 * len(whole) and late is not None


def test_readers(spark, tmp_path):
    from quillstone.sources import tables

    (tmp_path / "o.csv").write_text("﻿file,title,classification_level\na.pdf,,2\nb.pdf,T,\na.pdf,X,\n")
    got = {r.file: (r.title, r.classification_level) for r in tables.overrides(spark, str(tmp_path / "o.csv")).collect()}
    assert got["b.pdf"] == ("T", None) and got["a.pdf"][0] == "X"
    (tmp_path / "g.json").write_text('{"_note": ["x"], "cuti": ["rehat", "leave"], "n": 3}')
    assert sorted(map(tuple, tables.glossary(spark, str(tmp_path / "g.json")).collect())) == [("cuti", "leave"), ("cuti", "rehat")]
    (tmp_path / "p.txt").write_text("page one with more than thirty letters\fshort")
    pages = tables.text_pages(tables.raw_files(spark, str(tmp_path), "*.txt")).orderBy("number").collect()
    assert [p.number for p in pages] == [1, 2] and pages[1].text is None


def test_every_document_is_chunked_once(spark, data):
    from quillstone.sources import policy

    ids = lambda df: {r[0] for r in df.select("id").distinct().collect()}
    docs = policy.policy_documents(spark, data).where("trim(translate(text, '.\n', '')) <> ''")
    rules, minutes = ids(catalogue.chunk_rules(spark, data)), ids(catalogue.chunk_minutes(spark, data))
    assert not rules & minutes and ids(docs) <= rules | minutes
    assert ids(docs.where("doc_type = 'report'")) <= rules


def test_amendments_follow_all_retrieved_passages(spark, data):
    ids = lambda df: {tuple(r) for r in df.select("qid", "id").collect()}
    got = catalogue.amendment_injection_retrieved(spark, data)
    places = ids(catalogue.jurisdiction_policy(spark, data))
    assert {q for q, _ in ids(got)} == {q for q, _ in places}
    assert ids(got.where("origin = 'selected'")) <= places


def test_no_list_shows_more_than_the_clearance(spark, data):
    allowed = {r.id for r in catalogue.secure_documents(spark, data).collect()}
    for name in ("bm25_postfilter", "vector_postfilter", "named_reference_list", "rrf_fusion", "jurisdiction_policy"):
        shown = {r.id for r in catalogue.QUERIES[name](spark, data).select("id").distinct().collect()}
        assert shown and shown <= allowed, name
    levels = {r.id: r.classification_level for r in catalogue.P.policy_documents(spark, data).collect()}
    assert all(levels[r.id] <= 1 for r in catalogue.excluded_documents(spark, data).collect())


def test_stored_postings_give_the_same_scores(spark, data, tmp_path):
    docs = catalogue.table(spark, data, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = catalogue.P.questions(spark, data)
    retrieval.write_postings(docs, str(tmp_path), 8)
    stored = {tuple(r) for r in retrieval.bm25_stored(spark, str(tmp_path), asked.where("qid < 3")).collect()}
    assert stored and stored == {tuple(r) for r in retrieval.bm25(docs, asked.where("qid < 3")).collect()}


def test_numbers_are_found_by_any_part(spark, tmp_path):
    numbers = ["PP 13/2018", "PP 3/2018", "GP 7/2020", "SOP-KEW 12/2020", "SE 3/2018", "aaaa", "", None]
    docs = spark.createDataFrame(list(enumerate(numbers)), "id long, circular_no string")
    asked = ["3/2018", "GP", "GP ", "SOP-KEW", "sop-kew 1", "2020", "P 3", "aaa", "zzz", "PP 13/2018", "PP 13/20188", "", None, "/20"]
    rows = spark.createDataFrame(list(enumerate(asked)), "qid long, ref string")
    want = {(q, d) for q, a in enumerate(asked) for d, n in enumerate(numbers) if a and n and len(a) >= 3 and a.lower() in n.lower()}
    assert {tuple(r) for r in trigrams.containing(docs, rows).collect()} == want and (0, 0) in want
    trigrams.write_grams(docs, str(tmp_path / "grams"), 4)
    assert {tuple(r) for r in trigrams.containing_stored(spark, str(tmp_path / "grams"), rows).collect()} == want
    assert trigrams.containing(docs.limit(0), rows).count() == 0


def test_nearest_in_rounds(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(90, 5)).round(1)
    x[40:70] = x[40]  # ties go to smaller ids
    frame = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(100, None, 0), (101, [1.0], 0)], "id long, vec array<double>, tier int").repartition(3)
    asked = frame.where("id % 20 = 0").selectExpr("id as qid", "vec as qvec")
    scores = (x @ x.T).round(6)
    for rounds, rows in ((4096, 1024), (2, 16)):
        got = retrieval.nearest(frame.drop("tier"), asked, 7, rounds, rows).where("qid < 100").collect()
        assert {(r.qid, r.rank): r.id for r in got} == {(q, k + 1): int(i) for q in range(0, 90, 20) for k, i in enumerate(np.lexsort([np.arange(90), -scores[q]])[:7])}
        got = retrieval.nearest(frame, asked, 3, rounds, rows).where("qid < 100").collect()
        assert {(r.qid, r.tier, r.rank): r.id for r in got} == {(q, t, k + 1): int(i) for q in range(0, 90, 20) for t in (0, 1) for k, i in enumerate([i for i in np.lexsort([np.arange(90), -scores[q]]) if i % 2 == t][:3])}


def test_the_best_of_many_ties():
    import numpy as np

    best, rng = retrieval.Best(3, 5), np.random.default_rng(1)
    scores, ids = rng.integers(0, 3, (3, 60_000)).astype(float), rng.permutation(60_000)
    for a in range(0, 60_000, 500):
        best.add(scores[:, a : a + 500], ids[a : a + 500])
    row, score, found = best.shrink()
    want = [(q, scores[q][i], ids[i]) for q in range(3) for i in np.lexsort([ids, -scores[q]])[:5]]
    assert list(zip(row.tolist(), score.tolist(), found.tolist())) == [(int(q), float(x), int(i)) for q, x, i in want]


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(400)] + [(900, 700), (5000, 5000)]
    got = dict(validity.component_labels(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(401)}, 700: 700, 900: 700, 5000: 5000}


def test_percentiles_beside_outliers(spark):
    from quillstone.operators import analytics

    values = sorted([1e12] + [k % 50 / 7 for k in range(3000)] + [3.0] * 500)
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = dict(analytics.nearest_rank(frame, "v", (0.0, 0.5, 0.95, 1.0), 10, 20).collect())
    assert got == {q: values[round(q * (len(values) - 1))] for q in (0.0, 0.5, 0.95, 1.0)}
    assert analytics.nearest_rank(frame.where("v < 0"), "v", (0.5,)).count() == 0


def test_known_relations_and_results(spark, tmp_path):
    from quillstone.operators import evaluation
    from quillstone.sources import tables

    docs = spark.createDataFrame([(1, "PP 2/2024"), (2, "PP 3/2018")], "id long, circular_no string")
    (tmp_path / "r.csv").write_text('\ufeffsource_circular_no,target_circular_no,relation_type,scope,effective_date,evidence_text,evidence_page\n PP 2/2024 ,PP 3/2018,supersedes,,2024-02-01,"a, ""b""",2\nPP 2/2024,PP 9/2030,AMENDS,clauses: 6.1,,,\nPP 7/2030,PP 3/2018,AMENDS,whole,x,,\n', encoding="utf-8")
    rows = {r.target_ref_text: r for r in tables.known_relations(spark, str(tmp_path / "r.csv"), docs).collect()}
    first, other = rows["PP 3/2018"], rows["PP 9/2030"]
    assert (first.source_doc_id, first.target_doc_id, first.relation_type, first.scope, str(first.effective_date), first.evidence, first.evidence_page) == (1, 2, "SUPERSEDES", "whole", "2024-02-01", 'a, "b"', 2)
    assert len(rows) == 2 and (other.target_doc_id, other.scope, other.effective_date, other.evidence_page) == (None, "clauses: 6.1", None, None)
    scores = spark.createDataFrame([("B", 1, True, 1), ("A", 2, False, None)], "mode string, qid long, answered boolean, rank int")
    table = spark.createDataFrame([("mrr", 0.5, 1.0)], "metric string, A double, B double")
    evaluation.write_results(scores, table, str(tmp_path / "out"))
    evaluation.write_results(scores, table, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "results")).collect()
    assert [(r.mode, r.qid, r["rank"]) for r in back] == [("A", "2", None), ("B", "1", "1")]


def test_actions_that_cite_the_expected_document(spark):
    from quillstone.operators import evaluation

    actions = spark.createDataFrame([("m", 1, 1, [2]), ("m", 1, 2, [1, 2]), ("m", 2, 1, []), ("m", 3, 1, [9]), ("n", 1, 1, [1])], "mode string, qid long, place int, citations array<int>")
    sources = spark.createDataFrame([("m", 1, 1, "A"), ("m", 1, 2, "B"), ("n", 1, 1, "C")], "mode string, qid long, place int, circular_no string")
    golden = spark.createDataFrame([(1, "A"), (2, None)], "qid long, expected_doc string")
    got = {r["mode"]: (r.n_actions, r.share) for r in evaluation.action_accuracy(actions, sources, golden).collect()}
    assert got == {"m": (4, 0.25), "n": (1, 0.0)}
