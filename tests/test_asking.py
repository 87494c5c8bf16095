"""Asking and the publisher's desk on small tables: rungs, thresholds, prompts, events, queues, alerts, uploads, views."""

import json
from datetime import date

import pandas as pd
from pyspark.sql import functions as F

from quillstone.operators import analytics, asking, changes, chunking, records, validity

POOL = "qid long, id long, rrf double, place int"
SCORE = "qid long, id long, score double"


def test_the_first_rung_that_knows_a_question_ranks_it(spark):
    pool = spark.createDataFrame([(q, i, 1 / (60 + i), i) for q in (1, 2, 3, 4) for i in (1, 2, 3)] + [(1, 99, 0.001, 21)], POOL)
    backend = spark.createDataFrame([(1, 3, 0.9), (1, 3, 0.4), (1, 1, 0.2), (1, 99, 1.0), (4, 77, 1.0)], SCORE)
    model = spark.createDataFrame([(1, 2, 1.0), (2, 2, None), (3, 1, 0.5), (3, 3, 0.5)], SCORE)
    rows = {}
    for r in asking.ladder(pool, [("words", backend), ("crossencoder", model)]).orderBy("qid", "pos").collect():
        rows.setdefault(r.qid, []).append((r.id, r.kind, round(r.score, 4)))
    # place 21 isn't in the pool, whatever its score; a passage that the rung left out scores 0
    assert rows[1] == [(3, "words", 0.9), (1, "words", 0.2), (2, "words", 0.0)]
    # only a null score, and scores of passages outside the pool: nobody knows them
    assert [r[:2] for r in rows[2]] == [(1, "none"), (2, "none"), (3, "none")] and rows[2] == rows[4]
    # ties go to the better fused one
    assert rows[3] == [(1, "crossencoder", 0.5), (3, "crossencoder", 0.5), (2, "crossencoder", 0.0)]
    empty = asking.ladder(pool.limit(0), [("words", backend)])
    assert empty.count() == 0 and {r.kind for r in asking.ladder(pool, []).collect()} == {"none"}


def test_scores_are_squashed_and_judged_by_kind(spark):
    raw = spark.createDataFrame([(0.0,), (1.0,), (0.3,), (2.0,), (-2.0,), (None,)], "x double")
    assert [r[0] and round(r[0], 4) for r in raw.select(asking.squashed(F.col("x"))).collect()] == [0.0, 1.0, 0.3, 0.8808, 0.1192, None]
    rows = spark.createDataFrame([(0.5, "crossencoder"), (0.5, "embedding"), (0.5, "words"), (0.04, "none"), (0.04, "strange"), (0.04, None), (None, "words"), (0.05, "crossencoder"), (0.39, "embedding"), (0.0, "none")], "score double, kind string")
    assert [r[0] for r in rows.select(asking.confidence(F.col("score"), F.col("kind"))).collect()] == ["MEDIUM", "MEDIUM", "HIGH", "MEDIUM", "MEDIUM", "MEDIUM", "LOW", "LOW", "LOW", "LOW"]
    assert asking.over_floor(rows).count() == 8


BLOCK = "qid long, place int, circular_no string, title string, doc_type string, jurisdiction string, status string, status_reason string, issue_date date, clause_ref string, page int, text string"


def test_a_message_holds_its_sources_in_order(spark):
    rows = [
        (1, 2, "PP 2/2020", "Dua", "circular", "FEDERAL", "CANCELLED", "Dibatalkan oleh PP 3/2021", date(2020, 2, 1), "1.1", 4, "teks dua"),
        (1, 1, "PP 1/2020", None, "circular", "SARAWAK", "IN_FORCE", "Berkuat kuasa", None, None, None, None),
        (2, 1, "PP 5/2020", "Lima", "sop", "SARAWAK", "AMENDED", "", date(2021, 3, 4), "2", 1, "lima"),
        (9, 1, "PP 9/2020", "x", "sop", "SARAWAK", "AMENDED", "", None, "2", 1, "nobody asks"),
    ]
    asked = spark.createDataFrame([(1, "apa?", "SARAWAK", "N41", ""), (2, None, None, None, None), (3, "tiada", "FEDERAL", None, None)], "qid long, question string, jurisdiction string, grade string, scheme string")
    got = dict(asking.messages(spark.createDataFrame(rows, BLOCK), asked).collect())
    assert got[1] == (
        "USER_PROFILE: jurisdiction=SARAWAK; grade=N41; scheme=tidak dinyatakan\nQUESTION: apa?\nCONTEXT:\n"
        "[S1] PP 1/2020 | - | circular | SARAWAK | IN_FORCE | tarikh tidak diketahui | - | page -\n\n\n"
        "[S2] PP 2/2020 | Dua | circular | FEDERAL | CANCELLED (Dibatalkan oleh PP 3/2021) | 1 Februari 2020 | 1.1 | page 4\nteks dua"
    )
    assert set(got) == {1, 2} and "| AMENDED | 4 Mac 2021 |" in got[2] and "jurisdiction=-; grade=tidak dinyatakan" in got[2]
    hidden = dict(asking.messages(spark.createDataFrame(rows, BLOCK), asked, True).collect())
    assert "CANCELLED" not in hidden[1] and "| FEDERAL | - | 1 Februari 2020" in hidden[1]


def events(spark, asked, sources, tokens):
    a = spark.createDataFrame(asked, "qid long, n_packs int, kind string, conflict boolean, search_failure string, model_failure string")
    s = spark.createDataFrame(sources, "qid long, place int, id long, score double")
    t = spark.createDataFrame(tokens, "qid long, seq int, section string, text string")
    out = {}
    for r in asking.answer_events(a, s, t).orderBy("qid", "seq").collect():
        out.setdefault(r.qid, []).append((r.seq, r.event, json.loads(r.payload)))
    return out


def test_every_question_ends_with_one_final_event_or_an_error(spark):
    q = lambda n, **k: (n, k.get("packs", 1), "words", False, k.get("lost"), k.get("stopped"))
    asked = [q(1), q(2), q(3, stopped="masa"), q(4, packs=0), q(5, lost="rosak"), q(6), q(7, stopped="masa"), q(8)]
    sources = [(n, k, 10 * n + k, 0.5 - k / 10) for n in (1, 2, 3, 5, 8) for k in (1, 2)]
    tokens = [(1, 1, "answer", "Cuti [s1,"), (1, 2, "answer", " S7] ialah  30 hari ."), (1, 3, "actions", "- mohon [S2].\n- simpan [S3]\n- baca"), (2, 1, "answer", "tanpa sumber [S9]"), (2, 2, "actions", "- mohon [S1]"), (3, 1, "answer", "separuh [S1]"), (4, 1, "answer", "x [S1]"), (6, 1, "answer", "x [S1]")]
    got = events(spark, asked, sources, tokens)
    kinds = {n: [e[1] for e in v] for n, v in got.items()}
    assert kinds[1] == ["sources", "token", "token", "token", "final"] and [e[0] for e in got[1]] == [0, 1, 2, 3, 4]
    assert got[1][0][2] == {"sources": [{"id": "S1", "n": 1, "document_id": 11, "score": 0.4}, {"id": "S2", "n": 2, "document_id": 12, "score": 0.3}], "jurisdiction_conflict": False, "confidence": "HIGH", "rerank": "words"}
    assert got[1][-1][2] == {"answer": "Cuti [S1] ialah 30 hari.", "answerable": True, "refusal": False, "citations": ["S1"], "actions": [{"text": "mohon", "citations": ["S2"]}], "confidence": "HIGH", "warnings": []}
    # no valid citation: the actions go too
    assert got[2][-1][2] == {"answer": asking.REFUSAL, "answerable": False, "refusal": True, "citations": [], "actions": [], "confidence": "LOW", "warnings": []}
    # a model that stops leaves its tokens and sources, and no answer
    assert kinds[3] == ["sources", "token", "final"] and got[3][-1][2]["answer"] is None and got[3][-1][2]["warnings"] == [{"code": "llm_failed", "message": "masa"}] and not got[3][-1][2]["refusal"]
    assert kinds[4] == ["sources", "final"] and got[4][-1][2]["warnings"][0]["code"] == "no_packs" and got[4][-1][2]["refusal"]
    assert got[5] == [(0, "error", {"message": "rosak"})]
    # without sources no model is asked, so it can't stop
    assert kinds[6] == kinds[7] == ["sources", "final"] and got[7][-1][2]["refusal"] and got[7][-1][2]["warnings"] == []
    # an answer that never came
    assert kinds[8] == ["sources", "final"] and got[8][-1][2]["refusal"]
    assert events(spark, [], [], []) == {}


def test_the_queue_of_relations(spark):
    docs = spark.createDataFrame([(1, "A", "IN_FORCE"), (2, "B", "CANCELLED")], "id long, circular_no string, status string")
    rels = spark.createDataFrame([(1, 1, 2, "CANCELS", 1), (2, 1, None, "AMENDS", 0), (3, 2, 9, "REFERENCES", -1), (4, 2, 1, "SUPERSEDES", 0), (5, 7, 1, "AMENDS", 0)], "id long, source_doc_id long, target_doc_id long, relation_type string, verified int")
    read = lambda v: [(r.place, r.rel_id, r.target_no, r.effect) for r in records.relations_queue(rels, docs, v).orderBy("place").collect()]
    assert read(None) == [(1, 3, None, None), (2, 4, "A", "CANCELLED"), (3, 2, None, "AMENDED"), (4, 1, "B", "CANCELLED")]
    assert read(True) == [(1, 1, "B", "CANCELLED")] and read(False) == [(1, 4, "A", "CANCELLED"), (2, 2, None, "AMENDED")]
    assert records.relations_queue(rels.limit(0), docs).count() == 0


def test_alerts_are_ones_own_and_allowed(spark):
    users = spark.createDataFrame([(1, 0), (2, 2), (3, None)], "id long, clearance_level int")
    notices = spark.createDataFrame([(1, 1, 0, False), (2, 1, 1, False), (3, 1, None, True), (4, 2, 2, None), (5, 2, 0, True), (6, 2, 0, False), (7, 3, None, False), (8, 3, 0, False), (9, 8, 0, False)], "id long, user_id long, tier int, read boolean")
    got = [tuple(r) for r in records.alerts(notices, users, 2).orderBy("user_id", "place").collect()]
    assert got == [(1, 3, 1, True, 1), (1, 1, 2, False, 1), (2, 6, 1, False, 1), (2, 5, 2, True, 1), (3, 7, 1, False, 1)]


def test_uploaded_reports(spark):
    kind = analytics.REPORT_KIND
    texts = [json.dumps({"kind": kind, "queries": [{"query": "a", "user": 7, "hour": 3}, "x", 4, None, {"feedback": {"rating": 1}}, {}]}), json.dumps({"kind": "other", "queries": []}), json.dumps({"kind": kind, "queries": {"query": "a"}}), json.dumps({"kind": kind}), "{broken", "", None, json.dumps({"kind": kind, "queries": []}), json.dumps({"kind": kind, "queries": [{"query": 'say "x", [1]'}]})]
    ok, rows = analytics.imported_reports(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    assert [tuple(r) for r in ok.orderBy("id").collect()] == [(0, True, 3), (1, False, 0), (2, False, 0), (3, False, 0), (4, False, 0), (5, False, 0), (6, False, 0), (7, True, 0), (8, True, 1)]
    assert [(r.id, r.place, r.search) for r in rows.orderBy("id", "place").collect()] == [(0, 0, {"query": "a", "hour": "3"}), (0, 1, {"feedback": '{"rating":1}'}), (0, 2, {}), (8, 0, {"query": 'say "x", [1]'})]


def test_views_of_changes(spark):
    docs = spark.createDataFrame([(1, "A", 0), (2, "B", 0), (3, "C", 2)], "id long, circular_no string, classification_level int")
    payload = json.dumps({"relation_type": "AMENDS", "clauses": ["1.1"], "changes": [{"clause_old": "1.1", "clause_new": None, "kind": "REMOVED", "more": 1}], "effective_date": "2024-01-01"})
    sums = spark.createDataFrame([(1, 2, "ms", "en", payload), (2, 1, "m", "e", None), (1, 3, "m", "e", payload)], "old_doc_id long, new_doc_id long, summary_ms string, summary_en string, payload string")
    asked = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 1), (1, 9)], "old_id long, new_id long")
    got = {(r.old_id, r.new_id): r for r in changes.change_views(asked, sums, docs, 1).collect()}
    one = got[1, 2]
    assert (one.code, one.old_no, one.new_no, one.summary_en, one.relation_type, one.clauses, one.effective_date, one.who_is_affected) == ("OK", "A", "B", "en", "AMENDS", ["1.1"], "2024-01-01", None) and one.changes[0].kind == "REMOVED"
    assert got[2, 1].code == "OK" and got[2, 1].clauses == [] == got[2, 1].changes
    # nothing of a document above the clearance is told
    assert [got[k].code for k in ((1, 3), (1, 1), (1, 9))] == ["DOCUMENT", "SUMMARY", "DOCUMENT"] and all(x is None for x in got[1, 3][3:])


def test_recognised_documents(spark):
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "id long, chunk_index int")
    pages = spark.createDataFrame([(1, False), (1, True), (2, False), (2, None), (4, True)], "id long, ocr boolean")
    assert [tuple(r) for r in chunking.recognised(chunks, pages).orderBy("id", "chunk_index").collect()] == [(1, 0, True), (1, 1, True), (2, 0, False), (3, 0, False)]


def test_edges_are_contracted_without_losing_connections(spark, monkeypatch):
    frames = [pd.DataFrame({"up": [5, 7, 9, 5], "down": [4, 5, 8, 4]}), pd.DataFrame({"up": [8], "down": [7]})]
    whole = pd.concat(validity.contracted(iter(frames)))
    assert sorted(map(tuple, whole.values.tolist())) == [(5, 4), (7, 4), (8, 4), (9, 4)]
    # a table that forgets gives stars that still hang together
    monkeypatch.setattr(validity, "MOST_NODES", 0)
    rest = pd.concat(validity.contracted(iter(frames)))
    assert validity.component_labels(spark.createDataFrame(rest.rename(columns={"up": "a", "down": "b"}), "a long, b long")).groupBy("component").count().collect() == [(4, 5)]
    assert list(map(len, validity.contracted(iter([])))) == [0]
    # a hub, a long chain and two pairs, dealt over partitions
    links = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1400)] + [(5001, 5000), (6000, 6001), (7, 7), (9000, 9000), (None, 3)]
    edges = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = dict(validity.component_labels(edges).collect())
    want = {k: 0 for k in range(300)} | {k: 1000 for k in range(1000, 1401)} | {5000: 5000, 5001: 5000, 6000: 6000, 6001: 6000, 9000: 9000}
    assert got == want
