"""Streams against the batch results of the same rows, however they are cut."""

import datetime
import json
import random

from pyspark.sql import functions as F

from quillstone.operators import answers
from quillstone.streaming import answers as A
from quillstone.streaming import logs

TEXTS = [
    "ANSWERABLE: YES\nBoleh [S1].\n**ACTIONS:**\n- Mohon [S1]", "**ANSWERABLE:** yes** Ya.\n\n ACTIONS :  ** - a\n- b", "ANSWERABLE: NO\nx ACTIONS: y", "ANSWERABLE: NOT really", "answerable:yes", "", "  \n ", " short", "  short ACTIONS: a",
    "  longer than the sixty characters that a first line may take, so blanks go", " two\nlines", "ANSWERABLE: YES ACT ACTION ACTIONS no colon * ** \n ACTIONS", "ANSWERABLE: YES\n" + " " * 90 + "deep ** \n\n **  ACTIONS\n:\n\n***- x ACTIONS: again",
    "<think>why ANSWERABLE: NO</think>ANSWERABLE: YES\nSo <thin <think>x</think>it is.<think>open", "ANSW<think>a</think>ERABLE: YES b", " " * 70 + "ANSWERABLE: YES late", "ANSWERABLE: YESTERDAY", "plain text without a head", "ANSWERABLE: YES\nx <", "</think> a\nb", "ANSWERABLE: YES ***",
]


def whole(spark):
    rows = [(i, 0, t) for i, t in enumerate(TEXTS)]
    return {r.id: (r.answerable, r.answer, r.actions) for r in answers.fold_streams(spark.createDataFrame(rows, "id long, seq int, piece string")).collect()}


def fold(events):
    join = lambda name: "".join(t for s, t in events if s == name)
    return join("answer"), join("actions")


def test_every_cut_gives_the_whole(spark):
    want, rng = whole(spark), random.Random(3)
    for i, text in enumerate(TEXTS):
        cuts = [[text[k : k + n] for k in range(0, len(text), n)] for n in (1, 2, 3, 5, 7, 11, 1000)]
        cuts += [[text[:k], text[k:]] for k in range(len(text) + 1)]
        for _ in range(30):
            at = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(8)))
            cuts.append([text[a:b] for a, b in zip([0, *at], [*at, len(text)])])
        for pieces in cuts:
            parser, out = A.Parser(), []
            for piece in pieces:
                out += parser.feed(piece)
                parser = A.Parser(**json.loads(json.dumps(parser.state())))
            out += parser.finish()
            assert (parser.answerable, *fold(out)) == want[i], (text, pieces)


def test_text_is_given_out_early():
    parser = A.Parser()
    assert parser.feed("ANSWERABLE: YES") == [] and parser.feed("\nHad 15 hari. AC") == [("answer", "Had 15 hari.")]
    assert parser.feed("TUALLY ") == [("answer", " ACTUALLY")] and parser.feed("\nACTIONS:") == [] and parser.feed(" - go") == [("actions", "- go")]


def pieces_of(rng):
    rows = []
    for i, text in enumerate(TEXTS):
        at = sorted(rng.randrange(len(text) + 1) for _ in range(6))
        cut = [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]
        rows += [(i, k, p, k == len(cut) - 1) for k, p in enumerate(cut)]
    return rows


def test_stream_of_pieces(spark, tmp_path):
    rng = random.Random(4)
    rows = pieces_of(rng)
    rng.shuffle(rows)  # pieces come early, late and twice
    rows += rng.sample(rows, 20)
    schema = "id long, seq long, piece string, last boolean, at timestamp"
    day = datetime.datetime(2024, 5, 1)
    rows = [(*r, day) for r in rows] + [(500, 0, "ANSWERABLE: YES never ended AC", False, day)]

    def run(some):
        for k, part in enumerate(some):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            pieces = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            events = A.answer_events(pieces)
            # a new query each time goes on from the checkpoint
            events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)

    size = len(rows) // 3 + 1
    run([rows[k : k + size] for k in range(0, len(rows), size)])
    assert spark.read.parquet(str(tmp_path / "out")).where("id = 500 and section = 'end'").count() == 0
    # the watermark passes the stream that has no last piece
    run([[(900, 0, "x", False, day + datetime.timedelta(hours=3))], [(901, 0, "x", False, day + datetime.timedelta(hours=3))]])
    events = spark.read.parquet(str(tmp_path / "out")).orderBy("id", "part").collect()
    want = whole(spark)
    for i in range(len(TEXTS)):
        mine = [e for e in events if e.id == i]
        assert [e.part for e in mine] == list(range(len(mine))) and [e.section for e in mine].count("end") == 1 and mine[-1].section == "end"
        assert (mine[-1].answerable, *fold([(e.section, e.text) for e in mine])) == want[i], TEXTS[i]
    ended = [e for e in events if e.id == 500]
    assert ended[-1].section == "end" and fold([(e.section, e.text) for e in ended]) == ("never ended AC", "")


def test_log_is_appended_once(spark, tmp_path):
    schema = "id string, query string, created_at timestamp"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    put = lambda rows: spark.createDataFrame(rows, "id string, query string, t long").select("id", "query", F.timestamp_seconds("t").alias("created_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: logs.append_log(source(), str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination(120)
    put([("a", "one", 100), ("b", "two", 200), ("a", "one", 100)])
    go()
    put([("b", "two again", 300), ("c", "three", 400)])
    go()
    read = lambda: sorted((r.id, r.query) for r in logs.read_log(spark, str(tmp_path / "log")).collect())
    assert read() == [("a", "one"), ("b", "two"), ("c", "three")]
    # the first batch runs again, as after a failure between its write and its commit
    first = spark.read.parquet(str(tmp_path / "log" / "batch=0")).collect()
    logs.append_batch(str(tmp_path / "log"))(spark.createDataFrame(first), 0)
    assert read() == [("a", "one"), ("b", "two"), ("c", "three")]


def test_log_rows_and_feedback(spark):
    asked = spark.createDataFrame([(1, 7, "q", "{}", True, "HIGH", 12, 5, "t"), (2, 7, "r", "{}", False, "HIGH", 12, 5, "t")], "id long, user_id long, query string, rewritten_json string, answerable boolean, confidence string, latency_ms long, sources_ms long, topic string").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    sources = spark.createDataFrame([(1, 2, 20, 201, "B", 0.5, "c2"), (1, 1, 10, 101, "A", 0.25, "c1")], "id long, place int, doc long, chunk long, no string, score double, cluster string")
    excluded = spark.createDataFrame([(1, 1, 30, "C")], "id long, place int, doc long, no string")
    rows = {r.id: r for r in logs.log_rows(asked, sources, excluded).collect()}
    assert json.loads(rows["1"].retrieved_ids) == [{"doc": 10, "chunk": 101, "no": "A"}, {"doc": 20, "chunk": 201, "no": "B"}] and json.loads(rows["1"].excluded_ids) == [{"doc": 30, "no": "C"}]
    assert (rows["1"].top_score, rows["1"].cluster, rows["1"].confidence) == (0.5, "c1", "HIGH") and (rows["2"].retrieved_ids, rows["2"].confidence, rows["2"].top_score) == ("[]", "LOW", None)
    feedback = spark.createDataFrame([(1, "up", "x" * 900, 1), (1, "down", None, 2), (3, "up", "", 1)], "id long, rating string, comment string, created_at int")
    given = {r.id: r.feedback for r in logs.with_feedback(logs.log_rows(asked, sources, excluded), feedback).collect()}
    assert json.loads(given["1"]) == {"rating": "down", "comment": ""} and given["2"] is None
    assert len(json.loads(spark.range(1).select(logs.feedback_json(F.lit("up"), F.lit("x" * 900))).first()[0])["comment"]) == 500
