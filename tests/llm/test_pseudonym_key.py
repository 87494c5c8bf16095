"""Sessions without a key, on masters that aren't local, and how often a number is permuted."""

import time

import pytest

from quillstone.llm.pii import KEY_SETTING, PUBLIC_KEY, pseudonymise

CARD = "4785380592391139"


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session, as if its master were a cluster's, without a key."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    yield spark
    spark.conf.unset(KEY_SETTING)


def test_personal_data_on_a_cluster_without_a_key(cluster, data):
    from corpus_pipeline import personal_data

    docs = cluster.createDataFrame([(1, f"pay {CARD} now"), (2, f"again {CARD}, mail a@b.example"), (3, "nothing"), (4, None)], "doc_id long, text string")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    got = texts(personal_data(cluster, docs, data))
    assert got[3] == "nothing" and got[4] is None and got[1].split()[1] == got[2].split()[1].rstrip(",") != CARD and "a@b" not in got[2]
    # the key is none that others know, and the session keeps it
    assert len(cluster.conf.get(KEY_SETTING)) == 64 and got[1] != texts(pseudonymise(docs, PUBLIC_KEY))[1]
    assert texts(personal_data(cluster, docs, data)) == got == texts(pseudonymise(docs, cluster.conf.get(KEY_SETTING)))
    cluster.conf.set(KEY_SETTING, "own")
    assert texts(personal_data(cluster, docs, data)) == texts(pseudonymise(docs, "own"))


def test_op1_on_a_cluster_without_a_key(cluster, data):
    from quillstone.llm.queries import op1_pseudonyms

    docs = cluster.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = op1_pseudonyms(cluster, data).orderBy("doc_id").collect()
    assert got == pseudonymise(docs, cluster.conf.get(KEY_SETTING), counts="n_replaced").orderBy("doc_id").collect()
    assert len(got) == docs.count() and sum(r.n_replaced for r in got) > 0


def test_local_sessions_draw_no_key(spark):
    from quillstone.llm.pii import drawn_key

    assert drawn_key(spark) == PUBLIC_KEY and spark.conf.get(KEY_SETTING, None) is None


def test_a_number_is_permuted_once_not_for_each_digit(spark):
    # 150 cards took 33 s, planning included, when each character looked its digit up in a pseudonym of its own, and take 4 s now
    docs = spark.createDataFrame([(1, f"{CARD} x " * 150)], "doc_id long, text string").coalesce(1)
    began = time.time()
    assert pseudonymise(docs, "k", counts="n").first().n == 150 and time.time() - began < 16
