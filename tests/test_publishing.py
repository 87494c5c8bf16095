"""Publishing, installing and rolling back packs of files; what fails leaves the old state."""

import os

import pytest
from pyspark.sql import functions as F

from quillstone.operators import publishing as P


def rows(spark, n, word="x"):
    return {"documents": spark.range(n).select("id", F.lit(word).alias("status")), "chunks": spark.range(2 * n).withColumnRenamed("id", "chunk_id")}


@pytest.fixture
def shelves(spark, tmp_path):
    return P.Shelf(spark, str(tmp_path / "dist")), P.Shelf(spark, str(tmp_path / "device"))


def refused(code, call, *args, **more):
    with pytest.raises(P.Refused) as error:
        call(*args, **more)
    assert error.value.code == code


def test_versions_only_grow(spark, shelves):
    dist, _ = shelves
    P.publish(dist, rows(spark, 3), 1, 2, "m")
    first = P.publish(dist, rows(spark, 2), 0, 1, "m")
    assert first["previous_version"] is None and first["rows"] == {"documents": 2, "chunks": 4}
    refused("version", P.publish, dist, rows(spark, 1), 0, 1, "m")
    assert [(p["tier"], p["version"]) for p in dist.packs()] == [(0, 1), (1, 2)]
    again = P.publish(dist, rows(spark, 5), 0, 1, "m", force=True)
    assert again["previous_version"] == 1 and dist.tables(dist.packs()[0])["documents"].count() == 5 and len(dist.packs()) == 2
    assert P.publish(dist, rows(spark, 4), 0, 3, "m")["previous_version"] == 1
    assert dist.read("documents", 0).count() == 4 and dist.read("documents", 1).count() == 7 and dist.read("nothing", 2) is None
    assert [r["version"] for r in P.listing(dist)] == [1, 3, 2]


def test_a_failed_write_changes_nothing(spark, shelves):
    dist, _ = shelves
    P.publish(dist, rows(spark, 3), 0, 1, "m")
    broken = rows(spark, 3) | {"vectors": spark.range(3).select(F.raise_error(F.lit("lost")).alias("v"))}
    with pytest.raises(Exception, match="lost"):
        P.publish(dist, broken, 0, 2, "m")
    assert [p["version"] for p in dist.packs()] == [1] and dist.files.names(f"{dist.folder}/staging") == [] and len(dist.files.names(f"{dist.folder}/packs")) == 1


def test_of_two_writers_one_wins(spark, shelves):
    dist, _ = shelves
    P.publish(dist, rows(spark, 1), 0, 1, "m")
    base, packs = dist.number(), dist.manifest()["packs"]
    P.publish(dist, rows(spark, 2), 0, 2, "m")
    refused("conflict", dist.commit, base, packs)
    assert dist.manifest()["packs"][-1]["version"] == 2
    # a reader of the old manifest still finds its files
    assert dist.tables(dist.manifest(base)["packs"][0])["documents"].count() == 1
    orphan = P.staged(dist, rows(spark, 1), 0, 9)
    assert dist.sweep() == [orphan["path"]] and len(dist.packs()) == 2


def test_install_and_roll_back(spark, shelves):
    dist, device = shelves
    for tier, version in ((0, 1), (1, 1), (2, 1)):
        P.publish(dist, rows(spark, 3 + tier), tier, version, "m")
    assert [(p["tier"], p["version"]) for p in P.updates(dist, device, 1)] == [(0, 1), (1, 1)]
    for entry in P.updates(dist, device, 1):
        P.install(dist, device, entry, 1, "m")
    assert P.updates(dist, device, 1) == [] and device.read("documents", 1).count() == 7
    refused("clearance", P.install, dist, device, dist.packs()[2], 1, "m")
    refused("version", P.install, dist, device, dist.packs()[0], 1, "m")
    refused("none", P.rollback, device, 0)
    P.publish(dist, rows(spark, 9, "y"), 0, 2, "m")
    assert P.install(dist, device, P.updates(dist, device, 2)[0], 1, "m")["previous"]["version"] == 1
    assert device.read("documents", 0).count() == 9
    assert P.rollback(device, 0)["version"] == 1 and device.read("documents", 0).count() == 3
    refused("none", P.rollback, device, 0)
    assert [p["version"] for p in P.updates(dist, device, 0)] == [2]


def test_packs_are_verified(spark, shelves, tmp_path):
    dist, device = shelves
    entry = P.publish(dist, rows(spark, 3), 0, 1, "m")
    refused("embedding_model", P.install, dist, device, entry, 0, "other")
    refused("checksum", P.install, dist, device, entry | {"hashes": entry["hashes"] | {"documents": "0"}}, 0, "m")
    refused("manifest", P.install, dist, device, entry | {"version": 7}, 0, "m")
    refused("unreadable", P.install, dist, device, entry | {"path": "packs/none"}, 0, "m")
    for name in ("../secret", "/etc", "packs/../../x", "file:///etc", ""):
        refused("path", P.install, dist, device, entry | {"path": name}, 0, "m")
    assert device.packs() == [] and device.number() == 0
    # a row that is changed in place
    place = tmp_path / "dist" / entry["path"] / "documents"
    rows(spark, 3, "changed")["documents"].write.mode("overwrite").parquet(str(place))
    refused("checksum", P.install, dist, device, entry, 0, "m")
    P.install(dist, device, P.publish(dist, rows(spark, 3), 0, 2, "m"), 0, "m")
    os.rename(tmp_path / "device" / "packs", tmp_path / "device" / "gone")
    assert device.packs() == [] and P.listing(device) == []


def test_tables_of_a_tier(spark):
    docs = spark.createDataFrame([(1, "A", 0, "r"), (2, "B", 1, "Dibatalkan oleh A"), (3, "C", 0, "Dibatalkan oleh B")], "id long, circular_no string, classification_level int, status_reason string")
    chunks = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "chunk_id long, id long")
    vectors = spark.createDataFrame([(10, [1.0]), (20, [1.0]), (30, [0.5])], "chunk_id long, v array<double>")
    relations = spark.createDataFrame([(1, 2, 3, 1), (2, 1, 3, 1), (3, 2, 1, 0)], "id long, source_doc_id long, target_doc_id long, verified int")
    summaries = spark.createDataFrame([(3, 2, "s"), (3, 1, "t")], "old_doc_id long, new_doc_id long, summary string")
    zero, one = (P.tier_tables(t, docs, chunks, vectors, relations, summaries) for t in (0, 1))
    ids = lambda df, c: sorted(r[0] for r in df.select(c).collect())
    assert ids(zero["documents"], "id") == [1, 3] and ids(one["documents"], "id") == [2] and ids(zero["vectors"], "chunk_id") == [10, 30]
    assert ids(zero["relations"], "id") == [2] and ids(one["relations"], "id") == [1] and ids(zero["summaries"], "summary") == ["t"] and ids(one["summaries"], "summary") == ["s"]
    assert "B" not in zero["documents"].where("id = 3").first().status_reason
    refused("vectors", P.tier_tables, 0, docs, chunks, vectors.where("chunk_id <> 30"), relations, summaries)
