"""Publishing snapshots as files: staged writing, a manifest that is swapped, installation, listing, rollback.

A pack is a folder of Parquet tables that is never changed.  What is published is what the newest manifest names, and a
manifest is committed by one rename to the next number, which fails if that number is there: of two writers on one base
one wins, and a write that fails leaves readers on the old manifest.  Tables are hashed as they lie, after they are
written.  Files are reached through Spark's file systems, so folders may be in any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.snapshots import content_hash, redacted, relation_tiers

#: names of the levels; fixed values
TIERS = {0: "TERBUKA", 1: "TERHAD", 2: "SULIT"}


class Refused(Exception):
    """A publication or installation that isn't done; code says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Files:
    """Files of one store, by Spark's own file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(folder).toUri(), self.conf)
        self.fs = self.path(folder).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self.path(folder)).getLength()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        """Fails if there is something under the new name."""
        self.fs.mkdirs(self.path(new).getParent())
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        array = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        array[0] = none
        self.context.rename(self.path(old), self.path(new), array)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def inside(folder: str, name: str) -> str:
    """The place of a relative name in a folder; names that lead out of it are refused."""
    parts = name.replace("\\", "/").split("/")
    if not name or name.startswith("/") or ":" in name or ".." in parts:
        raise Refused("path", f"{name!r} is not inside {folder}")
    return f"{folder}/{name}"


class Shelf:
    """A folder of packs with its manifests."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)

    def number(self) -> int:
        found = [int(n.removesuffix(".json")) for n in self.files.names(f"{self.folder}/manifests") if n.removesuffix(".json").isdigit()]
        return max(found, default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self.number() if number is None else number
        return json.loads(self.files.read(f"{self.folder}/manifests/{number:08}.json")) if number else {"packs": []}

    def commit(self, base: int, packs: list[dict]) -> None:
        """Makes packs the manifest after base, in order of tier and version; refused if another one came between."""
        order = sorted(packs, key=lambda p: (p["tier"], p["version"]))
        draft = f"{self.folder}/staging/manifest-{uuid.uuid4()}.json"
        self.files.write(draft, json.dumps({"packs": order}, indent=1, ensure_ascii=False))
        try:
            self.files.rename(draft, f"{self.folder}/manifests/{base + 1:08}.json")
        except Exception as error:
            self.files.remove(draft)
            if self.number() > base:
                raise Refused("conflict", f"manifest {base + 1} was committed by another writer") from error
            raise

    def packs(self) -> list[dict]:
        """The listed packs whose files are there."""
        return [p for p in self.manifest()["packs"] if self.files.exists(inside(self.folder, p["path"]))]

    def tables(self, pack: dict) -> dict[str, DataFrame]:
        place = inside(self.folder, pack["path"])
        return {name: self.spark.read.parquet(f"{place}/{name}") for name in pack["hashes"]}

    def read(self, table: str, clearance: int) -> DataFrame | None:
        """A table of the newest pack of each tier up to a clearance; None where there is no such pack."""
        newest: dict[int, dict] = {}
        for p in self.packs():
            if p["tier"] <= clearance and table in p["hashes"]:
                newest[p["tier"]] = p
        frames = [self.tables(p)[table] for p in newest.values()]
        out = frames[0] if frames else None
        for more in frames[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def sweep(self) -> list[str]:
        """Removes packs and drafts that the newest manifest doesn't name; not while somebody writes."""
        named = {p["path"] for p in self.manifest()["packs"]}
        gone = [f"packs/{n}" for n in self.files.names(f"{self.folder}/packs") if f"packs/{n}" not in named]
        gone += [f"staging/{n}" for n in self.files.names(f"{self.folder}/staging")]
        for name in gone:
            self.files.remove(f"{self.folder}/{name}")
        return gone


def staged(shelf: Shelf, tables: dict[str, DataFrame], tier: int, version: int) -> dict:
    """Writes tables to a folder that no manifest names yet; its entry, with hashes of what lies there."""
    name = f"{tier}-{version}-{uuid.uuid4().hex[:12]}"
    draft, path = f"{shelf.folder}/staging/{name}", f"packs/{name}"
    try:
        for table, rows in tables.items():
            rows.write.parquet(f"{draft}/{table}")
        read = {t: shelf.spark.read.parquet(f"{draft}/{t}") for t in tables}
        entry = {"tier": tier, "version": version, "path": path, "hashes": {t: content_hash(x) for t, x in read.items()}, "rows": {t: x.count() for t, x in read.items()}, "size_bytes": shelf.files.size(draft)}
        shelf.files.write(f"{draft}/_own.json", json.dumps({"tier": tier, "version": version}))
        shelf.files.rename(draft, f"{shelf.folder}/{path}")
        return entry
    except BaseException:
        shelf.files.remove(draft)
        raise


def publish(shelf: Shelf, tables: dict[str, DataFrame], tier: int, version: int, model: str, force: bool = False) -> dict:
    """Publishes the tables of one tier as a version that must be newer than its latest, unless forced to replace it."""
    base = shelf.number()
    packs = shelf.manifest(base)["packs"]
    previous = max((p["version"] for p in packs if p["tier"] == tier), default=None)
    if previous is not None and version <= previous and not force:
        raise Refused("version", f"version {version} must be greater than {previous}")
    entry = staged(shelf, tables, tier, version) | {"tier_name": TIERS.get(tier, str(tier)), "embedding_model": model, "previous_version": previous}
    shelf.commit(base, [p for p in packs if (p["tier"], p["version"]) != (tier, version)] + [entry])
    return entry


def verify(shelf: Shelf, entry: dict, model: str) -> None:
    """Refuses a pack whose files don't hold what its entry says: unreadable, checksum, manifest, embedding_model."""
    place = inside(shelf.folder, entry["path"])
    try:
        held = {t: content_hash(shelf.spark.read.parquet(f"{place}/{t}")) for t in entry["hashes"]}
        own = json.loads(shelf.files.read(f"{place}/_own.json"))
    except Exception as error:
        raise Refused("unreadable", f"{entry['path']}: {type(error).__name__}") from error
    if held != entry["hashes"]:
        raise Refused("checksum", f"{entry['path']} is not what was published")
    if (own["tier"], own["version"]) != (entry["tier"], entry["version"]):
        raise Refused("manifest", f"{entry['path']} holds tier {own['tier']} version {own['version']}")
    if entry.get("embedding_model") != model:
        raise Refused("embedding_model", f"{entry.get('embedding_model')} is not {model}: vectors can't be compared")


def updates(source: Shelf, device: Shelf, clearance: int) -> list[dict]:
    """The newest listed pack of each tier up to a clearance that is newer than what is installed."""
    installed = {p["tier"]: p["version"] for p in device.packs()}
    newest = {p["tier"]: p for p in source.manifest()["packs"] if p["tier"] <= clearance}
    return [p for t, p in sorted(newest.items()) if t not in installed or p["version"] > installed[t]]


def install(source: Shelf, device: Shelf, entry: dict, clearance: int, model: str) -> dict:
    """Copies a pack, verifies the copy and makes it the tier's; the one before is kept for one rollback."""
    tier, version = entry["tier"], entry["version"]
    if tier > clearance:
        raise Refused("clearance", f"tier {tier} is above {clearance}")
    base = device.number()
    now = {p["tier"]: p for p in device.manifest(base)["packs"] if device.files.exists(inside(device.folder, p["path"]))}
    old = now.get(tier)
    if old and version <= old["version"]:
        raise Refused("version", f"version {version} is not newer than {old['version']}")
    verify(source, entry, model)
    copy = staged(device, source.tables(entry), tier, version)
    if copy["hashes"] != entry["hashes"]:
        device.files.remove(inside(device.folder, copy["path"]))
        raise Refused("checksum", "the copy is not what was published")
    kept = {k: old[k] for k in ("path", "version", "hashes", "embedding_model")} if old else None
    now[tier] = copy | {"embedding_model": model, "previous": kept}
    device.commit(base, list(now.values()))
    return now[tier]


def rollback(device: Shelf, tier: int) -> dict:
    """Makes the version before the installed one the tier's again, once."""
    base = device.number()
    packs = device.manifest(base)["packs"]
    old = next((p for p in packs if p["tier"] == tier), None)
    before = old and old.get("previous")
    if not before or not device.files.exists(inside(device.folder, before["path"])):
        raise Refused("none", f"no version to roll back to in tier {tier}")
    back = {"tier": tier, "previous": None} | before
    device.commit(base, [p for p in packs if p["tier"] != tier] + [back])
    return back


def tier_tables(tier: int, docs: DataFrame, chunks: DataFrame, vectors: DataFrame, relations: DataFrame, summaries: DataFrame) -> dict[str, DataFrame]:
    """The tables of one tier's pack, reasons redacted; refused if a chunk has no vector.

    docs: id, classification_level, status_reason, ...; chunks: chunk_id, id; vectors: chunk_id; relations with their
    tier; summaries: old_doc_id, new_doc_id.  What names documents is in the pack of the higher of their levels.
    """
    own = redacted(docs, relations).where(F.col("classification_level") == tier)
    held = chunks.join(own.select("id"), "id", "left_semi")
    missing = held.join(vectors.select("chunk_id"), "chunk_id", "left_anti").count()
    if missing:
        raise Refused("vectors", f"{missing} chunks of tier {tier} have no vector")
    edges = relation_tiers(docs, relations).where(F.col("tier") == tier).drop("tier")
    level = lambda a, b: docs.select(F.col("id").alias(a), F.col("classification_level").alias(b))
    seen = summaries.join(level("old_doc_id", "o"), "old_doc_id").join(level("new_doc_id", "n"), "new_doc_id")
    return {
        "documents": own,
        "chunks": held,
        "vectors": vectors.join(held.select("chunk_id"), "chunk_id", "left_semi"),
        "relations": edges,
        "summaries": seen.where(F.greatest("o", "n") == tier).select(*summaries.columns),
    }


def listing(shelf: Shelf, model: str | None = None, columns: Iterable[str] = ("tier", "tier_name", "version", "path", "size_bytes", "embedding_model")) -> list[dict]:
    """The packs that are there, by tier and version; with a model, embedding_ok tells whether a pack's vectors are of it."""
    rows = [{c: p.get(c) for c in columns} | {"tier_name": TIERS.get(p["tier"], str(p["tier"]))} for p in shelf.packs()]
    return [r | {"embedding_ok": r.get("embedding_model") == model} for r in rows] if model is not None else rows
