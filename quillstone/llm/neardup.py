"""MinHash near-duplicates by HyperMinHash (operator 9).

A text's set is its distinct five-word shingles.  Each shingle's hash picks one of 128 registers; a register keeps the
smallest hash as its number of leading zeros and ten bits of mantissa.  Empty registers borrow from others in an order
fixed for all texts.  Bands of four registers give candidates; the registers of a candidate pair estimate its Jaccard
index, corrected for chance collisions; what may reach the threshold is confirmed on the full sets.

Equal sets are one class, represented by the smallest doc_id.  Buckets never give their pairs: each is a star round a
member picked by a hash, another in each bucket.  Star links that may be as alike as ``LOOSE`` join documents into
clusters.  A bucket that still holds several clusters is open, as its pivot says nothing about two members that are both
unlike it: there the members outside the largest cluster are compared with all others, and only links that join clusters
leave the task.  An open bucket with over ``WIDE`` members outside its largest cluster is split by each later band first,
``DEPTH`` bands at most, and then compared in blocks.  So two documents over the threshold get into one cluster unless
they share no band, or a wide open bucket and no further band to split it by.

Inside a cluster each document's likeliest star link is confirmed on full sets; where that leaves several components,
members of different ones meet, block by block: registers are compared, sets confirm pairs that nothing has joined yet,
and only the links that join something leave the task.  So a large group of near copies costs a pass over its sets, and members that no
star link joins are compared with all others.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and is kept; a text with
fewer than five words has one shingle, the whole sequence; repeated rows of one doc_id give a row each, in the class of
its own text; an id that represents several classes joins them.  A row whose doc_id is null has its set's size, is linked with nothing, has no component (null) and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import components, cut
from quillstone.llm.memory import in_frames, release, small_batches

SHINGLE = 5
REGISTERS, BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // BAND
#: least share of the union, in hundredths, and the estimate (four standard errors below) that is confirmed on sets
PERCENT, ESTIMATE = 75, 0.58
LOOSE, BLOCK = 0.5, 512
#: members outside a bucket's largest cluster, members in a task, and bands in a key at most
WIDE, SPOT, DEPTH = 512, 1024, 3


class WordHashes(dict):
    """64-bit hash of each word; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = out = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out


WORD_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z count as a-z, and words end at ASCII white space only."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def borrow_order() -> np.ndarray:
    """For each register, the registers that it borrows from, in order; the same for all texts."""
    rng = np.random.default_rng(11)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


BORROW = borrow_order()


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: leading zeros of the bucket's least hash, then its mantissa bits; 0 for an empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    bucket = (hashes >> np.uint64(57)).astype(np.int64)
    rest = hashes << np.uint64(7) | np.uint64(127)
    # hashes are sorted, so the first of each bucket is its least
    which, first = np.unique(bucket, return_index=True)
    least = np.zeros(REGISTERS, np.uint64)
    least[which] = rest[first]
    full = np.zeros(REGISTERS, bool)
    full[which] = True
    # leading zeros from the exponent; the upper 32 bits are exact in a double
    top = (least >> np.uint64(32)).astype(np.float64)
    zeros = np.where(top > 0, 32 - np.frexp(top)[1], 32).astype(np.uint64)
    shifted = least << (zeros + np.uint64(1))
    value = ((zeros.astype(np.uint16) + np.uint16(1)) << np.uint16(MANTISSA)) | (shifted >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        lender = BORROW[empty][np.arange(len(empty)), full[BORROW[empty]].argmax(1)]
        value[empty] = value[lender]
    return value


def band_keys(value: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    packed = np.ascontiguousarray(value.astype("<u2")).view("<u8").astype(np.uint64)
    return mixed(packed + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard index from shares of equal registers, less the chance that different least hashes look alike."""
    chance = 2.0 ** -(MANTISSA + 1)
    return ((a == b).mean(-1) - chance) / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (sums that name the set), regs."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                h = shingles(text)
                again = mixed(h + np.uint64(0x632BE59BD9B4E019))
                rows.append((len(h), int(h.sum(dtype=np.uint64).view(np.int64)), int(again.sum(dtype=np.uint64).view(np.int64)), registers(h).astype("<u2").tobytes() if len(h) else None))
            out = pd.DataFrame(rows, columns=["n", "k1", "k2", "regs"])
            out.insert(0, "doc_id", frame["doc_id"].array)
            yield out
        release()

    return in_frames(docs.select("doc_id", "text"), work, "doc_id long, n long, k1 long, k2 long, regs binary")


def bands(reps: DataFrame) -> DataFrame:
    """(key, rep, band) of each band, the key naming band and registers."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                keys = np.stack([band_keys(np.frombuffer(r, "<u2")) for r in frame["regs"]])
                yield pd.DataFrame({"key": keys.ravel(), "rep": np.repeat(frame["rep"].to_numpy(), BANDS), "band": np.tile(np.arange(BANDS), len(frame))})

    return reps.select("rep", "regs").mapInPandas(work, "key long, rep long, band int")


def shared(keyed: DataFrame) -> DataFrame:
    """Rows of the buckets of two members or more."""
    return cut(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key"))


def stars(keyed: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of each member of a bucket with the bucket's pivot."""
    pivots = keyed.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", "key")).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(pivots, "key").where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def loose(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose registers show a likeness of ``LOOSE`` or more, with it."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("regs").alias(f"r_{x}"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                a, b = (np.frombuffer(b"".join(frame[c]), "<u2").reshape(len(frame), REGISTERS) for c in ("r_a", "r_b"))
                alike = estimate(a, b)
                yield frame[["a", "b"]].assign(e=alike)[alike >= LOOSE]

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "r_a", "r_b").mapInPandas(work, "a long, b long, e double")


def open_groups(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, component, ...) of the keys whose members are in several components.

    With the number of members, the largest component and its number.
    """
    counts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
    counts = counts.agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top")).where("n > top.c")
    return cut(rows.join(counts.select("key", "n", F.col("top.c").alias("most"), F.col("top.component").alias("top")), "key"))


def open_buckets(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the open buckets, with their clusters."""
    return open_groups(cut(keyed.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "band", F.coalesce("component", "rep").alias("component"))))


def spots(rows: DataFrame, wide: int, size: int) -> DataFrame:
    """(key, spot, rep, component) of open groups: the largest component in parts, all others with each part.

    With over ``wide`` others, all members are cut into blocks, and each pair of blocks is a spot.
    """
    parts, blocks = F.ceil(F.col("most") / size), F.ceil(F.col("n") / size)
    part, own = F.pmod(F.xxhash64("rep", F.lit(4)), parts), F.pmod(F.xxhash64("rep", F.lit(4)), blocks)
    upto = lambda count: F.sequence(F.lit(0).cast("long"), count - 1)
    light = F.col("n") - F.col("most") <= wide
    pairs = F.transform(upto(blocks), lambda x: F.least(own, x) * blocks + F.greatest(own, x))
    where = F.when(light & (F.col("component") == F.col("top")), F.array(part)).when(light, upto(parts)).otherwise(pairs)
    return rows.select("key", F.explode(where).alias("spot"), "rep", "component")


def whole_groups(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows that follow each other, across batches; only one group is held."""
    held = None
    for frame in frames:
        if len(frame):
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = np.logical_and.reduce([held[k] == held[k].iloc[-1] for k in key])
            for _, group in held[~last].groupby(key, sort=False):
                yield group
            held = held[last]
    if held is not None:
        yield held


def finer(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """Buckets split by each later band; a pair that shares bands meets again under the next one that it shares."""
    later = keyed.select("rep", F.col("key").alias("key2"), F.col("band").alias("band2"))
    split = rows.select("key", "rep", "band").join(later, "rep").where("band2 > band")
    return shared(split.select(F.xxhash64("key", "key2").alias("key"), "rep", F.col("band2").alias("band")))


def joining(rep: np.ndarray, component: np.ndarray, regs: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of different clusters that may reach the threshold, those joined already left out."""
    names, label, count = np.unique(component, return_inverse=True, return_counts=True)
    order = np.argsort(count[label], kind="stable")
    rep, label, regs = rep[order], label[order], regs[order]
    parent, out = list(range(len(names))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    # the largest cluster comes last, and its members need no rows of their own
    for k in range(int((label != label[-1]).sum())):
        others = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
        for j in others[estimate(regs[k], regs[others]) >= ESTIMATE].tolist():
            a, b = root(label[k]), root(label[j])
            if a != b:
                parent[a] = b
                out.append((int(rep[k]), int(rep[j])))
    return out


def across(rows: DataFrame, reps: DataFrame, wide: int) -> DataFrame:
    """Links (a, b) that join clusters inside open buckets."""
    dealt = spots(rows, wide, SPOT).join(reps, "rep").repartition("key", "spot").sortWithinPartitions("key", "spot")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(frames, ["key", "spot"]):
            if group["component"].nunique() > 1:
                regs = np.frombuffer(b"".join(group["regs"]), "<u2").reshape(len(group), REGISTERS)
                yield pd.DataFrame(joining(group["rep"].to_numpy(), group["component"].to_numpy(), regs), columns=["a", "b"], dtype=np.int64)

    return dealt.select("key", "spot", "rep", "component", "regs").mapInPandas(work, "a long, b long")


def clustered(reps: DataFrame, wide: int) -> tuple[DataFrame, DataFrame]:
    """(node, component) of documents that have others which may be over the threshold, and star links (a, b, e)."""
    keyed = shared(bands(reps))
    starred = cut(loose(stars(keyed), reps))
    links, level = starred.select("a", "b"), keyed
    found = cut(components(links))
    for depth in range(1, DEPTH + 1):
        rows = open_buckets(level, found)
        light = rows if depth == DEPTH else rows.where(F.col("n") - F.col("most") <= wide)
        links = cut(links.unionByName(across(light, reps, wide)))
        heavy = rows.where(F.col("n") - F.col("most") > wide)
        last = depth == DEPTH or heavy.isEmpty()
        if not last:
            level = finer(heavy, keyed)
            links = cut(links.unionByName(loose(stars(level), reps).select("a", "b")))
        found = cut(components(links))
        if last:
            break
    return found, starred


def alike(x: frozenset, y: frozenset) -> bool:
    both = len(x & y)
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def words_of(raw: bytes) -> frozenset:
    return frozenset(np.frombuffer(raw, np.uint64).tolist())


def full_sets(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(rep, hashes) of the documents of clusters."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"rep": frame["doc_id"].array, "hashes": [shingles(t).tobytes() for t in frame["text"]]})
        release()

    needed = docs.select("doc_id", "text").join(clusters.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    # an id that stands for several classes keeps all their sets
    return in_frames(needed, work, "rep long, hashes binary").dropDuplicates(["rep", "hashes"])


def confirmed_stars(starred: DataFrame, sets: DataFrame) -> DataFrame:
    """Each document's likeliest star link (a, b) that the full sets confirm.

    A pivot's members come to it in parts of ``BLOCK``, each with a copy of its set.
    """
    likely = starred.where(F.col("e") >= ESTIMATE)
    ends = likely.select("a", "b", "e").unionByName(likely.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
    best = ends.groupBy("a").agg(F.max(F.struct("e", "b"))["b"].alias("b"))
    parts = best.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    member = best.join(parts, "b").select("b", F.pmod(F.xxhash64("a", F.lit(5)), F.col("parts")).alias("part"), F.col("a").alias("rep"), F.lit(1).alias("member"))
    pivot = parts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("b").alias("rep"), F.lit(0).alias("member"))
    dealt = member.unionByName(pivot).join(sets, "rep").repartition("b", "part").sortWithinPartitions("b", "part", "member")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own = None, frozenset()
        for frame in frames:
            out = []
            for b, part, rep, member, raw in zip(frame["b"], frame["part"], frame["rep"], frame["member"], frame["hashes"]):
                if not member:
                    held, own = (b, part), words_of(raw)
                elif held == (b, part) and alike(own, words_of(raw)):
                    out.append((rep, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        release()

    return dealt.select("b", "part", "rep", "member", "hashes").mapInPandas(work, "a long, b long")


def confirm(rep: np.ndarray, component: np.ndarray, regs: np.ndarray, sets: list[bytes]) -> list[tuple[int, int]]:
    """Links between different components that the full sets confirm: the likeliest pairs first, those joined not at all."""
    names, label, count = np.unique(component, return_inverse=True, return_counts=True)
    order = np.argsort(count[label], kind="stable")
    rep, label, regs, sets = rep[order], label[order], regs[order], [sets[k] for k in order]
    size = np.array([len(x) // 8 for x in sets])
    found = []
    # the largest component comes last, and its members need no rows of their own
    for k in range(int((label != label[-1]).sum())):
        e = estimate(regs[k], regs[k + 1 :])
        may = (e >= ESTIMATE) & (label[k + 1 :] != label[k]) & (100 * np.minimum(size[k], size[k + 1 :]) >= PERCENT * np.maximum(size[k], size[k + 1 :]))
        y = np.flatnonzero(may)
        found.append(np.stack([np.full(len(y), float(k)), y + k + 1, e[y]]))
    pairs = np.concatenate(found, 1) if found else np.empty((3, 0))
    parent, words, out = list(range(len(names))), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k in np.argsort(-pairs[2], kind="stable").tolist():
        x, y = int(pairs[0, k]), int(pairs[1, k])
        a, b = root(label[x]), root(label[y])
        if a != b:
            for z in (x, y):
                if z not in words:
                    words[z] = words_of(sets[z])
            if alike(words[x], words[y]):
                parent[a] = b
                out.append((int(rep[x]), int(rep[y])))
    return out


def links_of(clusters: DataFrame, starred: DataFrame, reps: DataFrame, docs: DataFrame, wide: int, block: int) -> DataFrame:
    """Links (a, b) inside clusters that full sets confirm and that join all that is linked.

    Star links come first.  Clusters that they leave in several components are open, and only there members of
    different components meet, in spots of about ``block`` members of the largest component and the others.
    """
    sets = cut(full_sets(docs, clusters))
    links = cut(confirmed_stars(starred, sets))
    label = components(links).select(F.col("node").alias("rep"), "component")
    rows = clusters.select(F.col("component").alias("key"), F.col("node").alias("rep")).join(label, "rep", "left")
    rows = open_groups(rows.select("key", "rep", F.coalesce("component", "rep").alias("component")))
    full = spots(rows, wide, block).join(reps, "rep").join(sets, "rep")
    dealt = full.repartition("key", "spot").sortWithinPartitions("key", "spot")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(frames, ["key", "spot"]):
            if group["component"].nunique() > 1:
                regs = np.frombuffer(b"".join(group["regs"]), "<u2").reshape(len(group), REGISTERS)
                yield pd.DataFrame(confirm(group["rep"].to_numpy(), group["component"].to_numpy(), regs, group["hashes"].tolist()), columns=["a", "b"], dtype=np.int64)
        release()

    return links.unionByName(dealt.select("key", "spot", "rep", "component", "regs", "hashes").mapInPandas(work, "a long, b long"))


def near_duplicates(docs: DataFrame, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sig = cut(signatures(docs))
    classes = cut(sig.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("regs", "doc_id").alias("regs")))
    reps = classes.select("rep", "regs")
    clusters, starred = clustered(reps, wide)
    found = components(links_of(clusters, starred, reps, docs, wide, block))
    of_class = classes.join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sig.join(of_class, ["k1", "k2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
