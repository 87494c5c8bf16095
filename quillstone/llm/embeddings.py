"""Near-duplicate embeddings by an inverted multi-index (operator 6).

Unit vectors are cut in halves, and each half has a codebook of its own; pairs of codewords are the cells of a product
grid.  Every vector is stored in its nearest cell.  As a query it visits cells from the nearest on, in multi-sequence
order, as far as a margin beyond its nearest cell; the margin is the least that finds the target share of the links of
a sample of queries, which are compared with all vectors.  In each cell, visitors are compared with members exactly, in
double precision, block by block.

The codebooks are fitted on at most ``FIT`` vectors, or ``FIT_CODE`` for each codeword if that is more, up to ``FIT_MOST``.
The margin is fitted on blocks of ``PROBES`` queries, drawn until ``LINKED`` of them have links or ``MOST`` are drawn; below
so many linked ones it never falls below ``WIDEST`` / 8.  Every vector is indexed.  A pair that only one side's visit
finds counts for both sides, once.  Vectors of different lengths are never alike: the most frequent length, and each
other one with over ``FEW`` vectors, has an index of its own; those of rarer lengths are all compared with each other.

Defined results: vectors that are null, zero, hold null or non-finite components, or have a null vec_id link with nothing
and are kept; equal vectors are one class, counted with its size; a table without valid vectors gives its rows without
links; repeated rows of one vec_id count as vectors of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import components, cut
from quillstone.llm.memory import hash_sample

LEAST_COSINE, RECALL = 0.95, 0.995
FIT, FIT_CODE, FIT_MOST, PROBES, PER_CELL, BLOCK, BINS, FEW = 20_000, 20, 200_000, 512, 128, 1024, 200, 4096
#: vectors whose distances to all codewords are held at a time
ROWS = 512
#: a cell's rows meet its counts in so many parts
SALTS = 8
#: squared distance of unit vectors at the least cosine: no margin beyond about twice that is of use
WIDEST = 8 * (1 - LEAST_COSINE)
#: linked probes that support a margin below WIDEST / 8, and probes drawn at most to find them
LINKED, MOST = 200, 4096


def unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ codes.T + (codes**2).sum(1)[None, :])


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means with far-apart first centres; no more than ``ROWS`` times k distances are held."""
    centres = np.empty((k, x.shape[1]))
    centres[0] = x[rng.integers(len(x))]
    gap = distances(x, centres[:1])[:, 0]
    for n in range(1, k):
        total = gap.sum()
        centres[n] = x[rng.choice(len(x), p=gap / total) if total > 0 else rng.integers(len(x))]
        gap = np.minimum(gap, distances(x, centres[n : n + 1])[:, 0])
    for _ in range(10):
        count, sums = np.zeros(k, np.int64), np.zeros_like(centres)
        for a in range(0, len(x), ROWS):
            near = distances(x[a : a + ROWS], centres).argmin(1)
            count += np.bincount(near, minlength=k)
            np.add.at(sums, near, x[a : a + ROWS])
        centres = np.where(count[:, None] > 0, sums / np.maximum(1, count)[:, None], centres)
    return centres


class Index:
    """Two codebooks and a margin."""

    def __init__(self, sample: np.ndarray, k: int):
        rng = np.random.default_rng(5)
        self.half, self.k, self.margin = sample.shape[1] // 2, k, 0.0
        self.codes = codebook(sample[:, : self.half], k, rng), codebook(sample[:, self.half :], k, rng)

    def gaps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.codes[0]), distances(x[:, self.half :], self.codes[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest cell, and its distance."""
        d1, d2 = self.gaps(x)
        return d1.argmin(1) * self.k + d2.argmin(1), d1.min(1) + d2.min(1)

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """Cells of each vector in multi-sequence order, up to the margin."""
        d1, d2 = self.gaps(x)
        o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        out = []
        for a, b, p, q in zip(s1.tolist(), s2.tolist(), o1.tolist(), o2.tolist()):
            least = a[0] + b[0]
            heap, cells = [(least, 0, 0)], []
            while heap:
                d, i, j = heapq.heappop(heap)
                # as beyond() has it, so that a pair counts once
                if d - least > self.margin:
                    break
                cells.append(p[i] * self.k + q[j])
                # (i, j) opens (i, j + 1), and the row below if it heads its own
                if j + 1 < len(b):
                    heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(a):
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            out.append(cells)
        return out

    def beyond(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How far beyond its nearest cell each vector (row) has each cell (column)."""
        d1, d2 = self.gaps(x)
        return d1[:, cells // self.k] + d2[:, cells % self.k] - (d1.min(1) + d2.min(1))[:, None]


def link_gaps(index: Index, reps: DataFrame, probes: pd.DataFrame) -> np.ndarray:
    """For each probe with links, their number by how far beyond the probe's nearest cell they lie."""
    queries, names = unit(probes["embedding"]), probes["rep"].to_numpy()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = unit(frame["embedding"])
                q, m = np.nonzero((queries @ x.T >= LEAST_COSINE) & (names[:, None] != frame["rep"].to_numpy()[None, :]))
                gap = index.beyond(queries, index.cells(x)[0])[q, m]
                at = np.clip(np.ceil(gap / WIDEST * BINS), 0, BINS).astype(np.int64)
                pair, n = np.unique(q * (BINS + 1) + at, return_counts=True)
                yield pd.DataFrame({"q": pair // (BINS + 1), "bin": pair % (BINS + 1), "n": n})

    counts = reps.select("rep", "embedding").mapInPandas(work, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(queries), BINS + 1))
    table[counts["q"], counts["bin"]] = counts["n"]
    return table[table.sum(1) > 0]


def calibrated(index: Index, reps: DataFrame, probes: pd.DataFrame) -> float:
    """The least margin whose visits find the target share of the probes' links, over links and over probes."""
    table = np.zeros((0, BINS + 1))
    for k in range(0, len(probes), PROBES):
        table = np.concatenate([table, link_gaps(index, reps, probes.iloc[k : k + PROBES])])
        if len(table) >= LINKED:
            break
    if not len(table):
        return WIDEST / 8
    share = table.cumsum(1) / table.sum(1, keepdims=True)
    links = table.sum(0).cumsum() / table.sum()
    good = (share.mean(0) >= RECALL) & (links >= RECALL)
    # half as much again: a sample's largest gaps fall short of the table's
    margin = 1.5 * float(np.argmax(good)) / BINS * WIDEST
    return margin if len(table) >= LINKED else max(margin, WIDEST / 8)


def fitted(classes: DataFrame, n: int) -> Index:
    """An index for the n vectors of one length."""
    k = max(2, round((n / PER_CELL) ** 0.5))
    rows = classes.select("rep", "embedding")
    sample = hash_sample(rows, F.xxhash64("rep", F.lit(1)), min(FIT_MOST, max(FIT, FIT_CODE * k))).toPandas()
    index = Index(unit(sample["embedding"]), k)
    index.margin = calibrated(index, rows, hash_sample(rows, F.xxhash64("rep", F.lit(2)), MOST).toPandas())
    return index


def linked(q: pd.DataFrame, m: pd.DataFrame, indexes: dict[int, Index]) -> pd.DataFrame:
    """Links of a block of visitors with a block of members: what each counts, and the least id of its part here."""
    none = pd.DataFrame({"rep": [], "links": [], "label": []}, dtype=np.int64)
    if not len(q) or not len(m):
        return none
    a, b = unit(q["embedding"]), unit(m["embedding"])
    ra, rb = q["rep"].to_numpy(np.int64), m["rep"].to_numpy(np.int64)
    hit = (a @ b.T >= LEAST_COSINE) & (ra[:, None] != rb[None, :])
    rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(rows):
        return none
    hit, ra, rb = hit[np.ix_(rows, columns)], ra[rows], rb[columns]
    na, nb = q["size"].to_numpy(np.int64)[rows], m["size"].to_numpy(np.int64)[columns]
    forward = hit @ nb
    # the member counts the pair itself unless its own visit finds the visitor's cell
    index = indexes.get(int(q["dim"].iloc[0]))
    own = index.beyond(b[columns], index.cells(a[rows])[0]) <= index.margin if index else np.ones_like(hit.T)
    backward = na @ (hit & ~own.T)
    la, lb, big = ra.copy(), rb.copy(), np.int64(2**63 - 1)
    while True:
        new_b = np.minimum(lb, np.where(hit, la[:, None], big).min(0))
        new_a = np.minimum(la, np.where(hit, new_b[None, :], big).min(1))
        if (new_a == la).all() and (new_b == lb).all():
            break
        la, lb = new_a, new_b
    return pd.DataFrame({"rep": np.concatenate([ra, rb]), "links": np.concatenate([forward, backward]), "label": np.concatenate([la, lb])})


def near_embeddings(vectors: DataFrame) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # with one component only its sign counts
    base = base.withColumn("embedding", F.when(F.size("embedding") == 1, F.transform("embedding", F.signum)).otherwise(F.col("embedding")))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = base.withColumn("dim", F.when(F.col("embedding").isNotNull() & ~bad & nonzero & F.col("vec_id").isNotNull(), F.size("embedding")))
    keyed = rows.select("vec_id", "embedding", "dim", F.when(F.col("dim").isNotNull(), F.xxhash64("embedding")).alias("h"))
    classes = cut(keyed.where("h is not null").groupBy("h", "embedding", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")))
    # one row a length that occurs often, and the most frequent one; the others need no index
    counts = classes.groupBy("dim").count()
    often = dict(tuple(r) for df in (counts.where(F.col("count") > FEW), counts.orderBy(F.desc("count"), "dim").limit(1)) for r in df.collect()).items()
    indexes = {dim: fitted(classes.where(F.col("dim") == dim), n) for dim, n in often}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, group in frame.groupby("dim"):
                if dim in indexes:
                    for a in range(0, len(group), ROWS):
                        x = unit(group["embedding"].iloc[a : a + ROWS])
                        yield group.iloc[a : a + ROWS].assign(cell=indexes[dim].cells(x)[0], visits=indexes[dim].visits(x))
                else:
                    yield group.assign(cell=0, visits=[[0]] * len(group))

    placed = cut(classes.select("rep", "size", "embedding", "dim").mapInPandas(place, "rep long, size long, embedding array<double>, dim int, cell long, visits array<long>"))
    # columns of their own, as both sides of the cogroup come from one table; a cell's rows are counted and dealt in salts
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("salt")
    members = placed.select(*(F.col(c).alias(c) for c in ("rep", "size", "embedding", "dim", "cell")), salt)
    visitors = placed.select("rep", "size", "embedding", "dim", F.explode("visits").alias("cell"), salt)
    # cells in blocks: a row for each cell and salt, whatever the number of vectors
    blocks = lambda df, name: df.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))
    sizes = blocks(members, "mb").join(blocks(visitors, "qb"), ["dim", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    part = lambda count: F.pmod(F.xxhash64("rep", F.lit(6)), F.col(count))
    upto = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    m = members.join(sizes, ["dim", "cell", "salt"]).select("rep", "size", "embedding", "dim", "cell", part("mb").alias("i"), upto("qb").alias("j"))
    q = visitors.join(sizes, ["dim", "cell", "salt"]).select("rep", "size", "embedding", "dim", "cell", upto("mb").alias("i"), part("qb").alias("j"))
    key = ["dim", "cell", "i", "j"]
    got = cut(q.groupBy(*key).cogroup(m.groupBy(*key)).applyInPandas(lambda a, b: linked(a, b, indexes), "rep long, links long, label long"))
    found = components(got.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    links = got.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("h", "embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = keyed.join(of_class, ["h", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
