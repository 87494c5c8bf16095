"""Retrieval: postings and BM25, vector and substring lists, rank fusion, reranking, jurisdiction, amendments."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.functions.text import query_terms, scope_touches, term_ok, terms, tokens, words
from quillstone.operators.changes import DIM, unit_rows
from quillstone.operators.validity import cut

K1, B, RRF_K = 1.2, 0.75, 60
LIST_CUT, LIST_KEEP, POOL, CONTEXT = 100, 30, 20, 5
#: sides of each jurisdiction; fixed values
PREFERRED = {"FEDERAL": ("FEDERAL", "FEDERAL_SARAWAK"), "SARAWAK": ("SARAWAK", "FEDERAL_SARAWAK")}
HIGH, MEDIUM, FLOOR = 0.30, 0.12, 0.06


#: rows that may be broadcast; beyond it a join shuffles
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def few(df: DataFrame) -> DataFrame:
    """df, computed once, and broadcast if it has few rows, so that the other side of a join stays where it lies."""
    return bounded(cut(df))


def term_rows(docs: DataFrame) -> DataFrame:
    """(id, term): one row for each search term of documents (id, text); the same terms as those of :func:`terms`."""
    found = docs.select("id", F.explode(words(F.col("text"))).alias("word")).select("id", F.trim("word", F.lit("/")).alias("term"))
    return found.where(term_ok(F.col("term")))


#: terms that a plan may hold as a set; more of them are found by a join; texts whose terms a task counts
SET_TERMS, TEXTS = 10_000, 10_000


def wanted_counts(docs: DataFrame, key: list[str], wanted: DataFrame) -> DataFrame | None:
    """(*key, dl, hits) of texts (*key, text): how many terms, and (term, tf) of the wanted ones; None if too many are wanted.

    Terms are chosen inside the row, so one row a text with its wanted words is shuffled.  Texts without terms have a length
    of 0 and no hits.
    """
    some = [r[0] for r in wanted.select("term").distinct().limit(SET_TERMS + 1).collect()]
    if len(some) > SET_TERMS:
        return None
    # terms are letters, digits and underscores, so they need no escapes; one text is read faster than a literal each
    chosen = F.expr("filter(t, x -> x in (" + ", ".join(f"'{x}'" for x in some) + "))") if some else F.array().cast("array<string>")
    rows = docs.select(*key, terms(F.col("text")).alias("t")).select(*key, F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("n"), F.coalesce(chosen, F.array().cast("array<string>")).alias("w"))
    # one shuffle by the key, in as many parts as there are texts, so that what a task counts doesn't grow
    rows = rows.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // TEXTS)), *key)
    own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("n").alias("tf")))
    hits = F.transform("w", lambda x: F.struct(x.alias("term"), F.lit(1).cast("long").alias("tf")))
    counts = rows.select(*key, F.inline(F.concat(own, hits))).groupBy(*key, "term").agg(F.sum("tf").alias("tf"))
    dl = F.sum(F.when(F.col("term").isNull(), F.col("tf")))
    return counts.groupBy(*key).agg(dl.alias("dl"), F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("hits"))


def postings(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(id, dl, hits) of documents (id, text): their length and (term, tf) of each term, or each wanted one.

    The texts are read once.  Terms that aren't wanted are one row a document before anything is shuffled.
    """
    if wanted is not None and (few := wanted_counts(docs, ["id"], wanted)) is not None:
        return few
    rows = term_rows(docs)
    if wanted is not None:
        rows = rows.join(wanted.withColumn("asked", F.lit(True)), "term", "left").select("id", F.when(F.col("asked"), F.col("term")).alias("term"))
    counts = rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts.groupBy("id").agg(F.sum("tf").alias("dl"), F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("hits"))


def corpus_totals(index: DataFrame, n_docs: int) -> DataFrame:
    """One row: the number of documents, those without terms too, and their average length in terms."""
    return index.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("terms")).select(F.lit(n_docs).alias("n_docs"), (F.col("terms") / F.lit(max(1, n_docs))).alias("avgdl"))


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(query_terms(F.col("text"))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, score) of every document (id, text) with a query's term. queries: qid, text."""
    index = postings(docs, asked_terms(queries).select("term").distinct())
    return scored(index.select("id", "dl", F.inline("hits")), corpus_totals(index, docs.count()), queries)


def scored(found: DataFrame, totals: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, score) from the postings (id, dl, term, tf) of the queries' terms, and the corpus totals."""
    asked = asked_terms(queries)
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    # totals is a single row
    weights = df.crossJoin(F.broadcast(totals)).select("term", idf.alias("idf"), "avgdl")
    # there are no more weights than asked terms, so one check holds for both; the postings stay where they lie
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        weights, asked = F.broadcast(weights), F.broadcast(asked)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.join(weights, "term").join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))


#: scores that a task holds at once, and rows that it gives out at once
BLOCK, ROWS_OUT = 500_000, 50_000
#: stands for a null id in arrays, before all others as nulls are
NO_ID = -(2**63)


def best_scored(index: DataFrame, sizes: DataFrame, queries: DataFrame, k: int, asked: int = 1024, block: int = BLOCK) -> DataFrame:
    """(qid, id, score, rank): the k best of :func:`scored`, with a column tier those of each tier.

    index: id, dl, hits (term, tf); sizes: n, avgdl; each with tier or neither.  Weights are broadcast, each task scores its
    texts where they lie and gives its k best, so no row for each query and text is sorted or moved.  ``asked`` queries
    are scored in one pass, in blocks of texts.  Too many terms for a broadcast are scored by joins.
    """
    spark, tiers = index.sparkSession, [c for c in ("tier",) if c in index.columns]
    schema = ", ".join(["qid long", "id long", *(f"tier {index.schema[t].dataType.simpleString()}" for t in tiers), "score double"])
    order = (F.desc("score"), F.asc("id"))
    pairs = asked_terms(queries).select(F.coalesce("qid", F.lit(NO_ID)).alias("qid"), "term")
    df = index.select(*tiers, F.inline("hits")).groupBy(*tiers, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    # sizes hold a row a tier
    weights = df.join(F.broadcast(sizes), tiers) if tiers else df.crossJoin(F.broadcast(sizes))
    weights = weights.join(pairs.select("term").distinct(), "term", "left_semi").select(*tiers, "term", idf.alias("idf"), "avgdl")
    held, wanted = weights.limit(BROADCAST_ROWS + 1).collect(), pairs.limit(BROADCAST_ROWS + 1).collect()
    if len(held) > BROADCAST_ROWS or len(wanted) > BROADCAST_ROWS:
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        rows = index.select("id", *tiers, "dl", F.inline("hits")).join(weights, [*tiers, "term"]).join(pairs, "term")
        return top(rows.groupBy("qid", *tiers, "id").agg(F.round(F.sum(part), 6).alias("score")), ["qid", *tiers], k, *order)
    names = sorted({r.term for r in held})
    place = {term: i for i, term in enumerate(names)}
    of_tier: dict = {}
    for r in held:
        values, _ = of_tier.setdefault(r.tier if tiers else None, (np.zeros(len(names)), r.avgdl))
        values[place[r.term]] = r.idf
    by_query: dict = {}
    for qid, term in wanted:
        if term in place:
            by_query.setdefault(qid, []).append(place[term])
    texts = index.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), *tiers, F.col("dl").cast("double").alias("dl"), F.transform("hits", lambda x: x["term"]).alias("terms"), F.transform("hits", lambda x: x["tf"].cast("double")).alias("tfs"))

    def searched(qids: list[int]) -> DataFrame:
        # of each term its queries, as places in qids
        per_term = [[] for _ in names]
        for at, qid in enumerate(qids):
            for term in by_query[qid]:
                per_term[term].append(at)
        counts = np.array([len(x) for x in per_term], np.int64)
        starts, flat = np.cumsum(counts) - counts, np.array([at for x in per_term for at in x], np.int64)
        shared = spark.sparkContext.broadcast((np.array(qids), names, of_tier, counts, starts, flat))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[object, Best] = {}
            qids, names, of_tier, counts, starts, flat = shared.value
            known, rows = pa.array(names, pa.string()), max(1, block // len(qids))
            for batch in batches:
                for a in range(0, batch.num_rows, rows):
                    some = batch.slice(a, rows)
                    ids, dl, own = some.column("id").to_numpy(), some.column("dl").to_numpy(), np.array(some.column("tier").to_pylist() if tiers else [None] * len(some), object)
                    text = np.repeat(np.arange(len(some)), pc.list_value_length(some.column("terms")).to_numpy(zero_copy_only=False))
                    term = pc.fill_null(pc.index_in(some.column("terms").flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
                    tf = some.column("tfs").flatten().to_numpy(zero_copy_only=False)
                    for tier, (idf, avgdl) in of_tier.items():
                        here = np.flatnonzero(own == tier) if tiers else np.arange(len(some))
                        at = np.full(len(some), -1)
                        at[here] = np.arange(len(here))
                        hit = np.flatnonzero((at[text] >= 0) & (term >= 0))
                        if not len(hit):
                            continue
                        t, x, f = term[hit], text[hit], tf[hit]
                        part = idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl[x] / avgdl))
                        scores = np.zeros(len(qids) * len(here))
                        # a hit counts for each query with its term; some hits at a time
                        ends = np.cumsum(counts[t])
                        cuts = np.unique([0, *np.searchsorted(ends, np.arange(block, int(ends[-1]), block)), len(t)])
                        for lo, hi in zip(cuts[:-1], cuts[1:]):
                            n = counts[t[lo:hi]]
                            query = flat[np.repeat(starts[t[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                            scores += np.bincount(query * len(here) + np.repeat(at[x[lo:hi]], n), np.repeat(part[lo:hi], n), len(scores))
                        # every part is over 0, so a sum of 0 is a text without the query's terms
                        found = np.where(scores > 0, np.round(scores, 6), np.nan).reshape(len(qids), len(here))
                        kept.setdefault(tier, Best(len(qids), k)).add(found, ids[here])
            for tier, best_k in kept.items():
                row, score, ids = best_k.shrink()
                for a in range(0, len(row), ROWS_OUT):
                    b = slice(a, a + ROWS_OUT)
                    columns = [pa.array(qids[row[b]], pa.int64()), pa.array(ids[b], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array([tier] * len(row[b]), kind)] if tiers else []), pa.array(score[b], pa.float64())], ["qid", "id", *tiers, "score"])

        kind = to_arrow_type(index.schema["tier"].dataType) if tiers else None
        return texts.mapInArrow(best, schema)

    every = sorted(by_query)
    blocks = [searched(every[a : a + asked]) for a in range(0, len(every), asked)] if held else []
    if not blocks:
        return top(spark.createDataFrame([], schema), ["qid", *tiers], k, *order)
    found = functools.reduce(DataFrame.unionByName, blocks).withColumn("id", F.nullif("id", F.lit(NO_ID))).withColumn("qid", F.nullif("qid", F.lit(NO_ID)))
    # rounded by numpy; Spark's rounding of the same number settles how it is shown
    return top(found.withColumn("score", F.round("score", 6)), ["qid", *tiers], k, *order)


def bm25_top(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best of :func:`bm25`.  The texts are read once."""
    index = cut(postings(docs, asked_terms(queries).select("term").distinct()))
    totals = corpus_totals(index, docs.count())
    return best_scored(index, totals.withColumnRenamed("n_docs", "n"), queries, k)


def write_postings(docs: DataFrame, folder: str, buckets: int = 64) -> None:
    """The index of documents (id, text) as files: postings by a hash of the term, so that searches read few, and totals."""
    index = postings(docs)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    rows = index.select("id", "dl", F.inline("hits")).withColumn("bucket", bucket)
    rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("bucket").mode("errorifexists").parquet(f"{folder}/postings")
    corpus_totals(index, docs.count()).withColumn("buckets", F.lit(buckets)).write.mode("errorifexists").parquet(f"{folder}/totals")


def bm25_stored(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    """:func:`bm25` over a written index; only the buckets of the queries' terms are read."""
    totals = spark.read.parquet(f"{folder}/totals")
    bucket = F.pmod(F.xxhash64("term"), F.lit(totals.first()["buckets"]))
    asked = asked_terms(queries).select("term").distinct()
    # a bounded list: no more than the index has buckets
    read = [r[0] for r in asked.select(bucket.alias("bucket")).distinct().collect()]
    found = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(read)).join(bounded(asked), "term", "left_semi")
    return scored(found, totals, queries)


def top(df: DataFrame, key: str | list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= k)


def shown_list(hits: DataFrame, docs: DataFrame, statuses: tuple[str, ...], clearance: int, keep: int = LIST_KEEP) -> DataFrame:
    """Of each query's hits (qid, id, raw_rank), those that may be shown: the best ``keep``, with new ranks.

    Every list passes here, so that no document above the clearance, or with another status, reaches a fusion.
    """
    allowed = docs.where(F.col("status").isin(*statuses) & (F.col("classification_level") <= clearance))
    return top(hits.join(allowed.select("id", "status", "classification_level"), "id"), "qid", keep, F.asc("raw_rank"))


def keyword_list(scores: DataFrame, docs: DataFrame, statuses: tuple[str, ...], clearance: int, cut: int = LIST_CUT, keep: int = LIST_KEEP) -> DataFrame:
    """The best ``cut`` documents of each query, and of these, after the filters, the best ``keep`` with new ranks."""
    return shown_list(top(scores, "qid", cut, F.desc("score"), F.asc("id"), name="raw_rank"), docs, statuses, clearance, keep)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


class Best:
    """The k best of each query so far: rounded scores and ids, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.found, self.size = k, [], 0
        self.floor = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each query, a column for each id."""
        row, column = np.nonzero(scores >= self.floor[:, None])
        self.found.append((row, scores[row, column], ids[column]))
        self.size += len(row)
        if self.size > 2 * self.k * len(self.floor) + 100_000:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, score, ids = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.empty(0, int), np.empty(0), np.empty(0, int))
        order = np.lexsort([ids, -score, row])
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        full = place == self.k - 1
        self.floor[row[full]] = score[full]
        keep = place < self.k
        self.found, self.size = [(row[keep], score[keep], ids[keep])], int(keep.sum())
        return self.found[0]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, asked: int = 1024, rows: int = 1024) -> DataFrame:
    """(qid, id, score, rank): the k vectors (id, vec) with the largest dot products with each query (qid, qvec).

    With a column tier in vectors, the k of each tier.  Vectors stay where they lie: about ``asked`` queries at a time are
    broadcast to them, and each task gives its k best, which are merged; it holds a block of scores and the best so far,
    whatever the number of vectors and queries.  Null vectors and those of another length score nothing.  With a column
    words in place of vec, the vectors are those of :func:`unit_rows`, which are made where they are compared.
    """
    spark = vectors.sparkSession
    tiers, held = ["tier"] if "tier" in vectors.columns else [], "words" if "words" in vectors.columns else "vec"
    vectors, queries = vectors.where(F.col(held).isNotNull()), queries.where("qvec is not null").select("qid", F.col("qvec").cast("array<double>").alias("qvec"))
    rounds = max(1, -(-queries.count() // asked))
    rows_of = vectors.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), *tiers, F.col(held).cast("array<string>" if held == "words" else "array<double>").alias(held))
    schema = ", ".join(["qid long", "id long", *(f"tier {vectors.schema[t].dataType.simpleString()}" for t in tiers), "score double"])
    kind = to_arrow_type(vectors.schema["tier"].dataType) if tiers else None

    def searched(block: DataFrame) -> DataFrame:
        found = [(NO_ID if r.qid is None else r.qid, np.array(r.qvec, float)) for r in block.collect()]  # one round's queries
        by_size = {n: (np.array([q for q, v in found if len(v) == n]), np.stack([v for _, v in found if len(v) == n])) for n in {len(v) for _, v in found}}
        shared = spark.sparkContext.broadcast(by_size)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[tuple, Best] = {}
            for batch in batches:
                ids, lists = batch.column("id").to_numpy(), batch.column(held)
                sizes = pc.list_value_length(lists).to_numpy() if held == "vec" else np.full(len(ids), DIM)
                own = np.array(batch.column("tier").to_pylist() if tiers else [None] * len(ids), object)
                for size, (qids, asked_for) in shared.value.items():
                    for tier in set(own[sizes == size]):
                        mine = np.flatnonzero((sizes == size) & (own == tier))
                        top_k = kept.setdefault((size, tier), Best(len(qids), k))
                        step = max(1, min(rows, BLOCK // max(len(qids), size)))
                        for a in range(0, len(mine), step):
                            some = lists.take(pa.array(at := mine[a : a + step]))
                            made = unit_rows(some) if held == "words" else some.flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
                            top_k.add(np.round(asked_for @ made.T, 6), ids[at])
            for (size, tier), top_k in kept.items():
                row, score, ids = top_k.shrink()
                for a in range(0, len(row), ROWS_OUT):
                    b = slice(a, a + ROWS_OUT)
                    columns = [pa.array(shared.value[size][0][row[b]], pa.int64()), pa.array(ids[b], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array([tier] * len(row[b]), kind)] if tiers else []), pa.array(score[b], pa.float64())], ["qid", "id", *tiers, "score"])

        return rows_of.mapInArrow(best, schema)

    blocks = [searched(queries.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == j)) for j in range(rounds)]
    found = functools.reduce(DataFrame.unionByName, blocks).withColumn("id", F.nullif("id", F.lit(NO_ID))).withColumn("qid", F.nullif("qid", F.lit(NO_ID)))
    # rounded by numpy; Spark's rounding of the same number settles how it is shown
    return top(found.withColumn("score", F.round("score", 6)), ["qid", *tiers], k, F.desc("score"), F.asc("id"))


def fuse(lists: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (qid, id, list, rank), with the rank in each list as text."""
    ranks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("list", "rank"))), lambda x: F.concat_ws(" ", x["list"], x["rank"].cast("string"))), ", ")
    return lists.groupBy("qid", "id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("rrf"), F.count(F.lit(1)).alias("n_lists"), ranks.alias("ranks"))


def overlap(question: Column, passage: Column) -> Column:
    """Shared stemmed words over the question's, plus two; 0 for a question without words."""
    q, d = F.array_distinct(tokens(question)), F.array_distinct(tokens(passage))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, d)) / (F.size(q) + 2))


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


def apply_jurisdiction(ranked: DataFrame, target: str | None, n: int = CONTEXT, strong: float = MEDIUM, ratio: float = 0.75) -> DataFrame:
    """Per query: the user's side first; with strong rules on both sides, up to two places go to the other one.

    ranked: qid, id, score, pos, jurisdiction, doc_type; without a target for all, target too. Adds role, conflict and place.
    """

    def others(side: str) -> Column:
        other_side = "FEDERAL" if side == "SARAWAK" else "SARAWAK"
        return F.col("jurisdiction").isin([j for j in PREFERRED[other_side] if j not in PREFERRED[side]])

    rows = ranked.withColumn("other", others(target) if target else F.when(F.col("target") == "SARAWAK", others("SARAWAK")).otherwise(others("FEDERAL")))
    is_strong = (F.col("score") >= strong) & ~F.col("doc_type").isin("minutes", "report")
    rows = rows.withColumn("strong", is_strong)
    first = lambda cond: F.min_by(F.when(cond, F.col("score")), F.when(cond, F.col("pos")))
    facts = rows.groupBy("qid").agg(F.max("score").alias("top"), first(F.col("strong") & F.col("other")).alias("so"), first(F.col("strong") & ~F.col("other")).alias("sm"), F.count_if(F.col("strong") & F.col("other")).alias("n_so"), F.count_if(~F.col("other")).alias("n_mine"))
    facts = facts.withColumn("conflict", F.coalesce((F.col("so") >= ratio * F.col("top")) & (F.col("sm") >= ratio * F.col("top")), F.lit(False)))
    rows = rows.join(facts, "qid")
    in_side = F.row_number().over(Window.partitionBy("qid", "other").orderBy("pos"))
    in_strong = F.row_number().over(Window.partitionBy("qid", F.col("strong") & F.col("other")).orderBy("pos"))
    rows = rows.withColumn("side_pos", in_side).withColumn("strong_pos", in_strong)
    reserved = F.least(F.lit(2), F.col("n_so"))
    keep_conflict = (~F.col("other") & (F.col("side_pos") <= n - reserved)) | (F.col("strong") & F.col("other") & (F.col("strong_pos") <= reserved))
    keep_plain = (~F.col("other") & (F.col("side_pos") <= n)) | (F.col("other") & (F.col("n_mine") + F.col("side_pos") <= n))
    kept = rows.where(F.when(F.col("conflict"), keep_conflict).otherwise(keep_plain))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("other", "pos"))
    return kept.select("qid", "id", "score", F.when(F.col("other"), "comparison").otherwise("primary").alias("role"), "conflict", place.alias("place"))


def inject_amendments(selected: DataFrame, relations: DataFrame, passages: DataFrame, n: int = CONTEXT) -> DataFrame:
    """Per query: each amending passage right after the amended one, in place of the weakest if need be.

    selected: qid, id, pos, status, clause. passages: id, amended (its own text qualifies), one row per document.
    """
    edges = relations.where("verified = 1 and relation_type = 'AMENDS' and target_doc_id is not null").select(F.col("target_doc_id").alias("id"), F.col("source_doc_id").alias("new_id"), "scope", F.col("id").alias("rel_id"))
    touched = selected.where("status = 'AMENDED'").join(edges, "id").where(scope_touches(F.col("scope"), F.col("clause"))).join(passages.select(F.col("id").alias("new_id")), "new_id")
    return with_amendments(selected, touched, n)


def with_amendments(selected: DataFrame, touched: DataFrame, n: int = CONTEXT) -> DataFrame:
    """selected (qid, id, pos) with what amends it (qid, id, pos, new_id, rel_id) in its places."""
    one = latest_by(touched, ["qid", "new_id"], F.col("pos"), F.col("rel_id"))
    there = selected.select("qid", F.col("id").alias("new_id"), F.lit(True).alias("there"))
    placed = one.join(there, ["qid", "new_id"], "left").withColumn("is_new", F.col("there").isNull())
    counts = placed.groupBy("qid").agg(F.count(F.lit(1)).alias("n_placed"), F.count_if("is_new").alias("n_new"))
    base = selected.join(placed.select("qid", F.col("new_id").alias("id")), ["qid", "id"], "left_anti").join(counts, "qid", "left")
    base = base.withColumn("base_pos", F.row_number().over(Window.partitionBy("qid").orderBy("pos")))
    kept = base.where(F.coalesce(F.col("n_new"), F.lit(0)) == 0).unionByName(base.where((F.col("n_new") > 0) & (F.col("base_pos") <= F.greatest(F.lit(1), n - F.col("n_placed")))))
    hosts = kept.select("qid", F.col("id").alias("host"), F.col("pos").alias("host_pos"))
    follow = placed.withColumnRenamed("id", "host").join(hosts, ["qid", "host"]).select("qid", F.col("new_id").alias("id"), "host_pos", F.col("rel_id").alias("sub"), F.lit("amendment").alias("origin"))
    out = kept.select("qid", "id", F.col("pos").alias("host_pos"), F.lit(-1).cast("long").alias("sub"), F.lit("selected").alias("origin")).unionByName(follow)
    return top(out, "qid", n, F.asc("host_pos"), F.asc("sub"), name="place").select("qid", "id", "origin", "place")


def latest_by(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rank = 1").drop("__rank")
