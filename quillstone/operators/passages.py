"""Retrieval of passages from packs: each pack is searched by itself, then all lists are fused.

A pack holds the chunks of the documents of one level; packs above the reader's clearance are never searched.  Scores and
cuts are those of the pack (its number of chunks, its lengths, its best hundred), as each is a corpus of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import first_words, scope_touches, term_ok
from quillstone.functions.text import words as word_list
from quillstone.operators import retrieval as R
from quillstone.operators.changes import AMENDING, LEAD, hash_embed, text_words
from quillstone.operators.trigrams import containing
from quillstone.operators.validity import DEFAULT_STATUSES, HISTORICAL_STATUSES, cut, kept

#: order in which lists name a passage first
LISTS = ("vector", "keyword", "trigram")
#: words of a passage that are shown; fixed value
PASSAGE_WORDS = 250


def postings(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(chunk_id, tier, dl, term, tf) of chunks (chunk_id, tier, text): each term, or each wanted one, with the chunk's length.

    Terms that aren't wanted are one row a chunk before anything is shuffled; it has a null term, and holds the chunk's
    place in its pack's average.
    """
    if wanted is not None and (few := R.wanted_counts(chunks, ["chunk_id", "tier"], wanted)) is not None:
        own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf")))
        return few.select("chunk_id", "tier", "dl", F.inline(F.concat(own, "hits")))
    rows = chunks.select("chunk_id", "tier", F.explode_outer(word_list(F.col("text"))).alias("word")).select("chunk_id", "tier", F.trim("word", F.lit("/")).alias("term"))
    rows = rows.select("chunk_id", "tier", F.when(term_ok(F.col("term")), F.col("term")).alias("term"))
    if wanted is not None:
        rows = rows.join(wanted.withColumn("asked", F.lit(True)), "term", "left").select("chunk_id", "tier", F.col("term").isNotNull().alias("counted"), F.when(F.col("asked"), F.col("term")).alias("term"))
    else:
        rows = rows.withColumn("counted", F.col("term").isNotNull())
    counts = rows.groupBy("chunk_id", "tier", "term").agg(F.count_if("counted").alias("tf"))
    hits = counts.groupBy("chunk_id", "tier").agg(F.sum("tf").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("hits"))
    return hits.select("chunk_id", "tier", "dl", F.inline("hits"))


def totals(index: DataFrame) -> DataFrame:
    """(tier, n, avgdl): chunks of each pack, those without terms too, and their average length."""
    each = index.groupBy("tier", "chunk_id").agg(F.max("dl").alias("dl"))
    return each.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def scored(index: DataFrame, sizes: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, tier, chunk_id, score) from the postings of the queries' terms, by each pack's own numbers."""
    found = index.where("term is not null")
    df = found.groupBy("tier", "term").agg(F.count(F.lit(1)).alias("df")).join(R.bounded(sizes), "tier")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = F.col("idf") * F.col("tf") * (R.K1 + 1) / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("dl") / F.col("avgdl")))
    weights = df.select("tier", "term", idf.alias("idf"), "avgdl")
    return found.join(R.bounded(weights), ["tier", "term"]).join(R.bounded(R.asked_terms(queries)), "term").groupBy("qid", "tier", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def keyword_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    index = postings(chunks, R.asked_terms(queries).select("term").distinct())
    return scored(index, totals(index), queries)


def keyword_top(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """:func:`keyword_hits` of :func:`keyword_scores`, with no row for each query and chunk: see :func:`R.best_scored`."""
    wanted = R.asked_terms(queries).select("term").distinct()
    index = R.wanted_counts(chunks, ["chunk_id", "tier"], wanted)
    if index is None:
        hit = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
        index = postings(chunks, wanted).groupBy("chunk_id", "tier").agg(F.max("dl").alias("dl"), F.collect_list(hit).alias("hits"))
    index = kept(index.withColumnRenamed("chunk_id", "id"))
    sizes = index.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return R.best_scored(index, sizes, queries, R.LIST_CUT).select("qid", "tier", F.col("id").alias("chunk_id"), F.col("rank").alias("raw_rank"))


def write_index(chunks: DataFrame, folder: str, version: int, old: int | None = None, changed: DataFrame | None = None, buckets: int = 32) -> None:
    """The postings of packs as a version's files, by tier and a hash of the term, with their totals.

    With an old version, chunks are those that are new, and changed (id) names the documents whose old chunks are gone:
    the texts of all other chunks are not read again, their postings are taken over.
    """
    spark = chunks.sparkSession
    fresh = postings(chunks.select("chunk_id", "tier", "text")).join(chunks.select("chunk_id", "id"), "chunk_id")
    if old is not None:
        kept = spark.read.parquet(f"{folder}/postings/version={old}").drop("bucket")
        fresh = (kept.join(changed.select("id").distinct(), "id", "left_anti") if changed is not None else kept).unionByName(fresh)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    out = f"{folder}/postings/version={version}"
    fresh.withColumn("bucket", F.coalesce(bucket, F.lit(-1))).repartition("tier", "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("tier", "bucket").mode("errorifexists").parquet(out)
    totals(spark.read.parquet(out)).withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/totals/version={version}")


def stored_scores(spark: SparkSession, folder: str, versions: dict[int, int], queries: DataFrame) -> DataFrame:
    """:func:`keyword_scores` over written indexes, of each tier its version; only the buckets of the queries' terms are read."""
    asked, parts, sizes = R.asked_terms(queries).select("term").distinct(), None, None
    for tier, version in versions.items():
        size = spark.read.parquet(f"{folder}/totals/version={version}").where(F.col("tier") == tier)
        bucket = F.pmod(F.xxhash64("term"), F.lit((size.first() or {"buckets": 1})["buckets"]))
        read = [r[0] for r in asked.select(bucket.alias("b")).distinct().collect()]  # no more than there are buckets
        some = spark.read.parquet(f"{folder}/postings/version={version}").where((F.col("tier") == tier) & F.col("bucket").isin(read)).join(R.bounded(asked), "term", "left_semi").select("chunk_id", "tier", "dl", "term", "tf")
        size = size.select("tier", "n", "avgdl")
        parts, sizes = (some, size) if parts is None else (parts.unionByName(some), sizes.unionByName(size))
    return scored(parts, sizes, queries)


def keyword_hits(scores: DataFrame) -> DataFrame:
    """(qid, tier, chunk_id, raw_rank): the best hundred of each pack."""
    return R.top(scores, ["qid", "tier"], R.LIST_CUT, F.desc("score"), F.asc("chunk_id"), name="raw_rank").select("qid", "tier", "chunk_id", "raw_rank")


def vector_hits(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """As :func:`keyword_hits`, by vectors (chunk_id, tier, vec or words) and queries (qid, qvec)."""
    found = R.nearest(vectors.withColumnRenamed("chunk_id", "id"), asked, R.LIST_CUT)
    return found.select("qid", "tier", F.col("id").alias("chunk_id"), F.col("rank").alias("raw_rank"))


def named_hits(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """As :func:`keyword_hits`: all chunks of documents whose number holds a named one (qid, ref), the last of each first."""
    docs = chunks.select("id", "circular_no").distinct()
    rows = R.few(containing(docs, refs)).join(chunks.select("id", "chunk_id", "tier", "chunk_index"), "id")
    return rows.select("qid", "tier", "chunk_id", F.row_number().over(Window.partitionBy("qid", "tier").orderBy(F.desc("chunk_index"), "chunk_id")).alias("raw_rank"))


def allowed(history: Column, clearance: int) -> Column:
    """Whether a chunk (status, classification_level) may be shown; former rules where history is asked for."""
    status = F.col("status").isin(*DEFAULT_STATUSES) | (F.col("status").isin(*HISTORICAL_STATUSES) & history)
    return status & (F.col("classification_level") <= clearance)


def shown(hits: DataFrame, chunks: DataFrame, asked: DataFrame, clearance: int, history: bool = False) -> DataFrame:
    """Of each pack's hits the best thirty that may be shown, with new ranks. asked: qid, wants_history."""
    rows = R.few(hits).join(chunks.select("chunk_id", "status", "classification_level"), "chunk_id").join(R.bounded(asked.select("qid", "wants_history")), "qid")
    rows = rows.where(allowed(F.col("wants_history") | F.lit(history), clearance))
    return R.top(rows, ["qid", "tier"], R.LIST_KEEP, F.asc("raw_rank")).select("qid", "tier", "chunk_id", "rank")


def fused(lists: dict[str, DataFrame]) -> DataFrame:
    """(qid, tier, chunk_id, rrf, ranks, place): lists (qid, tier, chunk_id, rank) fused; of equal scores the one that was named first."""
    parts = [df.select("qid", "tier", "chunk_id", "rank", F.lit(LISTS.index(name)).alias("list")) for name, df in lists.items()]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    names = F.array(*map(F.lit, LISTS))
    entry = F.array_sort(F.collect_list(F.struct("list", "rank")))
    shown_as = F.transform("e", lambda x: F.concat_ws(" ", F.get(names, x["list"]), x["rank"].cast("string")))
    out = rows.groupBy("qid", "tier", "chunk_id").agg(F.round(F.sum(1 / (R.RRF_K + F.col("rank"))), 9).alias("rrf"), entry.alias("e"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "tier", F.get("e", F.lit(0))))
    return out.select("qid", "tier", "chunk_id", "rrf", F.array_join(shown_as, ", ").alias("ranks"), place.alias("place"))


def reranked(pool: DataFrame, chunks: DataFrame, asked: DataFrame, floor: float = R.FLOOR) -> DataFrame:
    """(qid, chunk_id, id, score, pos): the pool (qid, chunk_id, place) by shared words; those under the floor are left out."""
    rows = R.few(pool).join(chunks.select("chunk_id", "id", "circular_no", "breadcrumb", "text"), "chunk_id").join(R.bounded(asked.select("qid", "rerank_text")), "qid")
    passage = F.concat(F.col("circular_no"), F.lit(" | "), F.coalesce("breadcrumb", F.lit("")), F.lit("\n"), F.col("text"))
    rows = rows.withColumn("score", F.round(R.overlap(F.col("rerank_text"), passage), 6))
    pos = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "place"))
    return rows.withColumn("pos", pos).where(F.col("score") >= floor).select("qid", "chunk_id", "id", "score", "pos")


def amending(chunks: DataFrame, relations: DataFrame) -> DataFrame:
    """(rel_id, target, scope, new_id): of each verified amendment the chunk that speaks of it.

    It is the amending document's first chunk that holds the beginning of the evidence, else the first that speaks of
    amending.  Relation and chunk must lie in one pack, so an amendment of a lower level than its target is not seen.
    """
    edges = relations.where("verified = 1 and relation_type = 'AMENDS' and target_doc_id is not null")
    level = chunks.select(F.col("id").alias("target_doc_id"), F.col("classification_level").alias("target_level")).distinct()
    edges = R.few(edges).join(level, "target_doc_id").select(F.col("id").alias("rel_id"), F.col("source_doc_id").alias("id"), F.col("target_doc_id").alias("target"), "scope", F.substring(F.coalesce("evidence", F.lit("")), 1, LEAD).alias("lead"), "target_level")
    held = R.few(edges).join(chunks.select("id", "chunk_id", "chunk_index", "text", "classification_level", "status"), "id").where("classification_level >= target_level")
    by_text = (F.col("lead") != "") & F.contains(F.translate("text", "\n", " "), F.col("lead"))
    by_word = F.lower("text").contains(AMENDING.split("|")[0])
    order = F.struct(F.when(by_text, 0).otherwise(1), F.col("chunk_index"), F.col("chunk_id"))
    best = held.where(by_text | by_word).groupBy("rel_id", "target", "scope").agg(F.min_by(F.struct("chunk_id", "status", "classification_level"), order).alias("b"))
    return best.select("rel_id", "target", "scope", F.col("b.chunk_id").alias("new_id"), "b.status", "b.classification_level")


def with_amending(selected: DataFrame, chunks: DataFrame, relations: DataFrame, clearance: int, n: int = R.CONTEXT) -> DataFrame:
    """(qid, chunk_id, origin, place): selected passages (qid, chunk_id, id, pos, wants_history), each amended one followed
    by what amends it, in place of the weakest if need be."""
    facts = chunks.select("chunk_id", F.col("status").alias("own_status"), "clause_ref")
    rows = cut(R.few(selected).join(facts, "chunk_id").where("own_status = 'AMENDED'"))
    # only what amends a selected document is looked for
    relations = relations.join(R.bounded(rows.select(F.col("id").alias("target_doc_id")).distinct()), "target_doc_id", "left_semi")
    found = R.bounded(rows).join(amending(chunks, relations).withColumnRenamed("target", "id"), "id").where(scope_touches(F.col("scope"), F.col("clause_ref")) & allowed(F.col("wants_history"), clearance))
    touched = found.select("qid", F.col("chunk_id").alias("id"), "pos", "new_id", "rel_id")
    out = R.with_amendments(selected.select("qid", F.col("chunk_id").alias("id"), "pos"), touched, n)
    return out.withColumnRenamed("id", "chunk_id")


def excluded(ranked: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """(qid, chunk_id, id, place): of each cancelled document among the first ten places without the status filter, its best chunk."""
    rows = R.few(ranked.where(F.col("place") <= most)).join(chunks.where("status = 'CANCELLED'").select("chunk_id", "id"), "chunk_id")
    return R.top(rows, ["qid", "id"], 1, F.asc("place"), name="k").select("qid", "chunk_id", "id", "place")


def shown_text(c: Column) -> Column:
    return first_words(c, PASSAGE_WORDS)


def whole_texts(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "tier", F.concat(F.coalesce("breadcrumb", F.lit("")), F.lit("\n"), F.col("text")).alias("text"))


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    """(chunk_id, tier, vec) of chunks, with their breadcrumb before the text."""
    return hash_embed(whole_texts(chunks), "double", ("chunk_id", "tier")).withColumnRenamed("embedding", "vec")


def chunk_entries(chunks: DataFrame) -> DataFrame:
    """(chunk_id, tier, words): what :func:`chunk_vectors` is made of, for :func:`R.nearest`, so that no vector leaves a task."""
    return whole_texts(chunks).select("chunk_id", "tier", text_words(F.col("text")).alias("words"))
