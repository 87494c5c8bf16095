"""Asking: a ladder of rerankers with thresholds of their own, what a model is told, and the events of an answer.

Models answer elsewhere; their scores and pieces are tables here.  All groups are one question: at most twenty passages,
five sources, and the tokens of one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import malay_date
from quillstone.operators import answers as ANS
from quillstone.operators.retrieval import POOL

#: least scores of a high and a medium confidence, and the floor of what is shown, by kind of score; fixed values
HIGH = {"crossencoder": 0.70, "embedding": 0.62, "words": 0.30, "none": 0.05}
MEDIUM = {"crossencoder": 0.35, "embedding": 0.50, "words": 0.12, "none": 0.03}
FLOORS = {"crossencoder": 0.05, "embedding": 0.40, "words": 0.06, "none": 0.0}
#: what is said where no answer is found, and statuses whose reason a model is told; fixed values
REFUSAL = "Maaf, saya tidak menemui jawapan dalam pekeliling yang berkuat kuasa. / Sorry, I couldn't find this in the circulars currently in force."
EXPLAINED = ("CANCELLED", "AMENDED", "ONE_OFF")
UNSTATED = "tidak dinyatakan"
NO_PACKS = ("no_packs", "Tiada pek pengetahuan dipasang / No knowledge pack installed.")


def by_kind(kind: Column, values: dict[str, float]) -> Column:
    """A kind's value; an unknown or null kind has that of none."""
    known = F.create_map(*(F.lit(x) for item in values.items() for x in item))
    return F.coalesce(F.try_element_at(known, kind), F.lit(values["none"]))


def confidence(score: Column, kind: Column) -> Column:
    """HIGH, MEDIUM or LOW by the thresholds of the score's kind; LOW without a score."""
    return F.when(score >= by_kind(kind, HIGH), "HIGH").when(score >= by_kind(kind, MEDIUM), "MEDIUM").otherwise("LOW")


def squashed(raw: Column) -> Column:
    """A model's raw score between 0 and 1: by the logistic function, unless it lies there already."""
    return F.when(raw.between(0, 1), raw).otherwise(1 / (1 + F.exp(-raw)))


def ladder(pool: DataFrame, rungs: list[tuple[str, DataFrame]], most: int = POOL) -> DataFrame:
    """(qid, id, kind, score, pos) of the pool (qid, id, rrf, place)'s first places, by the first rung that has scores for the question.

    rungs: kinds with scores (qid, id, score), best first; the larger one counts where a passage has two.  A passage that
    its question's rung leaves out scores 0; a question that no rung knows keeps its fused scores, of the kind none.
    """
    rows = pool.where(F.col("place") <= most).select("qid", "id", "rrf", "place")
    for i, (_, scores) in enumerate(rungs):
        rows = rows.join(scores.groupBy("qid", "id").agg(F.max("score").alias(f"__s{i}")), ["qid", "id"], "left")
    question = Window.partitionBy("qid")
    kind, score = F.lit("none"), F.col("rrf")
    for i, (name, _) in reversed(list(enumerate(rungs))):
        known = F.count(f"__s{i}").over(question) > 0
        kind, score = F.when(known, F.lit(name)).otherwise(kind), F.when(known, F.coalesce(f"__s{i}", F.lit(0.0))).otherwise(score)
    rows = rows.select("qid", "id", "rrf", "place", kind.alias("kind"), score.alias("score"))
    pos = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("rrf"), "place"))
    return rows.select("qid", "id", "kind", "score", pos.alias("pos"))


def over_floor(ranked: DataFrame) -> DataFrame:
    """Of ranked passages (kind, score, ...) those that are worth showing."""
    return ranked.where(F.col("score") >= by_kind(F.col("kind"), FLOORS))


def passage_block(hide_status: bool = False) -> Column:
    """A source with its header line; hidden statuses are for a baseline that knows nothing of validity.

    Columns: place, circular_no, title, doc_type, jurisdiction, status, status_reason, issue_date, clause_ref, page, text;
    a null is a hyphen, a null text is empty.
    """
    reason = F.nullif(F.col("status_reason"), F.lit(""))
    told = F.when(F.col("status").isin(*EXPLAINED) & reason.isNotNull(), F.concat("status", F.lit(" ("), reason, F.lit(")"))).otherwise(F.col("status"))
    fields = [F.col("circular_no"), F.col("title"), F.col("doc_type"), F.col("jurisdiction"), F.lit("-") if hide_status else told, malay_date(F.col("issue_date")), F.col("clause_ref")]
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in fields]
    page = F.concat(F.lit("page "), F.coalesce(F.col("page").cast("string"), F.lit("-")))
    head = F.concat_ws(" | ", F.concat(F.lit("[S"), F.col("place").cast("string"), F.lit("] "), parts[0]), *parts[1:], page)
    return F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")))


def messages(sources: DataFrame, asked: DataFrame, hide_status: bool = False) -> DataFrame:
    """(qid, message): the profile, the question and its sources in order; questions without sources aren't asked.

    sources: qid and the columns of :func:`passage_block`. asked: qid, question, jurisdiction, grade, scheme.
    """
    blocks = F.array_sort(F.collect_list(F.struct("place", passage_block(hide_status).alias("block"))))
    context = sources.groupBy("qid").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("context"))
    stated = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNSTATED))
    profile = F.concat(F.lit("USER_PROFILE: jurisdiction="), F.coalesce("jurisdiction", F.lit("-")), F.lit("; grade="), stated("grade"), F.lit("; scheme="), stated("scheme"))
    said = F.concat_ws("\n", profile, F.concat(F.lit("QUESTION: "), F.coalesce("question", F.lit(""))), F.lit("CONTEXT:"), F.col("context"))
    return context.join(asked, "qid").select("qid", said.alias("message"))


def told(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def gated(asked: DataFrame, tokens: DataFrame) -> DataFrame:
    """asked (qid, n_packs, n_sources, failure) with its tokens, answer, used, actions and answerable.

    tokens: qid, seq, section, text.  An answer stands if the model ended well and cites a source that is there; else its
    actions go with it.  A model that failed leaves no answer, everything else that doesn't stand is the refusal.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "section", "text")))
    rows = asked.join(tokens.groupBy("qid").agg(order.alias("tokens")), "qid", "left")
    rows = rows.withColumn("tokens", F.when((F.col("n_packs") > 0) & (F.col("n_sources") > 0), F.col("tokens")))
    part = lambda name: F.array_join(F.transform(F.filter("tokens", lambda t: t["section"] == name), lambda t: t["text"]), "")
    rows = rows.withColumn("v", ANS.validated(F.coalesce(part("answer"), F.lit("")), F.col("n_sources"))).withColumn("acting", F.coalesce(part("actions"), F.lit("")))
    stands = F.col("tokens").isNotNull() & F.col("failure").isNull() & (F.col("v.text") != "") & (F.size("v.used") > 0)
    rows = rows.withColumn("answerable", stands)
    lines = ANS.actions(rows.where("answerable").select(F.col("qid").alias("id"), "n_sources", F.col("acting").alias("text")))
    listed = F.array_sort(F.collect_list(F.struct("place", F.col("action").alias("text"), F.transform("citations", source_name).alias("citations"))))
    acts = lines.groupBy(F.col("id").alias("qid")).agg(F.transform(listed, lambda x: F.struct(x["text"].alias("text"), x["citations"].alias("citations"))).alias("actions"))
    answer = F.when(F.col("answerable"), F.col("v.text")).when(F.col("failure").isNull(), REFUSAL)
    used = F.when(F.col("answerable"), F.transform("v.used", source_name)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<struct<text:string,citations:array<string>>>")
    return rows.join(acts, "qid", "left").select(*asked.columns, F.coalesce("tokens", F.array().cast("array<struct<seq:long,section:string,text:string>>")).alias("tokens"), answer.alias("answer"), used.alias("used"), F.coalesce("actions", none).alias("actions"), "answerable")


def source_name(n: Column) -> Column:
    return F.concat(F.lit("S"), n.cast("string"))


def answer_events(asked: DataFrame, sources: DataFrame, tokens: DataFrame) -> DataFrame:
    """(qid, seq, event, payload): each question's sources, then its tokens, then the final event; or one error.

    asked: qid, n_packs, kind, conflict, search_failure, model_failure (messages, null if there is none). sources: qid,
    place, score and what a source is told with. tokens: qid, seq, section, text as the parser gives them.  The confidence
    is that of the best source; a question without an answer ends at LOW.
    """
    kept = [c for c in sources.columns if c not in ("qid", "place")]
    one = F.struct("place", F.struct(source_name(F.col("place")).alias("id"), F.col("place").alias("n"), *(F.col(c).alias("document_id" if c == "id" else c) for c in kept)).alias("s"))
    found = sources.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("sources"), F.count(F.lit(1)).alias("n_sources"), F.max("score").alias("best"))
    rows = asked.join(found, "qid", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0))).withColumn("band", confidence(F.col("best"), F.col("kind")))
    none = F.array().cast(found.schema["sources"].dataType)
    failed = rows.where("search_failure is not null").select("qid", F.lit(0).cast("long").alias("seq"), F.lit("error").alias("event"), told(F.col("search_failure").alias("message")).alias("payload"))
    # a model is asked only where there are sources
    well = gated(rows.where("search_failure is null").withColumn("failure", F.when((F.col("n_packs") > 0) & (F.col("n_sources") > 0), F.col("model_failure"))), tokens)
    warning = lambda code, message: F.struct(F.lit(code).alias("code"), message.alias("message"))
    warnings = F.array_compact(F.array(F.when(F.col("n_packs") == 0, warning(NO_PACKS[0], F.lit(NO_PACKS[1]))), F.when(F.col("failure").isNotNull(), warning("llm_failed", F.col("failure")))))
    first = told(F.coalesce("sources", none).alias("sources"), F.col("conflict").alias("jurisdiction_conflict"), F.col("band").alias("confidence"), F.col("kind").alias("rerank"))
    band = F.when(F.col("answerable"), F.col("band")).otherwise("LOW")
    last = told("answer", "answerable", F.coalesce(F.col("answer") == REFUSAL, F.lit(False)).alias("refusal"), F.col("used").alias("citations"), "actions", band.alias("confidence"), warnings.alias("warnings"))
    event = lambda name, payload: F.struct(F.lit(name).alias("event"), payload.alias("payload"))
    pieces = F.transform("tokens", lambda t: event("token", F.to_json(F.struct(t["section"].alias("section"), t["text"].alias("text")))))
    shown = well.select("qid", F.posexplode(F.concat(F.array(event("sources", first)), pieces, F.array(event("final", last)))).alias("seq", "e"))
    return shown.select("qid", F.col("seq").cast("long").alias("seq"), "e.event", "e.payload").unionByName(failed)
