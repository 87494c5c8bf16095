"""Structural chunks of rule documents, by a fold of each document's lines, and of minutes, by windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import is_heading, malay_date, word_slices

#: words of a chunk at most, and of a preamble at least; fixed values
MAX_WORDS, LEAST_PREAMBLE = 500, 40
#: lines with a section's number, a clause's number and an item's letter; fixed formats
TOP, SUB, ITEM = r"^(\d{1,2})\.\s+(.+)$", r"^(\d{1,2}(?:\.\d{1,2})+)\.?\s+(.+)$", r"^\((\w{1,3})\)\s+(.+)$"
#: headings without a number; fixed values
CAPS = r"^(TUJUAN|LATAR BELAKANG|PEMAKAIAN|TARIKH KUAT KUASA|PEMBATALAN|LAMPIRAN)\b[A-Z0-9 ,'()/&\-]*$"
#: labels of the parts of minutes; fixed values
PERKARA, PARTS = r"(?i)^PERKARA\s+(\d{1,3})\s*[:.\-]?\s*(.*)$", r"^(KEPUTUSAN|TINDAKAN|KEHADIRAN)\s*:?\s*(.*)$"


#: words as splitting at blanks gives them, and documents whose lines a worker holds
WORD, HELD = r"[^ \t\n\x0b\f\r]+", 500


#: pages whose lines a task takes apart at most, on average
PAGES = 5_000


def by_document(pages: DataFrame) -> DataFrame:
    """pages, shuffled by document in so many parts that a part doesn't grow with the table.

    There are no fewer parts than other shuffles have, so that joins by document take these as they are.
    """
    spark = pages.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // PAGES))
    return pages.where("id is not null and text is not null").repartition(parts, "id")


def lines_of(pages: DataFrame) -> DataFrame:
    """(id, page, pos, line): lines that are not blank, trimmed, in order. pages: id, page, text."""
    split = pages.select("id", "page", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return split.select("id", "page", F.struct("page", "at").alias("pos"), F.trim("raw").alias("line")).where("line <> ''")


def joined(lines: Column) -> Column:
    """Text of ordered (pos, sep, line): each line after its separator, the first without."""
    return F.aggregate(lines, F.lit(""), lambda s, x: F.when(s == "", x["line"]).otherwise(F.concat(s, x["sep"], x["line"])))


#: what a line of a rule document is: a clause, a numbered paragraph, a numbered heading, an item, a known heading
CLAUSE, PARAGRAPH, HEADING, LETTERED, KNOWN = 1, 2, 3, 4, 5


def rule_lines(page: Column, text: Column) -> Column:
    """The lines (page, at, line, kind, mark, title) of a page that are not blank, trimmed, in order."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line"))), lambda x: x["line"] != "")

    def kind(line: Column) -> Column:
        # each pattern is tried on lines that begin as it does
        first = F.substring(line, 1, 1)
        numbered = F.when(line.rlike(SUB), CLAUSE).when(line.rlike(TOP), F.when(is_heading(F.regexp_extract(line, TOP, 2)), HEADING).otherwise(PARAGRAPH)).otherwise(0)
        return F.when(first.between("0", "9"), numbered).when(first == "(", line.rlike(ITEM).cast("int") * LETTERED).when(first.isin("T", "L", "P"), line.rlike(CAPS).cast("int") * KNOWN).otherwise(0)

    rows = F.transform(rows, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"), kind(x["line"]).alias("kind")))
    mark = lambda x: F.when(x["kind"] == CLAUSE, F.regexp_extract(x["line"], SUB, 1)).when(x["kind"].isin(PARAGRAPH, HEADING), F.regexp_extract(x["line"], TOP, 1))
    title = lambda x: F.when(x["kind"] == KNOWN, x["line"]).when(x["kind"] == HEADING, F.trim(F.regexp_extract(x["line"], TOP, 2)))
    return F.transform(rows, lambda x: F.struct(page.cast("long").alias("page"), x["at"].cast("int").alias("at"), x["line"].alias("line"), x["kind"].cast("int").alias("kind"), mark(x).alias("mark"), title(x).alias("title")))


def ends(values: np.ndarray, known: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The least and the greatest known value from each start to the next; null where none is known."""
    if not len(starts):
        return pa.array([], pa.int64()), pa.array([], pa.int64())
    big = np.iinfo(np.int64)
    low, high = np.minimum.reduceat(np.where(known, values, big.max), starts), np.maximum.reduceat(np.where(known, values, big.min), starts)
    none = ~np.logical_or.reduceat(known, starts)
    return pa.array(low, mask=none), pa.array(high, mask=none)


def rule_chunks(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The chunks of documents, each a list of :func:`rule_lines`: of each chunk its document's place, and its columns."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    doc, flat = np.repeat(np.arange(len(size)), size), lists.flatten()
    fields = {f.name: c for f, c in zip(flat.type, flat.flatten())}
    known = fields["page"].is_valid().to_numpy(zero_copy_only=False)
    page, at = (pc.fill_null(fields[c], np.iinfo(np.int32).min).to_numpy(zero_copy_only=False) for c in ("page", "at"))
    order = np.lexsort([at, page, doc])
    if (order != np.arange(len(order))).any():  # pages of one number
        fields, doc, page, known = {c: x.take(pa.array(order)) for c, x in fields.items()}, doc[order], page[order], known[order]
    kind = fields["kind"].to_numpy(zero_copy_only=False)
    # sections, counted over all documents and in each one
    opens, new = np.isin(kind, (PARAGRAPH, HEADING, KNOWN)), np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    here, count = np.cumsum(opens | new) - 1, np.cumsum(opens)
    lead, before = np.flatnonzero(opens | new), (count - opens)[new]
    numbered = count > np.repeat(before, size[size > 0])
    # units of the lines that are no headings
    body = np.flatnonzero(~np.isin(kind, (HEADING, KNOWN)))
    start = np.append(True, here[body][1:] != here[body][:-1])[: len(body)] | ((kind == CLAUSE) & numbered)[body]
    unit, first = np.cumsum(start) - 1, body[start]
    text = fields["line"].take(pa.array(body))
    words = np.bincount(unit, pc.count_substring_regex(text, WORD).to_numpy(zero_copy_only=False), len(first)).astype(np.int64)
    kept = numbered[first] | (words >= LEAST_PREAMBLE)
    # a sum of words that starts anew where it would pass the limit, in each section
    begins, section, total = [], -1, 0
    for own, n in zip(here[first[kept]].tolist(), words[kept].tolist()):
        over = own != section or (total > 0 and total + n > MAX_WORDS)
        section, total = own, n if over else total + n
        begins.append(over)
    begins = np.array(begins, bool)
    group_of = np.full(len(first), -1)
    group_of[kept] = np.cumsum(begins) - 1
    group, opening = group_of[unit], np.zeros(len(first), bool)
    opening[np.flatnonzero(kept)[begins]] = True
    # lines with what comes before them
    apart = start | (kind[body] == LETTERED) | ~numbered[body]
    sep = np.where(start & opening[unit], 0, np.where(apart, 1, 2))
    some = np.flatnonzero(group >= 0)
    pieces = pc.binary_join_element_wise(pa.array(["", "\n", " "]).take(pa.array(sep[some])), text.take(pa.array(some)), "")
    starts = np.flatnonzero(np.append(True, group[some][1:] != group[some][:-1])[: len(some)])
    joined_text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(some)), pa.int32()), pieces), "")
    # a unit's reference is its clause's number, else its section's
    has_num = np.isin(kind[lead], (PARAGRAPH, HEADING))[here[first]]
    clause = (kind[first] == CLAUSE) & numbered[first]
    of = np.where(clause, first, np.where(has_num, lead[here[first]], -1))
    low, high = ends(np.arange(len(first))[kept], (of >= 0)[kept], np.flatnonzero(begins))
    # places among the kept ones are places among all, as values
    ref = lambda x: fields["mark"].take(pa.array(of).take(x))
    head = lead[here[first[kept][begins]]]
    mark = pa.array(np.where(np.isin(kind[head], (PARAGRAPH, HEADING)), head, -1), mask=~np.isin(kind[head], (PARAGRAPH, HEADING)))
    title = pa.array(head, mask=~np.isin(kind[head], (HEADING, KNOWN)))
    owner = doc[first[kept][begins]]
    page_start, page_end = ends(page[body[some]].astype(np.int64), known[body[some]], starts)
    columns = {
        "place": pa.array(np.arange(len(owner)) - np.searchsorted(owner, owner), pa.int64()), "preamble": pa.array(~numbered[first[kept][begins]]),
        "num": fields["mark"].take(mark), "heading": fields["title"].take(title), "lo": ref(low), "hi": ref(high), "page_start": page_start, "page_end": page_end, "body": joined_text,
    }
    return owner, columns


def chunk_rules(pages: DataFrame, numbers: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """Chunks of rule documents: id, chunk_index, clause_ref, breadcrumb, page_start, page_end, text.

    numbers: id, circular_no. Sections start at numbered headings, numbered paragraphs and known headings; clauses and
    first lines start units; items and other lines go on with the unit before. Units fill chunks of up to 500 words.

    Pages are shuffled once, as they are; a document's lines are told apart inside its row and folded where they are.
    about (id, ...) joins what is known of documents on the way, so that no chunk is shuffled for it: what a join of the
    chunks with it gives.
    """
    listed = lambda df, name: df.groupBy("id").agg(F.collect_list(F.struct(*(c for c in df.columns if c != "id"))).alias(name))
    rows = listed(by_document(pages.select("id", "page", "text")), "pages").join(listed(numbers, "known"), "id")
    rows = rows.join(listed(about, "about"), "id") if about is not None else rows.withColumn("about", F.array(F.struct(F.lit(0).alias("none"))))
    rows = rows.select("id", "known", "about", F.flatten(F.transform("pages", lambda p: rule_lines(p["page"], p["text"]))).alias("lines"))
    kinds = "place long, preamble boolean, num string, heading string, lo string, hi string, page_start long, page_end long, body string"
    schema = T.StructType([*(rows.schema[c] for c in ("id", "known", "about")), *T.StructType.fromDDL(kinds)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, HELD) for b in batches for a in range(0, b.num_rows, HELD)):
            owner, columns = rule_chunks(batch.column("lines"))
            same = pa.array(owner)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in ("id", "known", "about")), *columns.values()], ["id", "known", "about", *columns])

    chunks = rows.mapInArrow(work, schema).select("*", F.size("known").alias("copies"), F.posexplode("known").alias("copy", "of"))
    chunks = chunks.withColumn("circular_no", F.col("of.circular_no")).withColumn("chunk_index", (F.col("place") * F.col("copies") + F.col("copy")).cast("int"))
    kind = pages.schema["page"].dataType
    heading = F.when(F.col("preamble"), "Pendahuluan").otherwise(F.coalesce("heading", F.lit("")))
    chunks = chunks.withColumn("heading", heading)
    clause = F.when(F.col("lo").isNull(), F.coalesce("num", F.initcap(F.lower("heading")))).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.concat_ws("-", "lo", "hi"))
    line1 = F.when(F.col("num").isNotNull() & (F.col("heading") != ""), F.concat_ws(". ", "num", "heading")).otherwise(F.col("heading"))
    crumb = F.when(F.col("heading") != "", F.initcap(F.lower("heading"))).otherwise(F.concat(F.lit("Perenggan "), F.col("num")))
    out = chunks.withColumn("clause_ref", clause).select(
        "id", "chunk_index", "clause_ref", F.concat_ws(" > ", "circular_no", crumb, "clause_ref").alias("breadcrumb"),
        F.col("page_start").cast(kind).alias("page_start"), F.col("page_end").cast(kind).alias("page_end"), F.when(line1 != "", F.concat_ws("\n", line1, "body")).otherwise(F.col("body")).alias("text"), "about",
    )
    return out.select(*out.columns[:-1], F.inline("about")) if about is not None else out.drop("about")


def chunk_minutes(pages: DataFrame, numbers: DataFrame) -> DataFrame:
    """Chunks of minutes, one for each agenda item, decision, action and attendance list.

    numbers: id, circular_no, issue_date. Lines before the first label are left out.
    """
    line = F.col("line")
    order = Window.partitionBy("id").orderBy("pos")
    rows = lines_of(by_document(pages)).withColumn("is_item", line.rlike(PERKARA)).withColumn("part", F.regexp_extract(line, PARTS, 1))
    kind = F.when(F.col("is_item"), "Perkara").when(F.col("part") != "", F.initcap(F.lower("part")))
    rows = rows.withColumn("kind", kind).withColumn("unit", F.count("kind").over(order)).where("unit > 0")
    fill = lambda c: F.last(c, ignorenulls=True).over(order)
    rows = rows.withColumn("no", fill(F.when(F.col("is_item"), F.regexp_extract(line, PERKARA, 1)))).withColumn("title", fill(F.when(F.col("is_item"), F.trim(F.regexp_extract(line, PERKARA, 2)))))
    own = F.when(F.col("is_item"), "").when(F.col("part") != "", F.trim(F.regexp_extract(line, PARTS, 2))).otherwise(line)
    rows = rows.withColumn("line", own)
    units = rows.groupBy("id", "unit").agg(
        F.first("kind", ignorenulls=True).alias("kind"), F.first("no", ignorenulls=True).alias("no"), F.first("title", ignorenulls=True).alias("title"),
        F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        joined(F.filter(F.array_sort(F.collect_list(F.struct("pos", F.lit(" ").alias("sep"), "line"))), lambda x: x["line"] != "")).alias("body"),
    ).where("body <> ''").join(numbers, "id")
    item = F.concat(F.lit("Perkara "), F.col("no"))
    context = F.when(F.col("no").isNotNull(), F.concat(F.lit("PERKARA "), F.col("no"), F.lit(": "), F.col("title")))
    label = F.upper("kind")
    text = F.when(F.col("kind") == "Kehadiran", F.concat(F.lit("KEHADIRAN: "), F.col("body"))).when(F.col("kind") == "Perkara", F.concat_ws("\n", context, "body")).otherwise(F.concat_ws(" - ", context, F.concat(label, F.lit(": "), F.col("body"))))
    clause = F.when(F.col("kind") == "Kehadiran", "Kehadiran").when(F.col("kind") == "Perkara", item).otherwise(F.concat(item, F.lit(" - "), F.col("kind")))
    head = F.when(F.col("kind") == "Kehadiran", F.lit("Kehadiran")).otherwise(F.concat(item, F.lit(": "), F.initcap(F.lower("title"))))
    crumb = F.concat_ws(" > ", F.concat(F.col("circular_no"), F.lit(" ("), malay_date(F.col("issue_date")), F.lit(")")), head, F.when(~F.col("kind").isin("Perkara", "Kehadiran"), F.col("kind")))
    parts = units.select("id", "unit", clause.alias("clause_ref"), crumb.alias("breadcrumb"), "page_start", "page_end", F.posexplode(word_slices(text, MAX_WORDS)).alias("k", "text"))
    index = F.row_number().over(Window.partitionBy("id").orderBy("unit", "k")) - 1
    return parts.select("id", index.alias("chunk_index"), "clause_ref", "breadcrumb", "page_start", "page_end", "text")


def recognised(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks (id, ...) with ocr: whether any page (id, ocr) of their document was read by recognition, be it another's."""
    any_page = pages.groupBy("id").agg(F.coalesce(F.bool_or("ocr"), F.lit(False)).alias("ocr"))
    return chunks.join(any_page, "id", "left").withColumn("ocr", F.coalesce("ocr", F.lit(False)))
