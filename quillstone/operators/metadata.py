"""Metadata of documents from their headers, completed by a model's answers and overridden by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import parse_malay_date

#: numbers in headers: pattern, series, short form, jurisdiction; fixed values, the first that is found counts
SERIES = (
    (r"(?i)SURAT\s+PEKELILING\s+PERKHIDMATAN\s+BILANGAN\s+(\d{1,3})\s+TAHUN\s+((?:19|20)\d{2})", "SPP", "SPP", "FEDERAL"),
    (r"(?i)PEKELILING\s+PERKHIDMATAN\s+BILANGAN\s+(\d{1,3})\s+TAHUN\s+((?:19|20)\d{2})", "PP", "PP", "FEDERAL"),
    (r"(?i)PEKELILING\s+PERBENDAHARAAN\s+(?:BILANGAN\s+)?(?:[A-Z]{2}\s*)?(\d{1,3})(?:\.\d+)?\s*(?:TAHUN|/)\s*((?:19|20)\d{2})", "PEKELILING_PERBENDAHARAAN", "PB", "FEDERAL"),
    (r"(?i)SURAT\s+EDARAN\s+(?:BILANGAN|BIL\.?)\s*(\d{1,3})\s*(?:TAHUN|/)\s*((?:19|20)\d{2})", "SE", "SE", "FEDERAL"),
    (r"(?i)PEKELILING\s+AM\s+SARAWAK\s+BILANGAN\s+(\d{1,3})\s+TAHUN\s+((?:19|20)\d{2})", "STATE", "PAS", "SARAWAK"),
    (r"(?i)GARIS\s+PANDUAN\s+BILANGAN\s+(\d{1,3})\s+TAHUN\s+((?:19|20)\d{2})", "OTHER", "GP", None),
)
#: minutes' and procedures' numbers; fixed values
MINUTES = r"(?i)MINIT\s+MESYUARAT\s+(.+?)\s+BIL\.?\s*(\d{1,3})\s*/\s*((?:19|20)\d{2})"
SOP = r"\b(SOP[-\s][A-Z0-9]+(?:[-\s][A-Z0-9]+)*\s*\d{0,3}/(?:19|20)\d{2})\b"
#: kinds of documents by their upper-case header, the first that is found counts; fixed values
KINDS = (("minutes", "MINIT MESYUARAT"), ("sop", r"PROSEDUR\s+OPERASI\s+STANDARD|\bSOP\b"), ("guideline", "GARIS PANDUAN"), ("report", r"(?m)^\s*LAPORAN\b"), ("policy", r"(?m)^\s*DASAR\b"))
#: lines with dates, the phrase for one-off rules, the section that says to whom they apply; fixed values
ISSUED, EFFECTIVE = r"(?im)^\s*Tarikh\s*:\s*(.+)$", r"(?i)berkuat\s+kuasa\s+mulai\s+(\d{1,2}\s+\w+\s+(?:19|20)\d{2})"
ONE_OFF = r"(?i)\b(sekali\s+sahaja|one[-\s]off)\b"
APPLIES = r"(?s)PEMAKAIAN\s*\n(.+?)(?:\n\d+\.\s+[A-Z ]{4,}\n|\z)"
#: lines that are no title, words that titles keep small, and those they keep in capitals; fixed values
HEADINGS = ("TUJUAN", "LATAR BELAKANG", "PEMAKAIAN", "KEHADIRAN", "TERHAD", "SULIT")
SMALL_WORDS = ("dan", "atau", "di", "ke", "dari", "bagi", "untuk", "melalui", "yang", "dalam", "of", "and", "the")
ACRONYMS = ("hrmis", "sop", "gcr")
#: fields that overrides may set
FIELDS = ("circular_no", "series", "title", "issuer", "doc_type", "jurisdiction", "issue_date", "effective_date", "one_off", "classification_level", "language", "applicability")


def capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))


def title_case(c: Column) -> Column:
    """Capitalised words, but small ones after the first; acronyms stay upper case."""
    words = F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")

    def shown(w: Column, i: Column) -> Column:
        bracket = F.concat(F.lit("("), capital(F.substring(w, F.lit(2), F.length(w))))
        return F.when((i > 0) & w.isin(*SMALL_WORDS), w).when(w.isin(*ACRONYMS), F.upper(w)).when(w.startswith("(") & (F.length(w) > 1), bracket).otherwise(capital(w))

    return F.array_join(F.transform(words, shown), " ")


def initials(c: Column) -> Column:
    words = F.filter(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*SMALL_WORDS))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def group(c: Column, pattern: str, k: int) -> Column:
    """A group of the first match, null where there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k))


def header_metadata(pages: DataFrame) -> DataFrame:
    """id, file and the fields that the texts give (null where they give none). pages: id, file, head, full.

    head is the text of the first two pages, full that of all.
    """
    rows = pages.select("id", "file", "head", "full", F.filter(F.transform(F.split("head", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    rows = rows.withColumn("block", F.array_join(F.slice("lines", 1, 10), "\n")).withColumn("upper", F.upper("head"))
    block, upper, lines = F.col("block"), F.col("upper"), F.col("lines")
    kind = reduce(lambda acc, k: acc.when(upper.rlike(k[1]), k[0]), KINDS[1:], F.when(upper.rlike(KINDS[0][1]), KINDS[0][0])).otherwise("circular")
    short = lambda p, prefix: F.concat(F.lit(prefix + " "), F.regexp_extract(block, p, 1).cast("int").cast("string"), F.lit("/"), F.regexp_extract(block, p, 2))
    which = reduce(lambda acc, k: acc.when(block.rlike(SERIES[k][0]), k), range(1, len(SERIES)), F.when(block.rlike(SERIES[0][0]), 0))
    minutes, sop = which.isNull() & block.rlike(MINUTES), which.isNull() & ~block.rlike(MINUTES) & block.rlike(SOP)
    rows = rows.withColumn("which", which).withColumn("minutes", minutes).withColumn("sop", sop)
    rows = rows.withColumn("series", reduce(lambda acc, k: acc.when(F.col("which") == k, SERIES[k][1]), range(len(SERIES)), F.when(F.col("minutes") | F.col("sop"), "OTHER")))
    name, number, year = (F.regexp_extract(block, MINUTES, k) for k in (1, 2, 3))
    own = F.when(F.col("minutes"), F.concat(F.lit("MM"), initials(name), F.lit(" "), number.cast("int").cast("string"), F.lit("/"), year)).when(F.col("sop"), F.regexp_replace(F.regexp_extract(block, SOP, 1), r"\s+", " "))
    rows = rows.withColumn("circular_no", reduce(lambda acc, k: F.when(F.col("which") == k, short(SERIES[k][0], SERIES[k][2])).otherwise(acc), range(len(SERIES)), own))
    # the line with the number, from 0
    found = lambda p: F.array_position(F.transform(lines, lambda x: x.rlike(p)), True) - 1
    at = reduce(lambda acc, k: F.when(F.col("which") == k, found(SERIES[k][0])).otherwise(acc), range(len(SERIES)), F.when(F.col("sop"), found(SOP)))
    rows = rows.withColumn("at", F.when(at >= 0, at))
    titles = F.filter(F.slice(lines, F.col("at").cast("int") + 2, F.lit(3)), lambda x: is_upper(x) & ~x.isin(*HEADINGS) & ~x.rlike(r"^\d+\."))
    of_meeting = F.concat(F.lit("Minit Mesyuarat "), name, F.lit(" Bil. "), number.cast("int").cast("string"), F.lit("/"), year)
    first = F.get(lines, F.lit(0))
    state = F.regexp_extract(upper, r"^[^\n]*\n?[^\n]*\n?[^\n]*", 0)
    side = reduce(lambda acc, k: acc.when(F.col("which") == k, SERIES[k][3]), range(1, 5), F.when(F.col("which") == 0, SERIES[0][3]))
    other = F.when(F.regexp_extract(state, r"^[^\n]*", 0).contains("SARAWAK") | F.substring(upper, 1, 300).contains("NEGERI SARAWAK"), "SARAWAK").when(upper.rlike("PERKHIDMATAN AWAM MALAYSIA|KEMENTERIAN|PERSEKUTUAN"), "FEDERAL")
    issued, effective = parse_malay_date(group(F.col("head"), ISSUED, 1)), group(F.col("full"), EFFECTIVE, 1)
    dated = F.when(effective.isNotNull(), parse_malay_date(effective)).when(kind.isin("sop", "guideline", "policy"), issued)
    applies = F.substring(F.regexp_replace(F.regexp_replace(F.trim(group(F.col("full"), APPLIES, 1)), r"^\d+(\.\d+)*\s*", ""), r"\s+", " "), 1, 400)
    return rows.select(
        "id", "file", "circular_no", "series",
        F.when(F.col("minutes"), title_case(of_meeting)).when(F.col("at").isNotNull(), F.when(F.size(titles) > 0, title_case(F.get(titles, F.lit(0))))).alias("title"),
        F.when(F.col("minutes"), title_case(F.concat(F.lit("Mesyuarat "), name))).when(is_upper(first) & (F.col("at").isNull() | (F.col("at") > 0)), title_case(first)).alias("issuer"),
        kind.alias("doc_type"), F.coalesce(side, other).alias("jurisdiction"), issued.alias("issue_date"), dated.alias("effective_date"),
        F.when(F.col("full").rlike(ONE_OFF), 1).alias("one_off"),
        F.when(F.col("head").rlike(r"(?m)^\s*SULIT\s*$"), 2).when(F.col("head").rlike(r"(?m)^\s*TERHAD\s*$"), 1).alias("classification_level"),
        F.lit("ms").alias("language"), applies.alias("applicability"),
    )


def complete_metadata(found: DataFrame, overrides: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Fields by precedence: overrides by file, then what the texts give, then a model's answers by id, then defaults.

    The model is asked only where a number, a title, an issue date or a jurisdiction is missing, and fills gaps only.
    """
    out = found
    if model is not None:
        filled = [c for c in FIELDS if c in model.columns]
        gaps = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in ("circular_no", "title", "issue_date", "jurisdiction")))
        said = model.select("id", *(F.col(c).alias(f"m_{c}") for c in filled))
        out = out.withColumn("gaps", gaps).join(said, "id", "left")
        out = out.select("id", "file", *(F.coalesce(c, F.when(F.col("gaps"), F.col(f"m_{c}"))).alias(c) if c in filled else F.col(c) for c in FIELDS))
    manual = [c for c in FIELDS if c in overrides.columns]
    out = out.join(overrides.select("file", *(F.col(c).alias(f"o_{c}") for c in manual)), "file", "left")
    out = out.select("id", "file", *(F.coalesce(f"o_{c}", c).alias(c) if c in manual else F.col(c) for c in FIELDS))
    stem = F.regexp_replace(F.regexp_extract("file", r"[^/\\]*$", 0), r"(?<=.)\.[^.]*$", "")
    defaults = {"series": "OTHER", "jurisdiction": "UNKNOWN", "classification_level": 0, "one_off": 0, "doc_type": "circular"}
    for c, value in defaults.items():
        out = out.withColumn(c, F.coalesce(c, F.lit(value)))
    return out.withColumn("circular_no", F.coalesce("circular_no", stem)).withColumn("title", F.coalesce("title", "circular_no"))
