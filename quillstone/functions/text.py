"""Text functions: folding, terms, stems, references, clause numbers, headings, slices."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: words that are no search terms; fixed values
STOPWORDS = (
    "yang", "dan", "untuk", "saya", "di", "ke", "dari", "ini", "itu", "adalah", "ada", "apa", "apakah", "berapa", "bagaimana", "boleh", "bolehkah",
    "bagi", "dengan", "pada", "atau", "kah", "tak", "tidak", "nak", "mahu", "perlu", "buat", "tentang", "mana", "masih", "sahaja", "jika", "kalau",
    "kita", "kami", "anda", "dia", "lagi", "the", "a", "an", "of", "to", "is", "in", "for", "and", "what", "how", "can", "i", "my", "me", "does",
    "do", "are", "be", "it", "on", "with", "many", "much", "still", "should", "which", "who", "when", "there", "any", "this", "that", "if", "or",
    "am", "was", "will", "would", "about", "under",
)
#: suffixes that stemming strips, in order; fixed values
SUFFIXES = ("nya", "kan", "lah", "es", "s")
MAX_TERMS = 24


def fold_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without: what decomposing and dropping marks gives."""
    pairs = []
    for point in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(point) and chr(point).islower():
            pairs.append((chr(point), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = fold_table()


def fold(c: Column) -> Column:
    """Lower case without marks on Latin letters; combining marks are dropped. Plain ASCII is only lowered."""
    lower = F.lower(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(F.regexp_replace(lower, r"\p{Mn}+", ""), MARKED, PLAIN)).otherwise(lower)


def words(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}_/]+"), F.lit(0))


def term_ok(w: Column) -> Column:
    """Whether a trimmed word is a search term: no stop word, two characters at least, no slash inside."""
    return (F.length(w) >= 2) & ~w.isin(*STOPWORDS) & ~w.contains("/")


def terms(c: Column) -> Column:
    """Search terms in order."""
    return F.filter(F.transform(words(c), lambda w: F.trim(w, F.lit("/"))), term_ok)


def query_terms(c: Column, limit: int = MAX_TERMS) -> Column:
    return F.slice(F.array_distinct(terms(c)), 1, limit)


def stem(w: Column) -> Column:
    out = F.when(F.lit(False), w)
    for suffix in SUFFIXES:
        out = out.when((F.length(w) > len(suffix) + 3) & w.endswith(suffix), F.substring(w, F.lit(1), F.length(w) - len(suffix)))
    return out.otherwise(w)


def tokens(c: Column) -> Column:
    """Stemmed words without stop words, in order."""
    plain = F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(plain, lambda w: ~w.isin(*STOPWORDS)), stem)


def first_words(c: Column, n: int) -> Column:
    """The first n words; longer texts end in dots."""
    parts = F.split(F.trim(c), r"\s+")
    return F.when(F.size(parts) > n, F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit(" ..."))).otherwise(c)


def is_heading(c: Column) -> Column:
    return (F.upper(c) == c) & c.rlike(r"\p{L}") & (F.length(c) <= 120)


def clean(c: Column, watermark: str | None = None) -> Column:
    """Without watermark lines, soft hyphens, carriage returns, trailing blanks and empty lines."""
    text = F.translate(c, "­\r", "")
    text = F.regexp_replace(text, f"(?im)^.*(?:{watermark}).*$", "") if watermark else text
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[ \t]+$", "")), lambda x: F.trim(x) != ""), "\n")


def word_slices(c: Column, n: int = 500) -> Column:
    parts = F.split(c, " ")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / n).cast("int")), lambda i: F.array_join(F.slice(parts, i * n + 1, F.lit(n)), " "))


def clause_key(ref: Column) -> Column:
    """A dotted clause number as numbers, which compare as arrays."""
    return F.transform(F.split(ref, r"\."), lambda x: x.try_cast("int"))


def scope_touches(scope: Column, clause: Column) -> Column:
    """Whether a scope's clauses overlap a passage's clause or clause range; true where either can't be read."""
    targets = F.regexp_extract_all(F.coalesce(scope, F.lit("")), F.lit(r"\d{1,2}(?:\.\d{1,2})*"), F.lit(0))
    low = clause_key(F.regexp_extract(clause, r"^(\d+(?:\.\d+)*)", 1))
    end = F.regexp_extract(clause, r"-(\d+(?:\.\d+)*)$", 1)
    high = clause_key(F.when(end == "", F.regexp_extract(clause, r"^(\d+(?:\.\d+)*)", 1)).otherwise(end))
    inside = F.exists(targets, lambda t: (low <= clause_key(t)) & (clause_key(t) <= high) | (F.slice(clause_key(t), F.lit(1), F.size(low)) == low))
    readable = (F.size(targets) > 0) & clause.rlike(r"^\d+(\.\d+)*(-\d+(\.\d+)*)?$")
    return F.when(F.coalesce(readable, F.lit(False)), inside).otherwise(F.lit(True))


#: patterns of references in documents, those with a long name first, and in questions; fixed values
REFERENCE = r"(?i)((?:surat\s+)?pekeliling\s+(?:perkhidmatan|perbendaharaan)|\b(?:spp|pp|se)\b)\s*(?:bilangan|bil\.?)\s*(\d{1,3})\s*(?:tahun|/)\s*((?:19|20)\d{2})"
STATE_REFERENCE = r"(?i)(pekeliling\s+am\s+sarawak|\bpas\b)\s*(?:bilangan|bil\.?)\s*(\d{1,3})\s*(?:tahun|/)\s*((?:19|20)\d{2})"
QUERY_REFERENCE = r"(?i)\b(spp|pp|pas|se|pb|gp)\s*(?:bil(?:angan)?\.?\s*)?(\d{1,3})\s*(?:/|tahun)\s*((?:19|20)\d{2})\b"


def series_code(name: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")
    return F.when(s.startswith("surat pekeliling perkhidmatan"), "SPP").when(s.startswith("pekeliling perkhidmatan"), "PP").when(s.startswith("pekeliling perbendaharaan"), "PB").when(s.startswith("pekeliling am sarawak"), "PAS").otherwise(F.upper(s))


def references(c: Column, *patterns: str) -> Column:
    """References in their short form: those of the first pattern in order, then those of the next."""
    found = []
    for pattern in patterns or (REFERENCE, STATE_REFERENCE):
        group = lambda k, p=pattern: F.regexp_extract_all(c, F.lit(p), F.lit(k))
        zipped = F.arrays_zip(group(1).alias("s"), group(2).alias("n"), group(3).alias("y"))
        found.append(F.transform(zipped, lambda r: F.concat(series_code(r["s"]), F.lit(" "), r["n"].cast("int").cast("string"), F.lit("/"), r["y"])))
    return F.concat(*found)


#: phrases that say how one document affects another, strongest first; fixed values
EFFECTS = {
    "SUPERSEDES": ("digantikan", "menggantikan", "superseded", "replaces"),
    "CANCELS": ("dibatalkan", "membatalkan", "dimansuhkan", "tidak lagi terpakai", "cancelled", "revoked"),
    "AMENDS": ("dipinda", "pindaan", "amends"),
}


def relation_effect(sentence: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, phrases in EFFECTS.items():
        out = out.when(F.lower(sentence).rlike("|".join(phrases)), kind)
    return out.otherwise("REFERENCES")


def has_trigger(sentence: Column) -> Column:
    return F.lower(sentence).rlike("|".join(p for phrases in EFFECTS.values() for p in phrases))


#: month names; fixed values
MONTHS = ("Januari", "Februari", "Mac", "April", "Mei", "Jun", "Julai", "Ogos", "September", "Oktober", "November", "Disember")
ENGLISH_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def malay_date(d: Column) -> Column:
    """Day, month name and year; a fixed text for no date."""
    named = F.concat_ws(" ", F.day(d).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)), F.year(d).cast("string"))
    return F.when(d.isNull(), "tarikh tidak diketahui").otherwise(named)


def parse_malay_date(c: Column) -> Column:
    """The first "day month year" with a Malay or English month name; null where there is none or no such day."""
    names = {m.lower(): k + 1 for months in (ENGLISH_MONTHS, MONTHS) for k, m in enumerate(months)}
    pattern = rf"(?i)\b(\d{{1,2}})\s+({'|'.join(sorted(names, key=len, reverse=True))})\s+((?:19|20)\d{{2}})\b"
    month = F.try_element_at(F.create_map(*(F.lit(x) for item in names.items() for x in item)), F.lower(F.regexp_extract(c, pattern, 2)))
    return F.try_to_date(F.concat_ws("-", F.regexp_extract(c, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(c, pattern, 1), 2, "0")), "yyyy-MM-dd")


def lenient_date(c: Column) -> Column:
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
