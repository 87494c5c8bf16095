"""Format-preserving pseudonyms (operator 1), with DataFrame functions only.

Candidates are found by one pattern and validated: card numbers by the Luhn sum, dates by the calendar, addresses by
their octets, social security numbers by their ranges.  A valid number or date is permuted within its format by a keyed
Feistel network over mixed radices, so equal values get equal pseudonyms in every document, and different values
different ones.  A card number's last digit is computed anew, so the pseudonym is valid too.  A date with slashes that
can be read day first is, and stays among those; others (month first, a day above 12) are permuted among themselves, by
walking on until the result is one.  Mail addresses and quoted secrets of any length are no numbers: they are replaced by
keyed digests of the same kind (64 bits for each part of an address).

The key is the caller's; :func:`session_key` reads it from the session, and only a local session may go without one.
:func:`drawn_key` gives other sessions without one a random key.  Who knows the key can undo the permutations.

What stays: secrets without quotes, dates before 1700 or after 2099, numbers that fail their check, names, and account
numbers of other kinds (IBAN among them).

Defined results: a null text stays null, an empty one empty; a text without valid candidates is unchanged; candidates
that are not valid stay; columns other than text are kept, whatever their names.
"""

from __future__ import annotations

import secrets
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.memory import free_name

#: the setting that holds the key, and the key of sessions without one: fit for tests only, as it is public
KEY_SETTING, PUBLIC_KEY = "spark.quillstone.pseudonym.key", "public-test-key"
ROUNDS = 10
#: days from 1700-01-01 to 2099-12-31 are 27 x 5411
DAY_RADICES, FIRST_DAY = (27, 5411), "1700-01-01"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
KINDS = {
    "secret": r"(?=[TSPAtspa])(?i:\b(?:token|secret|password|api[_-]?key))\s*+[=:]\s*+(?:\"[^\"\n]++\"|'[^'\n]++')",
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "address": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]\d|\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![./-]?\d)",
    "social": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!-?\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![ -]?\d)",
}
NUMBERS = ("address", "phone", "date", "social", "card")
#: one pattern, the kinds in order; those of numbers are tried only where a number may start
PATTERN = "|".join([KINDS["secret"], KINDS["mail"], "(?=[0-9+(])(?:" + "|".join(KINDS[k] for k in NUMBERS) + ")"])
#: what every candidate holds; a text without any needs no search
SIGN = '[0-9@"\']'


#: a secret's lead with its opening quote, and its value
SECRET = r"^([^=:]*[=:]\s*[\"'])(.*)[\"']$"


def session_key(spark: SparkSession) -> str:
    """The session's key; outside local sessions there must be one, as the public key hides nothing."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY_SETTING}: pseudonyms under the public key can be undone by anybody")
    return key or PUBLIC_KEY


#: held while a key is drawn, so that all queries of a session have the same
DRAWING = threading.Lock()


def drawn_key(spark: SparkSession) -> str:
    """The session's key; where there must be one and is none, a random one, which stays as the session's setting.

    Pseudonyms are then equal for equal values within this session only: who needs them in later sessions sets a key.
    """
    with DRAWING:
        if not spark.conf.get(KEY_SETTING, None) and not spark.sparkContext.master.startswith("local"):
            spark.conf.set(KEY_SETTING, secrets.token_hex(32))
        return session_key(spark)


def digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once; a lambda that names an expression computes it anew for each element."""
    return F.transform(F.array(value), then)[0]


def feistel(left: Column, right: Column, radix_left: Column, radix_right: Column, key: str, tweak: Column) -> tuple[Column, Column]:
    """A keyed permutation of pairs with left < radix_left and right < radix_right."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), radix_left.cast("long").alias("ml"), radix_right.cast("long").alias("mr"))

    def step(a: Column, i: Column) -> Column:
        f = F.conv(F.substring(digest(key, tweak, a["ml"], a["mr"], i, a["r"]), 1, 15), 16, 10).cast("long")
        return F.struct(a["r"].alias("l"), ((a["l"] + F.pmod(f, a["ml"])) % a["ml"]).alias("r"), a["mr"].alias("ml"), a["ml"].alias("mr"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return out["l"], out["r"]


def joined(pair: tuple[Column, Column], then: Callable[[Column, Column], Column]) -> Column:
    """then(*pair), with each of the pair computed once."""
    return once(F.struct(pair[0].alias("l"), pair[1].alias("r")), lambda p: then(p["l"], p["r"]))


def permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A string of 2 to 36 digits, permuted among the strings of its length."""
    n = F.length(digits)
    a = (n / 2).cast("int")
    power = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")
    pair = feistel(F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, n), power(a), power(n - a), key, F.concat_ws("|", tweak, n.cast("string")))
    return joined(pair, lambda left, right: F.concat(F.lpad(left.cast("string"), a, F.lit("0")), F.lpad(right.cast("string"), n - a, F.lit("0"))))


def in_format(found: Column, digits: Column) -> Column:
    """found with its digits replaced, in order, by those of digits."""
    chars = F.sequence(F.lit(1), F.length(found))

    def step(a: Column, i: Column, digits: Column) -> Column:
        c = F.substring(found, i, F.lit(1))
        is_digit = c.between("0", "9")
        return F.struct(F.concat(a["out"], F.when(is_digit, F.substring(digits, a["n"], F.lit(1))).otherwise(c)).alias("out"), (a["n"] + is_digit.cast("int")).alias("n"))

    return once(digits, lambda digits: F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), lambda a, i: step(a, i, digits))["out"])


def luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn sum; shift 0 counts the last digit as the check digit, 1 leaves room for it."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i + shift) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)


def pseudonym(found: Column, key: str) -> Column:
    """What stands for one candidate: itself where it is not valid."""
    return once(F.regexp_replace(found, r"[^0-9]", ""), lambda digits: pseudonym_of(found, digits, key))


def pseudonym_of(found: Column, digits: Column, key: str) -> Column:
    n = F.length(digits)
    body = once(F.substring(digits, F.lit(1), n - 1), lambda own: permuted_digits(own, key, F.lit("card")))
    card = F.when(luhn_sum(digits, 0) % 10 == 0, in_format(found, once(body, lambda body: F.concat(body, ((10 - luhn_sum(body, 1) % 10) % 10).cast("string"))))).otherwise(found)
    # country code and first digit of the area stay valid: the number's first digit is 2 to 9 where it was
    own = F.substring(digits, n - 9, F.lit(10))
    lead = F.substring(own, F.lit(1), F.lit(5)).cast("long")
    ranged = lead >= 20000
    pair = feistel(F.when(ranged, lead - 20000).otherwise(lead), F.substring(own, F.lit(6), F.lit(5)), F.when(ranged, F.lit(80000)).otherwise(F.lit(20000)), F.lit(100000), key, F.lit("phone"))
    number = joined(pair, lambda left, right: F.concat(F.lpad((left + F.when(ranged, 20000).otherwise(0)).cast("string"), 5, "0"), F.lpad(right.cast("string"), 5, "0")))
    phone = in_format(found, F.concat(F.substring(digits, F.lit(1), n - 10), number))
    octet = [F.split(found, r"\.")[k].cast("long") for k in range(4)]
    quad = lambda left, right: F.concat_ws(".", *(x.cast("string") for p in (left, right) for x in ((p / 256).cast("long"), p % 256)))
    address = joined(feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), key, F.lit("address")), quad)
    social = in_format(found, permuted_social(digits, key))
    mail = F.concat(F.lit("u"), F.substring(digest(key, F.lit("mail"), F.lower(F.substring_index(found, "@", 1))), 1, 16), F.lit("@d"), F.substring(digest(key, F.lit("host"), F.lower(F.substring_index(found, "@", -1))), 1, 16), F.lit(".example"))
    value = F.regexp_extract(found, SECRET, 2)
    hexes = F.substring(F.repeat(digest(key, F.lit("secret"), value), F.ceil(F.length(value) / 64).cast("int")), F.lit(1), F.length(value))
    secret = F.concat(F.regexp_extract(found, SECRET, 1), F.when(value == F.upper(value), F.upper(hexes)).otherwise(hexes), F.right(found, F.lit(1)))
    return (
        F.when(F.right(found, F.lit(1)).isin('"', "'"), secret)
        .when(found.contains("@"), mail)
        .when(found.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), address)
        .when(found.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$|^\d{2}\.\d{2}\.\d{4}$"), permuted_date(found, key))
        .when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), social)
        .when(found.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), phone)
        .otherwise(card)
    )


def permuted_social(digits: Column, key: str) -> Column:
    """Area 001 to 898 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 2).cast("long"), F.substring(digits, 6, 4).cast("long")
    at = area - 1 - (area > 666).cast("long")

    def number(left: Column, right: Column) -> Column:
        out = (left / 99).cast("long") + 1
        out = out + (out >= 666).cast("long")
        return F.concat(F.lpad(out.cast("string"), 3, "0"), F.lpad((left % 99 + 1).cast("string"), 2, "0"), F.lpad((right + 1).cast("string"), 4, "0"))

    return joined(feistel(at * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("social")), number)


def permuted_date(found: Column, key: str) -> Column:
    """A date of the years 1700 to 2099 becomes another of them in the same notation; others, and no dates, stay."""
    first = F.lit(FIRST_DAY).cast("date")

    def permuted(k: Column) -> Column:
        left, right = feistel((k / DAY_RADICES[1]).cast("long"), k % DAY_RADICES[1], F.lit(DAY_RADICES[0]), F.lit(DAY_RADICES[1]), key, F.lit("date"))
        return (left * DAY_RADICES[1] + right).cast("int")

    def walked(k: Column) -> Column:
        # of all dates, 39 % have a day up to 12: 64 steps miss the others with a chance of 1e-26
        out = F.aggregate(F.sequence(F.lit(1), F.lit(64)), k, lambda a, i: F.when((i == 1) | (F.day(F.date_add(first, a)) <= 12), permuted(a)).otherwise(a))
        return F.when(F.day(F.date_add(first, k)) > 12, out)

    out = found
    for pattern, like, move in (("MM/dd/yyyy", r"^\d{2}/", walked), ("dd.MM.yyyy", r"^\d{2}\.", permuted), ("dd/MM/yyyy", r"^\d{2}/", permuted), ("yyyy-MM-dd", r"^\d{4}-", permuted)):
        k = F.datediff(F.try_to_date(found, pattern), first)
        out = F.when(found.rlike(like) & k.between(0, DAY_RADICES[0] * DAY_RADICES[1] - 1), F.coalesce(F.date_format(F.date_add(first, move(k)), pattern), found)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, counts: str | None = None) -> DataFrame:
    """docs with pseudonyms in text; with ``counts``, a column of that name has the number of replacements."""
    found, new = (free_name(docs.columns, x) for x in ("found", "new"))
    none = F.array().cast("array<string>")
    out = docs.withColumn(found, F.when(F.col("text").rlike(SIGN), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(none))
    out = out.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda x: pseudonym(x, key))))
    pieces = F.split("text", PATTERN, -1)
    woven = F.array_join(F.zip_with(pieces, new, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    out = out.withColumn("text", F.when(F.col(new).isNotNull(), woven).otherwise(F.col("text")))
    if counts:
        out = out.withColumn(counts, F.coalesce(F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)), F.lit(0)))
        out = out.withColumn(counts, F.greatest(F.col(counts), F.lit(0)))
    return out.drop(found, new)
