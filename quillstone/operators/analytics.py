"""Usage analytics and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER_CLUSTER = "lain-lain"


def usage_report(log: DataFrame) -> DataFrame:
    """The log without users, times rounded down to the hour."""
    hour = F.date_trunc("hour", F.col("created_at")).cast("timestamp_ntz")
    return log.select("id", hour.alias("hour"), "query", "topic", "cluster", "answerable", "confidence", F.col("doc_ref").alias("excluded"))


#: mark of a usage report, and the fields of a search that one may hold; fixed values
REPORT_KIND = "pekeliling-navigator-usage"
REPORT_FIELDS = ("query", "topic", "cluster", "answerable", "confidence", "excluded_circulars", "feedback", "hour")


def imported_reports(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What uploaded reports (id, text) come to: (id, ok, n_queries), and their searches (id, place, search).

    A report is an object of the right kind with a list of searches.  Entries that are no objects are left out, and of the
    others all fields but the known ones; a search is a map of the known fields to their JSON, so nothing of a user stays.
    """
    outer = F.from_json("text", "kind string, queries string")
    listed = F.when(outer["queries"].startswith("["), F.from_json(outer["queries"], "array<string>"))
    rows = texts.select("id", F.when(outer["kind"] == REPORT_KIND, listed).alias("q"))
    inside = F.filter("q", lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull())
    known = lambda x: F.map_filter(F.from_json(x, "map<string,string>"), lambda k, v: k.isin(*REPORT_FIELDS))
    searches = rows.select("id", F.posexplode(F.transform(inside, known)).alias("place", "search"))
    return rows.select("id", F.col("q").isNotNull().alias("ok"), F.coalesce(F.size(inside), F.lit(0)).alias("n_queries")), searches


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 3)).otherwise(0.0)


def by_cluster(report: DataFrame) -> DataFrame:
    cluster = F.coalesce(F.nullif(F.col("cluster"), F.lit("")), F.lit(OTHER_CLUSTER))
    counts = report.groupBy(cluster.alias("cluster")).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("answerable")).alias("unanswered"))
    return counts.withColumn("rate", rate(F.col("unanswered"), F.col("total")))


def most_common(report: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, those seen first before others of the same count."""
    counts = report.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("seen"))
    return counts.orderBy(F.desc("n"), "seen").limit(k).select("value", "n")


def nearest_rank(df: DataFrame, column: str, shares: tuple[float, ...], buckets: int = 1000, most: int = 100_000) -> DataFrame:
    """Percentiles by index round(q (n - 1)), half to even, exactly.

    For each share, histograms of equal widths narrow the range in which the wanted rank lies, each between the least and
    the largest value of the bucket before, so that outliers and crowded values are parted; a range of at most ``most``
    rows, or of one value, decides.
    """
    spark = df.sparkSession
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")).where(~F.isnan("v"))
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    found = []
    for q in shares if n else ():
        at, a, b, size = round(q * (n - 1)), low, high, n
        while size > most and a < b:
            width = (b - a) / buckets
            here = rows.where(F.col("v").between(a, b)).withColumn("k", F.least(F.floor((F.col("v") - a) / width), F.lit(buckets - 1)))
            # at most ``buckets`` rows
            for _, least, largest, count in sorted(tuple(r) for r in here.groupBy("k").agg(F.min("v"), F.max("v"), F.count(F.lit(1))).collect()):
                if at < count:
                    a, b, size = least, largest, count
                    break
                at -= count
        value = a if a == b else rows.where(F.col("v").between(a, b)).orderBy("v").offset(at).limit(1).first()[0]
        found.append((float(q), float(value)))
    return spark.createDataFrame(found, "q double, value double")
