"""Connected components of a link table, by alternating stars; no link or label leaves the executors."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: links that one partition contracts, and nodes that it holds at a time
PART_LINKS, MOST_NODES = 500_000, 2_000_000


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder that spark.checkpoint.dir names.

    Where the session names none, a local session (as in tests) gets a folder of its own, and a cluster an error: its
    executors would not share that folder.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) of a partition as stars: each node that isn't its part's least, with the least one it reaches here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(y, y)
        return x

    def stars() -> pd.DataFrame:
        found = [(x, root(x)) for x in parent]
        return pd.DataFrame([p for p in found if p[0] != p[1]], columns=["u", "v"], dtype=np.int64)

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > MOST_NODES:
            yield stars()
            parent.clear()
    yield stars()


def components(links: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """(node, component) of every node that has a link to another; component is its smallest reachable node.

    links has long columns a and b.  First each partition, of about ``part_links`` links, turns its links into stars by
    itself.  With several partitions, alternating stars follow: each round lets every node point its larger neighbours at
    its smallest neighbour, then its smaller ones; the rounds needed grow with the logarithm of a component's size.
    """
    links = cut(links.where("a <> b"))
    parts = max(1, -(-links.count() // part_links))
    now = cut(links.select("a", "b").coalesce(parts).mapInPandas(contracted, "u long, v long"))
    # one partition that never had to forget: its stars are the components
    if parts == 1 and now.count() <= MOST_NODES // 2:
        return ends(now)
    state = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == state or not sums[0]:
            return ends(now)
        state = sums
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def ends(stars: DataFrame) -> DataFrame:
    """(node, component) of both ends of stars (u, v), each node once."""
    return stars.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("component")).groupBy("node").agg(F.min("component").alias("component"))
