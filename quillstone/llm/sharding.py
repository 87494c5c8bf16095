"""Sharding by a hierarchical weighted hash tree (operator 10), with DataFrame functions only.

A row descends region, rack and shard: at each level every child draws ``-ln(u) / weight`` with u hashed from the row's
id and the child's name, and the smallest draw wins.  A child's draw depends on nothing but the id, the name and the
child's weight, so a change of weights moves rows only into or out of the subtrees whose weights change.  A shard beyond
the base tree is a region of its own: it takes rows only into itself.

Defined results: a null text has no bytes and checksum 0; rows of the same doc_id fall into the same shard; a row whose
doc_id is null is placed by the text "null"; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, RACKS_PER_REGION, SHARDS_PER_RACK = 24, 4, 2
SEED = "quill"
#: numbering blocks of a shard: at least so many, and one for each so many rows of the table
NUMBERING_BLOCKS, BLOCK_ROWS = 64, 4_000_000

#: children of each node, in order, by the node's path ("" is the root); a leaf's path is in no key
Tree = dict[str, list[tuple[str, float]]]


def shard_tree(shards: int, base: int = SHARDS) -> tuple[Tree, dict[str, int]]:
    """Regions of racks of shards of weight 1, those beyond the base as regions with one shard; and each leaf's shard."""
    leaves = {}
    for s in range(shards):
        region = f"g{s // (RACKS_PER_REGION * SHARDS_PER_RACK)}" if s < base else f"x{s}"
        leaves[f"/{region}/r{s // SHARDS_PER_RACK if s < base else 0}/s{s}"] = s
    weights: dict[str, dict[str, float]] = {}
    for leaf in leaves:
        parts = leaf.split("/")
        for n in range(1, len(parts)):
            children = weights.setdefault("/".join(parts[:n]), {})
            children["/".join(parts[: n + 1])] = children.get("/".join(parts[: n + 1]), 0.0) + 1.0
    return {node: list(children.items()) for node, children in weights.items()}, leaves


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for item in table.items() for x in item)), key)


def descend(df: DataFrame, key: Column, tree: Tree, leaves: dict[str, int], out: str) -> DataFrame:
    """df with the shard that each row reaches, level by level: one set of draws a level, over the node's children.

    A draw's uniform number is the upper 52 bits of a hash, and a half, so that it lies inside (0, 1).
    """
    df = df.withColumn(out, F.lit(""))
    for level in range(3):
        nodes = {node: children for node, children in tree.items() if node.count("/") == level}
        draws = []
        for k in range(max(map(len, nodes.values()))):
            name = lookup({n: c[k][0] for n, c in nodes.items() if k < len(c)}, F.col(out))
            weight = lookup({n: c[k][1] for n, c in nodes.items() if k < len(c)}, F.col(out))
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(SEED), name), 12).cast("double")
            draws.append(F.struct((-F.log((bits + 0.5) / float(2**52)) / weight).alias("draw"), name.alias("name")))
        df = df.withColumn(out, F.array_min(F.filter(F.array(*draws), lambda d: d["draw"].isNotNull()))["name"])
    return df.withColumn(out, lookup(leaves, F.col(out)).cast("int"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, blocks: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots number a shard's rows without gaps.  Rows are counted by (shard, block of ids), the counts' running sums give
    each block its first slot, and rows are numbered within blocks, whose number grows with the table: no task holds a shard.
    """
    blocks = blocks or max(NUMBERING_BLOCKS, docs.count() // BLOCK_ROWS)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    # the text too, so that the rows of one id, or of none, are not one block
    placed = placed.withColumn("block", F.pmod(F.xxhash64(key, F.col("text_crc32"), F.lit("block")), F.lit(blocks)).cast("int"))
    placed = descend(placed, key, *shard_tree(shards), "shard")
    placed = descend(placed, key, *shard_tree(shards + 1), "grown_shard")
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x blocks rows, whatever the table's size
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("inside", F.row_number().over(inside))
    return numbered.join(F.broadcast(first), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first_slot") + F.col("inside") - 1).cast("long").alias("slot"), "grown_shard",
    )
