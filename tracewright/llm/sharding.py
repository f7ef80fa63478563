"""Sharding by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and weighted shards. A row descends it: at each level every child draws
-ln(u) / weight, u a hash of the row's key and the child's name, and the smallest draw wins. A change of weights moves
rows only into or out of the subtrees whose weights change. A shard added to a tree enters as a region of its own, so
nothing but rows bound for it moves, however many shards the tree began with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, table, text_of

#: {region: {rack: {shard: weight}}}
Topology = dict[str, dict[str, dict[int, float]]]


def topology(shards: int, base: int = 16, racks: int = 4, rack_size: int = 4) -> Topology:
    """The standard tree: the ``base`` shards that it began with in racks of ``rack_size``, ``racks`` // 2 racks a region; each
    later shard is a region of its own. With the same ``base``, and at least so many shards, growth by one shard moves rows
    only into it."""
    tree: Topology = {}
    for shard in range(shards):
        rack = shard // rack_size
        region, name = (f"region{rack // max(racks // 2, 1)}", f"rack{rack}") if shard < base else (f"added{shard}", f"rack-{shard}")
        tree.setdefault(region, {}).setdefault(name, {})[shard] = 1.0
    return tree


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of rate ``weight`` from 52 bits of the hash of key and name."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(unit) / F.lit(weight)


def place(key: Column, tree: Topology) -> Column:
    """The shard of ``key`` (a null key has a place too). Only built-in functions: it runs inside generated code."""

    def descend(node, path: str) -> Column:
        if not isinstance(node, dict):
            raise TypeError(node)
        children = sorted((c for c in node if _weight(node[c]) > 0), key=str)
        down = {c: descend(node[c], f"{path}/{c}") if isinstance(node[c], dict) else F.lit(int(c)) for c in children}
        if len(children) == 1:
            return down[children[0]]
        draws = F.array(*[F.struct(_draw(key, f"{path}/{c}", _weight(node[c])).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(children)])
        best = F.array_min(draws)["i"]
        out = down[children[-1]]
        for i, c in reversed(list(enumerate(children[:-1]))):
            out = F.when(best == i, down[c]).otherwise(out)
        return out

    return descend(tree, "")


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", base: int | None = None) -> DataFrame:
    """Each row's shard and its slot there: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 that of the text (null: empty). Only the id decides,
    so rows with equal ids share a shard; a null id is one more id. ``base`` is the number of shards that the tree began
    with (16, or ``shards`` if that is less), and must stay the same as shards are added; ValueError if it is above
    ``shards``. Slots count from 0 without gaps in every shard;
    they are numbered in chunks (input partition by shard), whose starts are running sums of their sizes, so that no
    task holds a whole shard: which slots rows of one shard get depends on the input's partitions, and among rows with equal ids
    on their order there. Other columns are not read. An empty table gives an empty result.
    """
    base = min(shards, 16) if base is None else base
    if not 1 <= base <= shards:
        raise ValueError("a tree begins with 1 shard at least and at most as many as it has")
    tree, grown = topology(shards, base), topology(shards + 1, base)
    key = F.col(id_col).cast("string")
    rows = settled(
        docs.select(
            F.col(id_col),
            (F.octet_length(text_of(text_col)) + 1).cast("long").alias("size"),
            F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
            place(key, tree).alias("shard"),
            place(key, grown).alias("grown_shard"),
            F.spark_partition_id().alias("chunk"),
        )
    )
    sizes = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(id_col)) - 1
    return (
        rows.withColumn("local", local)
        .join(starts, ["shard", "chunk"])
        .select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("local")).alias("slot"), "grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
