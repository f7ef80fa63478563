"""Tables in order over many partitions: lineage cuts, free column names, and places of rows without a task that sees them all."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a partition of an ordered table gets.
ROWS_A_PART = 200_000
#: A row's number is its partition's number times this, plus its place in the partition.
PART_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode a temporary one does if that is unset; on a
    cluster it is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, which lost executors don't take along."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: A side of a join that has at most so many rows, counted before, is broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def facts(df: DataFrame) -> DataFrame:
    """``df`` settled, and broadcast where it is small: for facts of groups that are joined to the groups' rows."""
    return small(settled(df))


def free(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column in ``taken`` has it (names are compared as Spark does)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """``free`` of each name for a column to be added to ``df``."""
    return tuple(free(n, df.columns) for n in names)


def in_order(df: DataFrame, keys: list[str], number: str, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, settled, with ``number``: whole numbers that grow in that order, though not
    by one (partition and place, see PART_BITS). The order of rows with equal keys is any, but stays."""
    parts = max(1, -(-df.count() // rows_a_part))
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return settled(ordered.withColumn(number, F.monotonically_increasing_id()))


def part_of(number: str) -> Column:
    return F.shiftright(number, PART_BITS).cast("int")


def starts(ordered: DataFrame, part: str, by: list[str], size: Column, name: str) -> DataFrame:
    """by, part and ``name``: what ``size`` adds up to in all earlier partitions. A row for each partition (and ``by``), so the
    sums over them in order are small."""
    sums = ordered.groupBy(*by, part).agg(size.alias("n"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))
