"""Helpers that the corpus operators share: table access, lineage cuts and skew-safe joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
#: A group is hot when it holds more than 1/HEAVY of all rows, so fewer than HEAVY groups are hot.
HEAVY = 512


#: What tasks of an operator leave in a Python worker for the next ones, by operator.
HELD: dict[str, dict] = {}


def release(but: str = "") -> None:
    """Empties what other operators' tasks have left in this Python worker."""
    for name, held in HELD.items():
        if name != but:
            held.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Also bounds the bytes of the Arrow batches that Python tasks get at once."""
    if spark.conf.get(BATCH_CONF).startswith(str((1 << 31) - 1)):  # nobody has set it
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column in ``taken`` has it (names are compared as Spark does)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local
    mode, where there is one machine; on a cluster an error, as executors don't see the driver's folders."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
        current = sc._jsc.sc().getCheckpointDir()
    return spark.conf.get("spark.checkpoint.dir", None) or current.get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that later jobs and lost executors reread it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of all ``keys``."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def attach(rows: DataFrame, facts: DataFrame, key: str, size: str, least: int = 0) -> DataFrame:
    """``rows`` left joined with ``facts``, which has one row for each non-null ``key`` and its row count ``size``.

    Facts of hot groups are broadcast (fewer than HEAVY rows by the definition of hot), so a hot key's rows stay
    where they are; all other rows are shuffled by key. Rows whose key has no facts get nulls.
    A group of at most ``least`` rows isn't hot, whatever its share. Both inputs should be settled: they are read twice
    where there are hot groups.
    """
    total, most = facts.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if most <= least or most * HEAVY <= total:
        return rows.join(facts, key, "left")
    is_hot = (F.col(size) * HEAVY > total) & (F.col(size) > least)
    hot, rest = facts.filter(is_hot), facts.filter(~is_hot)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return near.unionByName(far)


#: Keys that are broadcast at most, counted before; more are shuffled.
SMALL_ROWS = 200_000


def small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else keys


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose ``on`` values aren't in ``keys``, which should be settled (it is counted); nulls equal nulls.
    Few keys are broadcast, so the rows stay where they are."""
    return rows.join(small(keys), same(rows, keys, on), "left_anti")


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose ``on`` values are in ``keys``; otherwise as ``without``."""
    return rows.join(small(keys), same(rows, keys, on), "left_semi")
