"""Given tables seen as traces. Canonical form: one row a trace with ascending ``x`` and its ``y``; ``points`` is the long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its input has fewer partitions than there are; else as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, some partitions a core: for narrow tables whose rows take long, as a file may lie in one partition."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def points(traces: DataFrame) -> DataFrame:
    """One row for each sample: trace_id, i, x, y."""
    return traces.select("trace_id", F.posexplode(F.arrays_zip("x", "y")).alias("i", "s")).select("trace_id", "i", "s.x", "s.y")


def traces(points: DataFrame) -> DataFrame:
    """Traces from (trace_id, x, y) rows: samples without a finite x or y are dropped, the others sorted by x, then y.

    The only shuffle of a pipeline that starts from rows. A trace is one row, so it has to fit a task.
    """
    usable = ~(F.isnull("x") | F.isnull("y") | F.isnan("x") | F.isnan("y"))
    samples = F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    out = points.filter(usable).groupBy("trace_id").agg(samples.alias("s"))
    return out.select("trace_id", F.transform("s", lambda v: v["x"]).alias("x"), F.transform("s", lambda v: v["y"]).alias("y"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a trace over its positions."""
    y = F.transform("embedding", lambda v: v.cast("double"))
    return spread(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("trace_id"), F.transform("embedding", lambda v, i: i.cast("double")).alias("x"), y.alias("y")
    )


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of their user's trace over minutes since the start of 2024."""
    minutes = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 60e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), minutes.alias("x"), F.col("value").alias("y"), "event_type", "event_id")


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue a day (x: days since 1992-01-01) as a trace for each return flag."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("double")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("trace_id"), day.alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(20,4)").alias("y"))
    return traces(line.groupBy("trace_id", "x").agg(F.sum("y").cast("double").alias("y")))
