"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries name the digests that may be frequent, an exact count verifies them, and the winners (fewer than
``k``) are broadcast: their rows are decided where they lie, without a shuffle. All other digests are aggregated and
joined by an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, free, settled, table, text_of, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Misra-Gries counters for each partition, and the most digests that are broadcast.
K = 512


def merge_counts(held: dict, more: dict, k: int) -> dict:
    """Misra-Gries merge: add the counters, then take the (k+1)-th largest from all and drop what isn't positive."""
    for key, n in more.items():
        held[key] = held.get(key, 0) + n
    if len(held) > k:
        cut = sorted(held.values(), reverse=True)[k]
        held = {key: n - cut for key, n in held.items() if n > cut}
    return held


def frequent(digests: DataFrame, column: str, k: int = K) -> DataFrame:
    """At most ``k`` candidate values of ``column``; every value with at least 2/k of all rows is among them."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            counts = batch.column(0).value_counts()
            held = merge_counts(held, dict(zip(counts.field(0).to_pylist(), counts.field(1).to_pylist())), k)
        held.pop(None, None)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=[column, "low"])

    found = digests.select(column).mapInArrow(summarise, f"{column} binary, low long")
    return found.groupBy(column).agg(F.sum("low").alias("low")).orderBy(F.desc("low"), column).limit(k).select(column)


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.translate(text_of(text_col), UPPER, LOWER), 256))


def _decided(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions on the rows of frequent digests and on all others (id, digest, row_id, group_size, best), and the
    frequent digests with their winners."""
    rows = settled(docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row_id")))
    best = F.max(F.struct("id", "row_id")).alias("best")
    total = rows.count()
    candidates = frequent(rows, "digest", k)
    counted = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), best)
    hot = settled(counted.filter(F.col("group_size") * k >= 2 * total).limit(k))
    near = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    return near, rest.join(rest.groupBy("digest").agg(F.count("*").alias("group_size"), best), "digest"), hot


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One decision for each row of ``docs``: id, keep_id, group_size, kept, text_sha256, row_id.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays
    (a null id is smaller than all others). Of repeated rows with that same id and text, one stays. ``row_id`` is unique.
    Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    near, far, _ = _decided(docs, id_col, text_col, k)
    return near.unionByName(far).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_id",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """``docs`` with one row of each group of equal texts (see exact_dedup), all columns unchanged.

    Rows of frequent digests go where they lie, by the broadcast winners. Of the others, those that go are named by id and
    digest; while these are few they are broadcast as well, so that no text is shuffled.
    """
    near, far, hot = _decided(docs, id_col, text_col, k)
    names, digest, winner = docs.columns, free("digest", docs.columns), free("winner", docs.columns)
    losers = (F.col("row_id") != F.col("best.row_id")), F.col("id").eqNullSafe(F.col("best.id"))
    key = [F.col("id").alias(id_col), F.col("digest").alias(digest)]
    gone = settled(far.filter(losers[0] & ~losers[1]).select(*key).distinct())
    # a loser with its winner's id is a repeated row: of such rows, which are rare, one stays
    repeated = settled(near.unionByName(far).filter(losers[0] & losers[1]).select(*key).distinct())
    won = hot.select(F.col("digest").alias(digest), F.struct(F.col("best.id").alias("id")).alias(winner))
    marked = docs.withColumn(digest, _digest(text_col)).join(F.broadcast(won), digest, "left")
    marked = marked.filter(F.col(winner).isNull() | F.col(id_col).eqNullSafe(F.col(f"{winner}.id")))
    out = without(marked, gone, [id_col, digest])
    if repeated.isEmpty():
        return out.select(*names)
    several = among(marked, repeated, [id_col, digest]).dropDuplicates([id_col, digest])
    return without(out, repeated, [id_col, digest]).select(*names).unionByName(several.select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row_id")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
