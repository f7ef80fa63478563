"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Two 64-bit fingerprints that differ in at most 3 bits agree on at least one of four 16-bit segments, and of the other
48 bits one half (24 bits) has at most one error. The agreed segment is a key as it is; 23 bits of the half are keyed by
the perfect binary Golay code: one side by the codeword nearest to the half, the other by all codewords nearest to the
half or to a half one error away (one codeword or six). Candidates meet in an equi-join on these keys (28 bits and the
table's number), are verified on all 64 bits, and linked fingerprints are gathered into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY, among, attach, free, release, settled, table, text_of, without

SHINGLE = 3
SEED = 42
DISTANCE = 3


# Fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is 1 if set in over half of its shingles' hashes, repeats counted."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):  # so that a very long text takes bounded memory
        to = min(n, at + (1 << 16))
        parts = [joined[s:e] for s, e in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())]
        hashes = np.fromiter(map(digest, parts, repeat(SEED)), np.uint64, to - at)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=[id_col, "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col)).mapInArrow(compute, f"`{id_col}` {id_type}, fp long")


# The Golay code

#: Fixed value: the generator polynomial of the binary Golay code of length 23, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


def _remainder(v: int) -> int:
    for k in range(22, 10, -1):
        if v >> k & 1:
            v ^= GENERATOR << (k - 11)
    return v


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte at each of three places, and the error pattern of each syndrome."""
    syndromes = np.array([[_remainder(b << (8 * place)) if b << (8 * place) < 1 << 23 else 0 for b in range(256)] for place in range(3)], np.uint32)
    errors = np.zeros(1 << 11, np.uint32)
    for r in range(1, 4):
        for bits in combinations(range(23), r):
            e = sum(1 << b for b in bits)
            errors[_remainder(e)] = e
    return syndromes, errors


def nearest(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one codeword within 3 bits of each 23-bit value."""
    syndromes, errors = _tables()
    s = syndromes[0][v & 255] ^ syndromes[1][v >> 8 & 255] ^ syndromes[2][v >> 16]
    return (v ^ errors[s]) >> 11


def segments(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(table number, exact 16-bit segment, 23 bits of one half of the rest) for the eight tables."""
    blocks = [(fp >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.uint64) for i in range(4)]
    for i in range(4):
        a, b, c = (blocks[j] for j in range(4) if j != i)
        rest = a | b << np.uint64(16) | c << np.uint64(32)
        for half in range(2):
            yield 2 * i + half, blocks[i], (rest >> np.uint64(24 * half) & np.uint64((1 << 23) - 1)).astype(np.uint32)


def _key(number: int, exact: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (number << 28 | exact.astype(np.int64) << 12 | code.astype(np.int64)).astype(np.int64)


def index_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): eight keys for each fingerprint."""
    rows = np.arange(len(fp))
    keys = [_key(number, exact, nearest(half)) for number, exact, half in segments(fp)]
    return np.tile(rows, len(keys)), np.concatenate(keys)


def probe_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys under which any fingerprint within 3 bits is indexed in at least one table."""
    flips = np.array([0, *(1 << b for b in range(23))], np.uint32)
    rows, keys = [], []
    for number, exact, half in segments(fp):
        codes = np.sort(nearest(half[:, None] ^ flips[None, :]), axis=1)
        new = np.ones(codes.shape, bool)
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(_key(number, exact[r], codes[r, c]))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(distinct: DataFrame, keys) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 8192):
                part = fps[at : at + 8192]
                row, key = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(part[row].view(np.int64)), pa.array(key)], names=["fp", "key"])

    return distinct.select("fp").mapInArrow(spread, "fp long, key long")


#: Nodes with at most so many neighbours are joined as they are.
FEW = 10_000
#: Keys with more indexed fingerprints than this aren't joined; their fingerprints are linked by ``clustered_links``.
FULL = 1000
#: All vectors within two bits of zero, nearest first (1, 64 and 2016 of them).
BALL = np.array([0, *(1 << b for b in range(64)), *(1 << a | 1 << b for a, b in combinations(range(64), 2))], np.uint64)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in ``fp`` that differ in at most 3 bits: enough of them that whatever
    such pairs connect, they connect. All pairs, unless very many fingerprints share a key."""
    probes, index = _keyed(distinct, probe_keys), _keyed(distinct, index_keys)
    full = settled(index.groupBy("key").count().filter(F.col("count") > FULL).select("key"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    a, b = probes.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    if full.isEmpty():
        return a.join(b, (a["key"] == b["key"]) & close).select("a", "b").distinct()
    a, b = without(a, full, ["key"]), without(b, full, ["key"])
    pairs = a.join(b, (a["key"] == b["key"]) & close).select("a", "b")
    crowd = among(probes, full, ["key"]).select("fp").union(among(index, full, ["key"]).select("fp")).distinct()
    return pairs.union(clustered_links(settled(crowd))).distinct()


def clustered_links(crowd: DataFrame) -> DataFrame:
    """Pairs (a, b) at most 3 bits apart that connect all such pairs of distinct fingerprints, without meeting every pair.

    Two fingerprints are at most 3 bits apart exactly if some vector is at most 1 bit from one and 2 from the other. Each
    is sent to all vectors within 2 bits; where one arrives from within 1 bit, it is linked to all that arrive there.
    Work and links grow with the number of fingerprints (2081 for each), and a vector has at most 2081 arrivals.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = pa.array(np.repeat([True, False], [65, len(BALL) - 65]))
        for batch in batches:
            for f in batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
                at = (f ^ BALL).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(BALL), f).view(np.int64)), near], names=["at", "fp", "near"])

    sent = crowd.select("fp").mapInArrow(spread, "at long, fp long, near boolean")
    met = sent.groupBy("at").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("all")).filter("a is not null and size(all) > 1")
    return met.select("a", F.explode("all").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


# Components


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every node of ``edges`` (a, b): root is the component's smallest node.

    Alternates large-star and small-star steps: each hooks a node's neighbours to the smallest of them, which shortens
    all paths at once, and ends when a round changes nothing. Minima are aggregated map-side before they are joined, and
    those of hot nodes (the root of a giant component has all its nodes as neighbours) are broadcast, so no node's
    neighbours beyond FEW are gathered in one place.
    """
    edges = settled(edges.select("a", "b"))
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = settled(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m")))
        large = attach(both, low, "a", "n", FEW).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = settled(large)
        # small star: of the smaller neighbours of each node, the smallest takes the others and the node itself
        low = settled(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = attach(large, low, "a", "n", FEW).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settled(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        state = now


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, *carry: str) -> DataFrame:
    """id, fp and component_id of each row of ``docs``, and ``carry``: ``best`` names its component's row that stays."""
    rows = settled(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))).alias("first")
    classes = settled(rows.groupBy("fp").agg(F.count("*").alias("n_rows"), first))
    roots = components(links(classes))
    labelled = settled(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    best = F.min(F.struct("first.none", "first.id", "fp")).alias("best")
    firsts = settled(labelled.groupBy("root").agg(best, F.count("*").alias("n_classes")))
    facts = settled(attach(labelled.select("root", "fp", "n_rows"), firsts, "root", "n_classes").select("fp", "n_rows", "best"))
    return attach(rows, facts, "fp", "n_rows").select(id_col, "fp", F.col("best.id").alias("component_id"), *carry)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: id, fp (signed long), component_id.

    component_id is the smallest id among all rows reachable over links (equal fingerprints, or 3 bits apart at most),
    nulls aside; it is null where all those ids are. Texts without a word have fingerprint zero and link like any other.
    Repeated rows get a row each. Other columns are not read. An empty table gives an empty result.
    """
    return _labelled(docs, id_col, text_col, shingle)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component (that with the smallest id, nulls last), all columns unchanged.

    Rows that go are named by their ids; while these are few they are broadcast, so that no text is shuffled. Ids that
    several rows share, and null ones, don't name a row: those rows are told apart by their fingerprints.
    """

    @F.arrow_udf("long")
    def fp_of(texts: pa.Array) -> pa.Array:
        found = (fingerprint(t.as_py() or b"", shingle) for t in texts.cast(pa.binary()))
        return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    names, fp = docs.columns, free("fp", docs.columns)
    rows = settled(_labelled(docs, id_col, text_col, shingle, "best"))
    null = F.col(id_col).isNull()
    stays = F.col(id_col).eqNullSafe(F.col("best.id")) & (F.col("fp") == F.col("best.fp"))
    counted = rows.filter(~null).groupBy(id_col).agg(F.count("*").alias("n"), F.max(stays).alias("stays"))
    counted = settled(counted.filter("n > 1 or not stays"))
    shared = counted.filter("n > 1")
    # hot ids (fewer than HEAVY) are compared one by one, so that their rows aren't gathered by a join
    total = rows.count()
    hot = [r[0] for r in shared.filter(F.col("n") * HEAVY > total).select(id_col).collect()]
    out = without(docs.filter(~null), settled(counted.select(id_col)), [id_col]).select(*names)
    some_null = not rows.filter(null).isEmpty()
    if not some_null and shared.isEmpty():
        return out
    is_hot = null | F.col(id_col).isin(hot)
    several = docs.filter(is_hot).unionByName(among(docs.filter(~is_hot), settled(shared.select(id_col)), [id_col]).select(*names))
    stay = settled(rows.filter(stays).select(id_col, F.col("fp").alias(fp)).distinct())
    several = several.withColumn(fp, fp_of(text_of(text_col))).dropDuplicates([id_col, fp])
    return out.unionByName(among(several, stay, [id_col, fp]).select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
