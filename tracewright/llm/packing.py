"""Best-fit packing of tokenised documents by exact-complement hashing.

Every document becomes pieces of at most ``capacity`` tokens. The plan needs only how many pieces there are of each
length (``capacity`` counters, however large the corpus): lengths are taken from the largest down; sums of one, two and
three remaining lengths are indexed, and combinations that fill a sequence exactly are consumed in bulk, as often as
their counts allow; what stays over is packed best-fit. Pieces then find their slot by their rank within their length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HELD, release, settled, table

CAPACITY = 4096
END_ID = 1
#: Words whose ids a task remembers; as many again stay from before.
CACHE_WORDS = 250_000


#: Texts that a tokenizer must treat word by word, on its loading, to be used so.
PROBES = ("Two words, and  more.\nA line\tafter 12,5 x.y (z)", " it's DON'T |bar| a|b ", "Été ß 日本。 e\u0301 \u00a0x", "<|endoftext|> <| A<|endoftext|>B", "")


class WordEncoder:
    """Token ids of whole texts, word by word, with remembered words.

    For a tokenizer that lower-cases, drops white space and never joins across it, the ids of a text are those of its
    parts between blanks; words are encoded many at a time, parted by a separator word whose id is known. Whether the
    tokenizer is of this kind is tried on PROBES; texts are encoded whole for any other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.bar, self.by_words = bar[0] if bar else -1, len(bar) == 1
        if self.by_words:
            ids = self.encode([p.encode() for p in PROBES])
            self.by_words = all(i == self._alone(p.encode()) for i, p in zip(ids, PROBES))

    def _alone(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        got = {w: self._alone(w) for w in words if b"|" in w}
        rest = [w for w in words if b"|" not in w]
        groups = [rest[i : i + 1000] for i in range(0, len(rest), 1000)]
        texts = [" | ".join(w.decode("utf-8", "replace") for w in g) for g in groups]
        for group, out in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(out.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.bar).tolist(), len(ids)]
            if len(ends) != len(group):
                got |= {w: self._alone(w) for w in group}
                continue
            data, start = ids.tobytes(), 0
            for w, end in zip(group, ends):
                got[w] = data[4 * start : 4 * end]
                start = end + 1
        return got

    def prepare(self, words: set[bytes]) -> None:
        """Makes sure that ``young`` has all ``words``."""
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {b"": b""}, self.young
        young, old = self.young, self.old
        unknown = words.difference(young)
        again = {w for w in unknown if w in old}
        young.update((w, old[w]) for w in again)
        missing = unknown - again
        # a letter and one full stop or comma at the end of a word are parted by the tokenizer anyway
        cut = {w: (w[:-1], w[-1:]) for w in missing if w.endswith((b".", b",")) and w[-2:-1].isalpha() and b"<|" not in w}
        parts = {p for pair in cut.values() for p in pair}
        parts.update(w for w in missing if w not in cut)
        got = self._learn([p for p in parts if p not in young])
        young.update(got)
        for w, (a, b) in cut.items():
            young[w] = young[a] + young[b]

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        """The parts between blanks and line ends, A-Z lower-cased save next to what may be a special token."""
        if b"<|" in text:
            return [w if b"<|" in w else w.lower() for w in text.replace(b"\n", b" ").split(b" ")]
        return text.lower().replace(b"\n", b" ").split(b" ")

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts, held = [], 0
        if not self.by_words:
            yield from map(self._alone, texts)
            return
        for text in texts:
            parts.append(self.split(text))
            held += len(text)
            if held > 1 << 20:
                yield from self._flush(parts)
                parts, held = [], 0
        yield from self._flush(parts)

    def _flush(self, parts: list[list[bytes]]) -> Iterator[bytes]:
        self.prepare(set().union(*parts))
        ids = self.young.__getitem__
        for words in parts:
            yield b"".join(map(ids, words))


_ENCODERS: dict[str, WordEncoder] = HELD.setdefault("packing", {})


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, with their partition (chunk) and their rank there among pieces of their length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("packing")
        encoder = word_encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        chunk = TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            at, piece, start, length, crc, rank, held = [], [], [], [], [], [], []
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for i, ids in enumerate(encoder.encode(texts)):
                ids += end
                view, n = memoryview(ids), len(ids) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - s)
                    part = view[4 * s : 4 * (s + size)]
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    rank.append(int(seen[size]))
                    seen[size] += 1
                    if with_ids:
                        held.append(bytes(part))
            columns = [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array([chunk] * len(at), pa.int32()),
                pa.array(rank, pa.int64()),
            ]
            names = [id_col, "piece", "start", "length", "ids_crc32", "chunk", "rank"]
            if with_ids:
                columns.append(pa.array(held, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, chunk int, rank long"
    return docs.select(id_col, text_col).mapInArrow(cut, schema + ", ids binary" * with_ids)


class _Available:
    """Counts of pieces by length, and hashed sums of one, two and three lengths.

    ``pairs`` and ``triples`` map a sum to the smallest members of the combinations that have it; a sum's entry is made
    from the lengths at hand when a gap first asks for it. Counts only fall, so a combination that has run out is taken
    from its entry for good, and each is looked at once or as often as it is consumed.
    """

    def __init__(self, counts: np.ndarray):
        self.n = counts
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def times(self, parts: tuple[int, ...]) -> int:
        """How often counts allow this combination."""
        return min(int(self.n[a]) // parts.count(a) for a in parts)

    def take(self, parts: tuple[int, ...], m: int) -> None:
        for a in parts:
            self.n[a] -= m

    def _pair(self, total: int, with_: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths that sum to ``total`` and are at hand beside ``with_``."""
        if total not in self.pairs:
            low = np.arange(1, total // 2 + 1)
            self.pairs[total] = low[(self.n[low] > 0) & (self.n[total - low] > 0)].tolist()
        entry = self.pairs[total]
        for k in range(len(entry) - 1, -1, -1):
            pair = (entry[k], total - entry[k])
            if not self.times(pair):
                del entry[k]
            elif self.times((*with_, *pair)):
                return pair
        return None

    def exact(self, length: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths at hand, beside ``length``, that sum to ``gap``."""
        if self.n[gap] and self.times((length, gap)):
            return (gap,)
        if pair := self._pair(gap, (length,)):
            return pair
        if gap not in self.triples:
            low = np.arange(1, gap // 3 + 1)
            self.triples[gap] = low[self.n[low] > 0].tolist()
        entry = self.triples[gap]
        for k in range(len(entry) - 1, -1, -1):
            a = entry[k]
            if not self.n[a]:
                del entry[k]
            elif pair := self._pair(gap - a, (length, a)):
                return (a, *pair)
            elif not self._pair(gap - a, (a,)):
                del entry[k]
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, how many such sequences) that hold all pieces counted by length."""
    n = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        n[length] = count
    patterns: list[tuple[tuple[int, ...], int]] = []
    if n[capacity]:
        patterns.append(((capacity,), int(n[capacity])))
        n[capacity] = 0
    over: list[tuple[int, int]] = []
    at_hand = _Available(n)
    for length in range(capacity - 1, 0, -1):
        while n[length] and (parts := at_hand.exact(length, capacity - length)):
            pattern = (length, *parts)
            m = at_hand.times(pattern)
            at_hand.take(pattern, m)
            patterns.append((pattern, m))
        if n[length]:
            over.append((length, int(n[length])))
            n[length] = 0
    return patterns + best_fit(over, capacity)


def best_fit(counts: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over (length, count) pairs, longest first, many equal sequences at a time."""
    gaps: list[int] = []
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], m: int, gap: int) -> None:
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((pattern, m))

    for length, n in counts:
        while n:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                each = min(capacity // length, n)
                m = n // each
                put((length,) * each, m, capacity - each * length)
                n -= m * each
                continue
            gap = gaps[k]
            pattern, m = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
                gaps.pop(k)
            used = min(m, n)
            if m > used:
                put(pattern, m - used, gap)
            put((*pattern, length), used, gap - length)
            n -= used
    return [x for held in bins.values() for x in held]


def slots(patterns: list[tuple[tuple[int, ...], int]], counts: dict[int, int]) -> tuple[dict[int, int], np.ndarray]:
    """Where pieces go. Slots are numbered by length, then rank: the first number of each length, and rows (first slot,
    its sequence, offset) in order; the slots that follow a row's first go to the sequences that follow, same offset."""
    first, total = {}, 0
    for length in sorted(counts):
        first[length] = total
        total += counts[length]
    cursor, rows, sequence = dict(first), [], 0
    for pattern, m in patterns:
        offset = 0
        for length in pattern:
            rows.append((cursor[length], sequence, offset))
            cursor[length] += m
            offset += length
        sequence += m
    return first, np.array(sorted(rows), np.int64).reshape(-1, 3)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, on request).

    Null texts count as empty; every document ends with id 1, so an empty one is a piece of length 1. Longer documents
    than ``capacity`` are cut there. Rows with equal or null ids are documents of their own. Other columns are not read.
    An empty table gives an empty result.
    """
    cut = settled(pieces(docs, tokenizer, capacity, id_col, text_col, with_ids))
    sizes = settled(cut.groupBy("length", "chunk").agg(F.count("*").alias("n")))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    first, where = slots(plan(counts, capacity), counts)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["length", "chunk"]).withColumn("slot", F.col("before") + F.col("rank")).drop("before", "rank", "chunk")
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.zeros(capacity + 1, np.int64)
        for length, slot in first.items():
            base[length] = slot
        for batch in batches:
            slot = batch.column("slot").to_numpy(zero_copy_only=False) + base[batch.column("length").to_numpy(zero_copy_only=False)]
            k = np.searchsorted(where[:, 0], slot, "right") - 1
            columns = [batch.column(c) for c in names]
            columns += [pa.array(where[k, 1] + slot - where[k, 0]), pa.array(where[k, 2])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.select(*names, "slot").mapInArrow(seat, schema + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
