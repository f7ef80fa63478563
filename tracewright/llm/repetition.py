"""Quality rules with suffix-array repetition.

Every text becomes a sequence of words. Suffix arrays of many texts are built together by prefix doubling (only
suffixes that still tie are sorted again); the ranks of each doubling step give the longest common prefixes of
neighbours. A suffix's deepest LCP interval of at least ``MIN_WORDS`` words is a repeated substring; these spans, of
which the maximal ones contain all others, are united, and so are those of at least ``LONG_WORDS`` words. The method
rejects a text that spans of the second kind cover by more than ``MAX_COVERED``, or whose longest repeat is more than
``MAX_LONGEST`` words and ``LONGEST_SHARE`` of the text's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, release, table

MIN_WORDS, LONG_WORDS = 8, 16
MAX_COVERED = 0.20
MAX_LONGEST = 100
LONGEST_SHARE = 0.10
MIN_TEXT_WORDS = 20
#: Words whose suffixes are sorted together; a longer text is sorted alone.
BATCH_WORDS = 80_000

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_long_words", "longest_repeat")


def suffix_array(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array of several texts (``text`` numbers them, in order), each suffix ending with its text, and for
    lengths h = 1, 2, 4, ... ranks that are equal exactly where the first h words are."""
    n = len(words)
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True)) if n else np.zeros(0, np.int64)
    end = np.repeat(last + 1, np.diff(np.append(-1, last)))
    key = text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    sa = np.argsort(key, kind="stable")
    new = np.append(True, key[sa[1:]] != key[sa[:-1]]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)  # a copy is kept of every step
    rank[sa] = np.repeat(starts, sizes)
    steps, h = [(1, rank.copy())], 1
    tied = sa[np.repeat(sizes > 1, sizes)]
    while len(tied):
        ahead = tied + h
        inside = ahead < end[tied]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)], -1)
        order = np.lexsort((second, rank[tied]))
        tied, second = tied[order], second[order]
        first = rank[tied]
        group = np.append(True, first[1:] != first[:-1])
        parted = group | np.append(True, second[1:] != second[:-1])
        at = np.arange(len(tied))
        within = at - np.maximum.accumulate(np.where(group, at, 0))
        sa[first + within] = tied
        starts = np.flatnonzero(parted)
        sizes = np.diff(np.append(starts, len(tied)))
        rank[tied] = np.repeat((first + within)[starts], sizes)
        h *= 2
        steps.append((h, rank.copy()))
        tied = tied[np.repeat(sizes > 1, sizes)]
    return sa, steps


def common_prefixes(sa: np.ndarray, steps: list[tuple[int, np.ndarray]], end: np.ndarray) -> np.ndarray:
    """For each place k of ``sa`` after the first, the words that suffixes k-1 and k have in common at their start."""
    if not len(sa):
        return np.zeros(0, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    length = np.zeros(len(a), np.int64)
    live = np.flatnonzero(steps[0][1][a] == steps[0][1][b])
    for h, rank in reversed(steps):
        x, y = a[live] + length[live], b[live] + length[live]
        inside = (x < end[a[live]]) & (y < end[b[live]])
        top = len(rank) - 1
        equal = inside & (rank[np.minimum(x, top)] == rank[np.minimum(y, top)])
        length[live[equal]] += h
    return np.append(0, length)


def repeats(words: np.ndarray, text: np.ndarray, texts: int, least: tuple[int, ...] = (MIN_WORDS, LONG_WORDS)) -> tuple[np.ndarray, ...]:
    """Of each text the words covered by repeated substrings of at least so many words, for each of ``least``, and the
    longest repeat."""
    covered, longest = [np.zeros(texts, np.int64) for _ in least], np.zeros(texts, np.int64)
    n = len(words)
    if not n:
        return *covered, longest
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    end = np.repeat(last + 1, np.diff(np.append(-1, last)))
    sa, steps = suffix_array(words, text)
    lcp = common_prefixes(sa, steps, end)
    deepest = np.zeros(n, np.int64)
    deepest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    np.maximum.at(longest, text, deepest)
    for count, shortest in zip(covered, least):
        at = np.flatnonzero(deepest >= shortest)
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + deepest[at], -1)
        np.add.at(count, text[np.cumsum(marks[:-1]) > 0], 1)
    return *covered, longest


def _figures(texts: list[bytes]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in FIGURES}
    held: list[list[bytes]] = []

    def flush() -> None:
        if not held:
            return
        sizes = np.array([len(w) for w in held])
        flat = pa.array([w for words in held for w in words], pa.binary()).dictionary_encode().indices
        numbers = np.repeat(np.arange(len(held)), sizes)
        covered, long, longest = repeats(flat.to_numpy(zero_copy_only=False).astype(np.int64), numbers, len(held))
        out["n_repeat_words"] += covered.tolist()
        out["n_long_words"] += long.tolist()
        out["longest_repeat"] += longest.tolist()
        held.clear()

    size = 0
    for text in texts:
        words = text.split()
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text.translate(None, SPACES + CONTINUATION)))
        out["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
        lines = [line for line in text.split(b"\n") if line.strip()]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        if size + len(words) > BATCH_WORDS:
            flush()
            size = 0
        held.append(words)
        size += len(words)
    flush()
    return out


def quality_column(docs: DataFrame) -> str:
    return free("quality", docs.columns)


def quality_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, extended by the struct of the figures of each text (``quality_column`` names it).

    A null text counts as one without words. Words are runs of characters other than ASCII white space; lines are split
    at \\n, and those without a word don't count. No shuffle: each text is judged by itself, whole.
    """
    names, added = [f.name for f in docs.schema.fields], quality_column(docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            figures = _figures([t or b"" for t in batch.column(names.index(text_col)).cast(pa.binary()).to_pylist()])
            struct = pa.StructArray.from_arrays([pa.array(figures[c], pa.int64()) for c in FIGURES], names=list(FIGURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*names, added])

    struct_type = T.StructType([T.StructField(c, T.LongType()) for c in FIGURES])
    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, T.StructField(added, struct_type)]))


def base_failed(q: str) -> Column:
    return (F.col(f"{q}.n_words") < MIN_TEXT_WORDS) | (F.col(f"{q}.n_repeat_words") * 100 > F.col(f"{q}.n_words") * 30)


def repeats_allowed(q: str) -> Column:
    """The method's verdict."""
    words, longest = F.col(f"{q}.n_words"), F.col(f"{q}.longest_repeat")
    return (F.col(f"{q}.n_long_words") <= words * MAX_COVERED) & ((longest <= MAX_LONGEST) | (longest <= words * LONGEST_SHARE))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_long_words,
    longest_repeat, base_failed, kept. Repeated rows get a row each; an empty table gives an empty result; other columns are not read."""
    docs = docs.select(id_col, text_col)
    q = quality_column(docs)
    failed = base_failed(q)
    return quality_figures(docs, id_col, text_col).select(id_col, *[F.col(f"{q}.{c}").alias(c) for c in FIGURES], failed.alias("base_failed"), (~failed & repeats_allowed(q)).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    q = quality_column(docs)
    return quality_figures(docs, id_col, text_col).filter(~base_failed(q) & repeats_allowed(q)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
