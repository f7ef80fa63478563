"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart: one on ordinary texts, one on the passages of toxic texts that ordinary
texts hardly have (words with a substring that tells the two kinds apart). Every window is compressed with either; the
bytes that the toxic dictionary saves against the ordinary one are its evidence. How many windows save at least so many
bytes, in all and for each word, is turned into a probability by thresholds calibrated on labelled texts that neither
dictionary has seen.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, release, settled, table, text_of

#: Bounds of the training sample: rows of each label, in order of a hash of the id, as long as their whole texts come to
#: so many bytes in all.
TOXIC_TEXTS, ORDINARY_TEXTS = 2000, 4000
TOXIC_SAMPLE_BYTES, ORDINARY_SAMPLE_BYTES = 16 << 20, 32 << 20
WINDOW_WORDS = 1
#: Both dictionaries and every window end with this. zstandard begins no match in a block's last 8 bytes, and stores a
#: block as it is unless that saves some bytes; with a match at its end, each window shows every byte saved.
CARRIER = b"<[{(~^0123456789^~)}]>" + b"\n\t"
#: Binary trees find a rare word wherever it lies in the dictionary; the faster matchers overlook some.
LEVEL, MIN_MATCH, STRATEGY = 13, 5, zstandard.STRATEGY_BTLAZY2
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 16 << 10
#: Letting a toxic text pass counts as much as rejecting this many ordinary ones.
MISS_COST = 2.0
#: A substring tells toxic texts apart if so many of them have it, so many times as often as ordinary ones.
MIN_TEXTS, MIN_RATIO = 4, 6.0
GRAMS = (5, 6, 7)
#: Saved bytes from which a window counts.
CUTS = (1, 2, 3, 4, 5, 6, 7, 8)
#: Windows whose saved bytes a task remembers; as many again stay from before.
CACHE_WINDOWS = 100_000
EDGES = b".,!?;:\"'()"


def folded(text: str | bytes | None) -> bytes:
    """The text in small letters of any alphabet, in UTF-8: what is learnt from and what is scored. Null is empty."""
    return (text.decode("utf-8", "replace") if isinstance(text, bytes) else text or "").lower().encode("utf-8", "replace")


def windows(text: bytes, words: int = WINDOW_WORDS) -> list[bytes]:
    """Of a folded text."""
    parts = text.split()
    return parts if words == 1 else [b" ".join(parts[i : i + words]) for i in range(0, len(parts), words)]


def _padded(text: bytes) -> np.ndarray:
    """The text's words without their outer marks, each between blanks of its own."""
    return np.frombuffer(b"".join([b" %b " % w.strip(EDGES) for w in text.split()]), np.uint8)


def _grams(padded: np.ndarray, size: int) -> np.ndarray:
    """The bytes of the substring of ``size`` at each place as one number, 0 where it isn't within one word."""
    n = len(padded) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, across = np.zeros(n, np.uint64), np.zeros(n, bool)
    gap = (padded[:-1] == 32) & (padded[1:] == 32)
    for k in range(size):
        out |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 < size:
            across |= gap[k : k + n]
    out[across] = 0
    return out


def _texts_with(texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct substrings and the number of texts that have each."""
    each = [np.unique(_grams(t, size)) for t in texts]
    found, count = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_counts=True)
    return found[found > 0], count[found > 0]


def telling(toxic: list[np.ndarray], ordinary: list[np.ndarray], size: int) -> np.ndarray:
    """Substrings that at least MIN_TEXTS toxic texts have, MIN_RATIO times as often as ordinary ones."""
    found, count = _texts_with(toxic, size)
    found, count = found[count >= MIN_TEXTS], count[count >= MIN_TEXTS]
    usual = np.zeros(len(found) + 1, np.int64)
    for t in ordinary:
        own = np.unique(_grams(t, size))
        at = np.searchsorted(found, own)
        usual[at[(at < len(found)) & (found[np.minimum(at, max(len(found) - 1, 0))] == own)] if len(found) else []] += 1
    scale = max(len(ordinary), 1) / max(len(toxic), 1)
    return found[count * scale >= MIN_RATIO * (usual[:-1] + 1)]


def toxic_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Of each toxic text the words with a telling substring, in order: what the toxic dictionary is trained on."""
    padded = [_padded(t) for t in toxic]
    usual = [_padded(t) for t in ordinary]
    tells = {size: telling(padded, usual, size) for size in GRAMS}
    out = []
    for t in padded:
        marks = np.zeros(len(t), bool)
        for size, known in tells.items():
            marks[np.flatnonzero(np.isin(_grams(t, size), known)) + 1] = True  # its second byte lies in the word
        ends = np.flatnonzero((t[:-1] == 32) & (t[1:] == 32)) + 1
        parts = np.split(t, ends)
        has = [bool(m.any()) for m in np.split(marks, ends)]
        if passage := b"".join(p.tobytes() for p, h in zip(parts, has) if h):
            out.append(passage)
    return out


def _pieces(texts: list[bytes], size: int = 2048) -> list[bytes]:
    """The texts in pieces of about ``size`` bytes, cut at blanks; nothing is left out."""
    out = []
    for text in texts:
        at = 0
        while len(text) - at > size:
            end = text.find(b" ", at + size)
            end = len(text) if end < 0 else end
            out.append(text[at:end])
            at = end
        out.append(text[at:])
    return out


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary that zstandard trains on ``samples``; all of them where there is too little to choose from. Too few
    samples to train on are given in pieces; if that doesn't do either, they are the dictionary, whole."""
    whole = b"".join(samples)
    if len(whole) <= size:
        return whole or b" "
    for parts in (samples, _pieces(samples)):
        try:
            return zstandard.train_dictionary(size, parts, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:
            continue
    return whole


@dataclass
class Model:
    """Both dictionaries' contents and the calibration of the evidence."""

    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float = 0.5

    def compressors(self):
        if not hasattr(self, "_compressors"):
            self._compressors = _compressor(self.ordinary + CARRIER), _compressor(self.toxic + CARRIER)
            self._young, self._old = {}, {}
        return self._compressors

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def saved(self, found: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window, at most those of the last of CUTS. Windows that recur
        are compressed once and remembered."""
        with_ordinary, with_toxic = self.compressors()
        if len(self._young) > CACHE_WINDOWS:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        for w in set(found):
            if w not in young:
                if (known := old.get(w)) is None:
                    framed = b" %b %b" % (w, CARRIER)
                    known = min(max(len(with_ordinary(framed)) - len(with_toxic(framed)), 0), CUTS[-1])
                young[w] = known
        return np.fromiter(map(young.__getitem__, found), np.int64, len(found))

    def evidence(self, text: str | bytes | None) -> np.ndarray:
        """Windows of the folded text that save at least each of CUTS bytes, and the number of words."""
        found = windows(folded(text))
        at = np.bincount(self.saved(found), minlength=CUTS[-1] + 1)
        return np.array([*(at[c:].sum() for c in CUTS), len(found) * WINDOW_WORDS], float)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        x = (_features(evidence) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -30, 30)))


def _compressor(content: bytes):
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=MIN_MATCH, strategy=STRATEGY, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress


def _features(evidence: np.ndarray) -> np.ndarray:
    n, words = evidence[:, :-1], evidence[:, -1:]
    return np.concatenate([np.log1p(n), 50 * n / (words + 30), np.minimum(n, 1), np.clip(n - 1, 0, 1), np.log1p(words)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w)), x.T @ (p - y) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """A model from folded texts of both kinds; two of three are for the dictionaries, the others to calibrate."""
    part = lambda texts, own: [t for k, t in enumerate(texts) if (k % 3 < 2) == own]
    tox, ordi = part(toxic, True), part(ordinary, True)
    model = Model(dictionary(ordi, ORDINARY_BYTES, 24), dictionary(toxic_passages(tox, ordi), TOXIC_BYTES, 12), np.zeros(0), np.ones(0), np.zeros(0))
    tox, ordi = part(toxic, False), part(ordinary, False)
    seen = np.array([model.evidence(t) for t in tox + ordi]).reshape(-1, len(CUTS) + 1)
    if not tox or not ordi:  # nothing to calibrate with: every score is the share of toxic texts
        seen = np.concatenate([seen, np.zeros((2, len(CUTS) + 1))])
        y = np.array([1.0] * len(tox) + [0.0] * len(ordi) + [1.0, 0.0])
    else:
        y = np.array([1.0] * len(tox) + [0.0] * len(ordi))
    x = _features(seen)
    model.center, model.scale = x.mean(0), x.std(0) + 1e-6
    model.weights = _logistic((x - model.center) / model.scale, y)
    model.share = float(y.mean())
    return model


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[bytes], list[bytes], float]:
    """Folded toxic and ordinary texts, and the share of toxic ones among all labelled ids that may be learnt from.

    Texts are taken in order of a hash of the id, without those that no longer fit.

    Only ids whose crc32 (as text) mod 5 is not 0 are taken; labels other than 0 and 1, and null ids, aren't used. An id
    labelled both ways counts as toxic; of the texts of one id the smallest is taken. The sample is bounded by rows and
    bytes (TOXIC_TEXTS, TOXIC_SAMPLE_BYTES and so on); every text in it is whole.
    """
    known = labels.select(id_col, "toxic").filter(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1))
    known = known.filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    count = known.agg(F.avg("toxic")).first()[0]
    order = (F.xxhash64(id_col), F.col(id_col))
    first = lambda y, n: known.filter(F.col("toxic") == y).orderBy(*order).limit(n)
    chosen = first(1, TOXIC_TEXTS).unionByName(first(0, ORDINARY_TEXTS))
    rows = docs.select(id_col, text_of(text_col).alias(text_col)).join(F.broadcast(chosen), id_col)
    texts = settled(rows.groupBy(id_col, "toxic").agg(F.min(text_col).alias(text_col)))
    out: dict[int, list[bytes]] = {}
    for y, most in ((1, TOXIC_SAMPLE_BYTES), (0, ORDINARY_SAMPLE_BYTES)):
        own = texts.filter(F.col("toxic") == y)
        sizes = own.orderBy(*order).select(id_col, F.octet_length(text_col)).collect()  # at most as many rows as were chosen
        fits, left = [], most
        for doc_id, size in sizes:
            if size <= left:
                fits.append((doc_id,))
                left -= size
        if len(fits) < len(sizes):
            own = own.join(F.broadcast(docs.sparkSession.createDataFrame(fits, T.StructType([own.schema[id_col]]))), id_col)
        out[y] = [folded(r[0]) for r in own.orderBy(*order).select(text_col).collect()]
    return out[1], out[0], float(count or 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a bounded sample of labelled rows."""
    toxic, ordinary, share = training_sample(docs, labels, id_col, text_col)
    model = fit(toxic, ordinary)
    if 0 < share < 1:  # from the sample's odds to those of the labelled table, weighted by cost
        model.weights[-1] += math.log(share / (1 - share)) - math.log(model.share / (1 - model.share)) + math.log(MISS_COST)
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with all its columns and the score (0 to 1) of each whole text. A null text counts as empty. No shuffle."""
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        mine = pickle.loads(held.value)
        for batch in batches:
            texts = batch.column(names.index(text_col)).cast(pa.binary())
            seen = np.array([mine.evidence(t.as_py()) for t in texts]).reshape(-1, len(CUTS) + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine.scores(seen))], names=[*names, score_col])

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score, predicted. Other columns are not read.

    Repeated rows get a row each; rows with a null id are scored and not held out; an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col)
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = scored(docs.select(id_col, text_col), model, text_col)
    return out.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns unchanged."""
    score = free("score", docs.columns)
    return scored(docs, train(docs, labels, id_col, text_col), text_col, score).filter(F.col(score) < 0.5).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
