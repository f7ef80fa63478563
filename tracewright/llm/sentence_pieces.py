"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

Texts are cut into marked words, which no piece crosses. The distinct words of a batch are sorted, which walks their trie
depth-first: the forward table of a word (the best way to reach each of its prefixes) is kept on a stack, and the next
word goes on from the prefix that both share. For a unigram model the best way is that of the greatest sum of scores. For
a byte-pair model, which applies its best merge first, it is the one whose neighbouring pieces the merges would leave
apart; there is exactly one for each prefix, and like a score it depends on the prefix alone, so the table is shared in
the same way and the result is the library's, id for id. The model's own type decides; models that this doesn't cover
(other types, a normaliser, pieces across words) are refused.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MARK = "▁"
#: Words whose ids a task remembers; as many again stay from before.
CACHE_WORDS = 250_000


class Pieces:
    """Vocabulary of a SentencePiece model file and the forward step of its Viterbi."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.unknown = self.model.unk_id()
        self.text = [self.model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: self.model.get_score(i) for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        self.suffixes = {p[k:] for p in self.ids for k in range(len(p))}
        if any(MARK in p.lstrip(MARK) or "\n" in p and p != "\n" for p in self.ids):
            raise ValueError("pieces of this model cross the beginning of a word")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, bytes] = {}
        self._prepare()
        self.as_bytes = {p: np.array([i], "<u4").tobytes() for p, i in self.ids.items()}
        self.decoded = [self._decoded(i) for i in range(n)]

    def _prepare(self) -> None:
        self.whole = {p: self.merged(p) == [p] for p in self.ids}
        run = [p for p in self.ids if len(p) > 1 and not p.strip(MARK)]
        other = min((s for p, s in self.score.items() if len(p) > 1 and p.strip(MARK)), default=0.0)
        self.longest_run = max(map(len, run), default=1)
        thrice = self.merged(MARK * 3 * self.longest_run)
        if run and (max(self.score[p] for p in run) >= other or thrice != [MARK * self.longest_run] * 3):
            raise ValueError("runs of blanks of this model aren't merged last, from the left")

    def blanks(self, n: int) -> bytes:
        """Ids of a run of ``n`` marks: no merge joins it to what follows, and its longest pieces come first."""
        if n not in self.runs:
            whole = max(n // self.longest_run - 1, 0)
            parts = [MARK * self.longest_run] * whole + self.merged(MARK * (n - whole * self.longest_run))
            self.runs[n] = b"".join(self.as_bytes[p] if p in self.as_bytes else self._spelt(p) for p in parts)
        return self.runs[n]

    def _spelt(self, character: str) -> bytes:
        """Ids of a character without a piece."""
        return np.array([self.byte[b] for b in character.encode()] if self.byte else [self.unknown], "<u4").tobytes()

    def _decoded(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.text[i][3:5], 16)])
        if self.model.is_unknown(i):
            return self.model.decode([i]).encode()
        return b"" if self.model.is_control(i) else self.text[i].replace(MARK, " ").encode()

    def merged(self, word: str) -> list[str]:
        """Byte-pair merging of a short string: the best-scored neighbours first, the left of equals."""
        parts = list(word)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether merging leaves these two neighbours as they are."""
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def forward(self, word: str, path: list[str | None], at: int) -> None:
        """Extends ``path`` (the last piece on the way to each prefix; None for a character without a piece) from the
        prefix of length ``at`` to the whole word."""
        del path[at + 1 :]
        suffixes, ids, pairs, whole = self.suffixes, self.ids, self.pairs, self.whole
        for end in range(at + 1, len(word) + 1):
            start, found = end - 1, []
            while start >= 0 and (piece := word[start:end]) in suffixes:
                if piece in ids:
                    found.append(piece)
                start -= 1
            for piece in reversed(found):
                before = end - len(piece)
                last = path[before] if before else None
                if last is None:
                    if whole[piece]:
                        path.append(piece)
                        break
                else:
                    known = pairs.get((last, piece))
                    if self.stay_apart(last, piece) if known is None else known:
                        path.append(piece)
                        break
            else:
                path.append(None)

    def back(self, word: str, path: list[str | None]) -> bytes:
        """Ids of the best way, as little-endian unsigned 32-bit numbers."""
        out, end = [], len(word)
        while end:
            piece = path[end]
            if piece is None:
                out.append(self._spelt(word[end - 1]))
                end -= 1
            else:
                out.append(self.as_bytes[piece])
                end -= len(piece)
        return b"".join(reversed(out))

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, by a depth-first walk over their trie."""
        out: dict[str, bytes] = {}
        path: list[str | None] = [None]
        before = ""
        for word in sorted(words):
            marks = len(word) - len(word.lstrip(MARK))
            core = word[max(marks - 1, 0) :]  # of a run of marks, the last may belong to the word
            shared, most = 0, min(len(before), len(core))
            while shared < most and before[shared] == core[shared]:
                shared += 1
            self.forward(core, path, shared)
            out[word] = self.back(core, path) if marks < 2 else self.behind_blanks(marks, core, path)
            before = core
        return out

    def behind_blanks(self, marks: int, core: str, path: list[str | None]) -> bytes:
        """Ids of a word behind a run of marks: the last mark is one of the run unless a longer piece begins with it."""
        ids, first = self.back(core, path), core
        end = len(core)
        while end:
            first = path[end]
            end -= len(first) if first else 1
        if first == MARK or first is None:
            alone = self.as_bytes.get(MARK) or self._spelt(MARK)
            return self.blanks(marks) + ids[len(alone) :]
        return self.blanks(marks - 1) + ids


class Unigram(Pieces):
    """The forward step of a unigram model: the greatest sum of scores to each prefix."""

    def _prepare(self) -> None:
        #: Fixed value of the library: an unknown character costs this much more than the worst piece.
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        self.sums: list[float] = [0.0]

    def forward(self, word: str, path: list[str | None], at: int) -> None:
        del path[at + 1 :], self.sums[at + 1 :]
        suffixes, score, sums = self.suffixes, self.score, self.sums
        for end in range(at + 1, len(word) + 1):
            start, best, last = end - 1, float("-inf"), None
            if word[start] not in score:
                best = sums[start] + self.unknown_score
            while start >= 0 and (piece := word[start:end]) in suffixes:
                if piece in score and sums[start] + score[piece] >= best:  # the longest of equals
                    best, last = sums[start] + score[piece], piece
                start -= 1
            path.append(last)
            sums.append(best)

    def behind_blanks(self, marks: int, core: str, path: list[str | None]) -> bytes:
        """Pieces may hold several marks and letters, so the whole word goes its own way."""
        kept = list(self.sums)
        word, own = MARK * (marks - 1) + core, [None]
        self.sums = [0.0]
        self.forward(word, own, 0)
        out = self.back(word, own)
        self.sums = kept
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The model in a file, by its type. Only models that leave text as it is but for marks are taken."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal, kinds = model.normalizer_spec, {1: Unigram, 2: Pieces}
    if model.trainer_spec.model_type not in kinds or any(p.type == 4 for p in model.pieces):
        raise ValueError("only unigram and byte-pair models without user-defined pieces are known")
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.add_dummy_prefix and normal.escape_whitespaces) or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models that mark the beginnings of words, without a normaliser, are known")
    return kinds[model.trainer_spec.model_type](path)


class Encoder:
    def __init__(self, path: str):
        self.pieces = pieces(path)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        """Marked words and line ends. A run of blanks belongs to the word that follows."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return re.findall(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+", MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.words(t) for t in texts]
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {"": b""}, self.young
        young, old, missing = self.young, self.old, []
        for w in {w for words in parts for w in words}:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    missing.append(w)
        young.update(self.pieces.encode_words(missing))
        out = [b"".join([young[w] for w in words]) for words in parts]
        return out if self.pieces.byte else [self._joined_unknown(ids) for ids in out]

    def _joined_unknown(self, ids: bytes) -> bytes:
        """Without pieces for bytes, unknown characters in a row are one unknown piece."""
        a = np.frombuffer(ids, "<u4")
        again = np.append(False, (a[1:] == a[:-1]) & (a[1:] == self.pieces.unknown))
        return a[~again].tobytes() if len(a) else ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of ids: bytes joined, marks as blanks, without the blank that marks the beginning."""
    known = pieces(path).decoded
    return b"".join([known[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


def _parts(texts: list, most: int = 4 << 20) -> Iterator[list[str]]:
    """Texts, a few megabytes at a time; nulls as empty."""
    held, size = [], 0
    for t in texts:
        held.append((t or b"").decode("utf-8", "replace"))
        size += len(held[-1])
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of each whole text; null and empty texts have none. No shuffle. Repeated rows get a row
    each, an empty table gives an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            at = 0
            for texts in _parts(batch.column(1).cast(pa.binary()).to_pylist()):
                ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in code.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])
                at += len(texts)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row of ids; null ids give an empty text. A blank written as U+2581 comes back as a blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(np.array(ids or [], np.int64), path) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What encode() and decode() give, as figures, without moving the ids: id, n_ids, ids_crc32 (unsigned, little-endian
    unsigned 32-bit ids), decoded_sha256 (of the text that the ids decode to), round_trip (it is the text)."""
    names = [id_col, "n_ids", "ids_crc32", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            at = 0
            for texts in _parts(batch.column(1).cast(pa.binary()).to_pylist()):
                rows = []
                for text, ids in zip(texts, code.encode(texts)):
                    back = decode_ids(np.frombuffer(ids, "<u4"), path)
                    rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names=names)
                at += len(texts)

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
