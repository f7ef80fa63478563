"""Chat formatting over a prefix tree.

Conversations that begin with the same turns share them: sorted by their turns, they lie depth-first in a trie, and the
turns of a path are emitted once, when it is entered. A sample is a run of such conversations: its text, one segment for
each node, position ids that go on from the parent (not from what was emitted before), the intervals of all ancestors
(neighbouring ones merged), which are what a node's tokens may attend to besides themselves, and the spans under the loss mask. Everything is given in
characters of the text; with a tokenizer, a sample also has its token ids, and all spans and positions in tokens.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, so no control string of the template can come from them; line ends in roles become ``\\n``. Both are undone by
``unescape``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: A sample takes no further conversation when it has this many characters.
SAMPLE_CHARS = 1 << 20
LEARNT_ROLE = "assistant"

_SPANS = "start:bigint,end:bigint,position:bigint,ancestors:array<struct<start:bigint,end:bigint>>,loss:struct<start:bigint,end:bigint>"
SAMPLE = f"text string, ids array<int>, segments array<struct<parent:int,{_SPANS},tokens:struct<{_SPANS}>>>, leaves array<struct<conv_id:{{id}},segment:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its text begins and ends."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape(role), unescape(rest[: -len(END) - 1])))
    return out


def _spans(begin: int, sizes: tuple[int, int, int], learnt: bool, over: dict | None) -> dict:
    """Spans of a node that begins at ``begin`` with parts of these sizes (before, in and after its text); ``over`` is
    its parent. Ancestors that were emitted one after the other are one interval, so a path has as many as it has
    branches, not as many as it has turns."""
    ancestors = []
    if over:
        ancestors, last = over["ancestors"], {"start": over["start"], "end": over["end"]}
        if ancestors and ancestors[-1]["end"] == last["start"]:
            ancestors, last = ancestors[:-1], {"start": ancestors[-1]["start"], "end": last["end"]}
        ancestors = [*ancestors, last]
    return {
        "start": begin,
        "end": begin + sum(sizes),
        "position": over["position"] + over["end"] - over["start"] if over else 0,
        "ancestors": ancestors,
        "loss": {"start": begin + sizes[0], "end": begin + sizes[0] + sizes[1]} if learnt else None,
    }


class _Sample:
    """A sample that is being emitted."""

    def __init__(self, encode=None):
        self.encode = encode
        self.parts: list[str] = []
        self.size = 0
        self.ids: list[int] = []
        self.segments: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # turn and segment of the open nodes

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        depth = 0
        while depth < min(len(self.path), len(turns)) and self.path[depth][0] == turns[depth]:
            depth += 1
        del self.path[depth:]
        for role, text in turns[depth:]:
            formatted, begin, end = format_turn(role, text)
            parent = self.path[-1][1] if self.path else -1
            over = self.segments[parent] if self.path else None
            learnt = role == LEARNT_ROLE
            node = _spans(self.size, (begin, end - begin, len(formatted) - end), learnt, over) | {"parent": parent, "tokens": None}
            if self.encode:
                tokens = [self.encode(part) for part in (formatted[:begin], formatted[begin:end], formatted[end:])]
                node["tokens"] = _spans(len(self.ids), tuple(map(len, tokens)), learnt, over and over["tokens"])
                for part in tokens:
                    self.ids += part
            self.segments.append(node)
            self.parts.append(formatted)
            self.size += len(formatted)
            self.path.append(((role, text), len(self.segments) - 1))
        self.leaves.append({"conv_id": conv_id, "segment": self.path[-1][1] if self.path else -1})


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, nulls as empty. Nothing says which rows without a conv_id belong together, so each is
    a conversation of its own (they aren't gathered, however many there are). Turns of the same number, or without one
    (they come first), are ordered by role and text; repeated rows are repeated turns."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", said.alias("said"))))
    known = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.transform(ordered, lambda t: t["said"]).alias("turns"))
    return known.unionByName(turns.filter("conv_id is null").select("conv_id", F.array(said).alias("turns")))


def samples(turns: DataFrame, sample_chars: int = SAMPLE_CHARS, tokenizer: str | None = None) -> DataFrame:
    """Samples of all conversations in ``turns`` (conv_id, turn, role, text); columns as in SAMPLE.

    Conversations are range-partitioned by hashes of their turns, so those that share turns meet, and a tree that very
    many conversations share is cut between partitions (and at ``sample_chars``); each part then opens with its own
    copy of the open path. Nodes are merged only if their texts are equal, whatever the hashes are. Spans count
    characters (code points), and tokens of the byte-level ``tokenizer`` (a file) if one is given. An empty table gives an empty result; other columns are not read.
    """
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    keyed = conversations(turns).withColumn("path", path)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")
    schema = SAMPLE.format(id=turns.schema["conv_id"].dataType.simpleString())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        if tokenizer:
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_file(tokenizer)
            encode = lambda part: loaded.encode(part, add_special_tokens=False).ids
        kinds = None
        now = _Sample(encode)

        def flush() -> pa.RecordBatch:
            leaves = pa.array([now.leaves], pa.list_(pa.struct([("conv_id", kinds), ("segment", pa.int32())])))
            columns = [pa.array(["".join(now.parts)]), pa.array([now.ids if encode else None], pa.list_(pa.int32())), pa.array([now.segments], pa.list_(SEGMENT)), leaves]
            return pa.RecordBatch.from_arrays(columns, names=["text", "ids", "segments", "leaves"])

        for batch in batches:
            kinds = batch.column(0).type
            ids, all_turns = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                now.add(ids[k].as_py(), [(t["role"], t["text"]) for t in all_turns[k].as_py()])
                if now.size >= sample_chars:
                    yield flush()
                    now = _Sample(encode)
        if now.leaves:
            yield flush()

    return ordered.mapInArrow(emit, schema)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FIELDS = [("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("ancestors", pa.list_(SPAN)), ("loss", SPAN)]
SEGMENT = pa.struct([("parent", pa.int32()), *_FIELDS, ("tokens", pa.struct(_FIELDS))])


def _check_ids(text: str, ids: list[int], segments: list[dict], decode) -> None:
    """Raises an error unless every segment's token spans, positions and ancestors agree with its characters."""
    for s in segments:
        t, over = s["tokens"], segments[s["parent"]]["tokens"] if s["parent"] >= 0 else None
        pairs = [(s, t)] + ([(s["loss"], t["loss"])] if s["loss"] else [])
        if any(decode(ids[b["start"] : b["end"]]) != text[a["start"] : a["end"]] for a, b in pairs) or (t["loss"] is None) != (s["loss"] is None):
            raise ValueError("token ids and text of a sample differ")
        if t["position"] != (over["position"] + over["end"] - over["start"] if over else 0) or t["position"] != sum(a["end"] - a["start"] for a in t["ancestors"]):
            raise ValueError("positions or ancestors of a sample are wrong")


def read_back(packed: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """What each conversation of ``samples`` says, read from their output alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    With ``tokenizer``, the one that the samples were made with, ids, positions and ancestors in tokens are checked against
    the text: a sample whose ids say something else is an error."""
    id_type = packed.schema["leaves"].dataType.elementType["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = None
        if tokenizer:
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_file(tokenizer)
            decode = lambda ids: loaded.decode(ids, skip_special_tokens=False)
        for batch in batches:
            for sample in range(batch.num_rows):
                text = batch.column("text")[sample].as_py()
                segments = batch.column("segments")[sample].as_py()
                rows = []
                if decode:
                    _check_ids(text, batch.column("ids")[sample].as_py(), segments, decode)
                for leaf in batch.column("leaves")[sample].as_py():
                    path = leaf["segment"]
                    own = segments[path]["ancestors"] + [segments[path]] if path >= 0 else []
                    formatted = "".join(text[s["start"] : s["end"]] for s in own)
                    masks = []
                    while path >= 0:
                        if mask := segments[path]["loss"]:
                            masks.append(text[mask["start"] : mask["end"]])
                        path = segments[path]["parent"]
                    turns = parse_turns(formatted)
                    said = "".join(f"{role}\n{body}\n" for role, body in turns)
                    learnt = "".join(unescape(m) for m in reversed(masks))
                    rows.append((leaf["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted)))
                kinds = [batch.column("leaves").type.value_type.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return packed.mapInArrow(read, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -1, whose texts are full of control strings."""
    said = f"{END}{START}assistant ok"
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    own = turns.select("conv_id", "turn", "role", "text")
    return own.unionByName(probe.select(*[F.col(f.name).cast(f.dataType) for f in own.schema.fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_back(samples(with_probe(table(spark, sf_dir, "conversations")), tokenizer=tokenizer), tokenizer)


SQL = """
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 0, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text), '') AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
    CAST(sum(length(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))
      + length(role) - length(replace(role, chr(10), ''))
      + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + 24) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id, alone)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM c
"""
