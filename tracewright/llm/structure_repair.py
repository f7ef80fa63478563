"""Repair of conversations' structure as Knuth's lightest derivation.

A conversation is read as a sequence of rows and shall become one whose role initials give ``(s?(ua)+)?``. Items are
``(row, k)``, that row k is there, ``(prefix, k, state)``, that the first k rows can be repaired so that the pattern is in
``state``, and the goal. Deductions are hyperedges: a step over a row has two premises, the prefix before it and the row, and
one edit; an insertion has one premise. An item's weight is (cost, audit): a deduction adds its edit's cost and joins its
letter to the prefix's audit, rows weigh nothing. The agenda pops the least item, which is then final, until the goal is.

That is right because these functions are superior. They don't fall below a premise: costs aren't negative, and what costs
nothing is Keep, which makes an audit longer, hence greater. They keep order: of two audits of one item that cost the
same neither begins the other, for the rest would be insertions, which cost, and an audit's cost follows from its
letters; so their first difference decides, whatever is joined.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: The pattern's automaton: begun with nothing, after s, after u, after a.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (NOTHING, ASSISTANT)
ROLE = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
_WORD = re.compile(r"[^\x20\x09-\x0D]")


class Audits:
    """Strings of edits as nodes of a tree, so that joining a letter and comparing two take no time in their length
    (but its logarithm). Equal strings are the same node."""

    def __init__(self):
        self.parent, self.jump, self.depth, self.letter = [0], [0], [0], [""]
        self.child: dict[tuple[int, str], int] = {}

    def join(self, node: int, letter: str) -> int:
        if (found := self.child.get((node, letter))) is not None:
            return found
        far = self.jump[node]
        even = self.depth[node] - self.depth[far] == self.depth[far] - self.depth[self.jump[far]]
        new = self.child[node, letter] = len(self.parent)
        self.parent.append(node)
        self.jump.append(self.jump[far] if even else node)
        self.depth.append(self.depth[node] + 1)
        self.letter.append(letter)
        return new

    def _up(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.jump[node] if self.depth[self.jump[node]] >= depth else self.parent[node]
        return node

    def less(self, a: int, b: int) -> bool:
        depth = min(self.depth[a], self.depth[b])
        x, y = self._up(a, depth), self._up(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        while self.parent[x] != self.parent[y]:
            if self.jump[x] != self.jump[y]:
                x, y = self.jump[x], self.jump[y]
            else:
                x, y = self.parent[x], self.parent[y]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))


class _Weight:
    __slots__ = ("cost", "audit", "of")

    def __init__(self, cost: int, audit: int, of: Audits):
        self.cost, self.audit, self.of = cost, audit, of

    def __lt__(self, other: _Weight) -> bool:
        return self.cost < other.cost or self.cost == other.cost and self.audit != other.audit and self.of.less(self.audit, other.audit)


def _edits(role: str, must_go: bool, truncated: bool) -> list[tuple[str, str, int]]:
    """The edits of a row: letter, the initial that it leaves (none if deleted), cost."""
    out = [(DELETE, "", COST[DELETE])]
    if not must_go:
        extra = TRUNCATED_COST * truncated
        out += [(KEEP, role[:1], COST[KEEP] + extra)] * (role[:1] in ("s", "u", "a")) + [(REROLE, i, COST[REROLE] + extra) for i in ROLE]
    return out


def lightest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of rows (role, must go, is truncated)."""
    audits = Audits()
    goal, n = ("goal",), len(rows)
    edits = [_edits(*row) for row in rows]
    best: dict[tuple, _Weight] = {}
    final: set[tuple] = set()
    agenda: list[tuple[_Weight, int, tuple]] = []

    def propose(item: tuple, cost: int, audit: int) -> None:
        weight = _Weight(cost, audit, audits)
        if item not in final and (item not in best or weight < best[item]):
            best[item] = weight
            heapq.heappush(agenda, (weight, len(agenda), item))

    def step(k: int, state: int) -> None:
        """All deductions from a prefix and the row after it, once both are final."""
        before = best["prefix", k, state]
        for letter, initial, cost in edits[k]:
            after = STEP.get((state, initial)) if initial else state
            if after is not None:
                propose(("prefix", k + 1, after), before.cost + cost, audits.join(before.audit, letter))

    propose(("prefix", 0, NOTHING), 0, 0)
    for k in range(n):
        propose(("row", k), 0, 0)
    while goal not in final:
        weight, _, item = heapq.heappop(agenda)
        if item in final:
            continue
        final.add(item)
        if item[0] == "row":
            for state in range(4):
                if ("prefix", item[1], state) in final:
                    step(item[1], state)
        elif item[0] == "prefix":
            _, k, state = item
            for initial in ROLE:
                if (after := STEP.get((state, initial))) is not None:
                    propose(("prefix", k, after), weight.cost + COST[INSERT], audits.join(weight.audit, INSERT))
            if k == n and state in ACCEPTING:
                propose(goal, weight.cost, weight.audit)
            elif ("row", k) in final:
                step(k, state)
    return best[goal].cost, audits.text(best[goal].audit)


def apply_audit(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows (role, text) after the edits of an audit. The pattern says which role is set: after u it is a, else u."""
    out, state, at = [], NOTHING, 0
    for edit in audit:
        text = ""
        if edit != INSERT:
            role, text = rows[at]
            at += 1
            if edit == DELETE:
                continue
        if edit != KEEP:
            role = ROLE["a" if state == USER else "u"]
        state = STEP[state, role[0]]
        out.append((role, text))
    if at != len(rows) or state not in ACCEPTING:
        raise ValueError("not an audit of these rows")
    return out


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each row: blank, duplicate, truncated or none."""
    out, seen = [], set()
    for role, text in rows:
        words = _WORD.findall(text[-64:]) or _WORD.findall(text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repair(rows: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int, str, list[str]]:
    """The repaired rows, their cost and audit, and each row's fault."""
    found = faults(rows)
    cost, audit = lightest([(role, fault in ("blank", "duplicate"), fault == "truncated") for (role, _), fault in zip(rows, found)])
    return apply_audit(rows, audit), cost, audit, found


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FIELDS = [("conv_id", None), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("turns", _TURNS)]


def with_ids(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``turns``, null texts and roles as one space; ``alone``, a number for each row without a
    conv_id (a conversation of its own), null for all others; and ``gone``, false."""
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    said = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *said, alone.alias("alone"), F.lit(False).alias("gone"))


def gathered(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role and text in order) and gaps of the conversations in rows of ``with_ids``; a row that is gone counts
    for neither, but its conversation stays. One shuffle."""
    there = F.when(~F.col("gone"), F.struct("turn", "role", "text"))
    turn = F.when(~F.col("gone"), F.col("turn"))
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.size(F.collect_set(turn)), F.lit(0)).cast("long")
    turns = F.transform(F.array_sort(F.collect_list(there)), lambda t: F.struct(t["role"], t["text"]))
    return rows.groupBy("conv_id", "alone").agg(gaps.alias("gaps"), turns.alias("turns")).drop("alone")


def repaired(conversations: DataFrame) -> DataFrame:
    """Conversations of ``gathered``, repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and turns (role and
    text, as repaired). One row each; no shuffle.

    Rows are read by turn (null first), those of the same turn by role and text. A role is kept only if it begins with s, u or
    a in its place; an empty or any other role can be set or deleted. A conversation is one row, so it must fit a task.
    """
    id_type = conversations.schema["conv_id"].dataType.simpleString()

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _FIELDS[1:]]
            for turns in batch.column("turns"):
                rows = [(t["role"], t["text"]) for t in turns.as_py()]
                turns, cost, audit, found = repair(rows)
                illegal = sum(a[:1] + b[:1] not in LEGAL_PAIRS for (a, _), (b, _) in zip(rows, rows[1:]))
                facts = (found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, [{"role": r, "text": t} for r, t in turns])
                for column, fact in zip(columns, facts):
                    column.append(fact)
            arrays = [batch.column("conv_id"), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS[1:])), batch.column("gaps")]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(n for n, _ in _FIELDS), "gaps"])

    schema = f"conv_id {id_type}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role:string,text:string>>, gaps long"
    return conversations.select("conv_id", "turns", "gaps").mapInArrow(mend, schema)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """``repaired`` for a table of turns (conv_id, turn, role, text); other columns are not read. Null roles and texts count as one
    space; rows without a conv_id are conversations of their own; an empty table gives an empty result."""
    return repaired(gathered(with_ids(turns)))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``with_ids``, damaged by crc32(``conv_id:turn``) % 20, where nulls are one space: 0 drops the row (it is gone), 1
    empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row, 4 sets the role user."""
    word = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = turns.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.withColumns({"role": role, "text": text, "gone": F.col("gone") | (F.col("kind") == 0)})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select(*turns.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(with_ids(table(spark, sf_dir, "conversations")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    done = repaired(gathered(rows)).withColumn("repaired_sha256", F.sha2(said.cast("binary"), 256))
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


#: Damage, faults, and the cheapest repair row by row: of each conversation and state of the pattern the least (cost, audit).
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""

SQL = rf"""
WITH RECURSIVE s AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, ({_CRC}) % 20 AS kind
  FROM conversations),
ids AS (SELECT row_number() OVER (ORDER BY conv_id, alone) AS no, conv_id, alone FROM (SELECT DISTINCT conv_id, alone FROM s)),
d AS (
  SELECT no, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM s JOIN ids ON ids.conv_id IS NOT DISTINCT FROM s.conv_id AND ids.alone = s.alone CROSS JOIN range(2) AS c(copy)
  WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY no, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ \t-\r]*\z') THEN 'truncated' ELSE '' END AS fault,
    left(lag(role) OVER (PARTITION BY no ORDER BY k), 1) || left(role, 1) AS pair FROM o),
facts AS (
  SELECT no, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY no),
moves(state, initial, after) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
inserts(state, after, letters, lines, cost) AS (
  SELECT state, state, '', '', 0 FROM (SELECT DISTINCT state FROM moves)
  UNION ALL SELECT state, after, 'I', CASE initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10), 5 FROM moves WHERE initial <> 's'
  UNION ALL SELECT a.state, b.after, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 10 FROM moves a JOIN moves b ON a.after = b.state WHERE a.state IN ('', 's') AND a.initial <> 's'),
edits AS (
  SELECT no, k, 'D' AS letter, '' AS initial, 2 AS cost, '' AS line FROM f
  UNION ALL SELECT no, k, 'K', left(role, 1), CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, role || ':' || text || chr(10) FROM f
    WHERE fault NOT IN ('blank', 'duplicate') AND left(role, 1) IN ('s', 'u', 'a')
  UNION ALL SELECT no, k, 'R', initial, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, role_name || ':' || text || chr(10)
    FROM f CROSS JOIN (VALUES ('u', 'user'), ('a', 'assistant')) AS r(initial, role_name) WHERE fault NOT IN ('blank', 'duplicate')),
p(no, k, state, cost, audit, said) AS (
  SELECT no, 0::BIGINT, after, inserts.cost, letters, lines FROM ids CROSS JOIN inserts WHERE state = ''
  UNION ALL
  SELECT no, k, state, best.cost, best.audit, best.said FROM (
    SELECT p.no, p.k + 1 AS k, i.after AS state,
      min({{'cost': p.cost + e.cost + i.cost, 'audit': p.audit || e.letter || i.letters, 'said': p.said || e.line || i.lines}}) AS best
    FROM p JOIN edits e ON e.no = p.no AND e.k = p.k + 1
    JOIN (SELECT state, initial, after FROM moves UNION ALL SELECT DISTINCT state, '', state FROM moves) m ON m.state = p.state AND m.initial = e.initial
    JOIN inserts i ON i.state = m.after GROUP BY p.no, p.k, i.after)),
r AS (
  SELECT p.no, min({{'cost': p.cost, 'audit': p.audit, 'said': p.said}}) AS best FROM p LEFT JOIN facts USING (no)
  WHERE p.k = coalesce(facts.n, 0) AND p.state IN ('', 'a') GROUP BY p.no)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(left(best.said, greatest(length(best.said) - 1, 0))) AS repaired_sha256
FROM ids JOIN r USING (no) LEFT JOIN facts USING (no)
"""
