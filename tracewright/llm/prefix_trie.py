"""The trie of all conversations' prefixes, built as z-fast tries.

A conversation is the string of its turns. Sorted by their turns, conversations lie in the trie's depth-first order and are
range-partitioned so, however many share their first turns. Each task builds the z-fast trie of its run of
conversations: compacted nodes are hashed by their handle, the prefix whose length is the two-fattest number on the
node's edge, so a conversation's exit node is found by a fat binary search of as many look-ups as its length has bits.
Conversations are inserted in batches: exit nodes first, then those that leave at the same node one after the other.
At last the edges are expanded into a node for each turn.

A node is in more than one task only if it is a prefix of the first or the last conversation of each. These border nodes
(at most twice the longest conversation for each task) are merged by their prefix digests. What lies under one of them
is an interval of the order: its own share of the first and the last task, and the totals of the tasks between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, small, table

#: Turns for a task: more partitions than spark.sql.shuffle.partitions are made if there would be more.
TASK_TURNS = 500_000
#: Borrowed turns of the query: fewer than BORROWED, from the conversation that begins the block of BLOCK ids.
BLOCK, BORROWED = 100, 6
DIGEST_BYTES = 16
EMPTY = hashlib.sha256(b"").hexdigest()
ROWS_A_BATCH = 10_000


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """A compacted node. Its edge has the depths (top, end]; ``keys[d]`` is the digest of the first d turns of a
    conversation that goes through it."""

    __slots__ = ("keys", "chars", "top", "end", "parent", "children", "ends", "n", "low", "leaves", "saved")

    def __init__(self, keys: list[bytes], chars: list[int], top: int, end: int, parent: Node | None):
        self.keys, self.chars, self.top, self.end, self.parent = keys, chars, top, end, parent
        self.children: dict[bytes, Node] = {}
        self.ends: list[int | None] = []


class ZFastTrie:
    """Compacted nodes by the digests of their handles."""

    def __init__(self):
        root = [b""]
        self.root = Node(root, [0], -1, 0, None)
        self.at: dict[bytes, Node] = {}

    def exit_node(self, keys: list[bytes], start: Node | None = None) -> Node:
        """Where a conversation leaves the trie: the node on whose edge it ends or departs, else the deepest one whose
        extent is a prefix of it. ``start``: a node whose extent is known to be a prefix."""
        node = start or self.root
        low, high = node.end, len(keys) - 1
        while low < high:
            f = fattest(low, high)
            hit = self.at.get(keys[f])
            if hit is None:
                high = f - 1
                continue
            node = hit
            if hit.end >= len(keys) or hit.keys[hit.end] != keys[hit.end]:
                return hit
            low = hit.end
        return node.children.get(keys[node.end + 1], node) if node.end + 1 < len(keys) else node

    def insert(self, keys: list[bytes], chars: list[int], conv_id: int | None, node: Node) -> None:
        """Adds a conversation that leaves at ``node``: splits its edge where they part, and hangs the rest below."""
        last = len(keys) - 1
        low, high = max(node.top, 0), min(node.end, last)
        while low < high:  # digests of prefixes are equal as far as the conversations are
            middle = (low + high + 1) // 2
            if node.keys[middle] == keys[middle]:
                low = middle
            else:
                high = middle - 1
        if low < node.end:
            node = self._split(node, low)
        if low < last:
            leaf = Node(keys, chars, low, last, node)
            node.children[keys[low + 1]] = leaf
            self.at[keys[fattest(low, last)]] = leaf
            node = leaf
        node.ends.append(conv_id)

    def _split(self, node: Node, depth: int) -> Node:
        upper = Node(node.keys, node.chars, node.top, depth, node.parent)
        del self.at[node.keys[fattest(node.top, node.end)]]
        node.parent.children[node.keys[node.top + 1]] = upper
        node.top, node.parent = depth, upper
        upper.children[node.keys[depth + 1]] = node
        self.at[upper.keys[fattest(upper.top, depth)]] = upper
        self.at[node.keys[fattest(depth, node.end)]] = node
        return upper

    def insert_batch(self, batch: list[tuple[list[bytes], list[int], int | None]]) -> None:
        """Finds the exit nodes of all, then inserts group by group; within a group, all but the first search on from
        the extent above their exit node. A group's insertions don't change another group's exit nodes."""
        groups: dict[int, tuple[Node, list]] = {}
        for one in batch:
            node = self.exit_node(one[0])
            groups.setdefault(id(node), (node, []))[1].append(one)
        for node, own in groups.values():
            above = node.parent or self.root
            for k, (keys, chars, conv_id) in enumerate(own):
                self.insert(keys, chars, conv_id, self.exit_node(keys, above) if k else node)

    def nodes(self) -> list[Node]:
        """All compacted nodes, parents before children."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            out.append(node)
            todo.extend(node.children.values())
        return out


def _least(values) -> int | None:
    return min((v for v in values if v is not None), default=None)


def _joined(ids: list[int | None]) -> str:
    return ",".join(map(str, sorted(i for i in ids if i is not None)))


_COLUMNS = [
    ("part", pa.int32()), ("at", pa.int32()), ("fork", pa.int32()), ("key", pa.binary()), ("up", pa.binary()), ("up_at", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends", pa.string()),
]
_SCHEMA = "part int, at int, fork int, key binary, up binary, up_at int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string"


def expanded(trie: ZFastTrie, first: list[bytes], last: list[bytes], part: int) -> Iterator[tuple]:
    """A row for each turn's node, as in _COLUMNS. Of a border node (``at`` is its place among those of this part) only
    what lies in this part and under no other border node counts, and ``ends`` are ids; all other rows are final,
    but that a parent's conv_id is left out where the parent is a border node (``up_at``)."""
    fork = 0
    while fork + 1 < min(len(first), len(last)) and first[fork + 1] == last[fork + 1]:
        fork += 1
    border = {key: k for k, key in enumerate([*first, *last[fork + 1 :]])}
    order = trie.nodes()
    for node in reversed(order):
        below = node.children.values()
        node.n = len(node.ends) + sum(c.n for c in below)
        node.low = _least([_least(node.ends), *(c.low for c in below)])
        node.leaves = sum(c.leaves for c in below) or 1
        node.saved = sum(c.saved for c in below) + (node.n - 1) * sum(node.chars[max(node.top + 1, 0) : node.end + 1])
    for node in order:
        inner = [c for c in node.children.values() if c.keys[node.end + 1] not in border]
        saved = sum(c.saved for c in node.children.values())
        for depth in range(node.end, max(node.top, -1), -1):
            key, at_end = node.keys[depth], depth == node.end
            saved += (node.n - 1) * node.chars[depth]
            up = node.keys[depth - 1] if depth else None
            if (at := border.get(key)) is not None:
                if at_end:
                    facts = (len(inner), sum(c.leaves for c in inner), sum(c.saved for c in inner))
                elif node.keys[depth + 1] in border:
                    facts = (0, 0, 0)
                else:
                    facts = (1, node.leaves, saved - (node.n - 1) * node.chars[depth])
                yield (part, at, fork, key, up, None, depth, node.low, None, node.n, *facts, node.chars[depth], _joined(node.ends) if at_end else "")
                continue
            up_at = border.get(up)
            parent = None if up_at is not None else node.low if depth - 1 > node.top else node.parent.low
            digest = hashlib.sha256(_joined(node.ends).encode()).hexdigest() if at_end and node.ends else EMPTY
            yield (part, None, None, None, None, up_at, depth, node.low, parent, node.n, len(node.children) if at_end else 1, node.leaves, saved, None, digest)


def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The expanded nodes of a partition of conversations (conv_id, digests, chars) in order."""
    trie, first, last = ZFastTrie(), None, None
    for batch in batches:
        ids, digests, chars = (batch.column(k) for k in range(3))
        sizes, flat, flat_chars = digests.value_lengths().to_pylist(), digests.flatten().to_pylist(), chars.flatten().to_pylist()
        found, at = [], 0
        for conv_id, size in zip(ids.to_pylist(), sizes):
            keys, key = [b""], b""
            for digest in flat[at : at + size]:
                key = hashlib.sha256(key + digest).digest()[:DIGEST_BYTES]
                keys.append(key)
            found.append((keys, [0, *flat_chars[at : at + size]], conv_id))
            at += size
        if found:
            first, last = first or found[0][0], found[-1][0]
            trie.insert_batch(found)
    if first is None:
        return
    rows: list[tuple] = []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLUMNS)], names=[n for n, _ in _COLUMNS])

    for row in expanded(trie, first, last, TaskContext.get().partitionId()):
        rows.append(row)
        if len(rows) == ROWS_A_BATCH:
            yield packed()
            rows = []
    if rows:
        yield packed()


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, and digests and chars (code points of the text) of its turns in order; texts aren't shuffled.

    Null roles and texts are empty. Turns without a number come first; those of the same number are ordered by the digests
    of role and text. Rows without a conv_id are conversations of their own."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn"), F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, DIGEST_BYTES).alias("digest"), F.length(text).alias("chars"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    known = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    both = known.unionByName(rows.filter("conv_id is null").select("conv_id", F.array("turn").alias("turns")))
    return both.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"))


def rebuilt(conversations: DataFrame, block: int = BLOCK, borrowed: int = BORROWED) -> DataFrame:
    """Every conversation of ``paths`` c with its first h turns replaced by those of conversation c - c % block (all if it
    has fewer, none if there is no such one), h being crc32 of c as text modulo ``borrowed``; without an id, h is 0."""
    lead = conversations.filter(F.col("conv_id") % block == 0)
    lead = lead.select(F.col("conv_id").alias("base"), F.slice("digests", 1, borrowed - 1).alias("lead_digests"), F.slice("chars", 1, borrowed - 1).alias("lead_chars"))
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % borrowed, F.lit(0)).cast("int")
    both = conversations.withColumns({"base": F.col("conv_id") - F.col("conv_id") % block, "h": h}).join(lead, "base", "left")

    def mixed(name: str):
        own = F.slice(name, F.col("h") + 1, F.greatest(F.size(name) - F.col("h"), F.lit(0)))
        return F.when(F.col(f"lead_{name}").isNull(), own).otherwise(F.concat(F.slice(f"lead_{name}", F.lit(1), F.col("h")), own)).alias(name)

    return both.select("conv_id", mixed("digests"), mixed("chars"))


def _streamed_digests(chunks: DataFrame) -> DataFrame:
    """key and ends_sha256 of all ids that end at it. The chunks of a key lie in the order of their parts and are hashed one
    after the other: SHA-256 can't be shared out, but a task holds one part's ids at a time."""
    ordered = chunks.repartition("key").sortWithinPartitions("key", "part").select("key", "ends")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([now.hexdigest()])], names=["key", "ends_sha256"])
        for batch in batches:
            for k in range(batch.num_rows):
                own, ids = batch.column(0)[k].as_py(), batch.column(1)[k].as_py().encode()
                if now is not None and own == key:
                    now.update(b"," + ids)
                    continue
                if now is not None:
                    yield give()
                key, now = own, hashlib.sha256(ids)
        if now is not None:
            yield give()

    return ordered.mapInArrow(digest, "key binary, ends_sha256 string")


def _merged(border: DataFrame) -> DataFrame:
    """One row for each border node: what its parts add up to, its children among the border nodes included."""
    found = border.groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"),
        F.min("part").alias("from_part"), F.max("part").alias("to_part"), F.max("chars").alias("chars"), F.max("up").alias("up"),
    )
    kids = found.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("kids"))
    return found.join(kids, "key", "left").withColumn("n_children", F.col("inner") + F.coalesce("kids", F.lit(0))).drop("inner", "kids")


def _subtrees(border: DataFrame, merged: DataFrame) -> DataFrame:
    """key, n_leaves and saved_tokens of the whole subtrees of border nodes.

    A border node's own leaf and savings count in the first part that has it. In a part, its border nodes are two paths
    that part at ``fork``; sums along them are the part's share. Of the parts between a node's first and last one all
    counts, which sums up to each part give."""
    facts = merged.select("key", "from_part", "to_part", (F.col("n_children") == 0).cast("long").alias("own_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own_saved"))
    rows = border.select("part", "at", "fork", "key", "depth", "n_leaves", "saved_tokens").join(facts, "key")
    is_first = F.col("part") == F.col("from_part")
    rows = rows.withColumns({"n_leaves": F.col("n_leaves") + F.when(is_first, F.col("own_leaves")).otherwise(0), "saved_tokens": F.col("saved_tokens") + F.when(is_first, F.col("own_saved")).otherwise(0)})
    totals = settled(rows.groupBy("part").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n_leaves", "saved_tokens")}
    sums = totals.select("part", *(s.alias(f"{c}_before") for c, s in sums.items()), *((s + F.col(c)).alias(f"{c}_through") for c, s in sums.items()))
    late = (F.col("at") > F.col("first_length")).cast("int")  # on the last conversation's path, beyond the fork
    rows = rows.withColumn("first_length", F.max(F.when(F.col("at") == F.col("depth"), F.col("at"))).over(Window.partitionBy("part"))).withColumn("late", late)
    along = Window.partitionBy("part", "late").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("part")
    here = {}
    for c in ("n_leaves", "saved_tokens"):
        beyond = F.sum(F.when(F.col("late") == 1, F.col(c))).over(whole)
        here[c] = F.sum(c).over(along) + F.when((F.col("late") == 0) & (F.col("depth") <= F.col("fork")), F.coalesce(beyond, F.lit(0))).otherwise(0)
    shares = rows.select("key", "part", "from_part", "to_part", *(v.alias(c) for c, v in here.items()))
    shares = shares.filter("part = from_part or part = to_part").join(small(sums), "part")
    across = F.col("from_part") < F.col("to_part")
    more = {c: F.when(across & (F.col("part") == F.col("from_part")), -F.col(f"{c}_through")).when(across, F.col(f"{c}_before")).otherwise(0) for c in here}
    return shares.groupBy("key").agg(*(F.sum(F.col(c) + more[c]).alias(c) for c in here))


def nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, digests, chars as ``paths`` gives them).

    conv_id is the smallest member's id (null if no member has one), depth the number of turns, parent_conv_id the parent's
    conv_id (null for the root), n_convs the members, n_children the children, n_leaves the childless nodes of the
    subtree (itself included), saved_tokens the sum over the subtree of (n_convs - 1) times the code points of a node's
    text, ends_sha256 the digest of the ascending, comma-joined ids that end there. A conversation without turns belongs
    to the root alone; without conversations there is no node. Equal conversations are members of the same nodes.
    A conversation is one row, so it must fit a task.
    """
    spark = conversations.sparkSession
    conversations = settled(conversations.select("conv_id", "digests", "chars"))
    turns = conversations.agg(F.coalesce(F.sum(F.size("digests") + 1), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TASK_TURNS))
    ordered = conversations.repartitionByRange(parts, "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    local = settled(ordered.mapInArrow(grown, _SCHEMA))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = local.filter("at is null").withColumnRenamed("ends", "ends_sha256")
    border = local.filter("at is not null")
    merged = settled(_merged(border))
    names = merged.select("key", F.col("conv_id").alias("known_conv_id"))
    places = settled(border.select("part", F.col("at").alias("up_at"), "key").join(names, "key").drop("key"))
    hung = inside.filter("up_at is not null").join(small(places), ["part", "up_at"]).withColumn("parent_conv_id", F.col("known_conv_id"))
    digests = _streamed_digests(border.filter("ends != ''").select("key", "part", "ends"))
    parents = names.select(F.col("key").alias("up"), F.col("known_conv_id").alias("parent_conv_id"))
    top = merged.join(_subtrees(border, merged), "key").join(digests, "key", "left").join(parents, "up", "left")
    top = top.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return inside.filter("up_at is null").select(*out).unionByName(hung.select(*out)).unionByName(top.select(*out))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """``nodes`` of the conversations in ``turns`` (conv_id, turn, role, text); other columns are not read."""
    return nodes(paths(turns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(rebuilt(paths(table(spark, sf_dir, "conversations"))))


#: CRC-32 of a conv_id as text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c.conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""

SQL = f"""
WITH s AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (
  SELECT conv_id, alone, length(text) AS chars, sha256(length(role) || ':' || role || text) AS said,
    row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS k FROM s),
c AS (SELECT DISTINCT conv_id, alone, row_number() OVER (ORDER BY conv_id, alone) AS no FROM (SELECT DISTINCT conv_id, alone FROM s)),
h AS (SELECT c.*, CASE WHEN conv_id IS NULL THEN 0 ELSE ({_CRC}) % 6 END AS h FROM c),
r AS (
  SELECT h.no, h.conv_id, b.k, b.said, b.chars FROM h JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100 AND b.k <= h.h
  UNION ALL
  SELECT h.no, h.conv_id, o.k, o.said, o.chars FROM h JOIN o ON o.conv_id IS NOT DISTINCT FROM h.conv_id AND o.alone = h.alone AND o.k > h.h),
p AS (SELECT no, conv_id, chars, row_number() OVER w AS depth, string_agg(said, '') OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM r WINDOW w AS (PARTITION BY no ORDER BY k)),
q AS (
  SELECT no, conv_id, depth, chars, sha256(path) AS key, coalesce(lag(sha256(path)) OVER (PARTITION BY no ORDER BY depth), '') AS up,
    depth = max(depth) OVER (PARTITION BY no) AS ends FROM p
  UNION ALL SELECT no, conv_id, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM r WHERE r.no = h.no) FROM h),
n AS (
  SELECT key, min(conv_id) AS conv_id, min(no) AS a_member, min(depth) AS depth, min(up) AS up, count(*) AS n_convs, min(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM q GROUP BY key),
k AS (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
t AS (
  SELECT a.key, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved_tokens
  FROM m JOIN q a ON a.no = m.a_member AND a.depth <= m.depth GROUP BY a.key)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children,
  CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN t USING (key) LEFT JOIN m u ON m.up = u.key
"""
