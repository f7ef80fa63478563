"""The prefix trie, the secret tagger and the structure repair against brute-force versions, on tables with nulls, ties, repeated
rows, missing ids, empty and very long texts, extra columns with clashing names, and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import prefix_trie, secret_tags, structure_repair

TURNS = "conv_id long, turn long, role string, text string, key string, part int, n double"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], TURNS).repartition(5)


def some_turns():
    rng = random.Random(3)
    rows = []
    for c in [*range(60), 100, 101, 150, -7, 200, 201, 202]:
        first = rng.choice([2, 3, 9])
        for t in range(rng.choice([1, 2, 3, 4, 6, 8])):
            text = f"shared {first} {t}" if t < 3 and rng.random() < 0.7 else rng.choice(["é東", "", "own", f"own {c}"])
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2], text))
    rows += [(300, t, "user", "same") for t in range(70)] + [(301, t, "user", "same") for t in range(70)]
    rows += [(7, None, "system", "first"), (7, None, None, None), (8, 1, None, None), (9, 2, "user", None)]
    rows += [rows[0], (None, 1, "user", "shared 2 0"), (None, None, None, None), (None, 1, "user", "shared 2 0")]
    rows += [(c, 0, "user", "hot") for c in range(1000, 1080)] + [(c, 1, "assistant", "hot") for c in range(1000, 1080)]
    return rows


def read_in_order(rows):
    """Turns of each conversation in the trie's order; rows without an id are conversations of their own."""
    found = defaultdict(list)
    for k, (c, turn, role, text) in enumerate(rows):
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
        found[c if c is not None else ("alone", k)].append(((turn is not None, turn or 0), digest, role, text))
    return {c: [(r, t) for *_, r, t in sorted(own, key=lambda x: x[:2])] for c, own in found.items()}


def brute_rebuilt(rows):
    own = read_in_order(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if isinstance(c, int) else 0
        base = int(c - np.fmod(c, 100)) if isinstance(c, int) else None
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_nodes(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    number = lambda ids: sorted(i for i in ids if isinstance(i, int))
    kids = Counter(path[:-1] for path in members if path)
    out = []
    for path, ids in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = number(c for c in ids if len(conversations[c]) == len(path))
        low = min(number(ids), default=None)
        up = min(number(members[path[:-1]]), default=None) if path else None
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        out.append((low, len(path), up, len(ids), kids[path], sum(not kids[p] for p in under), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def as_sorted(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_trie_equals_all_prefixes(spark, parts):
    rows = some_turns()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        table = turns_of(spark, rows)
        assert as_sorted(prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.paths(table))).collect()) == as_sorted(brute_nodes(brute_rebuilt(rows)))
        assert as_sorted(prefix_trie.prefix_trie(table).collect()) == as_sorted(brute_nodes(read_in_order(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(turns_of(spark, [])).count() == 0
    only = prefix_trie.prefix_trie(turns_of(spark, [(None, None, None, None)])).collect()
    assert sorted((r.depth, r.conv_id, r.n_convs) for r in only) == [(0, None, 1), (1, None, 1)]


def test_trie_in_random_batches():
    rng = random.Random(8)
    strings = [tuple(rng.choice("ab") for _ in range(rng.choice([0, 1, 3, 8, 40]))) for _ in range(300)]
    trie = prefix_trie.ZFastTrie()
    keyed = [([b"", *("".join(s[: d + 1]).encode() for d in range(len(s)))], [0] * (len(s) + 1), k) for k, s in enumerate(strings)]
    for at in range(0, 300, 37):
        trie.insert_batch(keyed[at : at + 37])
    prefixes = {s[:d] for s in strings for d in range(len(s) + 1)}
    branching = {p for p in prefixes if len({q[len(p)] for q in prefixes if len(q) == len(p) + 1 and q[: len(p)] == p}) > 1}
    found = trie.nodes()
    assert {tuple(n.keys[n.end].decode()) for n in found} == branching | set(strings) | {()}
    assert sum(len(n.ends) for n in found) == 300
    for n in found[1:]:
        f = prefix_trie.fattest(n.top, n.end)
        assert n.top < f <= n.end and max((f2 & -f2) for f2 in range(n.top + 1, n.end + 1)) == f & -f
        assert trie.at[n.keys[f]] is n
    for keys, _, k in keyed:
        assert k in trie.exit_node(keys).ends


# secrets


def brute_base(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate([
        ("assign", r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32),
    ]):
        at = 0
        while m := re.compile(pattern).search(text, at):
            at = m.end()
            if len(m[group]) >= least:
                out.append((m.start(), rank, kind, m.end()))
    return [(a, b, kind) for a, _, kind, b in sorted(out)]


@pytest.fixture(scope="module")
def tagger():
    return secret_tags.fit(secret_tags.labelled_texts())


def test_base_spans():
    rng = random.Random(1)
    parts = ["password", "PassWd", "ſecret", "toKen", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "AKIAB", "deadbeef", "0123456789abcdef", "XYZ", "é", "東", "-", "\n", "Aa0"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert secret_tags.base_spans(text) == brute_base(text)
    assert secret_tags.base_spans("password=token:abcdefgh12") == []  # the failing match takes "token"


def test_best_labels_are_viterbis():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 8, 9, 64, 300):
        emit = rng.integers(-(1 << 24), 1 << 24, (n, 3))
        moves = rng.integers(-(1 << 23), 1 << 23, (3, 3))
        moves[0, 2] = secret_tags.NEVER
        best, back = moves[0] + emit[0], []
        for t in range(1, n):
            ways = best[:, None] + moves
            back.append(ways.argmax(0))
            best = ways.max(0) + emit[t]
        want = [int(best.argmax())]
        for b in reversed(back):
            want.append(int(b[want[-1]]))
        for block in (1, 4, 8, 128):
            assert secret_tags.best_labels(emit, moves, block).tolist() == want[::-1]


def test_tagger_on_held_out_texts(tagger):
    texts = secret_tags.labelled_texts(600, seed=99)
    hit = wrong = missed = 0
    together = tagger.tags([t for t, _ in texts])
    for (text, spans), labels in zip(texts, together):
        got = set(tagger.spans(text, labels))
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.85 and hit / (hit + missed) > 0.85
    for (text, _), labels in list(zip(texts, together))[:80]:  # alone as among others
        assert tagger.tags([text])[0].tolist() == labels.tolist()


def test_tagger_adds_and_spares(tagger):
    key = "ghp_" + "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY1zA2"
    text = f"the on ing {key} li en"
    assert [text[a:b] for a, b in tagger.spans(text, tagger.tags([text])[0])] == [key]
    clean = ["", " ", "the on ing. Enra 42.144.35.254 an 4041894974608795 re", "bosbt.42@mail8.example.com the", "ONHESHED!! IN!! in### de%%% la$$$", "SPDX-License-Identifier: MIT", "see the password policy", "x " * 30_000]
    assert not any(labels.any() for labels in tagger.tags(clean))


def test_secrets_of_tables(spark, tagger):
    schema = "doc_id long, text string, spans string, kind int"
    texts = [None, "", "  ", "\n", "password=abcdefgh1", "password=abcdefgh1", "x" * 300_000, "0a" * 20 + " é東 TOKEN: 'abcd.efgh'", "AKIA" + "Q" * 16, "the ghp_aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY1zA2 on"]
    rows = [(k if k != 5 else 4, t, "s", 1) for k, t in enumerate(texts)] + [(None, "secret = 12345678", "s", 1)]
    got = secret_tags.secrets(spark.createDataFrame(rows, schema).repartition(3), tagger).collect()
    assert len(got) == len(rows)
    by_text = {(r[0], r[1]) for r in rows}
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and by_text
    for doc_id, text in by_text:
        spans = [(s.start, s.end, s.kind) for s in next(r for r in got if r.doc_id == doc_id).spans]
        assert [s for s in spans if s[2] != "tagged"] == brute_base(text or "")
        assert spans == sorted(spans, key=lambda s: s[0])
    assert [(s.start, s.end) for s in next(r for r in got if r.doc_id == 9).spans if s.kind == "tagged"] == [(4, 44)]
    assert secret_tags.secrets(spark.createDataFrame([], schema), tagger).count() == 0


def test_long_texts_are_chunked(spark, tagger):
    text = ("the on ing li en mo " * 40 + "password=abcdefgh1 ") * 3000
    labels = tagger.tags([text])[0]
    assert len(secret_tags.base_spans(text)) == 3000 and labels.any()


# repairs


def brute_lightest(rows):
    """The least (cost, audit) of all edit strings; insertions beyond two in a row can't help."""
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    ways = {("", 0, "")}
    for k in range(len(rows) + 1):
        ways = {(i + x, c + 5 * len(x), a + "I" * len(x)) for i, c, a in ways for x in inserts}
        ways = {w for w in ways if re.fullmatch("(s?(ua)*u?)?", w[0])}
        best = {}
        for i, c, a in ways:  # what has been said only counts by its end
            state = i[-1:]
            best[state] = min(best.get(state, (c, a, i)), (c, a, i))
        ways = {(i, c, a) for c, a, i in best.values()}
        if k == len(rows):
            return min((c, a) for i, c, a in ways if re.fullmatch("(s?(ua)+)?", i))
        role, must_go, truncated = rows[k]
        edits = [("", 2, "D")]
        if not must_go:
            edits += [("u", 1 + 5 * truncated, "R"), ("a", 1 + 5 * truncated, "R")] + [(role[:1], 5 * truncated, "K")] * (role[:1] in ("s", "u", "a"))
        ways = {(i + x, c + y, a + z) for i, c, a in ways for x, y, z in edits}


def test_lightest_derivation():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 5, 8, 30):
        for _ in range(150):
            rows = [(rng.choice(["user", "assistant", "system", "tool", "", "user"]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
            assert structure_repair.lightest(rows) == brute_lightest(rows)


def test_audits_are_ordered_as_strings():
    rng = random.Random(6)
    audits = structure_repair.Audits()
    held = {}
    for _ in range(400):
        text = "".join(rng.choice("DI") for _ in range(rng.randint(0, 9))) if rng.random() < 0.5 else "K" * rng.randint(0, 60) + rng.choice("DR")
        node = 0
        for letter in text:
            node = audits.join(node, letter)
        held[text] = node
        assert audits.text(node) == text
    for a in held:
        for b in rng.sample(sorted(held), 20):
            assert audits.less(held[a], held[b]) == (a < b)


def brute_repairs(rows, damage):
    """Result rows by plain Python, as the query gives them."""
    groups = defaultdict(list)
    for k, (c, turn, role, text) in enumerate(rows):
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20 if damage else 9
        own = groups[c if c is not None else ("alone", k)]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [((turn is not None, turn or 0), role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for c, own in groups.items():
        own.sort()
        seen, faults = set(), []
        for _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        cost, audit = brute_lightest([(r, f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(own, faults)])
        said, at = [], 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[at][1:]
            at += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if said and said[-1][0] == "u" else "user"
            said.append(f"{role}:{text}")
        known = [t[1] for t, *_ in own if t[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append((c if isinstance(c, int) else None, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


@pytest.mark.parametrize("damage", [False, True])
def test_repairs(spark, damage):
    rng = random.Random(7)
    rows = []
    for c in range(120):
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Fine.", "no stop", "What?\n ", "é! ", " ", None, f"own {t}."])))
    rows += [rows[0], rows[0], (None, 1, "user", "a."), (None, 1, "user", "a."), (500, 3, "user", "x" * 100_000 + "."), (501, None, None, None)]
    ready = structure_repair.with_ids(turns_of(spark, rows))
    made = structure_repair.repaired(structure_repair.gathered(structure_repair.damaged(ready) if damage else ready))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    made = made.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said.cast("binary"), 256))
    assert as_sorted(made.collect()) == as_sorted(brute_repairs(rows, damage))


def test_repairs_of_nothing_and_of_long_conversations(spark):
    assert structure_repair.repair_conversations(turns_of(spark, [])).count() == 0
    rows = [("user", False, False), ("user", False, True)] * 3000
    cost, audit = structure_repair.lightest(rows)
    assert len(audit) == 6000 and cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in audit)
    assert structure_repair.apply_audit([], "") == []
    with pytest.raises(ValueError):
        structure_repair.apply_audit([("user", "x")], "K")
