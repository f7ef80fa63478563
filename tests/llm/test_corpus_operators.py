"""Every operator against a brute-force version or a round trip, on small tables with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns whose names clash."""

import gzip
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations_with_replacement
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tracewright.llm import chat, common, exact_dedup, html_main, packing, repetition, sentence_pieces, sharding, simhash, toxicity, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, kept string, fp string, n double"


def frame(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def odd_texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Été", "ß", "日本", "of,", "x."]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = body(9000)
    one = body(120)
    near = one.replace("w1 ", "w2 ", 1)
    texts = [None, "", "  ", "\n", "a", "a b", one, one, one.upper(), near, long, long + " end", "Same", "same", "same", "\tx\x0by\n"]
    texts += [body(rng.randint(1, 200)) for _ in range(60)]
    texts += [f"{one} {body(2)}" for _ in range(8)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en") for i, t in enumerate(odd_texts())]
    rows += [(None, "no id"), (None, "no id"), (7, rows[7][1], "en")]  # null ids, and a repeated row
    return frame(spark, rows).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# op2


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("k", [2, 512])
def test_exact_dedup(docs, empty, k):
    source = docs.collect()
    groups = {}
    for r in source:
        groups.setdefault(low(r.text), []).append(r.doc_id)
    got = rows_of(exact_dedup.exact_dedup(docs, k=k))
    assert len(got) == len(source)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(list(by_digest))
    kept = exact_dedup.deduplicate(docs, k=k)
    assert kept.columns == docs.columns
    assert sorted(low(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_misra_gries_finds_frequent_values():
    rng = random.Random(2)
    held, truth = {}, Counter()
    for _ in range(30):
        batch = Counter(rng.choice(["a", "b", *map(str, range(300))]) if rng.random() < 0.5 else "a" for _ in range(500))
        truth.update(batch)
        held = exact_dedup.merge_counts(held, batch, 8)
        assert len(held) <= 8
    n = sum(truth.values())
    assert all(v in held for v, c in truth.items() if c > n / 9)
    assert all(0 <= truth[v] - c <= n / 9 for v, c in held.items())


# op9


def brute_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, empty):
    source = docs.collect()
    fps = [brute_fingerprint(r.text) for r in source]
    root = list(range(len(source)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(source):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f, least.get(find(i))) for i, (r, f) in enumerate(zip(source, fps)))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows_of(simhash.near_duplicates(docs)))
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(len(fps))})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_one_row_of_each_component_stays_where_ids_are_null_or_shared(spark, monkeypatch):
    rng = random.Random(8)
    a, b, c, d, e, f, g, h = (" ".join(f"{name}{rng.randint(0, 999)}" for _ in range(80)) for name in "abcdefgh")
    rows = [(None, a), (None, a), (None, b)]  # two unrelated texts without ids
    rows += [(5, c), (5, d), (9, d)]  # one id of two unrelated texts, the smallest of both components
    rows += [(6, e), (None, e), (2, f), (2, f), (3, g), (None, h), (6, h)]
    want = sorted([(5, c), (5, d), (6, e), (2, f), (3, g), (6, h), (None, a), (None, b)], key=str)
    for heavy in (1, 512):  # no shared id is hot but null, or all are
        monkeypatch.setattr(simhash, "HEAVY", heavy)
        kept = simhash.keep_one(frame(spark, rows).repartition(3))
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
    named = [(None if i is None else f"n{i}", t) for i, t in rows]
    kept = simhash.keep_one(spark.createDataFrame(named, "doc_id string, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i and f"n{i}", t) for i, t in want), key=str)


def test_all_close_fingerprints_are_linked(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for r in (1, 2, 3, 4):
            for _ in range(4):
                fps.add(f ^ sum(1 << int(b) for b in rng.choice(64, r, replace=False)))
    fps = sorted(fps)
    a = np.array(fps, np.uint64)
    want = {frozenset((x, y)) for i, x in enumerate(fps) for y in a[i + 1 :][np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3].tolist()}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.links(df).collect()}
    assert got == want and len(want) > 400


def test_crowded_keys_link_the_same_components(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = [int(v) for v in rng.integers(0, 1 << 63, 3)]
    fps = sorted({c ^ sum(1 << int(b) for b in rng.choice(64, r, replace=False)) for c in centre for r in (0, 1, 2, 3, 5) for _ in range(25)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")

    def parts(pairs):
        root = {f: f for f in fps}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for x, y in pairs:
            root[find(x)] = find(y)
        return sorted(sorted(f for f in fps if find(f) == r) for r in {find(f) for f in fps})

    close = [(x, y) for i, x in enumerate(fps) for y in fps[i + 1 :] if (x ^ y).bit_count() <= 3]
    for full in (0, 5, 1000):
        monkeypatch.setattr(simhash, "FULL", full)
        got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()]
        assert all((x ^ y).bit_count() <= 3 for x, y in got)
        assert parts(got) == parts(close)


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 2000).astype(np.uint32)
    code = simhash.nearest(v)
    every = np.array([m << 11 | simhash._remainder(m << 11) for m in range(1 << 12)], np.uint32)
    assert simhash.nearest(every).tolist() == list(range(1 << 12))
    words = np.array([int(c) << 11 | simhash._remainder(int(c) << 11) for c in code], np.uint32)
    assert (np.bitwise_count(words ^ v) <= 3).all()


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_of_long_chains(spark, monkeypatch, few):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (200, 150)]
    monkeypatch.setattr(simhash, "FEW", few)
    got = {r.fp: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[105] == 100 and got[200] == got[150] == 150


# op6


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    for capacity in (64, 4096):
        got = rows_of(packing.pack(docs, path, capacity=capacity))
        source = Counter((r.doc_id, tuple([*whole.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
        want = Counter()
        for (i, ids), n in source.items():
            for k, s in enumerate(range(0, len(ids), capacity)):
                part = np.array(ids[s : s + capacity], "<u4")
                want[(i, k, s, len(part), zlib.crc32(part.tobytes()))] += n
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(r["length"] for r in got)
        assert len(sequences) <= -(-total // capacity) * 1.05 + 1
    assert packing.pack(empty, path).count() == 0


def test_word_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    texts = ["", " ", "It's  DON'T, don't. x.. y.,", "a|b | c ||", "É é É İI ﬁ", "a<|endoftext|>b <|ENDOFTEXT|> <|", "tab\tsep\x0b nbsp line", "12,5 3.14. 日本。"]
    texts += ["".join(random.Random(k).choice("ab .,|'é\n<>1É̈") for _ in range(80)) for k in range(200)]
    encoder = packing.WordEncoder(path)
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_encode_texts_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["Two  words", "", "A\n\nb é"]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(30))
def test_gaps_are_filled_exactly_whenever_three_lengths_can(seed):
    rng = random.Random(seed)
    n = np.zeros(31, np.int64)
    for _ in range(rng.randint(1, 9)):
        n[rng.randint(1, 29)] += rng.randint(1, 3)
    at_hand = packing._Available(n)
    for length in range(29, 0, -1):
        while n[length]:
            able = [p for k in (1, 2, 3) for p in combinations_with_replacement(range(1, 30), k) if sum(p) == 30 - length and at_hand.times((length, *p))]
            parts = at_hand.exact(length, 30 - length)
            assert (parts is None) == (not able) and (parts is None or tuple(sorted(parts)) in able)
            if parts is None:
                break
            at_hand.take((length, *parts), 1)
        n[length] = 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 500])
    counts = Counter(rng.randint(1, capacity) if rng.random() < 0.8 else capacity // 3 for _ in range(rng.choice([1, 50, 3000])))
    patterns = packing.plan(dict(counts), capacity)
    used = Counter()
    for pattern, m in patterns:
        assert m > 0 and sum(pattern) <= capacity
        for length in pattern:
            used[length] += m
    assert used == counts
    assert packing.plan({}, capacity) == []


def test_plan_fills_complements_exactly():
    patterns = packing.plan({60: 5, 40: 5, 50: 5, 30: 3, 20: 3, 25: 8}, 100)
    assert all(sum(p) == 100 for p, _ in patterns)


# op8


def brute_repeats(words, least):
    n = len(words)
    deepest = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                deepest[i] = max(deepest[i], k)
    covered = {p for i in range(n) if deepest[i] >= least for p in range(i, i + deepest[i])}
    return len(covered), max(deepest, default=0)


def test_suffix_array_repeats():
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        words = [rng.randrange(rng.choice([1, 2, 6, 40])) for _ in range(rng.choice([0, 1, 2, 9, 50, 90]))]
        texts.append(words + words[: rng.randrange(25)])
    flat = np.array([w for t in texts for w in t])
    number = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    covered, long, longest = repetition.repeats(flat, number, len(texts))
    assert [(int(c), int(m)) for c, m in zip(covered, longest)] == [brute_repeats(t, 8) for t in texts]
    assert long.tolist() == [brute_repeats(t, 16)[0] for t in texts]


def test_quality(docs, empty):
    got = rows_of(repetition.quality(docs))
    for r, s in zip(sorted(got, key=str), sorted(got, key=str)):
        assert r == s
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for r in docs.collect():
        text = r.text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        q = by[r.doc_id][0]
        assert q["n_words"] == len(words)
        assert q["word_chars"] == sum(map(len, words))
        assert q["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert q["n_dup_lines"] == len(lines) - len(set(lines))
        if len(words) < 300:
            windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
            inside = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
            assert q["n_repeat_words"] == len(inside)
        failed = len(words) < 20 or 100 * q["n_repeat_words"] > 30 * len(words)
        assert q["base_failed"] == failed and not (failed and q["kept"])
    kept = repetition.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert repetition.quality(empty).count() == 0


def test_long_repeats_are_rejected(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(120))
    body = " ".join(f"b{rng.randrange(10**6)}" for _ in range(600))
    words = [f"c{rng.randrange(10**6)}" for _ in range(60)]
    long = " ".join(words[:30] + [f"d{i}" for i in range(150)] + words[:30])  # 60 of 210 words repeat, in one long run
    short = " ".join(x for k in range(6) for x in (*words[10 * k : 10 * k + 10], f"e{k}", *[f"f{k}.{i}" for i in range(20)])) + " " + " ".join(x for k in range(3) for x in (*words[10 * k : 10 * k + 10], f"g{k}"))
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition.quality(frame(spark, [(1, f"{passage} {body} {passage}"), (2, body), (3, long), (4, short)])).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (False, False), 4: (False, True)}


def test_filters_on_empty_tables_and_clashing_columns(spark, empty):
    assert repetition.keep_good(empty).count() == 0
    names = "doc_id long, text string, quality string, score double, digest string, winner string, fp long, best string"
    body = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, t, "q", 0.5, "d", "w", 1, "b") for i, t in enumerate([body, body, body + " x", "bad"])], names)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    assert repetition.keep_good(df).columns == df.columns and repetition.keep_good(df).count() == 3
    assert exact_dedup.deduplicate(df).columns == df.columns and exact_dedup.deduplicate(df).count() == 3
    assert simhash.keep_one(df).columns == df.columns
    assert toxicity.drop_toxic(df, labels).columns == df.columns and toxicity.drop_toxic(df.limit(0), labels).count() == 0


# op10


def test_sharding(docs, empty):
    got = rows_of(sharding.shard_rows(docs))
    source = docs.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in source)
    slots = {}
    for r in got:
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(empty).count() == 0


def test_draws_equal_a_twin_in_plain_python(spark):
    def twin(key, node, path=""):
        while isinstance(node, dict):
            def draw(c):
                h = xxhash.xxh64_intdigest(f"{path}/{c}".encode(), xxhash.xxh64_intdigest(key.encode(), 42))
                return -math.log(((h >> 12) + 0.5) / (1 << 52)) / sharding._weight(node[c])

            children = sorted(node, key=str)
            best = min(children, key=lambda c: (draw(c), children.index(c))) if len(children) > 1 else children[0]
            node, path = node[best], f"{path}/{best}"
        return int(path.rpartition("/")[2])

    trees = [sharding.topology(16), sharding.topology(17), {"a": {"r": {0: 3.0, 1: 0.5}}, "b": {"r": {2: 1.0}, "s": {3: 2.0, 4: 1.0}}}]
    ids = spark.range(500)
    for tree in trees:
        got = ids.select("id", sharding.place(ids.id.cast("string"), tree).alias("s")).collect()
        assert all(r.s == twin(str(r.id), tree) for r in got)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    ids = frame(spark, [(i, None) for i in range(3000)])
    for shards in (1, 2, 3, 5, 9, 13, 15, 16, 17, 23, 40):
        got = sharding.shard_rows(ids, shards).collect()
        assert {r.shard for r in got} <= set(range(shards)) and len({r.shard for r in got}) == shards
        assert all(r.grown_shard in (r.shard, shards) for r in got) and any(r.grown_shard == shards for r in got)
    nine = {r.doc_id: r for r in sharding.shard_rows(ids, 9).collect()}
    for later in (10, 11):  # the tree goes on as it began
        now = {r.doc_id: r for r in sharding.shard_rows(ids, later, base=9).collect()}
        assert all(now[i].shard == (nine[i].grown_shard if later == 10 else now[i].shard) and now[i].grown_shard in (now[i].shard, later) for i in now)
    with pytest.raises(ValueError):
        sharding.shard_rows(ids, 8, base=9)


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    ids = spark.range(20000)
    tree = sharding.topology(16)
    heavier = json.loads(json.dumps(tree))
    heavier = {a: {b: {int(s): w for s, w in rack.items()} for b, rack in region.items()} for a, region in heavier.items()}
    heavier["region0"]["rack1"][5] = 2.0
    rows = ids.select("id", sharding.place(ids.id, tree).alias("a"), sharding.place(ids.id, heavier).alias("b"), sharding.place(ids.id, sharding.topology(17)).alias("c")).collect()
    share = Counter(r.a for r in rows)
    assert all(abs(share[s] / 1250 - 1) < 0.15 for s in range(16))
    where = {s: (a, b) for a, region in tree.items() for b, rack in region.items() for s in rack}
    for r in rows:
        if r.a != r.b:  # into the heavier region, its heavier rack or the shard
            assert where[r.b][0] == "region0" and (where[r.a][0] != "region0" or where[r.b][1] == "rack1")
        assert r.c in (r.a, 16)
    assert abs(sum(r.c == 16 for r in rows) / (20000 / 17) - 1) < 0.15


# op3


def listed(folder, generation=0):
    return [json.loads(line) for line in Path(f"{folder}/manifest-{generation:06d}.jsonl").read_text().splitlines()]


PAGES = "page_id long, url string, html string, payload string"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>é</p>" * 40
    rows = [(i, f"http://x/{i}", long if i % 3 == 0 else f"<p>{i}</p>" * (i % 40)) for i in range(60)]
    rows += [(90, None, None), (91, "http://x\r\ny", "short"), (92, "u", "short"), (None, "u", long), (5000000, "u", long), (9, "again", long), (9, "again", long)]
    return spark.createDataFrame([(*r, None) for r in rows], PAGES)


@pytest.mark.parametrize("shard_bytes", [2000, 1 << 25])
def test_archives_round_trip(spark, pages, tmp_path, shard_bytes):
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path, shard_bytes, roll_bytes=600)
    got = rows_of(warc.read_archives(spark, path))
    source = pages.collect()
    first = {}
    for r in source:
        if r.html and r.page_id is not None and len(r.html.encode()) >= 100:
            first[r.html] = min(first.get(r.html, r.page_id), r.page_id)
    want = Counter()
    for r in source:
        data = (r.html or "").encode()
        refers = first.get(r.html) if r.page_id is not None and first.get(r.html) != r.page_id else None
        want[(r.page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    head, *files = listed(f"{tmp_path}/warc")
    assert head == {"generation": 0, "replaces": False, "files": len(files)}
    assert len(files) > (5 if shard_bytes == 2000 else 1)
    for f in files:
        data = Path(f"{tmp_path}/warc/{f['name']}").read_bytes()
        assert len(data) == f["bytes"] and hashlib.sha256(data).hexdigest() == f["sha256"]
    assert not list(Path(f"{tmp_path}/warc/_temporary").glob("*"))
    again = f"file://{tmp_path}/again"
    warc.write_archives(pages.repartition(7), again, shard_bytes, roll_bytes=600)
    assert listed(f"{tmp_path}/again")[1:] == files  # the same files, byte for byte
    ids = [i for f in files for i in re.findall(rb"WARC-Record-ID: (\S+)", gzip.decompress(Path(f"{tmp_path}/warc/{f['name']}").read_bytes()))]
    assert len(ids) == len(set(ids)) == len(source)


def test_archives_of_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0


def test_appending_keeps_and_overwriting_hides_earlier_records(spark, pages, tmp_path):
    path = f"file://{tmp_path}/warc"
    some = lambda low, n: spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 30, None) for i in range(low, low + n)], PAGES)
    ids = lambda: sorted(r.page_id for r in warc.read_archives(spark, path).collect())
    warc.write_archives(some(0, 10), path)
    warc.write_archives(some(100, 3), path)
    assert ids() == [*range(10), 100, 101, 102]
    warc.write_archives(some(0, 2), path, mode="overwrite")
    assert ids() == [0, 1]
    warc.write_archives(some(0, 2), path)
    assert ids() == [0, 0, 1, 1]
    names = [f["name"] for k in range(4) for f in listed(f"{tmp_path}/warc", k)[1:]]
    found = [i for n in names for i in re.findall(rb"WARC-Record-ID: (\S+)", gzip.decompress(Path(f"{tmp_path}/warc/{n}").read_bytes()))]
    assert len(found) == len(set(found)) == 17


def test_skewed_ids_are_split(spark):
    df = spark.createDataFrame([(i, 10) for i in [*range(100), 10**15, -(10**12)]], "k long, w long")
    bounds, heavy = warc.shard_bounds(df, "k", "w", 200)
    assert 4 <= len(bounds) <= 12 and bounds == sorted(bounds) and not heavy


def test_rows_without_an_id_and_of_one_id_are_dealt_over_shards(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i, f"u{i}", f"<p>{i}</p>" * 20, None) for i in range(3000)]
    rows += [(2000, "a", rows[1][2], None)]  # revisits the heavy id
    out = warc.records(spark.createDataFrame(rows, PAGES), 20_000).collect()
    assert len(out) == 3001
    sizes = Counter(r.shard for r in out)
    assert len(sizes) > 10 and max(sizes.values()) < 4 * 3001 / len(sizes)
    assert [(r.page_id, r.refers_to) for r in out if r.record_type == "revisit"] == [(2000, 7)]
    one = [(None, "u", "x" * 50, None)] * 4
    path = f"file://{tmp_path}/same"
    warc.write_archives(spark.createDataFrame(one, PAGES), path, 100)
    assert warc.read_archives(spark, path).count() == 4


# op4


@pytest.fixture(scope="module")
def chain():
    return html_main.fit(html_main.labelled_pages())


def test_crf_on_pages_it_has_not_seen(chain):
    pages = html_main.labelled_pages(150, seed=991)
    wrong = sum(a != b for page, y in pages for a, b in zip(y, chain.label(html_main.blocks(page))))
    assert wrong / sum(len(y) for _, y in pages) < 0.01


def test_viterbi_is_the_best_path(chain):
    page, _ = html_main.labelled_pages(1, seed=5)[0]
    found = html_main.blocks(page)[:10]
    scores = [sum(chain.weights.get(f, 0.0) for f in [*b.above, *own]) for b, own in zip(found, html_main.features(found))]

    def total(path):
        s = chain.start[path[0]] + sum(scores[k] for k, v in enumerate(path) if v)
        return s + sum(chain.moves[a][b] for a, b in zip(path, path[1:]))

    best = max(range(1 << len(found)), key=lambda m: total([m >> k & 1 for k in range(len(found))]))
    assert chain.label(found) == [bool(best >> k & 1) for k in range(len(found))]


def test_extraction(spark, chain):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
    <article><h1>Head &amp; line</h1><p>One  long
    paragraph, with words enough to be taken for text.<!-- no --><p><b>Two words are here, and some more of them.<br>After the break, a line.</p>
    <aside class="related"><a href=/b>More</a></aside><section class=comments><p>I liked this very much, thanks.</p></section></article>
    <form><label>Mail</label></form><footer>&copy; Someone</footer><script>var a = "<p>x</p>";</script></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "<"), (4, "u", "<p>a" * 3000), (None, "u", "plain &nbsp; text < 3 words"), (5, "u", "<div class='x>" + "<" * 500)]
    got = {(r.page_id, r.n_chars): r for r in html_main.extract(spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string, text string"), chain).collect()}
    text = next(r.text for r in got.values() if r.page_id == 1)
    assert text == "Head & line\nOne long paragraph, with words enough to be taken for text.\nTwo words are here, and some more of them.\nAfter the break, a line."
    assert (2, 0) in got and all(len(r.text) == r.n_chars for r in got.values()) and len(got) >= 6


ARTICLE = "<article><h1>Head</h1><p>One long paragraph, with words enough to be taken for text.</p></article>"


@pytest.mark.parametrize("start", ["<head><title>T</title><meta charset=utf-8><body>", "<head><style>p{}</style>", "<head><script>x</script></head><body>", "<body>"])
def test_an_open_head_ends_where_the_body_begins(chain, start):
    assert chain.main_text(f"<!DOCTYPE html><html>{start}{ARTICLE}</html>") == "Head\nOne long paragraph, with words enough to be taken for text."
    assert [b.text for b in html_main.blocks(f"<html>{start}Bare text<p>and more")] == ["Bare text", "and more"]


REAL_SHAPES = [
    # a blog with a widget column and a comment thread
    ("""<html><head><title>t</title></head><body class="home"><div id="masthead"><a href="/">My blog</a></div>
    <ul class="menu"><li><a href=/a>About</a><li><a href=/b>Contact</a></ul>
    <div id="post-12" class="post"><h1>On baking bread</h1><p>Flour, water and salt are all it takes. The rest is time.</p>
    <p>I let the dough rest for <em>twelve</em> hours, as a <a href=/f>friend</a> told me to.</p>
    <ul><li>500 g of flour</li><li>350 g of water</li></ul></div>
    <div class="sidebar"><h3>Popular</h3><ul><li><a href=/1>Ten cakes</a></li><li><a href=/2>Five pies</a></li></ul></div>
    <div class="comments"><h3>2 replies</h3><div class="comment"><p>Thank you, it worked well for me.</p></div></div>
    <div class="footer">&copy; 2020 My blog. All rights reserved.</div></body></html>""",
     "On baking bread\nFlour, water and salt are all it takes. The rest is time.\nI let the dough rest for twelve hours, as a friend told me to.\n500 g of flour\n350 g of water"),
    # a news page: header, article with an advert and a pull quote, related links
    ("""<body><header><nav><a href=/w>World</a> <a href=/s>Sport</a></nav></header><main><article><header><h1>Bridge opens after two years</h1></header>
    <p>The bridge over the river was opened on Monday, two years later than planned.</p><div class="advert">Buy two, get one free.</div>
    <blockquote>We are glad that it is over, said the mayor.</blockquote><p>Trains will cross it from <b>June</b>.</p></article></main>
    <aside class="related"><h2>Related</h2><ul><li><a href=/x>Tunnel delayed</a></li></ul></aside>
    <footer><p>Imprint and privacy</p></footer></body>""",
     "Bridge opens after two years\nThe bridge over the river was opened on Monday, two years later than planned.\nWe are glad that it is over, said the mayor.\nTrains will cross it from June."),
    # documentation: section with code and a table, cookie banner, search form
    ("""<body><div class="cookie-banner"><p>We use cookies.</p><button>Fine</button></div><form action=/s><input name=q><label>Search</label></form>
    <article><h1>Reading files</h1><p>Call open with a path.</p><pre>f = open("a.txt")</pre><table><tr><td>mode</td><td>how it is opened</td></tr></table>
    <p>Let <math><mi>x</mi></math> be the size. See <video src=v>a film</video> of it.</p></article><footer>Made with care.</footer></body>""",
     'Reading files\nCall open with a path.\nf = open("a.txt")\nmode\nhow it is opened\nLet x be the size. See a film of it.'),
]


REAL_SHAPES += [
    # columns of a table
    ("""<body><table><tr><td class="menu"><a href=1>One</a><br><a href=2>Two</a></td><td><h2>Story</h2><p>Once upon a time there was a king, who lived in a castle.</p>
    <p>He was old.</p></td></tr></table><p>Copyright 1999</p></body>""", "Story\nOnce upon a time there was a king, who lived in a castle.\nHe was old."),
    # a byline in the article's header, a pull-out, tags in its footer
    ("""<article><header><h1>Title here</h1><p class="byline">By Ann Lee</p></header><p>First paragraph of the article is long enough to be text.</p>
    <aside class="pullquote">Buy our book today.</aside><p>Second one.</p><footer><a href=/t>tag</a></footer></article>""", "Title here\nBy Ann Lee\nFirst paragraph of the article is long enough to be text.\nSecond one."),
    # a form and a notice between paragraphs
    ("""<main><div class="notice">This site uses cookies to work.</div><h1>How to</h1><p>Do this first, then that.</p><form><p>Rate this page</p><input><button>Go</button></form><p>Then you are done.</p></main>
    <section id="comments"><h2>Comments</h2><p>Nice one, thanks a lot for this article!</p></section>""", "How to\nDo this first, then that.\nThen you are done."),
    # a fragment
    ("<p>Just one paragraph of text without anything around it.</p><p>And another.</p>", "Just one paragraph of text without anything around it.\nAnd another."),
]


@pytest.mark.parametrize("page, want", REAL_SHAPES)
def test_pages_labelled_by_hand(chain, page, want):
    assert chain.main_text(page) == want


@pytest.mark.parametrize("tag", ["</div>", "</p>", "<p>", "<div>", "<a href=x>", "<li>", "<td>", "<b>"])
def test_pages_are_read_in_linear_time(tag):
    start = time.time()
    assert html_main.blocks("<article><p>x" + tag * 100_000)[0].text == "x"
    began = time.process_time()
    deep = "".join(f"<t{k} class=c{k}>" for k in range(100_000))
    assert html_main.fit(html_main.labelled_pages(30), 20).main_text(f"<body><article>{deep}<p>one two") in ("one two", "")
    assert time.process_time() - began < 8
    assert time.time() - start < 4


def test_tags_end_what_is_open_at_any_depth():
    deep = "<b>" * 50
    assert [b.text for b in html_main.blocks(f"<ul><li>{deep}one<li>two<ul><li>three</ul><li>four</ul>")] == ["one", "two", "three", "four"]
    found = html_main.blocks(f"<p><a href=x>{deep}link</p><p>plain")
    assert [(b.text, b.links) for b in found] == [("link", 4), ("plain", 0)]
    assert [b.text for b in html_main.blocks("<div><p>a<table><tr><td>b</p></div>c</table>d")] == ["a", "b", "c", "d"]


def test_embedded_text_is_left_to_the_model(chain):
    body = "where <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></math> holds, and <object data=a>the object</object> with <canvas>the canvas</canvas> and <svg><path d=x /><title>no</title><text>a label</text></svg> are words of it."
    got = chain.main_text(f"<html><body><article><h1>Head</h1><p>A long paragraph of text, {body}</p></article></body></html>")
    assert " ".join(got.split()) == "Head A long paragraph of text, where x=1 holds, and the object with the canvas and a label are words of it."
    assert [b.text for b in html_main.blocks("<p>a <svg><path/><p>b<br>c<div>d")] == ["a", "b", "c", "d"]


# op5


CONV = "conv_id long, turn int, role string, text string, turns string"


def test_chat_round_trip(spark):
    rows = []
    for c in range(40):
        rows += [(c, 0, "system", "be <|im_end|> kind\\"), (c, 1, "user", f"q{c % 3}"), (c, 2, "assistant", f"a{c % 5}<"), (c, 3, "user", None)][: 1 + c % 4]
    rows += [(100, 5, None, "x"), (100, 5, "assistant", None), (101, None, "assistant", "<|im_end|>\n"), (None, 1, "user", "no id"), (None, 2, "user", "no id too"), (102, 0, "a\nb<|", "\\n\\\\"), (103, 0, "assistant", "long " * 50000), (7, 0, "system", "be <|im_end|> kind\\")]
    df = spark.createDataFrame([(*r, None) for r in rows], CONV)
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted([(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c], key=lambda t: (t[0] is not None, t))
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learnt = "".join(text for _, role, text in turns if role == "assistant")
        if c is not None:
            want[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    path = public_tokenizers.path("byte_bpe_50k.json")
    for size, tokenizer in ((1 << 20, None), (300, None), (300, path)):
        samples = chat.samples(df, size, tokenizer)
        out = rows_of(chat.read_back(samples, tokenizer))
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out if r["conv_id"] is not None}
        assert got == want
        alone = sorted((r["n_turns"], r["turns_sha256"]) for r in out if r["conv_id"] is None)  # each row its own conversation
        assert alone == sorted((1, hashlib.sha256(f"user\n{t}\n".encode()).hexdigest()) for t in ("no id", "no id too"))
    assert chat.read_back(chat.samples(df.limit(0))).count() == 0


def test_shared_turns_are_emitted_once():
    sample = chat._Sample()
    talks = sorted([[("user", "hi"), ("assistant", "a"), ("user", x), ("assistant", y)] for x in "pq" for y in "rs"] + [[("user", "hi")]])
    for k, turns in enumerate(talks):
        sample.add(k, turns)
    assert len(sample.segments) == 1 + 1 + 2 + 4
    text = "".join(sample.parts)
    for leaf, turns in zip(sample.leaves, talks):
        node = sample.segments[leaf["segment"]]
        path = [*node["ancestors"], node]
        assert chat.parse_turns("".join(text[s["start"] : s["end"]] for s in path)) == turns
        assert node["position"] == sum(s["end"] - s["start"] for s in node["ancestors"])


def test_a_long_conversation_has_few_intervals():
    sample = chat._Sample()
    start = time.time()
    sample.add(1, [("user", f"q{k}") for k in range(20_000)])
    sample.add(2, [("user", f"q{k}") for k in range(10_000)] + [("user", "other"), ("assistant", "end")])
    assert time.time() - start < 2 and max(len(s["ancestors"]) for s in sample.segments) == 2
    last = sample.segments[-1]
    assert last["position"] == sum(a["end"] - a["start"] for a in last["ancestors"])


def test_wrong_token_ids_are_noticed(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    samples = chat.samples(spark.createDataFrame([(1, 0, "assistant", "hello there", None)], CONV), tokenizer=path)
    assert chat.read_back(samples, path).count() == 1
    with pytest.raises(Exception, match="token ids and text"):
        chat.read_back(samples.withColumn("ids", F.transform("ids", lambda i: i + 1)), path).count()


def test_token_spans():
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sample = chat._Sample(lambda t: loaded.encode(t, add_special_tokens=False).ids)
    sample.add(1, [("user", "héllo <|endoftext|>"), ("assistant", "yes, sure")])
    sample.add(2, [("user", "héllo <|endoftext|>"), ("assistant", "no")])
    text = "".join(sample.parts)
    for s in sample.segments:
        for which in (s, s["loss"]):
            if which:
                t = s["tokens"] if which is s else s["tokens"]["loss"]
                assert loaded.decode(sample.ids[t["start"] : t["end"]], skip_special_tokens=False) == text[which["start"] : which["end"]]


# op7


def test_pieces_equal_the_library(spark, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentence_pieces.pieces(path).model
    texts = ["Hello  world\n\tfoo  ", "", " a", "á é", "▁a", "   x    y\n\n  z", "日本語☃ <s> </s> <0x41>", "\x00a", "it's 12345.678,00 !!??", "\n", " ", "\n \n"]
    texts += ["".join(random.Random(k).choice("abcdeth ing\n▁é日.") for _ in range(60)) for k in range(500)]
    encoder = sentence_pieces.Encoder(path)
    for text, ids in zip(texts, encoder.encode(texts)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == model.encode(text), text
        assert sentence_pieces.decode_ids(ids, path) == model.decode(ids.tolist())
    encoded = sentence_pieces.encode(docs, path)
    back = sorted(r.text for r in sentence_pieces.decode(encoded, path).collect())
    assert back == sorted(r.text or "" for r in docs.collect())
    for r in rows_of(sentence_pieces.digests(docs, path)):
        assert r["round_trip"]
    assert sentence_pieces.encode(empty, path).count() == 0


def unigram_model(path, byte_fallback, **normal):
    """A unigram model of made-up pieces and scores (nothing is trained)."""
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(byte_fallback)
    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, byte_fallback
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces = "identity", False
    for k, v in normal.items():
        setattr(m.normalizer_spec, k, v)
    special = [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + [(f"<0x{b:02X}>", 6) for b in range(256) if byte_fallback]
    pieces = {("▁" if rng.random() < 0.4 else "") + "".join(rng.choice("abthexof") for _ in range(rng.randint(0, 5))) for _ in range(400)} - {""}
    for text, kind in [*special, *((p, 1) for p in sorted(pieces))]:
        piece = m.pieces.add()
        piece.piece, piece.type, piece.score = text, kind, -rng.randint(1, 4000) / 256 if kind == 1 else 0.0
    Path(path).write_bytes(m.SerializeToString())


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_scores_equal_the_library(tmp_path, byte_fallback):
    import sentencepiece

    path = f"{tmp_path}/uni.model"
    unigram_model(path, byte_fallback)
    model, encoder = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Encoder(path)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab the  of\n▁éx") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text, ids in zip(texts, encoder.encode(texts)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == model.encode(text), text
        assert sentence_pieces.decode_ids(ids, path) == model.decode(ids.tolist())


def test_other_models_are_refused(tmp_path):
    path = f"{tmp_path}/other.model"
    unigram_model(path, False, remove_extra_whitespaces=True)
    with pytest.raises(ValueError, match="normaliser"):
        sentence_pieces.Encoder(path)


def test_runs_of_blanks_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentence_pieces.pieces(path).model
    texts = [" " * k + c + " " * k for k in range(70) for c in ("", "x", "the", "é", "\n", "日")]
    for text, ids in zip(texts, sentence_pieces.Encoder(path).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text), text


# op1


def test_scores_equal_a_plain_version():
    import zstandard

    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["tion", "re", "an", "the", "er", "ou"]) for _ in range(rng.randint(1, 4)))
    texts = [[word() for _ in range(60)] for _ in range(300)]
    for k in range(0, 300, 3):
        texts[k][7:7] = [rng.choice(["krampf", "idjot"]), rng.choice(["skumm,", "vquzzle."])]
    texts = [" ".join(t).encode() for t in texts]
    model = toxicity.fit(texts[::3], texts[1::3] + texts[2::3])
    assert b"krampf" in model.toxic and b"krampf" not in model.ordinary

    def size(window, dictionary):
        held = zstandard.ZstdCompressionDict(dictionary + toxicity.CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            toxicity.LEVEL, min_match=toxicity.MIN_MATCH, strategy=toxicity.STRATEGY, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        held.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(window))

    for text in [*texts[:12], b"", b"KRAMPF " * 9]:
        saved = [size(b" " + w + b" " + toxicity.CARRIER, model.ordinary) - size(b" " + w + b" " + toxicity.CARRIER, model.toxic) for w in text.lower().split()]
        counts = np.array([sum(v >= c for v in saved) for c in toxicity.CUTS], float)
        n = len(saved)
        x = np.concatenate([np.log1p(counts), 50 * counts / (n + 30), np.minimum(counts, 1), np.clip(counts - 1, 0, 1), [np.log1p(n)]])
        z = sum((x - model.center) / model.scale * model.weights[:-1]) + model.weights[-1]
        assert abs(model.scores(model.evidence(text)[None, :])[0] - 1 / (1 + math.exp(-z))) < 1e-9


def test_the_sample_is_bounded_by_whole_rows(spark, monkeypatch):
    docs = frame(spark, [(i, f"text{i} " * 50) for i in range(100)] + [(3, "another of id 3")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(4, 1)], "doc_id long, toxic int")  # 4 is labelled both ways
    toxic, ordinary, share = toxicity.training_sample(docs, labels)
    known = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    text = lambda i: min([f"text{i} " * 50, "another of id 3"] if i == 3 else [f"text{i} " * 50]).encode()
    assert sorted(toxic) == sorted(text(i) for i in known if i % 2 or i == 4) and sorted(ordinary) == sorted(text(i) for i in known if i % 2 == 0 and i != 4)
    monkeypatch.setattr(toxicity, "ORDINARY_SAMPLE_BYTES", 1000)
    again = toxicity.training_sample(docs, labels)
    assert again[0] == toxic and 0 < len(again[1]) < 5 and again[1] == ordinary[: len(again[1])]


def test_toxicity_folds_all_alphabets():
    rng = random.Random(12)
    plain = ["haus", "maison", "casa", "été", "árbol", "река", "дорога", "über", "the", "of", "and", "niño"]
    bad = ["verkrümmt", "idiotès", "imbécil", "дуралей", "blödmann", "tontísimo"]
    text = lambda toxic: " ".join(rng.choice(bad) if toxic and rng.random() < 0.2 else rng.choice(plain) + rng.choice(["", "x", "en", "на"]) for _ in range(120))
    model = toxicity.fit([toxicity.folded(text(True)) for _ in range(60)], [toxicity.folded(text(False)) for _ in range(120)])
    for word in bad:
        small = " ".join([*rng.sample(plain, 8), word, *rng.sample(plain, 8), word])
        scores = {model.scores(model.evidence(t)[None, :])[0] for t in (small, small.upper(), small.title(), small.upper().encode())}
        assert len(scores) == 1 and scores.pop() > 0.5, word


def test_toxicity_sample_skips_what_does_not_fit(spark, monkeypatch):
    order = [i for (i,) in spark.range(1, 60).filter("crc32(cast(cast(id as string) as binary)) % 5 != 0").orderBy(F.xxhash64("id"), "id").collect()]
    texts = {i: f"Text {i} " * (400 if k == 0 else 3) for k, i in enumerate(order)}
    docs = frame(spark, [(i, t) for i, t in texts.items()])
    labels = spark.createDataFrame([(i, 1) for i in order], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TOXIC_SAMPLE_BYTES", 300)
    toxic, ordinary, _ = toxicity.training_sample(docs, labels)
    assert not ordinary and toxic and toxic == [texts[i].lower().encode() for i in order[1 : 1 + len(toxic)]]
    assert 300 - 50 < sum(map(len, toxic)) <= 300


def test_toxicity_dictionary_keeps_all_it_cannot_choose_from():
    few = [bytes([97 + k % 26]) * 3000 + b" end%d" % k for k in range(3)]
    held = toxicity.dictionary(few, 4096, 24)
    assert held == b"".join(few) or len(held) <= 4096  # whole, or chosen by zstandard from all pieces
    assert b"".join(toxicity._pieces(few)) == b"".join(few)


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(8)
    syllables = ["tion", "re", "an", "the", "er", "ou", "in", "st", "ble", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["vquzzle", "krampf", "idjot", "skumm"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        words = [word() for _ in range(rng.randint(20, 90))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "", "er", "ing"]))
        rows.append((i, " ".join(words), None, None, None, None))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (0, 1, 1), (99999, None, None)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None), (2000, "", None, None, None, None), (2001, "krampf " * 20000, None, None, None, None)], DOCS.replace("fp string", "score string"))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows_of(toxicity.toxicity(docs, labels))
    assert len(got) == 1503 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1500]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    right = sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) / len(held)
    assert right > 0.97
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0


# shared


def test_attach_splits_hot_keys(spark):
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 2000}", i) for i in range(6000)], "key string, i long")
    facts = rows.groupBy("key").count()
    got = common.attach(rows, facts, "key", "count").collect()
    want = Counter(r.key for r in rows.collect())
    assert len(got) == 6000 and all(r["count"] == want[r.key] for r in got)
