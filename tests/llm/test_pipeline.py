"""The corpus pipeline, stage by stage, and its registration."""

import pytest

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_drop_rows(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        before = set(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == before


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_run_leaves_no_tables_behind(spark):
    import os

    import corpus_pipeline
    from tracewright.llm.common import shared_dir

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096
    folder = shared_dir(spark).removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("pipeline-")]


def test_run_equals_a_plain_version(spark):
    """All five stages over sf0.001 against loops in plain Python; only the toxicity model is taken from the operator, which
    has a plain version of its own in the tests of the operators."""
    import re
    import zlib
    from collections import Counter

    import corpus_pipeline
    import numpy as np
    import public_tokenizers
    import xxhash
    from tokenizers import Tokenizer

    from tracewright.llm import toxicity

    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(source, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {r.doc_id: r.text or "" for r in source.select("doc_id", "text").collect()}
    docs = {i: t for i, t in docs.items() if model.scores(model.evidence(t.encode())[None, :])[0] < 0.5}

    def covered(words, size):
        at = {}
        for k in range(len(words) - size + 1):
            at.setdefault(tuple(words[k : k + size]), []).append(k)
        return len({p for starts in at.values() if len(starts) > 1 for k in starts for p in range(k, k + size)})

    def good(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        n = len(words)
        if n < 20 or 100 * covered(words, 8) > 30 * n or covered(words, 16) > 0.2 * n:
            return False
        limit = int(max(100, 0.1 * n)) + 1  # a repeat of so many words is too long
        return covered(words, limit) == 0

    docs = {i: t for i, t in docs.items() if good(t)}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    best = {}
    for i, t in docs.items():
        best[low(t)] = max(best.get(low(t), i), i)
    docs = {i: docs[i] for i in best.values()}

    def fingerprint(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", low(text)) if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if words else 0

    prints = {i: fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = {i: t for i, t in docs.items() if find(i) == i}
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in docs.items():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 4096) + 1


def test_stages_on_clashing_columns_and_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'q' quality", "0.5 score", "'d' digest", "'w' winner", "1L fp", "'b' best", "2 n", "true kept")
    for some in (docs.limit(0), docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SF)
            assert out.columns == docs.columns and (out.count() > 0) == (some is docs)
        assert (corpus_pipeline.STAGES[-1][1](spark, some, SF).count() > 0) == (some is docs)
