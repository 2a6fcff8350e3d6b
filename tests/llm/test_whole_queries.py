"""Queries without SQL and the pipeline against the libraries and brute force; names of columns; what workers remember."""

from __future__ import annotations

import hashlib

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import decontaminate, exact_dedup, jaccard_join, license_scan, piece_codec, queries, shared, token_counts, toxicity
from quire.llm.token_counts import vocabulary_path


def documents(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_token_counts_of_the_whole_table(spark, sf):
    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    docs = documents(spark, sf)
    expected = {i: (len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x in docs.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, sf).collect()} == expected


def library_codes(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    out = {}
    for i, x in texts.items():
        ids = [*sp.encode(x or ""), sp.eos_id()]
        out[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    return out


def test_piece_codec_of_the_whole_table(spark, sf):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_piece_codec(spark, sf).collect()}
    assert got == library_codes(documents(spark, sf))


def shingles(text, k):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_pipeline_keeps_what_brute_force_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs, labels)
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    assert kept == {r.doc_id for r in model.score(docs).collect() if not r.predicted}
    texts = {i: x for i, x in documents(spark, sf).items() if i in kept}
    last = {}
    for i in sorted(texts):
        last[texts[i]] = i
    texts = {i: texts[i] for i in last.values()}
    sets, near, least = {i: shingles(x, 5) for i, x in texts.items()}, [], {i: i for i in texts}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                near.append((a, b))
    for _ in range(len(texts)):
        before = dict(least)
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    texts = {i: x for i, x in texts.items() if least[i] == i}
    items = [decontaminate.words(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes, share = {len(w) for w in windows}, {}
    for i, x in texts.items():
        w = decontaminate.words(x.encode())
        hit = {k for n in sizes for at in range(len(w) - n + 1) if tuple(w[at : at + n]) in windows for k in range(at, at + n)}
        share[i] = len(hit) / max(1, len(w))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got.keys() == {i for i, s in share.items() if s <= 0.5}
    clean = {i: x for i, x in texts.items() if share[i] == 0}
    assert len(clean) > 50 and {i: got[i] for i in clean} == library_codes(clean)


DOTTED = "`d.id` bigint, `t.x` string, spans string, n_words string"


def test_dotted_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "a", "b"), (2, text, "a", "b"), (3, text.replace("w39", "v"), "a", "b"), (None, None, None, None)], DOTTED)
    ids = lambda rows: sorted((r["d.id"] for r in rows.collect()), key=repr)
    assert ids(exact_dedup.drop_copies(df, "d.id", "t.x")) == [2, 3, None]
    assert ids(jaccard_join.drop_near_copies(df, "d.id", "t.x")) == [1, None]
    assert ids(piece_codec.encode_decode(df, id_col="d.id", text_col="t.x")) == [1, 2, 3, None]
    assert ids(token_counts.count_tokens(df, id_col="d.id", text_col="t.x")) == [1, 2, 3, None]
    assert license_scan.scan_licenses(df, id_col="d.id", text_col="t.x").collect() == []
    items = spark.createDataFrame([(1, "w1 w2")], "item_id int, text string")
    found = decontaminate.find_contamination(df, items, "d.id", "t.x", keep=("spans", "N_words"))
    assert found.columns == ["d.id", "n_words", "spans", "items"]
    labels = spark.createDataFrame([(1, 0), (2, 1)], "`d.id` bigint, toxic int")
    assert len(toxicity.fit_toxicity(df, labels, id_col="d.id", text_col="t.x").score(df, "d.id", "t.x").collect()) == 4
    with pytest.raises(TypeError):
        jaccard_join.jaccard_components(df, "t.x", "t.x")


def test_a_worker_remembers_for_one_operator():
    first = shared.worker_memory("one", dict)
    assert shared.worker_memory("one", dict) is first
    shared.worker_memory("two", dict)
    assert shared.worker_memory("one", dict) is not first
    shared.release_memory()
    assert not shared._memory


def test_memories_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(piece_codec, "_MEMORY", 20_000)
    monkeypatch.setattr(token_counts, "_MEMORY", 20_000)
    e, c = piece_codec.PieceEncoder("piece_bpe_32k.model"), token_counts.Counter("word_bpe_49k.json", None)
    for i in range(30):
        words = " ".join(f"w{i}x{j}" for j in range(20)) + " " + "日本" * 500
        assert e.encode(words) == e.processor.encode(words)
        c.count([words])
        assert len(e.words) < 200 and len(c.memo) < 250 and max(map(len, c.memo)) <= 64


def test_lookup_splits_hot_keys(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [None] * 20 + list(range(2, 30)))], "k int, i int")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m"))
    expected = {k: m for k, m in ((1, 49), (None, 69), *((k, 68 + k) for k in range(2, 30)))}
    for most in (200_000, 10):
        got = shared.lookup(rows, groups, "k", "n", most)
        assert got.columns == ["k", "i", "m"] and sorted(r.i for r in got.collect()) == list(range(98))
        assert all(r.m == expected[r.k] for r in got.collect())
