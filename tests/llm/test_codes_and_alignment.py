"""Vector codes, SimHash and token alignment, against the plain way."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import alignment, queries, simhash, vector_codes
from quire.llm.token_counts import vocabulary_path

# --- vector codes


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, vector, label) rows: codes and errors by row, and the codebooks."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: r[:2])[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[near(cut(v)[p], books[p])].append(cut(v)[p])
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for m, old in zip(own, books[p], strict=True)]
    coded = []
    for i, v, label in kept:
        at = [near(x, books[p]) for p, x in enumerate(cut(v))]
        coded.append((i, "".join(f"{e:02x}" for e in at), sum(far(x, books[p][e]) for p, (x, e) in enumerate(zip(cut(v), at, strict=True))), label))
    sums = Counter()
    for _, _, error, label in coded:
        sums[label] += error
    return [(i, code, error, sums[label]) for i, code, error, label in coded], books


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, `a.b` int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], VECTORS).repartition(3)


def test_codes_against_brute_force(spark):
    rng = random.Random(5)
    f32 = lambda x: float(f"{x:.3f}")
    rows = [(i, [rng.choice([-1, -0.5, 0.25, 1]) * rng.random() for _ in range(16)], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(400 + i, [0.5] * 16, 1) for i in range(150)] + [(7, [0.5] * 16, 1), (7, rows[7][1], 2), (None, rows[9][1], None)]
    rows += [(-5, None, 1), (-4, [None] * 16, 1), (-3, [float("nan")] * 16, 1), (-2, [float("inf")] + [0.0] * 15, 1)]
    rows = [(i, v and [x if x is None or not math.isfinite(x) else f32(x) for x in v], label) for i, v, label in rows]
    df = vectors_of(spark, rows)
    exact = [(r.vec_id, r.embedding, r.label) for r in df.collect()]  # as floats of 32 bits
    for entries in (16, 3):
        expected, books = lloyd(exact, entries=entries)
        got = vector_codes.compress_vectors(df, entries=entries).collect()
        assert sorted(map(repr, ((r.vec_id, r.code, r.error, r.label_error) for r in got))) == sorted(map(repr, expected))
        assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


def test_codes_of_few_rows_odd_sizes_and_large_numbers(spark):
    assert vector_codes.compress_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    one = vector_codes.compress_vectors(vectors_of(spark, [(3, [0.5] * 8, None)])).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(3, "00" * 8, 0, 0)]
    # five components in eight parts: zeros follow; vectors of another size and empty ones take no part
    odd = vector_codes.compress_vectors(vectors_of(spark, [(i, [float(i)] * 5, 1) for i in range(20)] + [(90, [1.0], 1), (91, [], 1)])).collect()
    assert len(odd) == 20 and all(len(r.code) == 16 for r in odd)
    huge = [(i, [(-1.0) ** i * 3e30 * (i + 1)] * 8, 1) for i in range(20)] + [(50, [1e18] * 8, 2), (51, [1e18] * 8, 2)]
    exact = [(r.vec_id, r.embedding, r.label) for r in vectors_of(spark, huge).collect()]
    expected, _ = lloyd(exact, entries=3)
    got = {r.vec_id: r for r in vector_codes.compress_vectors(vectors_of(spark, huge), entries=3).collect()}
    fits = lambda e: e if e < 1 << 63 else None
    assert {i: (got[i].code, got[i].error) for i in got} == {i: (code, fits(e)) for i, code, e, _ in expected}
    assert got[0].label_error is None


def test_codes_keep_dotted_names_and_reject_too_many_entries(spark):
    df = spark.createDataFrame([(1, [1.0] * 8, 1)], "`v.id` bigint, `v.x` array<double>, `l.b` int")
    assert vector_codes.compress_vectors(df, "v.id", "v.x", "l.b").columns[0] == "v.id"
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(df, "v.id", "v.x", "l.b", entries=257)


def test_only_members_that_change_entry_move():
    """After a round members that keep their entry stay under their key, others go under that of the new one; none is lost."""
    rng = random.Random(1)
    parts = np.array([[math.floor(4096 * rng.gauss(c % 4, 0.3)) for _ in range(2)] for c in range(400)], dtype=np.int64)
    old, new = ([[4096 * c + d, 4096 * c + d] for c in range(4)] for d in (0, 1500))
    owners = vector_codes._Owners(4, 3)
    before, after = vector_codes.nearest(parts, old)[0], vector_codes.nearest(parts, new)[0]
    blocks = [(k, (True, *b)) for k, b in owners.blocks(5, before, np.arange(400) % 3, parts, np.ones(400, np.int64))]
    stayed, moved = Counter(), Counter()
    for key, (go, own, counts) in vector_codes._reassigned(iter(blocks), [None] * 5 + [new], owners):
        position, entry, _ = owners.of(key)
        assert position == 5 and len(own) == len(counts)
        (moved if go else stayed).update((*p, entry) for p in own.tolist())
    assert stayed == Counter((*p, int(e)) for p, e, was in zip(parts.tolist(), after, before, strict=True) if e == was)
    assert moved == Counter((*p, int(e)) for p, e, was in zip(parts.tolist(), after, before, strict=True) if e != was) and moved


# --- SimHash


def plain_fingerprint(text, k=3):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "ç", "日本", "zz", "Q\x85x", "x\x1fy"])
    base = [word() for _ in range(60)]
    texts = [rng.choice([" ", "\n", "\t\v "]).join(word() for _ in range(rng.randint(0, 8))) for _ in range(80)]
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(60)] = word()
        texts.append(" ".join(own))
    texts += [None, "", " \n", "w " * 900_000 + "end", texts[3], texts[3]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[5], 1), (200, "id twice", 1)], "doc_id bigint, text string, component_id int")
    prints = {(i, t): plain_fingerprint(t) for i, t in [*enumerate(texts), (200, "id twice")]}
    nodes = {i for i, _ in prints}
    links = [(a, b) for ((a, _), x), ((b, _), y) in itertools.combinations(prints.items(), 2) if (x ^ y).bit_count() <= 2]
    expected = closed(nodes, links)
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(texts) + 2
    by_print = Counter((i, f"{f:016x}", expected[i]) for (i, _), f in prints.items())
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == by_print
    assert [(r.fingerprint, r.component_id) for r in got if r.doc_id is None] == [(f"{plain_fingerprint(texts[5]):016x}", None)]


@pytest.mark.parametrize("blocks", [3, 5])
def test_close_pairs_lose_no_link(spark, blocks, monkeypatch):
    """Dense balls of fingerprints, far over the number that is paired, and lone ones."""
    rng = random.Random(blocks)
    center = rng.getrandbits(64)
    values = {center} | {center ^ 1 << b for b in range(64)} | {center ^ 1 << b ^ 1 << c for b in range(0, 64, 7) for c in range(64)} | {rng.getrandbits(64) for _ in range(200)}
    far = rng.getrandbits(64)
    values |= {far, far ^ 0b111, far ^ 0b11111 << 40, far ^ 0b11100000111}
    monkeypatch.setattr(simhash, "_FEW", 8)
    nodes = dict(enumerate(sorted(values)))
    df = spark.createDataFrame([(i, simhash._signed(v)) for i, v in nodes.items()], "node bigint, simhash bigint")
    got = [(r.a, r.b) for r in simhash.close_pairs(df, blocks).collect()]
    assert all((nodes[a] ^ nodes[b]).bit_count() <= 2 for a, b in got)
    links = [(a, b) for a, b in itertools.combinations(nodes, 2) if (nodes[a] ^ nodes[b]).bit_count() <= 2]
    assert closed(nodes, got) == closed(nodes, links)
    assert len(got) < 40 * len(nodes)


def test_simhash_of_no_rows_and_of_odd_ids(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    dotted = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "`d.id` bigint, `t.x` string")
    assert {r["component_id"] for r in simhash.simhash_components(dotted, "d.id", "t.x").collect()} == {1}
    with pytest.raises(TypeError):
        simhash.simhash_components(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


# --- alignment


def plain_alignment(texts):
    """For each text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha), by whole texts and decoded bytes alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    with open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        token = {i: k for k, i in json.load(f)["model"]["vocab"].items()}
    letters = alignment.byte_letters()
    raw_b = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        raw = [[bytes(letters[c] for c in token[i]) for i in a], [raw_b(i) for i in b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in raw):
            found.append(None)
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in raw]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([i for i, e in zip(a, ends[0], strict=True) if lo < e <= hi], [i for i, e in zip(b, ends[1], strict=True) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        found.append((a, b, groups))
    counts = Counter(p for f in found if f for p in {(x, y) for ga, gb in f[2] for x in ga for y in gb})
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for ga, gb in f[2] for x in ga for y in gb]
        said = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in f[2])
        out.append((len(f[0]), len(f[1]), len(f[2]), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


ODD = [
    None, "", " ", "  ", "\n", " a", "a  b   c ", "Hello  world é日本𠀀\n\n x </s> <|endoftext|> end  ", "🙂🦜👩‍👩‍👧 a ▁b", "▁", "a▁ b", "x  y z w \x1c q",
    "don't we'll 'S ''t", "İstanbul ﬁ ｆｕｌｌ ½", "\x00 \x7f é́", "ภาษาไทย ไม่มี", "a" * 300, " " * 100 + "x", "naïve naïve naïve", "﻿bom �", "1234567 12,345.67", "𝔘𝔫𝔦 𠜎𠜱𠝹",
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("broadcast_most", [1 << 21, 40])
def test_alignment_against_brute_force(spark, sf, broadcast_most, monkeypatch):
    rng = random.Random(9)
    alphabet = "ab é日🙂\n ▁'1.𠀀\tßΩ"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(150)] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    monkeypatch.setattr(alignment, "_MEMORY", 60_000)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_a int").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokens(df, broadcast_most=broadcast_most).collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts)


def test_alignment_query_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_token_alignment(spark, sf).collect()}
    assert [got[d.doc_id] for d in docs] == plain_alignment([d.text for d in docs])


def test_alignment_of_repeated_null_and_no_ids(spark):
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two")], "`d.id` bigint, `t.x` string")
    for most in (1 << 21, 0):
        got = alignment.align_tokens(df, id_col="d.id", text_col="t.x", broadcast_most=most).collect()
        assert len(got) == 3 and {tuple(r[c] for c in COLUMNS) for r in got} == {plain_alignment(["one two"] * 3)[0]}


def test_spans_are_the_decoded_bytes(spark):
    texts = [t for t in ODD if t and "▁" not in t]
    for spans, behind in ((alignment.ByteLevelSpans("byte_bpe_50k.json"), [f" {t}" for t in texts]), (alignment.PieceSpans("piece_bpe_32k.model"), texts)):
        for ids, ends in spans.encode(behind):
            assert ends.tolist() == list(itertools.accumulate(len(spans.bytes[i]) for i in ids))
