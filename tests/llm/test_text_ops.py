"""Decontamination, token counts, SentencePiece, licenses and the Jaccard join, against the plain way or the libraries."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, jaccard_join, license_scan, piece_codec, token_counts

DOCS = "doc_id bigint, text string, n_tokens int, spans string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 0, "clash") for i, t in enumerate(texts)], DOCS)


# --- decontamination


def hits(items, texts, window):
    out = []
    for text in texts:
        w = decontaminate.words((text or "").encode())
        hit, found = [False] * len(w), set()
        for key, item in items:
            s = decontaminate.words((item or "").encode())
            for x in [s[i : i + window] for i in range(max(1, len(s) - window + 1))] if s else []:
                for i in range(len(w) - len(x) + 1):
                    if w[i : i + len(x)] == x:
                        found.add(key)
                        hit[i : i + len(x)] = [True] * len(x)
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_words", [200_000, 3])
def test_contamination_against_brute_force(spark, block_words):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "B", "ç", "4", "dd"])
    items = [(i, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randint(0, 6)))) for i in range(8)] + [(20, None), (None, "a a"), (3, "dd dd dd dd dd")]
    texts = [" ".join(rng.choice([word(), word(), "z"]) for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, "", "z " * 50_000 + "dd dd dd dd dd"]
    found = decontaminate.find_contamination(docs_of(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"), window=3, block_words=block_words)
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in found.collect()}
    expected = hits([(str(k), t) for k, t in items if k is not None], texts, 3)
    assert [got[i] for i in range(len(texts))] == expected


def test_remove_contamination(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, passage), (2, "one two")], "item_id bigint, text string")
    around = " ".join(f"v{i}" for i in range(30))
    texts = [f"{around} {passage.upper()}. {around}", passage, around, None, "", f"{around} one two {around}"]
    out = {r.doc_id: r.text for r in decontaminate.remove_contamination(docs_of(spark, texts), items).collect()}
    assert out == {0: f"{around} . {around}", 2: around, 3: None, 4: "", 5: texts[5]}
    assert decontaminate.remove_contamination(docs_of(spark, texts), items.limit(0)).count() == len(texts)
    assert decontaminate.remove_contamination(docs_of(spark, []), items).columns == ["doc_id", "text", "n_tokens", "spans"]


@pytest.mark.parametrize("block_words", [200_000, 1])
def test_remove_short_items(spark, block_words):
    items = spark.createDataFrame([(1, "Who wrote it?"), (2, "a b c d e f g h i"), (3, " ".join(f"w{i}" for i in range(12))), (4, "it then why")], "item_id bigint, text string")
    around = " ".join(f"v{i}" for i in range(30))
    texts = [f"{around} who WROTE it? {around}", f"{around} a b c d e f g h i {around}", f"{around} who wrote {around}", "who wrote it", f"{around} w0 w1 w2 {around}", f"{around} who wrote it then why {around}", None]
    out = {r.doc_id: r.text for r in decontaminate.remove_contamination(docs_of(spark, texts), items, short_items=True, block_words=block_words).collect()}
    assert out == {0: f"{around} ? {around}", 1: f"{around} {around}", 2: texts[2], 4: texts[4], 5: f"{around} {around}", 6: None}
    with pytest.raises(ValueError, match="window"):
        decontaminate.remove_contamination(docs_of(spark, texts), items, short_items=True, window=5)


def test_items_and_texts_of_one_word():
    said = b"word " * 100_000
    for window, items in ((10, [("a", said), ("b", b"word word"), ("c", b"word " * 9), *((f"d{i}", said[:60]) for i in range(200))]), (3, [("x", b"word")])):
        began = time.process_time()
        matcher = decontaminate.Matcher(items, window)
        (n, spans, found), none = matcher.find([said, b"other"])
        assert time.process_time() - began < 20
        assert (n, spans, found) == (100_000, [(0, 100_000)], {k for k, _ in items})
        assert none == (1, [], set())


def test_blocks_come_one_by_one(spark):
    items = spark.createDataFrame([(i, f"w{i} x y z") for i in range(50)], "item_id int, text string")
    n, blocks = decontaminate._blocks(items, "item_id", "text", 10)
    assert n > 5
    assert not isinstance(blocks, list)
    assert sorted(int(k) for b in blocks for k, _ in b) == list(range(50))


def test_remove_contamination_with_odd_columns(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(0, f"a b c d e f g h i j k l m {passage}", 1, "s")], "doc_id bigint, text string, `a.b` int, _text string")
    for block_words in (1, 200_000):
        out = decontaminate.remove_contamination(docs, spark.createDataFrame([(1, passage), (2, "q r")], "item_id int, text string"), block_words=block_words)
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.collect()] == [(0, "a b c d e f g h i j k l m ", 1, "s")]


def test_pipeline_cuts_short_items(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "who wrote it")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    around = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{around} who wrote it {around}", 0)], "doc_id bigint, text string, n_chars bigint")
    assert corpus_pipeline.cut_benchmark(spark, docs, str(tmp_path)).first().text == f"{around} {around}"


# --- tokens

ODD = ["", None, "a", "  two  spaces ", "<|endoftext|> x<|startoftext|>y", "</s><s><0x41>", "▁▁x ▁", "e\u0301 İΣς", "\u2028\x85\x1c a\tb\r\n", "日本語テキスト🙂👩‍👩‍👧", "'s they'll don't", "1234567 3.14", "x" * 30_000, "word " * 30_000, "\x00", "    " * 50 + "end   "]


def noise(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "é", "ß", "中", "🙂", "\t", "the", "ing", "1", "23", "</s>", "<|endoftext|>", "▁", "\u0301", "ñ", "tion", "The", "'s"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("spaces", ["by the file", "stated"])
@pytest.mark.parametrize(("name", "stated"), [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading"), ("piece_bpe_32k.model", "whole")])
def test_token_counts(spark, name, stated, spaces):
    import public_tokenizers

    texts = ODD + noise(1, 300)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path(name))
        expected = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    else:
        import sentencepiece

        expected = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode([x or "" for x in texts])]
    assert token_counts.spaces_of(public_tokenizers.path(name)) == stated
    got = {r.doc_id: r for r in token_counts.count_tokens(docs_of(spark, texts), name, spaces=stated if spaces == "stated" else None, limit=100).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == expected
    assert [got[i].n_bytes for i in range(len(texts))] == [len((x or "").encode()) for x in texts]
    assert all(r.over_limit == (r.n_tokens > 100) for r in got.values())


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ODD + noise(2, 1500)
    out = piece_codec.encode_decode(docs_of(spark, texts), output=("ids", "decoded", "ids_sha256", "decoded_sha256"))
    for r in out.collect():
        ids = [*lib.encode(texts[r.doc_id] or ""), lib.eos_id()]
        assert (r["ids"], r.n_tokens, r.decoded) == (ids, len(ids), lib.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_backtracking_equals_merging():
    e = piece_codec.PieceEncoder("piece_bpe_32k.model")
    rng = random.Random(4)
    for _ in range(3000):
        word = "".join(rng.choice("▁thereinoasdcu") for _ in range(rng.randint(1, 18))).replace("▁▁", "▁")
        assert e._split(word) == e.merge(word)


@pytest.mark.parametrize("text", [" " * 1_000_000, " " * 999_999 + "the end", "日本語の長い文" * 60_000, "the quick  " * 100_000, "x\n   \n" * 100_000, "ñ" * 400_000, "a" * 400_000, "  é  中 "], ids=range(8))
def test_pieces_of_long_texts(text):
    import public_tokenizers
    import sentencepiece

    began = time.process_time()
    got = piece_codec.encoder("piece_bpe_32k.model").encode(text)
    assert time.process_time() - began < 20
    assert got == sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode(text)


def test_runs_of_spaces_equal_merging():
    e = piece_codec.encoder("piece_bpe_32k.model")
    for n in range(1, 120):
        for rest in ("", "the", "中", "\u0301", "é."):
            text = "\u2581" * n + rest
            assert e.runs
            assert [e.ids[p] for p in e.merge(text)] == e.word(text) or not e.characters.issuperset(rest)


def test_pieces_of_documents(spark, sf):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in piece_codec.encode_decode(docs, output=("ids",)).collect():
        assert r["ids"] == [*lib.encode(texts[r.doc_id]), lib.eos_id()]


# --- licenses


def test_licenses(spark):
    texts = [
        "intro\nReleased under the MIT License.\nmore",
        "Licensed under the Apache License, Version 2.0.",
        "We say: this work is licensed under the GNU General Public Licence, version 3, so be it.",
        "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.",
        "Copyright nobody, all rights reserved for the purple elephants of the moon",
        "no cue here", "", None,
    ]
    got = sorted((r.doc_id, r.block_no, r.license, r.n_diffs, r.exact, r.confirmed) for r in license_scan.scan_licenses(docs_of(spark, texts)).collect() if r.doc_id != 4)
    assert got == [(0, 1, "MIT", 0, True, True), (1, 0, "Apache-2.0", 0, True, True), (2, 0, "GPL-3.0", 1, False, True), (3, 0, "CC-BY-NC-4.0", 0, True, True), (3, 1, "MIT", 0, True, True)]
    assert not any(r.confirmed for r in license_scan.scan_licenses(docs_of(spark, texts)).where("doc_id = 4").collect())
    assert license_scan.scan_licenses(docs_of(spark, [])).count() == 0


def test_license_of_every_template():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for i, (name, text) in enumerate(license_scan.TEMPLATES):
        v = scanner.judge(f"see {text} end")
        assert (v.license, v.diffs) == (name, 0), i


@pytest.mark.parametrize("size", [1_000, 12_000, 100_000])
def test_license_in_a_long_line(spark, size):
    rng = random.Random(size)
    noise = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(size // 13))
    texts = [f"{noise()} {text} {noise()}" for _, text in license_scan.TEMPLATES]
    got = {r.doc_id: (r.license, r.n_diffs, r.confirmed) for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    assert got == {i: (name, 0, True) for i, (name, _) in enumerate(license_scan.TEMPLATES)}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_licenses(spark, mark):
    texts = ["\n".join(["import os", *[mark + x for x in textwrap.wrap(text, width, break_long_words=False)], "x = 1"]) for width in (20, 76) for _, text in license_scan.TEMPLATES]
    got = sorted((r.doc_id, r.block_no, r.license, r.n_diffs, r.confirmed) for r in license_scan.scan_licenses(docs_of(spark, texts)).collect())
    assert got == [(i, 1, license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)][0], 0, True) for i in range(len(texts))]


def test_several_licenses_in_a_line(spark):
    filler = "lorem ipsum dolor " * 40
    for between in (" ", f" {filler} ", "\n"):
        text = "é " + between.join(t for _, t in license_scan.TEMPLATES)
        got = license_scan.scan_licenses(docs_of(spark, [text])).orderBy("start").collect()
        assert [(r.license, r.n_diffs, r.confirmed, text[r.start : r.end]) for r in got] == [(name, 0, True, t) for name, t in license_scan.TEMPLATES]
    twice = license_scan.scan_licenses(docs_of(spark, ["Released under the MIT License. " * 2 + f"{filler} Copyright nobody"])).orderBy("start").collect()
    assert [(r.confirmed, r.start) for r in twice] == [(True, 0), (True, 32), (False, 64 + len(filler) + 1)]


def test_spdx_lines_and_families(spark):
    t = license_scan
    two, three = (t._BSD + t._BSD_CLAUSES + x + t._BSD_WARRANTY for x in ("", t._BSD_THIRD))
    texts = ["// SPDX-License-Identifier: MIT\nint x;", "# SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: Foo-1.0", two, three, t._BSD, "Copyright (c) 2020 Nobody\n\n" + dict(t.TEMPLATES)["MIT"]]
    texts += [dict(t.TEMPLATES)[n] for n in ("AGPL-3.0", "LGPL-3.0", "ISC", "Unlicense")][:0] + [x for n, x in t.TEMPLATES if n in ("AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "GPL-2.0", "ISC", "Unlicense", "Zlib") and "SPDX" not in x]
    got = {r.doc_id: (r.license, r.exact) for r in license_scan.scan_licenses(docs_of(spark, texts)).where("confirmed").collect()}
    assert got.get(2) is None
    assert [got[i] for i in (0, 1, 3, 4, 5)] == [("MIT", True), ("GPL-2.0", True), ("BSD-2-Clause", True), ("BSD-3-Clause", True), ("BSD", True)]
    assert [got[i][0] for i in range(7, len(texts))] == ["GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "ISC", "Unlicense", "Zlib"]


def test_unconfirmed_and_spdx_expressions(spark):
    texts = [
        "Copyright 2020 by Foo. All rights reserved.", "// SPDX-License-Identifier: EUPL-1.2\nint x;", "SPDX-License-Identifier: MIT OR Apache-2.0", "/* SPDX-License-Identifier: (GPL-2.0-only OR  BSD-2-Clause) */",
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0.", "SPDX-License-Identifier: MIT AND Foo", "SPDX-License-Identifier: MIT.", "SPDX-License-Identifier: MIT\nReleased under the MIT License.",
    ]
    rows = license_scan.scan_licenses(docs_of(spark, texts)).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.license, r.exact, r.confirmed) for r in rows] == [
        (0, None, False, False), (1, None, False, False), (2, "MIT OR Apache-2.0", True, True), (3, "(GPL-2.0-only OR BSD-2-Clause)", True, True), (4, "GPL-2.0-only WITH Classpath-exception-2.0", True, True),
        (5, None, False, False), (6, "MIT", True, True), (7, "MIT", True, True), (7, "MIT", True, True),
    ]
    assert [texts[r.doc_id][r.start : r.end] for r in rows if r.doc_id in (1, 3, 5)] == ["SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: (GPL-2.0-only OR  BSD-2-Clause)", "SPDX-License-Identifier: MIT AND Foo"]


def test_the_winner_is_the_confirmed_template_that_saves_most():
    """Against all templates at all places of short texts."""
    rng = random.Random(12)
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    words = [w for _, t in license_scan.TEMPLATES for w in t.split()]
    for i, (_, said) in enumerate(license_scan.TEMPLATES):
        own = said.split()
        for _ in range(int(0.1 * len(own))):
            own[rng.randrange(len(own))] = rng.choice(words)
        text = " ".join([*(rng.choice("abc") for _ in range(3)), *own, "x"])
        b = license_scan.wording(text)
        confirmed = [k for k, w in enumerate(scanner.wordings) if plain_differences(w, b) <= 0.1 * len(w)]
        for n in scanner.notices(text):
            block = text[n.start : n.end]
            if n.verdict.confirmed and len(license_scan.wording(block)) >= 0.9 * len(scanner.wordings[i]):
                saved = {k: s for s, k in scanner.rank(block) if k in confirmed}
                assert scanner.names[n.verdict.template] == scanner.names[max(saved, key=lambda k: (saved[k], -k))] or saved[n.verdict.template] == max(saved.values())


def plain_differences(t, b):
    row = [0] * (len(b) + 1)
    for i, w in enumerate(t, 1):
        new = [i]
        for j, x in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_license_query_against_brute_force(spark, sf):
    from quire.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_license_scan(spark, sf).collect()
    held = {}
    for r in rows:
        held.setdefault(r.doc_id, []).append(r)
        if r.confirmed:
            name, said = license_scan.TEMPLATES[r.template]
            template = license_scan.wording(said)
            assert r.license == name
            assert r.n_diffs == plain_differences(template, license_scan.wording(docs[r.doc_id][r.start : r.end])) <= 0.1 * len(template)
            assert r.exact == (r.n_diffs == 0)
    found = 0
    for i, text in docs.items():
        words = [(m.start(), w) for m in re.finditer(r"\S+", text) if (w := m.group().lower().strip(license_scan._PUNCTUATION))]
        flat = [w for _, w in words]
        for name, said in license_scan.TEMPLATES:
            t = license_scan.wording(said)
            for k in range(len(flat) - len(t) + 1):
                if flat[k : k + len(t)] == t:  # every exact wording lies in a confirmed notice
                    found += 1
                    assert any(r.confirmed and r.start <= words[k][0] < r.end for r in held.get(i, [])), (i, name)
        for m in license_scan._CUE.finditer(text):  # every cue is part of a row
            at = max(p for p, _ in words if p <= m.start())
            assert any(r.start <= at < r.end for r in held.get(i, [])), (i, m.group())
    assert found


def test_differences():
    plain = plain_differences
    rng = random.Random(6)
    for _ in range(300):
        t, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 8))] for _ in range(2))
        assert license_scan.differences(t, b) == plain(t, b)


# --- Jaccard join


def classes(rows, words, percent):
    sets, parent = [], {i: i for i, _ in rows if i is not None}
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set())

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and None not in (rows[a][0], rows[b][0]) and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = top(rows[a][0]), top(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else top(i)) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


@pytest.mark.parametrize(("seed", "words", "percent", "stars"), [(0, 4, 85, 3), (1, 5, 80, 3), (2, 2, 60, 0), (3, 1, 70, 1), (4, 3, 100, 3)])
def test_jaccard_against_brute_force(spark, rows, seed, words, percent, stars):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 60))] for _ in range(6)]
    data = []
    for i in range(120):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = f"w{rng.randrange(30)}"
        if rng.random() < 0.2:
            text += rng.choice(base)[:10]
        data.append((i, " ".join(text).upper() if rng.random() < 0.2 else "\t ".join(text)))
    data += [(200, None), (201, ""), (202, " \n"), (None, data[0][1]), (204, "one"), (205, "ONE"), (206, "one two")]
    docs = spark.createDataFrame([(*d, 0, "clash") for d in data], "doc_id bigint, text string, component_id int, tokens string")
    out = jaccard_join.jaccard_components(docs, words=words, percent=percent, star_rounds=stars)
    assert rows(out, "doc_id", "n_shingles", "component_id") == classes(data, words, percent)


def test_jaccard_long_texts_and_no_rows(spark):
    text = " ".join(f"t{i}" for i in range(300_000))
    docs = docs_of(spark, [text, text + " end", "x" * 3_000_000, text[:-3000]])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got[0] == (299_996, 0)
    assert got[1] == (299_997, 0)
    assert got[2] == (1, 2)
    assert got[3][1] == 0
    assert jaccard_join.jaccard_components(docs_of(spark, [])).count() == 0


def thue_morse(a, b, rounds):
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_jaccard_of_words_that_polynomial_hashes_confuse(spark, rows):
    data = list(enumerate([*thue_morse("a", "b", 10), *(" ".join(thue_morse("c", "d", 10)[k] for k in (0, 1, i % 2, i % 3 % 2)) for i in range(6))]))
    docs = docs_of(spark, [t for _, t in data])
    assert rows(jaccard_join.jaccard_components(docs, words=4, percent=85), "doc_id", "n_shingles", "component_id") == classes(data, 4, 85)


@pytest.mark.parametrize("words", [1, 4, 5, 9])
def test_exact_sets(words):
    rng = random.Random(words)
    texts = [" ".join(rng.choice("abcdE") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts += [" ".join(str(rng.randrange(10**6)) for _ in range(20_000)), texts[3] + " x", "a\x0bB\u00a0c"]  # many words: their numbers don't fit one 64-bit number
    plain = []
    for t in texts:
        w = t.encode().lower().split()
        plain.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    got = [set(x.tolist()) for x in jaccard_join.exact_sets([t.encode() for t in texts], words)]
    assert [len(x) for x in got] == [len(x) for x in plain]
    assert all(len(x & y) == len(p & q) for x, p in zip(got, plain, strict=True) for y, q in zip(got, plain, strict=True))


def test_jaccard_deals_stars_in_shares(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_SHARE", 5)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    data = []
    for i in range(90):
        text = list(base) if i % 3 else [f"v{rng.randrange(40)}" for _ in range(60)]
        text[rng.randrange(60)] = f"n{i}"
        data.append((i, " ".join(text)))
    out = jaccard_join.jaccard_components(docs_of(spark, [t for _, t in data]), words=2, percent=80)
    assert rows(out, "doc_id", "n_shingles", "component_id") == classes(data, 2, 80)


@pytest.mark.parametrize("name", ["_gone", "a.b"])
def test_drop_near_copies_with_clashing_columns(spark, name):
    text = " ".join(f"t{i}" for i in range(60))
    docs = spark.createDataFrame([(0, text, 1), (1, text + " more", 2), (None, text, 3)], f"doc_id bigint, text string, `{name}` int")
    out = jaccard_join.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r)[2] for r in out.collect()) == [1, 3]


def test_drop_near_copies(spark):
    text = " ".join(f"t{i}" for i in range(60))
    out = jaccard_join.drop_near_copies(docs_of(spark, [text, text + " more", "other words here", None]))
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3]
    assert out.columns == ["doc_id", "text", "n_tokens", "spans"]


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    parent = {x: x for link in links for x in link}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    named = {x for a, b in links if a != b for x in (a, b)}
    got = {r.id: r.component for r in jaccard_join.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for x in named}
    assert jaccard_join.components(spark.createDataFrame([], "a bigint, b bigint")).select(F.col("id")).count() == 0
