"""Toxicity, WARC audits, the registered queries and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quire.llm import decontaminate, queries, toxicity, warc

# --- toxicity


def invented(n, seed=0):
    """Texts of invented words; label 1 where they hold words of abuse, which no list in the code names."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "ren", "sha"]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [word() for _ in range(rng.randint(20, 60))]
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words[rng.randrange(len(words))] = rng.choice(["zurgle", "you bloffer", "Gribnak!", "vexpod"])
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    data = invented(900)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in data], "doc_id bigint, text string, label string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(5000, None), (None, 1), (0, data[0][2])], "doc_id bigint, toxic int")
    return data, docs, labels, toxicity.fit_toxicity(docs, labels, trees=8)


def test_held_out_accuracy(learned):
    data, docs, _, model = learned
    truth = {i: y for i, _, y in data}
    got = {r.doc_id: r for r in model.score(docs).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(data)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95


def test_held_out_labels_are_not_seen(spark, learned):
    data, docs, _, model = learned
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in data], "doc_id bigint, toxic int")
    again = toxicity.fit_toxicity(docs, flipped, trees=8)
    assert again.lexicon == model.lexicon
    some = docs.limit(50)
    assert sorted(tuple(r) for r in again.score(some).collect()) == sorted(tuple(r) for r in model.score(some).collect())


def test_toxicity_of_odd_texts(spark, learned):
    texts = [None, "", " \n", "zurgle " * 50_000, "x" * 200_000, "!!!", "YOU " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = learned[3].score(docs).collect()
    assert len(got) == len(texts)
    assert all(r.score is not None for r in got)
    assert learned[3].score(docs.limit(0)).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [(r.score, r.predicted) for r in model.score(docs).collect()] == [(0.0, 0)] * 2


def test_drop_toxic_keeps_columns_and_clean_rows(learned):
    data, docs, labels, _ = learned
    kept = toxicity.drop_toxic(docs, labels, trees=8)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean, toxic = {i for i, _, y in data if not y}, {i for i, _, y in data if y}
    assert len(clean & ids) / len(clean) > 0.97
    assert len(toxic & ids) / len(toxic) < 0.05


def test_features():
    f = toxicity.Features({"bad": 3.0, "^grue": 2.0})
    named = dict(zip(toxicity.FEATURES, f.of("you BAD gruesome b4d, fine!!"), strict=True))
    assert named["hit_density"] == pytest.approx(1 / 5)
    assert named["most_weight"] == 3
    assert named["most_stem"] == 2
    assert named["close_hits"] == 1
    assert named["uncovered"] == 3
    assert named["shouted"] == pytest.approx(1 / 5)
    assert f.of("") == [0.0] * len(toxicity.FEATURES)


def plain_features(text, lexicon):
    """Token by token, without memory, numpy or shortcuts."""
    t = toxicity
    n = letters = upper = shouted = marks = exclaimed = symbols = chars = obscure = 0
    word_sum = stem_sum = uncovered = 0.0
    words, stems, hits, addressed = [0.0], [0.0], [], []
    for i, token in enumerate(text.split()):
        parts = "".join(c if c.isalpha() else " " for c in token.lower()).split()
        word = max([lexicon.get(p, 0.0) for p in parts], default=0.0)
        stem = max([lexicon.get("^" + p[:k], 0.0) for p in parts for k in t.PREFIXES if len(p) > k], default=0.0)
        core = token.strip(t._EDGES)
        own = [c for c in token if c.isalpha()]
        ups = sum(c.isupper() for c in own)
        odd = bool(own) and any(not c.isalpha() and c not in "'’-" for c in core)
        n, letters, upper, chars = n + 1, letters + len(own), upper + ups, chars + len(token)
        shouted += len(own) > 2 and ups == len(own)
        marks += sum(not c.isalnum() for c in token)
        exclaimed += token.count("!")
        symbols += sum(token.count(c) for c in "%&$*#@|~^")
        obscure += odd
        if odd and not word:
            uncovered += lexicon.get("".join(c for c in core.lower().translate(t.LOOKALIKE) if c.isalpha()), 0.0)
        word_sum, stem_sum = word_sum + word, stem_sum + stem
        words.append(word)
        stems.append(stem)
        if word > 0:
            hits.append(i)
        if any(p in t.SECOND_PERSON for p in parts):
            addressed.append(i)
    if not n:
        return [0.0] * len(t.FEATURES)
    close, n_stems = sum(any(abs(h - a) <= t.NEAR for a in addressed) for h in hits), sum(x > 0 for x in stems)
    return [
        math.log1p(n), len(hits) / n, math.log1p(len(hits)), word_sum / n, max(words), n_stems / n, math.log1p(n_stems), stem_sum / n, max(stems),
        close, close / n, len(addressed) / n, upper / max(letters, 1), shouted / n, marks / max(chars, 1), exclaimed / n, symbols / max(chars, 1), obscure / n, uncovered,
    ]


def test_features_against_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "_CHUNK", 300)  # long texts take several stretches
    rng = random.Random(8)
    lexicon = {"bad": 3.0, "badly": 2.5, "^grue": 2.25, "^badly": 2.75, "idiot": 4.0, "ünfug": 2.0}
    some = ["you", "BAD", "b4d", "gruesome", "badlyish", "1d10t!", "fine,", "Tú", "don't", "$$$", "3.14", "ÜNFUG!!", "a-b", "(euch)", "x" * 40, "i.d.i.o.t", "\u00a0", "it's", "#bad#", "‘bad’"]
    maker = toxicity.Features(lexicon)
    for k in (0, 1, 2, 5, 30, 400):
        for _ in range(20):
            text = "".join(rng.choice(some) + rng.choice([" ", "\n", "  "]) for _ in range(k))
            assert maker.of(text) == pytest.approx(plain_features(text, lexicon), rel=1e-5)


def test_toxicity_query_against_brute_force(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    fitted = []
    fit = toxicity.fit_toxicity
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    (model,) = fitted
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        score = model.base_rate
        if model.trees is not None:
            score = model.trees.predictProbability(Vectors.dense([float(np.float32(x)) if k in (4, 8) else x for k, x in enumerate(toxicity.Features(model.lexicon).of(docs[i]))]))[1]
            if model.calibration is not None:
                score = float(np.interp(score, model.calibration.boundaries, model.calibration.predictions))
        assert r.score == pytest.approx(score, abs=1e-6)
        assert r.predicted == int(r.score >= 0.5)
    held = [(got[i].score, y) for i, y in labels.items() if y is not None and i in got and got[i].held_out]
    right = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x > y]
    assert not right or sum(right) / len(right) > 0.8


def test_no_model_keeps_all_rows(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 2 else "other", i, i) for i in range(60)], "doc_id bigint, text string, `a.b` int, score int")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns
    assert out.count() == 60


def test_drop_toxic_with_odd_columns(spark, learned):
    data, _, labels, _ = learned
    names = ["a.b", "features", "prediction", "_row", "_text", "margin"]
    docs = spark.createDataFrame([(i, t, *[i] * 6) for i, t, _ in data], "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = toxicity.drop_toxic(docs, labels, trees=8)
    assert out.columns == docs.columns
    left = out.collect()
    assert 400 < len(left) < 900
    assert all(r["a.b"] == r.doc_id == r["margin"] for r in left)


# --- WARC

PAGES = "page_id bigint, url string, html string, archive string"


def test_records(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>ü", ""), (0, None, None, ""), (5, "u", "x" * 100_000, "")], PAGES)
    got = {r.page_id: r for r in warc.warc_records(pages, per_archive=4).collect()}
    lines = bytes(got[1].record).split(b"\r\n")
    assert lines[:2] == [b"WARC/1.0", b"WARC-Type: response"]
    assert re.fullmatch(rb"WARC-Record-ID: <urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", lines[2])
    assert lines[3:] == [
        b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: http://a/", b"Content-Type: application/http; msgtype=response", b"Content-Length: 83", b"",
        b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: 5", b"", b"<p>\xc3\xbc", b"", b"",
    ]
    assert (got[0].offset, got[1].offset, got[5].offset) == (0, got[0].length, 0)
    assert all(r.length == len(r.record) and r.sha256 == hashlib.sha256(r.record).hexdigest() for r in got.values())


def test_records_read_back(spark, tmp_path):
    texts = ["<p>ü", None, "a\r\n\r\nb", "x" * 100_000, "WARC/1.0\r\n", ""]
    pages = spark.createDataFrame([(i, f"http://h/é{i}", t, "") for i, t in enumerate(texts)], PAGES)
    rows = sorted(warc.warc_records(pages).collect(), key=lambda r: r.offset)
    (tmp_path / "a.warc").write_bytes(b"".join(bytes(r.record) for r in rows))
    (tmp_path / "broken.warc").write_bytes(bytes(rows[0].record) + b"no record\r\n\r\n")
    back = warc.read_warc(spark, str(tmp_path)).select("*", warc.parse_record(F.col("record")).alias("r")).orderBy("path", "offset").collect()
    assert [(r.offset, r.length, bytes(r.record)) for r in back[:6]] == [(r.offset, r.length, bytes(r.record)) for r in rows]
    assert [(r.r.type, r.r.uri, r.r.payload) for r in back[:6]] == [("response", f"http://h/é{i}", t or "") for i, t in enumerate(texts)]
    assert len({r.r.id for r in back[:6]}) == 6
    assert [r.r.payload for r in back[6:]] == ["<p>ü", None]


def test_null_ids_dont_gather(spark):
    pages = spark.createDataFrame([(None, "u", "x", "")] * 40 + [(3, "u", "x", "")], PAGES).repartition(3)
    per = {r.archive: r["count"] for r in warc.warc_records(pages, per_archive=8).groupBy("archive").count().collect()}
    assert per.pop(0) == 1
    assert sum(per.values()) == 40
    assert max(per.values()) <= 8
    assert max(per) < 0


def test_no_record_is_shuffled(spark, sf):
    plan = queries.op7_warc_audit(spark, sf)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in re.findall(r"hashpartitioning\(.*|Exchange.*", plan)]
    assert moved
    assert not any("record" in x or "html" in x for x in moved)


@pytest.mark.parametrize(("range_bytes", "fanout"), [(64, 2), (1 << 18, 8), (1000, 3)])
def test_audit_against_brute_force(spark, range_bytes, fanout):
    rng = random.Random(range_bytes)
    rows = [(a, i * 40, 40, f"h{a}-{i}") for a in (0, 1, 2, None) for i in range(60)]
    theirs = [r for r in rows if rng.random() > 0.03]
    theirs = [(a, o, n, h + "x" if rng.random() < 0.03 else h) for a, o, n, h in theirs if a != 2] + [(1, 9_000, 40, "new"), (7, 0, 1, "new"), (0, 0, 40, "h0-0")]
    kind = "archive bigint, offset bigint, length bigint, sha256 string"
    got = {(r.archive, r.offset): r.status for r in warc.audit(spark.createDataFrame(rows, kind), spark.createDataFrame(theirs, kind), range_bytes, fanout).collect()}
    expected = {}
    for at in {r[:2] for r in rows + theirs}:
        left, right = ([r for r in x if r[:2] == at] for x in (rows, theirs))
        only_left = [r for r in left if left.count(r) > right.count(r)]
        only_right = [r for r in right if right.count(r) > left.count(r)]
        if only_left or only_right:
            expected[at] = "changed" if only_left and only_right else "missing" if only_left else "extra"
    assert got == expected


def laid_out(records):
    """(archive, offset, length, sha256) of records (length, sha256) that follow each other."""
    at, out = 0, []
    for length, sha in records:
        out.append((0, at, length, sha))
        at += length
    return out


@pytest.mark.parametrize("damage", ["lost", "put in", "changed", "longer", "two lost", "none"])
def test_audit_aligns_what_has_moved(spark, damage):
    kind = "archive bigint, offset bigint, length bigint, sha256 string"
    records = [(100 + i % 7, f"s{i % 40}") for i in range(50)]  # some of them twice
    theirs = list(records)
    if damage == "put in":
        theirs.insert(20, (30, "new"))
    elif damage in ("changed", "longer"):
        theirs[20] = (106 if damage == "changed" else 150, "other")
    elif damage != "none":
        for i in (30, 12) if damage == "two lost" else (20,):
            del theirs[i]
    ours = laid_out(records)
    found = warc.audit(spark.createDataFrame(ours, kind), spark.createDataFrame(laid_out(theirs), kind), 256, 4, aligned=True).collect()
    what = lambda s: sorted(r.offset for r in found if r.status == s)
    at = [r[1] for r in ours]
    expected = {"lost": ([at[20]], [], []), "put in": ([], [at[20]], []), "changed": ([], [], [at[20]]), "longer": ([], [], [at[20]]), "two lost": ([at[12], at[30]], [], []), "none": ([], [], [])}[damage]
    assert (what("missing"), what("extra"), what("changed")) == expected
    back = {(o, l, s) for _, o, l, s in laid_out(theirs)}
    assert all((r.their_offset, *next(x[2:] for x in ours if x[1] == r.offset)) in back for r in found if r.status == "moved")


def test_gzip_archives(spark, tmp_path):
    import gzip

    record = lambda body: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    one, two, three = record(b"one"), record(b"two two"), record(b"3" * 5000)
    members = [gzip.compress(one), gzip.compress(two + three), gzip.compress(b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "b.warc.gz").write_bytes(members[0] + members[1][:-9])
    (tmp_path / "c.warc").write_bytes(b"")
    got = sorted((r.path[-9:], r.offset, r.length, bytes(r.record)) for r in warc.read_warc(spark, str(tmp_path)).collect())
    first, second, third = map(len, members)
    assert got == sorted([("a.warc.gz", 0, first, one), ("a.warc.gz", first, second, two), ("a.warc.gz", first, second, three), ("a.warc.gz", first + second, third, b""), ("b.warc.gz", 0, first, one), ("b.warc.gz", first, second - 9, members[1][:-9])])


def test_audit_of_equal_and_empty_replicas(spark):
    kind = "archive bigint, offset bigint, length bigint, sha256 string"
    some, none = spark.createDataFrame([(0, 0, 5, "a"), (0, 5, 5, "b")], kind), spark.createDataFrame([], kind)
    assert warc.audit(some, some).count() == 0
    assert warc.audit(none, none).count() == 0
    assert {r.status for r in warc.audit(some, none).collect()} == {"missing"}
    assert warc.audit(none, some).count() == 2


# --- registered queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = con.execute(queries.ORACLES[name])
    names = sorted(c[0] for c in expected.description)
    want = sorted((tuple(dict(zip([c[0] for c in expected.description], r, strict=True))[n] for n in names) for r in expected.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == want


def test_decontamination_query(spark, sf):
    docs = {r.doc_id: decontaminate.words(r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {str(r.item_id): decontaminate.words(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    windows = {}
    for k, s in items.items():
        for i in range(max(1, len(s) - 9)):
            windows.setdefault(tuple(s[i : i + 10]), set()).add(k)
    hit_docs = 0
    for r in queries.op6_decontaminate(spark, sf).collect():
        w, hit, found = docs[r.doc_id], set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    found |= own
                    hit |= set(range(i, i + n))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        hit_docs += bool(hit)
    assert hit_docs


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), corpus_pipeline.COLUMNS
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        if k < 4:
            assert made.columns == columns
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k == 1:
            assert docs.select("text").distinct().count() == docs.count()
        if k == 3:
            left = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert left.where(F.size("spans") > 0).count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    assert counts == sorted(counts, reverse=True)
    assert counts[-1] > counts[0] / 2
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
