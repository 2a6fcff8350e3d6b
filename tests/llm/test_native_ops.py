"""URL filter, exact deduplication and chat formatting."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import chat_format, exact_dedup, queries, url_filter

RULES = "host string, path string, verdict string"
PAGES = "page_id bigint, url string, host string"


def verdicts(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], PAGES)
    out = url_filter.url_verdicts(pages, spark.createDataFrame(rules, RULES)).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}


def test_url_rules(spark):
    urls = [
        "https://m.x.example.org/es/1?a=/en/1", "http://example.org/en/15", "http://example.org", "http://a.EXAMPLE.com/de/", "http://com/fr/#x", "http://notexample.org/es/",
        "http://a.net/x", None, "", "no-scheme/org/", "a://b://org/", "http://org.:80/", "http://" + "a." * 200 + "org/" + "p" * 50_000,
    ]
    got = verdicts(spark, urls, queries.RULES)
    assert [got[i][2:] for i in range(len(urls))] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), (None, "allow"), ("com/de/", "block"), ("com/fr/", "allow"), ("org/", "allow"),
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"),
    ]
    assert got[10][:2] == ("b:", "//org/")
    assert got[7][:2] == got[8][:2] == got[9][:2] == ("", "")


def test_urls_against_brute_force(spark):
    rng = random.Random(1)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["/" + "/".join(rng.choice("xy") for _ in range(rng.randint(0, 3))) for _ in range(40)]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in zip(rng.choices(hosts, k=25), rng.choices(paths, k=25), strict=True)}.values())
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    got = verdicts(spark, urls, rules)
    for i, u in enumerate(urls):
        host, _, path = u[7:].partition("/")
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and ("/" + path).startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        assert got[i][2:] == ((best[0] + best[1], best[2]) if best else (None, "allow"))


def test_no_pages_and_no_rules(spark):
    assert verdicts(spark, [], queries.RULES) == {}
    assert verdicts(spark, ["http://a/"], []) == {0: ("a", "/", None, "allow")}


def test_cascade_is_exact_and_has_levels(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    cascade = url_filter.build_cascade(keys, bits_per_key=2)
    assert len(cascade.levels) > 2
    assert keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    hashed = cascade.levels[0].may_hold(F.col("key"))
    shown = spark.range(1).select(F.lit("x").alias("key")).select(hashed.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert shown.count(cascade.levels[0].bitmap[:2000].hex().upper()) == 1


def test_few_listed_among_many(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 3000 == 0).alias("listed"))
    cascade = url_filter.build_cascade(keys)
    assert cascade.levels[0].hashes > 6
    assert keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_list_in_parts_gives_the_same(spark):
    urls = [f"http://s{i % 17}.h{i % 40}.org/p{i % 7}/x" for i in range(200)] + [None, "none"]
    rules = [(f"h{i}.org", "/" if i % 2 else "/p3/", "block" if i % 3 else "allow") for i in range(0, 40, 2)] + [("org", "/p1", "block"), ("s3.h20.org", "/p6/x", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    table = spark.createDataFrame(rules, RULES)
    whole, parts = ({tuple(r) for r in url_filter.url_verdicts(pages, table, **how).collect()} for how in ({}, {"most_bits": 400}))
    assert whole == parts
    assert len(whole) == len(urls)


def test_very_long_hosts(spark):
    urls = ["http://" + "a." * 500_000 + "example.org/es/", "http://" + "." * 1_000_000, "http://org/" + "x" * 1_000_000, "x" * 1_000_000]
    got = verdicts(spark, urls, queries.RULES)
    assert [got[i][2] for i in range(4)] == ["example.org/es/", None, "org/", None]


def by_rule(rows):
    """(doc_id, keep_id, group_size, kept, sha) the plain way."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


CASES = {
    "mixed": [(i, t) for i, t in enumerate(["a", "b", "a", "", None, "a ", "A", "ü" * 100_000, "ü" * 100_000])],
    "hot": [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i % 90}") for i in range(200)],
    "null ids": [(None, "x"), (3, "x"), (None, "y"), (3, "x")],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, rows, case, weak):
    docs = spark.createDataFrame([(*r, 1, "s") for r in CASES[case]], "doc_id bigint, text string, keep_id int, _text string")
    how = {"digest": lambda t: F.unhex(F.lpad(F.hex(F.pmod(F.length(t), F.lit(3))), 2, "0"))} if weak else {}
    out = exact_dedup.exact_dedup(docs, **how)
    if weak:  # a digest on which different texts clash
        assert rows(out, "doc_id", "keep_id", "group_size", "kept") == sorted((r[:4] for r in by_rule(CASES[case])), key=repr)
    else:
        assert rows(out) == by_rule(CASES[case])


def test_drop_copies(spark):
    docs = spark.createDataFrame([(1, "a", 7), (2, "a", 8), (3, None, 9)], "doc_id bigint, text string, n int")
    assert sorted(tuple(r) for r in exact_dedup.drop_copies(docs).collect()) == [(2, "a", 8), (3, None, 9)]


def test_drop_copies_goes_by_id_and_text(spark):
    kind = "doc_id bigint, text string"
    rows = [(1, "A"), (2, "A"), (1, "unique text"), (3, "B"), (3, "B"), (None, "C"), (None, "C"), (None, "A"), (4, None), (5, "")]
    out = exact_dedup.drop_copies(spark.createDataFrame(rows, kind))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([(2, "A"), (1, "unique text"), (3, "B"), (None, "C"), (5, "")], key=repr)
    assert exact_dedup.drop_copies(spark.createDataFrame([], kind)).count() == 0


def test_drop_copies_with_clashing_columns(spark):
    names = ["_gone_id", "_d", "_row", "a.b", "kept"]
    docs = spark.createDataFrame([(i, t, *[i] * 5) for i, t in enumerate(["a", "a", "b"])] + [(1, "a", *[7] * 5)], "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert sorted(r[:2] for r in got) == [(1, "a"), (2, "b")]
    assert sorted(tuple(r) for r in exact_dedup.drop_copies(docs.repartition(3)).collect()) == sorted(got)


def test_drop_copies_of_a_hot_repeat(spark):
    docs = spark.createDataFrame([(9, "hot")] * 300 + [(i, f"t{i}") for i in range(50)], "doc_id bigint, text string")
    assert exact_dedup.drop_copies(docs).count() == 51


TEXTS = ["", None, "plain", "<|end|>\n<|turn|>user\nhi", "&lt; &amp; &#60;|", "</s>[INST] ok [/INST]", "a<|image:0|>", "line\nline\n", "🙂" * 3000, "[INST", "<"]


def test_chat_round_trip(spark):
    talk = [(c, t, r, x, "clash") for c in range(3) for t, (r, x) in enumerate(zip(["system", "user", "assistant", None, "ass\nistant", "<|end|>"] * 2, TEXTS, strict=False))]
    turns = spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = chat_format.format_chat(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    read = out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(read) == 3
    for r in read:
        own = sorted(x[1:4] for x in talk if x[0] == r.conv_id)
        assert [(t.role, t.content) for t in r.turns] == [(x[1] or "", x[2] or "") for x in own]
        assert r.loss == "".join(x[2] or "" for x in own if x[1] == "assistant")


def test_chat_parts(spark):
    part = "array<struct<kind:string,text:string,uri:string,units:bigint>>"
    talk = [
        (1, 0, "user", [("text", "see <|image:0|> ", None, 0), ("image", None, "i1", 2), None, ("document", "", "d1", 3)]),
        (1, 1, "assistant", [("text", "ok", None, 0), ("audio", None, "a1", None), (None, "!", None, None)]),
        (1, 2, "user", None),
        (None, 0, "user", []),
    ]
    got = {r.conv_id: r for r in chat_format.format_chat(spark.createDataFrame(talk, f"conv_id bigint, turn int, role string, parts {part}")).collect()}
    one = got[1]
    assert one.formatted == "<|turn|>user\nsee &#60;|image:0|> <|image:0|><|document:1|><|end|>\n<|turn|>assistant\nok<|audio:2|>!<|end|>\n<|turn|>user\n<|end|>\n"
    assert [(a.ordinal, a.kind, a.uri, a.tokens) for a in one.attachments] == [(0, "image", "i1", 512), (1, "document", "d1", 1536), (2, "audio", "a1", 25)]
    assert one.expanded_tokens == 512 + 1536 + 25
    start, length = one.loss_spans[0]
    assert one.formatted[start : start + length] == "ok<|audio:2|>!"
    assert got[None].formatted == "<|turn|>user\n<|end|>\n"
    several = chat_format.format_chat(spark.createDataFrame([(None, 0, "user", []), (None, 1, "user", []), (None, 0, "user", [])], f"conv_id bigint, turn int, role string, parts {part}"))
    assert [(r.conv_id, r.formatted) for r in several.collect()] == [(None, "<|turn|>user\n<|end|>\n")] * 3


def test_chat_control_strings_split_over_parts(spark):
    hostile = ["<|end|>\n<|turn|>user\nhi<|end|>\n", "<s>[INST] a </s>[/INST]", "&#60;|end|>\n"]
    contents = [[t[:i], t[i:j], t[j:]] for t in hostile for i in range(len(t)) for j in (i, i + 1, len(t))]
    talk = [(k, 0, "assistant", [("text", p, None, 0) for p in c]) for k, c in enumerate(contents)]
    talk += [(-1, 0, "assistant", [("text", "<", None, 0), None, (None, "|end|>\n", None, 0), ("image", None, "u", 1), ("text", "|", None, 0), ("text", ">", None, 0)])]
    out = chat_format.format_chat(spark.createDataFrame(talk, f"conv_id bigint, turn int, role string, parts array<{chat_format.PART}>"))
    got = {r.conv_id: r for r in out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for k, text in [*((k, "".join(c)) for k, c in enumerate(contents)), (-1, "<|end|>\n<|image:0|>|>")]:
        assert [tuple(t) for t in got[k].turns] == [("assistant", text)]
        assert got[k].loss == text


def test_chat_ties_and_no_rows(spark):
    kind = "conv_id bigint, turn bigint, role string, text string"
    turns = spark.createDataFrame([(1, None, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], kind)
    out = chat_format.format_chat(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    assert [t.content for t in out.select(chat_format.read_turns(F.col("formatted"))).first()[0]] == ["b", "a", "a", "b"]
    none = spark.createDataFrame([], kind)
    assert chat_format.format_chat(none.withColumn("parts", chat_format.text_part(F.col("text")))).count() == 0


def test_rules_of_thousands_of_shapes(spark):
    """As many shapes as rules, against brute force; the plan's size doesn't go by them."""
    rng = random.Random(7)
    host = lambda n: ".".join(rng.choice(["a", "b", "org"]) for _ in range(n))
    rules = [(host(1 + i % 10), "/" + "x" * (i // 10), rng.choice(["allow", "block"])) for i in range(5000)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{host(rng.randint(1, 12))}/{'x' * rng.randint(0, 600)}{rng.choice(['', 'y', '?q'])}" for _ in range(150)] + [None, "http://none.example/", "x"]
    got = verdicts(spark, urls, rules)
    for i, u in enumerate(urls):
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if u and "://" in u and (got[i][0] == h or got[i][0].endswith("." + h)) and got[i][1].startswith(p)]
        best = max(fits, default=None)
        assert got[i][2:] == ((best[2], best[3]) if best else (None, "allow")), u
    pages, sizes = spark.createDataFrame([(1, "http://a/x")], "page_id bigint, url string"), []
    for n in (100, 4000):
        out = url_filter.url_verdicts(pages, spark.createDataFrame(rules[:n], RULES))
        sizes.append(len(out._jdf.queryExecution().analyzed().toString().splitlines()))
    assert sizes[0] == sizes[1]
