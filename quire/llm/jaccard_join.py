"""Exact Jaccard self-join on word n-grams with a token-group matrix, and the components of its links."""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_words, quoted, release_memory, staged, unused

_CHUNK = 1 << 20  # bytes of text that are hashed or compared at once
_STRETCH = 1_000_000  # tokens among which a task counts
_FEW = 200_000  # rows of a table of links up to which one task takes them all
_SHARE = 2048  # pairs of one star that are compared in one place
_U = np.uint64


def _mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a public finaliser, splitmix64)."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _hashed(text: bytes) -> tuple[np.ndarray, bytes]:
    """The hashes of a text's words (SipHash over their bytes), and a digest of the sequence of words."""
    parts, whole = [], hashlib.blake2b(digest_size=16)
    for words in ascii_words(text):
        if words:
            whole.update(b" ".join(words) + b" ")
            parts.append(hash_array(np.array(words, dtype=object), categorize=False))
    return (parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, _U), *parts])), whole.digest()


def shingle_sets(texts: list[bytes], words: int) -> list[tuple[np.ndarray, bytes]]:
    """For each text its distinct shingles of `words` words as sorted 64-bit hashes; of fewer words, the whole sequence as one. With a
    digest of the sequence of words."""
    out: list[tuple[np.ndarray, bytes]] = []
    at = 0
    while at < len(texts):
        end, size, group = at, 0, []
        while end < len(texts) and (end == at or size + len(texts[end]) < _CHUNK):
            size += len(texts[end])
            group.append(_hashed(texts[end]))
            end += 1
        hashes = group[0][0] if len(group) == 1 else np.concatenate([h for h, _ in group])
        n = max(0, len(hashes) - words + 1)
        shingles = np.zeros(n, _U)
        for i in range(words):
            shingles = _mix(shingles * _U(0x2545F4914F6CDD1D) + hashes[i : i + n])
        a = 0
        for own, digest in group:
            b = a + len(own)
            if len(own) >= words:
                out.append((np.unique(shingles[a : b - words + 1]), digest))
            else:
                short = np.zeros(min(1, len(own)), _U)
                for w in own:
                    short = _mix(short * _U(0x2545F4914F6CDD1D) + w)
                out.append((short, digest))
            a = b
        at = end
    return out


def exact_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text its distinct shingles as numbers, equal among these texts if and only if their words are: no hash decides."""
    number: defaultdict[bytes, int] = defaultdict(itertools.count(1).__next__)
    ids = [np.concatenate([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in ascii_words(t)]) for t in texts]
    for i, x in enumerate(ids):
        if 0 < len(x) < words:
            ids[i] = np.concatenate((x, np.zeros(words - len(x), np.int64)))  # 0 is no word
    base, bound = len(number) + 1, 1
    windows = [max(0, len(x) - words + 1) for x in ids]
    code = np.zeros(sum(windows), np.int64)
    for k in range(words):
        if bound * base >= 1 << 63:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            bound = int(code.max(initial=0)) + 1
        code = code * base + np.concatenate([x[k : k + n] for x, n in zip(ids, windows, strict=True)])
        bound *= base
    return [np.unique(x) for x in np.split(code, np.cumsum(windows)[:-1])]


def _ceil(n: Column | int, by: int, over: int):  # noqa: ANN202
    """ceil(n * by / over) in whole numbers."""
    return F.floor((n * by + (over - 1)) / F.lit(over)).cast("bigint") if isinstance(n, Column) else -(-n * by // over)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[list, list[tuple[np.ndarray, bytes]]]]:
    """The ids, and the shingle sets and digests, of a batch, some texts at a time."""
    ids, texts = batch.column(0), batch.column(1)
    for at in range(0, len(ids), 256):
        yield ids.slice(at, 256).to_pylist(), shingle_sets(texts.slice(at, 256).to_pylist(), words)


def _survey(rows: DataFrame, words: int) -> DataFrame:
    """(doc, n, digest) for each document, and (token, count) for tokens that several texts among a stretch of a task's hold.

    digest is of the sequence of words.
    """
    names = ["doc", "n", "digest", "token", "count"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def made(cols: dict[str, list | np.ndarray]) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

    def frequent(kept: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(kept), return_counts=True)
        often = counts >= 2
        return made({"token": tokens[often].view(np.int64), "count": counts[often]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        kept: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0
        for batch in batches:
            for ids, sets in _sets(batch, words):
                yield made({"doc": ids, "n": [len(s) for s, _ in sets], "digest": [d for _, d in sets]})
                for s, d in sets:
                    if d not in seen and len(s):
                        seen.add(d)
                        kept.append(s)
                        size += len(s)
                if size > _STRETCH:
                    yield frequent(kept)
                    kept, size = [], 0
                    seen.clear()
        if kept:
            yield frequent(kept)

    return rows.mapInArrow(run, "doc bigint, n bigint, digest binary, token bigint, count bigint")


def _prefixes(rows: DataFrame, words: int, percent: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, doc, pos, size, frequent): of each set the n - ceil(n * percent / 100) + 1 tokens that come first, rare ones before frequent ones.

    Two sets that link share one of these. size is n * 2^31 + the place in the token order, in 31 bits, of the last of them.
    frequent is the document for a token that is known to be frequent, and null for one that may be this set's alone. A task leaves out
    sequences of words that it has had before: their documents are copies.
    """
    shared = rows.sparkSession.sparkContext.broadcast(order)
    names = ["token", "doc", "pos", "size", "frequent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        frequent, rank = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            for ids, sets in _sets(batch, words):
                parts: list[tuple[np.ndarray, int, int]] = []
                for doc, (s, d) in zip(ids, sets, strict=True):
                    if not len(s) or doc is None or d in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(d)
                    p = len(s) - _ceil(len(s), percent, 100) + 1
                    last, level = 0, np.zeros(p, np.int8)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        level = np.where(frequent[at] == s, rank[at], 0)
                        if level.any():
                            by = np.argsort(level, kind="stable")
                            s, level = s[by], level[by]
                            last = int(level[p - 1])
                    parts.append((s[:p], level[:p] > 0, doc, len(s) << 31 | last << 25 | int(s[p - 1]) >> 39))
                if parts:
                    sizes = [len(p[0]) for p in parts]
                    docs, packed = (np.repeat(np.array([p[i] for p in parts], np.int64), sizes) for i in (2, 3))
                    tokens = np.concatenate([p[0] for p in parts]).view(np.int64)
                    pos = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
                    often = pa.array(docs, mask=~np.concatenate([p[1] for p in parts]))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in (tokens, docs, pos, packed)], often], names)

    return rows.mapInArrow(run, "token bigint, doc bigint, pos int, size bigint, frequent bigint")


def _linked(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, of pairs (a, b, ta, tb) with their texts. Rows of the same b that follow each other are taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            keep, at = np.zeros(len(a), bool), 0
            while at < len(a):
                end, size = at + 1, int(sizes[at])
                while end < len(a) and b[end] == b[at] and size + sizes[end] <= _CHUNK:
                    size += int(sizes[end])
                    end += 1
                own, *others = exact_sets([batch.column(3)[at].as_py(), *batch.column(2).slice(at, end - at).to_pylist()], words)
                for i, x in enumerate(others, at):
                    shared = len(np.intersect1d(own, x, assume_unique=True))
                    keep[i] = shared > 0 and shared * (100 + percent) >= (len(own) + len(x)) * percent
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach, for each id that a link names. Nothing is collected.

    Large-star and small-star steps in turn, which take about log(n) rounds; each round is written to the shared folder. Up to _FEW
    links go through one task, which spares the rounds their shuffles; neither step makes more links than there were.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    was = mark(e)
    few = was[0] <= _FEW
    while True:
        e = e.coalesce(1) if few else e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large-star")
        large = large.coalesce(1) if few else large
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = mark(e)
        if now == was:
            roots = e.select("v").distinct()
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))
        was = now


def _with_groups(postings: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return postings.withColumn("g", F.col("doc"))
    return postings.join(groups.select(F.col("id").alias("doc"), F.col("component").alias("_g")), "doc", "left").withColumn("g", F.coalesce("_g", "doc")).drop("_g")


def _under_stars(links: DataFrame) -> DataFrame:
    """(id, component): each document of links (a, b) under a star b that it links with, or under that one's own star, two steps on.

    Stars are more central than what is under them, so there is no circle.
    """
    up = staged(links.groupBy("a").agg(F.min("b").alias("b")), "stars")
    for _ in range(2):
        above = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
        up = up.join(above, "b", "left").select("a", F.coalesce("c", "b").alias("b"))
    return up.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _several(postings: DataFrame) -> DataFrame:
    """Postings of tokens that more than one group has."""
    cross = postings.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("token")
    return postings.join(cross, "token", "left_semi")


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    frequent_most: int = 1 << 21,
    broadcast_most: int = 1 << 20,
    star_rounds: int = 3,
) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id.

    A document's set is its distinct shingles of `words` words (A-Z lower-cased, between white space of ASCII); of fewer words, the
    whole sequence as one. Two documents link when 100 * |intersection| >= percent * |union|; component_id is the smallest id
    that links reach. All links count; none is sampled or capped. Documents without words (null or empty texts too) have 0
    shingles and link with nothing. A null id has a null component. Rows that share an id are one node of the links; ids are
    integers, or a TypeError is raised. Other columns are ignored; no rows give no rows. percent is from 1 to 100.

    1. Equal sequences of words are found by a cryptographic digest and go on as one. Token frequencies are counted by the map tasks
       over all documents; at most frequent_most tokens, the most frequent ones, get a late place in the token order, which alone
       depends on them.
    2. The prefix tokens of each set under that order are its postings; those that no other set has are dropped: one shuffle, in
       which a frequent token is known to be shared and is dealt by document. Other tokens have few rows each: at most one for each
       stretch of a task, or frequent_most tokens would have more.
    3. Similar documents are partitioned into groups: each token's most central document is its star, documents that share enough
       tokens with a star are compared with it, and those that link are one group. That costs a comparison or two a document,
       not all pairs of a large family; within a group nothing needs comparing any more.
    4. The token-group matrix holds the union of each group's tokens. A query document's overlap with a group is bounded by the
       tokens they share and what lies behind the prefix that ends first; only groups that can hold a link are opened. The pairs in
       them are bounded in the same way, and compared in full if they pass.

    Tokens are hashes of shingles and only choose what is compared; pairs are compared, and links decided, by the words of both texts.
    Texts move only for documents of pairs that reach a comparison. Their ids are broadcast up to broadcast_most of them, counted
    first; more are joined by a shuffle. The pairs of a star with many are dealt in shares.
    """
    spark = docs.sparkSession
    kind = docs.select(quoted(id_col)).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} has to be a whole number, not {kind}")
    rows = docs.select(quoted(id_col).cast("bigint").alias("doc"), F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("text"))
    survey = staged(_survey(rows, words), "survey")
    sets = survey.where("digest is not null").select("doc", "n", "digest")

    counted = survey.where("token is not null").groupBy("token").agg(F.floor(F.log2(F.sum("count"))).cast("int").alias("level"))
    counted = staged(counted, "frequent")
    sizes, level, room = {r.level: r.n for r in counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}, 63, frequent_most
    while level >= 1 and sizes.get(level, 0) <= room:
        room -= sizes.get(level, 0)
        level -= 1
    often = counted.where(F.col("level") > level).toArrow()  # no more than frequent_most rows
    tokens, level = often["token"].to_numpy().view(_U), often["level"].to_numpy().astype(np.int8)
    by_token = np.argsort(tokens)
    order = (tokens[by_token], level[by_token])

    same = sets.where("n > 0 and doc is not null").groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    same = staged(same.where("first < last").select("digest", "first"), "copies")
    copies = sets.where("doc is not null").join(same, "digest").where("doc <> first").select("doc", "first").distinct()

    everywhere = Window.partitionBy("token", "frequent")
    found = _prefixes(rows, words, percent, order).withColumn("lo", F.min("doc").over(everywhere)).withColumn("hi", F.max("doc").over(everywhere))
    found = found.where("lo < hi or frequent is not null").select("token", "doc", "pos", F.shiftright("size", 31).alias("n"), F.col("size").bitwiseAND((1 << 31) - 1).alias("end"))
    found = staged(found, "prefixes")
    found = found.join(copies, "doc", "left").withColumn("doc", F.coalesce("first", "doc")).drop("first")
    postings = staged(_several(found.groupBy("token", "doc").agg(F.max("n").alias("n"), F.max("end").alias("end"), F.min("pos").alias("pos")).withColumn("g", F.col("doc"))).drop("g"), "postings")

    def fit(a: Column, b: Column) -> Column:
        return (a * 100 >= b * percent) & (b * 100 >= a * percent)

    def rest(n: Column) -> Column:
        """Tokens behind a set's prefix."""
        return _ceil(n, percent, 100) - 1

    def least_shared(a: Column, b: Column) -> Column:
        """What sets of these sizes share at least if they link."""
        return _ceil(a + b, percent, 100 + percent)

    def may_link(a: str, b: str) -> Column:
        """From c, the tokens that both prefixes hold: beyond the prefix that ends first, only that set's rest can be shared."""
        na, nb, ea, eb = F.col(f"n{a}"), F.col(f"n{b}"), F.col(f"e{a}"), F.col(f"e{b}")
        more = F.when(ea < eb, rest(na)).when(eb < ea, rest(nb)).otherwise(F.greatest(rest(na), rest(nb)))
        return F.col("c") + more >= least_shared(na, nb)

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        pairs = staged(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
        few = pairs.count() * 2 <= broadcast_most or ids.count() <= broadcast_most
        texts = staged(rows.join(F.broadcast(ids) if few else ids, "doc", "left_semi"), "texts")
        left, right = (texts.select(F.col("doc").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        many = staged(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / _SHARE).alias("shares")).where("shares > 1"), "shares")
        on = ["b"]
        if not many.isEmpty():
            on = ["b", "share"]
            pairs = pairs.join(many, "b", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("a"), "shares"), F.lit(0))).drop("shares")
            right = right.join(many, "b", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("shares") - 1, F.lit(0))))).drop("shares")
        both = pairs.join(left, "a").join(right, on).select("a", "b", "ta", "tb")
        return staged(_linked(both, words, percent), "links")

    links = copies.select(F.col("doc").alias("a"), F.col("first").alias("b"))
    star_links: DataFrame | None = None
    groups: DataFrame | None = None
    linked = 0
    for turn in range(star_rounds):
        current = staged(_several(_with_groups(postings, groups)), "open-postings")
        if turn:
            # pairs of documents of different groups that share a token, at most: where they are few, or stars no longer help, the
            # exact part takes them
            per = current.groupBy("token", "g").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("own"))
            left = per.agg(F.sum(F.col("all") * F.col("all") - F.col("own")), F.sum("all")).first()
            if not left[0] or left[0] <= 20 * left[1] or linked * 200 < left[1]:
                break
        prefix = F.col("n") - rest(F.col("n"))
        widths = current.groupBy("token").agg(F.count(F.lit(1)).alias("width"))
        central = current.join(widths, "token").groupBy("doc").agg((F.sum(F.sqrt("width")) / F.max(prefix)).alias("central"))
        score = F.col("central") if not turn else F.xxhash64("doc", F.lit(turn)).cast("double")
        stars = current.join(central, "doc").groupBy("token").agg(F.max(F.struct(score.alias("score"), "doc", "n", "end", "g")).alias("s"))
        near = current.join(stars, "token").where((F.col("g") != F.col("s.g")) & fit(F.col("n"), F.col("s.n")))
        near = near.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("end").alias("ea"), F.col("s.doc").alias("b"), F.col("s.n").alias("nb"), F.col("s.end").alias("eb"))
        near = near.groupBy(*near.columns).agg(F.count(F.lit(1)).alias("c"))
        new = compared(near.where(may_link("a", "b")).select("a", "b"))
        star_links = new if star_links is None else star_links.unionByName(new)
        linked = new.count()
        if not linked:
            break
        groups = staged(components(star_links) if turn else _under_stars(new), "groups")
    if star_links is not None:
        links = links.unionByName(star_links)

    current = staged(_several(_with_groups(postings, groups)), "open-postings")
    matrix = current.groupBy("token", F.col("g").alias("group")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("early"), F.min("end").alias("first"), F.max("end").alias("last"))
    # The first token that two linked sets share comes early in both: what is before it can't be shared.
    n, smallest = F.col("n"), F.greatest(F.col("lo"), _ceil(F.col("n"), percent, 100))
    largest = F.least(F.col("hi"), F.floor(n * 100 / F.lit(percent)))
    early = (F.col("pos") <= n - least_shared(n, smallest)) & (F.col("early") <= largest - least_shared(n, largest))
    asked = current.join(matrix, "token").where((F.col("g") > F.col("group")) & (smallest <= largest) & early)
    reached = staged(asked.select("doc", "group").distinct(), "reached")
    asked = current.join(reached, "doc").join(matrix, ["token", "group"])
    asked = asked.where(smallest <= largest)
    opened = asked.groupBy("doc", "n", "end", "group").agg(F.count(F.lit(1)).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.max("last").alias("last"))
    more = F.when(F.col("end") < F.col("first"), rest(n)).when(F.col("end") > F.col("last"), rest(F.col("hi"))).otherwise(F.greatest(rest(n), rest(F.col("hi"))))
    opened = staged(opened.where(F.col("c") + more >= least_shared(n, smallest)).select("doc", "group"), "opened")
    # one row for each document and member of a group that it opens, whatever they share
    held = current.groupBy("doc", "n", "end", "g").agg(F.collect_list("token").alias("tokens"))
    query = held.join(opened, "doc").select("group", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("end").alias("ea"), F.col("tokens").alias("ta"))
    member = held.select(F.col("g").alias("group"), F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("end").alias("eb"), F.col("tokens").alias("tb"))
    pairs = query.join(member, "group").where(fit(F.col("na"), F.col("nb"))).withColumn("c", F.size(F.array_intersect("ta", "tb")))
    pairs = pairs.where((F.col("c") > 0) & may_link("a", "b")).select("a", "b")
    links = links.unionByName(compared(pairs))

    reached = staged(components(links), "components")
    out = sets.join(reached.withColumnRenamed("id", "doc"), "doc", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; docs' columns, whatever their names.

    Rows with a null id stay, and of rows that share the smallest id all do. Null, empty and very long texts are as in jaccard_components.
    """
    gone = jaccard_components(docs, id_col, text_col, **how).where(quoted(id_col) != F.col("component_id"))
    key = unused("_gone", docs)
    return docs.join(gone.select(quoted(id_col).alias(key)).distinct(), quoted(id_col) == F.col(key), "left_anti")
