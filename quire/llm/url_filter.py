"""URL filtering by a Bloom filter cascade, in DataFrame operations only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, quoted, staged

_FEW = 64  # shapes of rules up to which each has an expression of its own
BUCKET = 32768  # bits of one bitmap that bitmap_construct_agg makes


def _seeds(key: Column, level: int, bits: int) -> Column:
    """Two numbers of a key at a level, from which all its bit positions come (double hashing)."""
    a = F.pmod(F.xxhash64(F.lit(level), key), F.lit(bits))
    b = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits - 1)) + 1
    return F.struct(a.alias("a"), b.alias("b"))


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    bitmap: bytes

    def may_hold(self, key: Column) -> Column:
        """The bitmap stands in the expression once, whatever the number of hashes; the first bit that isn't set ends the test."""

        def is_set(at: Column) -> Column:
            byte = F.lit(self.bitmap).substr(F.shiftright(at, 3).cast("int") + 1, F.lit(1))
            return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), at.bitwiseAND(7).cast("int")) == 1

        numbers = F.array(*[F.lit(i) for i in range(self.hashes)])
        return F.forall(F.array(_seeds(key, self.number, self.bits)), lambda s: F.forall(numbers, lambda i: is_set(F.pmod(s["a"] + s["b"] * i, F.lit(self.bits)))))


@dataclass(frozen=True)
class Cascade:
    """Levels 1, 3, ... encode listed keys, levels 2, 4, ... the false positives of the level before."""

    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over. A null key is not contained."""
        inside = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels) - 1, -1, -1):
            inside = F.when(self.levels[n].may_hold(key), inside).otherwise(F.lit(n % 2 == 1))
        return F.coalesce(F.when(key.isNotNull(), inside), F.lit(False))


def _level(keys: DataFrame, n: int, number: int, bits_per_key: float) -> Level:
    bits = BUCKET * max(1, math.ceil(n * bits_per_key / BUCKET))
    hashes = max(1, round(bits_per_key * math.log(2)))
    seeds = keys.select(_seeds(F.col("key"), number, bits).alias("s"))
    at = seeds.select(F.explode(F.transform(F.array(*[F.lit(i) for i in range(hashes)]), lambda i: F.pmod(F.col("s.a") + F.col("s.b") * i, F.lit(bits)))).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bitmap"))
    bitmap = bytearray(bits // 8)
    for r in parts.collect():  # bits / 32768 rows of 4 KB: about bits_per_key for each key of the list, which callers bound
        bitmap[(r.bucket - 1) * BUCKET // 8 : r.bucket * BUCKET // 8] = r.bitmap
    return Level(number, bits, hashes, bytes(bitmap))


def _first_bits(listed: int, others: int, bits_per_key: float) -> float:
    """Bits a key of level 1, so that about as many other keys pass it as are listed, or fewer."""
    return max(bits_per_key, math.log2(max(1.0, others / max(1, listed))) / math.log(2))


def build_cascade(universe: DataFrame, bits_per_key: float = 6) -> Cascade:
    """universe: key string, listed boolean; every key that will be asked for. Repeated keys count once and are listed if any is.

    Level 1 has the more bits a key the more keys there are that aren't listed, so its false positives are about as many as the listed
    keys at most; the levels behind it have bits_per_key and shrink by a factor of 18 each. In all that is some 1.5 bits for each
    doubling of the ratio, and 12 more, a listed key.
    """
    keys = universe.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    keys = staged(keys, "url-keys")
    sizes = {r.listed: r["n"] for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, bits = sizes.get(True, 0), _first_bits(sizes.get(True, 0), sizes.get(False, 0), bits_per_key)
    encode, other = keys.where("listed").select("key"), keys.where("not listed").select("key")
    levels: list[Level] = []
    while True:
        levels.append(_level(encode, n, len(levels) + 1, bits))
        passed = staged(other.where(levels[-1].may_hold(F.col("key"))), "url-level")
        n, bits = passed.count(), bits_per_key
        if not n:
            return Cascade(tuple(levels))
        encode, other = passed, encode


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Every rule string that could fit: the last labels of the host with the first characters of the path, as many as a rule has.

    shapes: the (labels of the host, characters of the path) of the rules. A host may have any number of labels.
    """
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    found = [F.when((labels >= n) & (F.length(path) >= k), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, k))) for n, k in shapes]
    return F.filter(F.array(*found), lambda k: k.isNotNull())


def _listed_keys(parts: DataFrame, hosts: DataFrame, shapes: list[tuple[int, int]], bits_per_key: float) -> Column:
    """url_keys for rules of many shapes. A cascade on hosts alone, over all suffixes of the urls' hosts, tells which suffixes are of a listed host; only these
    go with lengths of paths. The shapes stand in the plan as one literal, however many there are."""
    counts, table = sorted({n for n, _ in shapes}), json.dumps([{"n": n, "k": k} for n, k in shapes])
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    suffix = lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)
    all_counts = F.from_json(F.lit(json.dumps(counts)), "array<int>")
    asked = parts.select(F.explode(F.transform(F.filter(all_counts, lambda n: n <= labels), suffix)).alias("key"), F.lit(False).alias("listed"))
    known = build_cascade(asked.unionByName(hosts.select(F.col("host").alias("key"), F.lit(True).alias("listed"))), bits_per_key)
    listed = F.filter(all_counts, lambda n: (n <= labels) & known.contains(suffix(n)))
    fits = lambda s: (s["k"] <= F.length("path")) & F.array_contains(listed, s["n"])
    made = F.transform(F.filter(F.from_json(F.lit(table), "array<struct<n:int,k:int>>"), fits), lambda s: F.concat(suffix(s["n"]), F.substring(F.col("path"), F.lit(1), s["k"])))
    return F.when(F.size(listed) > 0, made).otherwise(F.array().cast("array<string>"))


def url_verdicts(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url", most_bits: int = 1 << 28, bits_per_key: float = 6) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains if the url's path starts with the rule's
    path; of the rules that fit, the longest (then the one with the longer host) wins. Where none fits, the rule is null and the
    verdict is `otherwise`: the url isn't listed. A null url, or one without `://`, has an empty host and path. A long host or path costs
    in proportion to its length. Repeated rules count once; of contradicting ones block wins. No rules give `otherwise` for all, no
    pages no rows. Other columns of pages are ignored.

    Two cascades answer without a join: whether a candidate key is a rule, over all candidate keys of all pages, and whether
    a rule is a block, over all rules. The shapes of the rules are collected: as many pairs of numbers as there are distinct ones. For more than
    a few of them a third cascade, on hosts alone, goes before.

    What is sent to the tasks grows with the list. A list whose cascades need more than about most_bits (32 MB) is taken in parts, by
    a hash of the key, one pass over the narrow table of urls for each; a pass has the cascades of its part only.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where(F.col("host").isNotNull())
    rules = rules.select("host", F.concat("host", "path").alias("key"), (F.col("verdict") == "block").alias("block"), (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels"), F.length("path").alias("chars"))
    shapes = sorted((r[0], r[1]) for r in rules.select("labels", "chars").distinct().collect())
    parts = pages.select(quoted(id_col), url_host(quoted(url_col)).alias("host"), url_path(quoted(url_col)).alias("path"))
    if not shapes:
        return parts.select(quoted(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    n = math.ceil(rules.count() * (bits_per_key + 40) / most_bits)  # 40: more than what the ratio adds to level 1
    if len(shapes) > _FEW:
        # written once: the cascades' levels and the verdicts all go by these keys
        keyed = staged(parts.withColumn("_keys", _listed_keys(parts, rules, shapes, bits_per_key)), "url-candidates")
    else:
        keyed = parts.withColumn("_keys", url_keys(F.col("host"), F.col("path"), shapes))
    part = lambda key: F.pmod(F.xxhash64(key, F.lit(0)), F.lit(n))
    ranked = keyed.withColumn("_best", F.lit(None).cast("struct<n:int,host_n:int,key:string,block:boolean>"))
    for p in range(n):
        own = rules.where(part(F.col("key")) == p)
        asked = keyed.select(F.explode("_keys").alias("key"), F.lit(False).alias("listed")).where(part(F.col("key")) == p)
        listed = build_cascade(asked.unionByName(own.select("key", F.lit(True).alias("listed"))), bits_per_key)
        blocked = build_cascade(own.select("key", F.col("block").alias("listed")), bits_per_key)
        hits = F.filter("_keys", lambda k: (part(k) == p) & listed.contains(k)) if n > 1 else F.filter("_keys", listed.contains)
        best = F.array_max(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("host_n"), k.alias("key"))))
        best = F.transform(F.array(best), lambda b: F.when(b.isNotNull(), F.struct(b["n"].alias("n"), b["host_n"].alias("host_n"), b["key"].alias("key"), blocked.contains(b["key"]).alias("block"))))[0]
        ranked = ranked.withColumn("_best", F.greatest("_best", best))
        if n > 1:
            ranked = staged(ranked, "url-verdicts")
    verdict = F.when(F.col("_best").isNull(), F.lit(otherwise)).when(F.col("_best.block"), F.lit("block")).otherwise(F.lit("allow"))
    return ranked.select(quoted(id_col), "host", "path", F.col("_best.key").alias("rule"), verdict.alias("verdict"))
