"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard_join import components
from .shared import ascii_words, lookup, quoted, staged

_HASHES = 1 << 16  # hashes whose bits are counted at once
_FEW = 32  # fingerprints of a block that are paired with each other
DISTANCE = 2  # bits that linked fingerprints differ in at most


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text, as a signed number of 64 bits.

    Words (A-Z lower-cased, between white space of ASCII) make shingles of `words` words, joined by a space, repeats included; fewer
    words are one shingle, no words give zero. A bit is set where it is in over half of the shingles' XXH64.
    """
    ones, n, carry = np.zeros(64, np.int64), 0, []
    for piece in ascii_words(text):
        own = carry + piece
        carry = own[len(own) - min(words - 1, len(own)) :]
        if len(own) >= words:
            n += len(own) - words + 1
            ones += _ones(own, words, seed)
    if not n:
        if not carry:
            return 0
        n, ones = 1, _ones(carry, len(carry), seed)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _ones(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """How many shingles of k words have each bit set."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES):
        bits = np.unpackbits(hashes[at : at + _HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return counts


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """id_col and simhash (a signed number of 64 bits) for each row of docs; a null text counts as empty. No shuffle; a long text is taken
    in stretches."""
    rows = docs.select(quoted(id_col).alias("_id"), F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), words, seed) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(made, pa.int64())], ["_id", "simhash"])

    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, simhash bigint").withColumnRenamed("_id", id_col)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int) -> list[int]:
    """The bits of each choice of all but DISTANCE of `blocks` about equal blocks: fingerprints that differ in so few bits are the
    same in the bits of one of them at least."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(own, blocks - DISTANCE)]


def close_pairs(prints: DataFrame, blocks: int = 5) -> DataFrame:
    """Links (a, b) between the nodes of prints (node, simhash; one row a fingerprint) that connect what all pairs of fingerprints with
    DISTANCE differing bits or fewer connect.

    Each fingerprint goes to a block key for every choice of blocks (10 of about 38 bits for 5 blocks, which chance seldom repeats); keys
    that several fingerprints share are joined. Up to _FEW fingerprints of a key are paired and their distance verified. Where a key
    has more, each goes with the up to 28 values that differ from it in one bit at most, outside the key's bits: two fingerprints of
    the key have at most two differing bits exactly if they share such a value. A value has at most 28 fingerprints, all of which link with each
    other, and each is linked with the first. So rows grow with the fingerprints, however many a key has.
    """
    if not DISTANCE < blocks <= 16:
        raise ValueError("blocks has to be from 3 to 16")
    masks = block_masks(blocks)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("simhash").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    keyed = prints.select("node", "simhash", F.inline(keys))
    several = staged(keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "block-keys")
    held = staged(keyed.join(several, ["choice", "key"]), "blocks")

    left, right = (held.where(F.col("n") <= _FEW).select("choice", "key", F.col("node").alias(x), F.col("simhash").alias(f"f{x}")) for x in "ab")
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= DISTANCE
    paired = left.join(right, ["choice", "key"]).where((F.col("fa") < F.col("fb")) & near).select("a", "b")

    free = [[0, *[_signed(1 << i) for i in range(64) if not m >> i & 1]] for m in masks]
    flips = F.element_at(F.array(*[F.array(*[F.lit(x).cast("bigint") for x in own]) for own in free]), F.col("choice") + 1)
    around = held.where(F.col("n") > _FEW).select("choice", "node", F.explode(F.transform(flips, lambda x: F.col("simhash").bitwiseXOR(x))).alias("value"))
    balls = around.groupBy("choice", "value").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)
    starred = balls.select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b")).where("a <> b")
    return paired.unionByName(starred).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, blocks: int = 5) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 lowercase hex digits), component_id: the smallest id that links reach.

    Documents link when their fingerprints differ in two bits or fewer; those without words (null and empty texts too) have the fingerprint
    zero and link like any other. A row with a null id has its fingerprint and a null component, and links nothing. Rows that share
    an id each have their own fingerprint, and their links meet in that id. ids are whole numbers, or a TypeError is raised. Rows may repeat; other columns
    are ignored; no rows give no rows. Texts are taken whole.

    Equal fingerprints go as one from the start, named by their smallest id, so copies cost nothing further on; close_pairs joins the
    distinct ones. The way back from fingerprints to rows broadcasts those that many rows have (`lookup`).
    """
    kind = docs.select(quoted(id_col)).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} has to be a whole number, not {kind}")
    rows = docs.select(quoted(id_col).cast("bigint").alias("doc"), quoted(text_col).alias("text"))
    prints = staged(fingerprints(rows, "doc", "text", words), "fingerprints")
    groups = staged(prints.groupBy("simhash").agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    links = close_pairs(groups.where("node is not null").select("node", "simhash"), blocks)
    # an id with several fingerprints is one node of the links: its rows connect the groups they are in
    shared = prints.where("doc is not null").groupBy("doc").agg(F.min("simhash").alias("lo"), F.max("simhash").alias("hi")).where("lo <> hi").select("doc")
    both = prints.join(shared, "doc").join(groups, "simhash").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    reached = staged(components(links.unionByName(both)), "components")
    found = groups.join(reached.withColumnRenamed("id", "node"), "node", "left").select("simhash", "n", F.coalesce("component", "node").alias("component"))
    out = lookup(prints, found, "simhash", "n")
    return out.select(F.col("doc").alias(id_col), _digits(F.col("simhash")).alias("fingerprint"), F.when(F.col("doc").isNotNull(), F.col("component")).alias("component_id"))


def _digits(simhash: Column) -> Column:
    return F.lpad(F.lower(F.hex(simhash)), 16, "0")
