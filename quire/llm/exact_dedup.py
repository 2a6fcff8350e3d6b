"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted, staged


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    hot_floor: int = 100,
    hot_most: int = 200_000,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; a null text counts as the empty one. Of equal texts the row with the largest id
    stays. A null id is below every other; where every id of a group is null, keep_id is null and all its rows are kept, and
    rows that repeat the winner's id are all kept, as nothing tells them apart. No rows give no rows. Other columns are ignored.

    1. Map tasks deduplicate their own rows (the partial aggregation on digest and full text), so a copy is shuffled once a task.
    2. Digests of more than hot_floor rows are hot; beyond hot_floor * hot_most rows in all (20 M), of more than rows / hot_most. There are
       fewer than hot_most of them, whatever the input, which bounds what is broadcast to 6 MB of digests. Their groups are spread over
       `salts` sub-groups, merged on digest, full text and salt. A digest that isn't hot has one sub-group, which is its whole group
       already: of 50 G rows 250,000 at most, one for each map task that meets it.
    3. The winners of the salted sub-groups are combined on digest and full text.

    Full texts are shuffled once, in stage 2. The way back from groups to rows joins on the digest alone; digests that turn out to
    hold more than one text (none, with SHA-256) go by digest and full text instead.
    """
    rows = docs.select(quoted(id_col).alias("_id"), F.coalesce(quoted(text_col), F.lit("")).alias("_text"))
    keyed = rows.withColumn("_digest", digest(F.col("_text")))
    limit = max(hot_floor, docs.count() // hot_most)
    counts = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    hot = staged(counts.where(F.col("_n") > limit).select("_digest"), "hot-digests").coalesce(1)
    any_hot = not hot.isEmpty()

    best = [F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    cold_rows = keyed.join(F.broadcast(hot), "_digest", "left_anti") if any_hot else keyed
    cold = cold_rows.groupBy("_digest", "_text").agg(*best).withColumn("_hot", F.lit(False))
    groups = cold
    if any_hot:
        hot_rows = keyed.join(F.broadcast(hot), "_digest", "left_semi")
        salted = hot_rows.groupBy("_digest", "_text", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt")).agg(*best)
        merged = salted.groupBy("_digest", "_text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        groups = cold.unionByName(merged.withColumn("_hot", F.lit(True)))
    classes = staged(groups.select("_digest", "keep_id", "group_size", "_hot"), "dedup-groups")

    clash = classes.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).where(F.col("_texts") > 1).select("_digest")
    clashing = staged(clash, "dedup-clashes")
    clashes = not clashing.isEmpty()
    clear_rows, clear = keyed.select("_id", "_digest"), classes
    if clashes:
        clear_rows, clear = (x.join(clashing, "_digest", "left_anti") for x in (clear_rows, clear))
    value = ["keep_id", "group_size"]
    out = (clear_rows.join(F.broadcast(hot), "_digest", "left_anti") if any_hot else clear_rows).join(clear.where(~F.col("_hot")).drop("_hot"), "_digest").select("_id", "_digest", *value)
    if any_hot:
        # fewer than hot_most digests of one text each
        hot_classes = F.broadcast(clear.where("_hot").drop("_hot"))
        out = out.unionByName(clear_rows.join(hot_classes, "_digest").select("_id", "_digest", *value))
    if clashes:
        mixed = keyed.join(clashing, "_digest", "left_semi")
        by_text = groups.join(clashing, "_digest", "left_semi").select("_digest", "_text", *value)
        out = out.unionByName(mixed.join(by_text, ["_digest", "_text"]).select("_id", F.col("_digest"), *value))
    return out.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of docs for each text, with docs' columns, whatever their names: of equal texts a row with the largest id.

    Null and empty texts are equal; null ids are below every other. Rows go by id and text together, so an id that stands at several
    texts loses only the copies; of rows that share the winning id and the text, the one with the smallest hash of all its columns
    stays, and one of literal repeats. No rows give no rows; texts are compared whole.
    """
    digest = how.get("digest", sha256)
    verdicts = staged(exact_dedup(docs, id_col, text_col, **how).select(quoted(id_col).alias("_i"), F.unhex("text_sha256").alias("_d"), "kept", "keep_id"), "dedup-verdicts")
    # a group of null ids has no largest one: all its rows are kept so far, and come together below
    gone = verdicts.where("not kept").select("_i", "_d").distinct()
    again = staged(verdicts.where("kept").groupBy("_i", "_d").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_i", "_d"), "dedup-repeats")
    names = docs.columns
    own = docs.select(F.struct(*[quoted(c) for c in names]).alias("_row"), quoted(id_col).alias("_id"), digest(F.coalesce(quoted(text_col), F.lit(""))).alias("_digest"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d"))
    left = own.join(gone, same, "left_anti")
    if not again.isEmpty():
        once = left.join(again, same, "left_semi").groupBy("_id", "_digest").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
        left = left.join(again, same, "left_anti").select("_row").unionByName(once.select("_row"))
    return left.select(*[F.col("_row").getField(c).alias(c) for c in names])
