"""Progress of documents as their pages get done."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import js_round
from .ordering import numbered


BITS = 1 << 15  # pages of a bitmap


def percent(done: Column, total: Column) -> Column:
    """From 0 to 100; null where there is nothing to do."""
    share = F.try_divide(done.cast("double") * F.lit(100.0), total)
    return F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)))


def progress(done: DataFrame, docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """After each completion (done: doc_id, done_no as the order, maybe page_index): doc_id, done_no, percent, label.

    Where done has page_index, a page that is delivered again counts when it came first, and later rows don't add to the percentage.
    blocks: as in `numbered`, for documents too large for one task.
    """
    new = F.lit(1)
    if "page_index" in done.columns:
        new = (F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("done_no")) == 1).cast("int")
    rows = done.select("doc_id", "done_no", new.alias("_new")).withColumn("_again", 1 - F.col("_new"))  # of rows at one done_no, new pages come first
    after = numbered(rows, "doc_id", ["done_no", "_again"], "_n", blocks, F.col("_new")).withColumn("_n", F.col("_n") + F.col("_new"))
    after = after.join(docs.select("doc_id", "page_count"), "doc_id")
    share = percent(F.col("_n"), F.col("page_count"))
    return after.select("doc_id", "done_no", share.alias("percent"), F.concat(js_round(share).cast("string"), F.lit("%")).alias("label"))


def done_bitmaps(done: DataFrame) -> DataFrame:
    """The done pages (doc_id, page_index) as doc_id, bucket, bitmap, one bit a page. Pages delivered again change nothing, and parts of a log can be
    put together with merge_bitmaps, in any order."""
    number = F.col("page_index").cast("bigint") + 1  # Spark's buckets begin at 1
    rows = done.where("page_index >= 0").select("doc_id", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    return rows.groupBy("doc_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def progress_of(bitmaps: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, n_done, percent of each document of docs (doc_id, page_count), by done_bitmaps."""
    counted = bitmaps.groupBy("doc_id").agg(F.sum(F.bitmap_count("bitmap")).alias("n_done"))
    n = F.coalesce("n_done", F.lit(0))
    return docs.select("doc_id", "page_count").join(counted, "doc_id", "left").select("doc_id", n.alias("n_done"), percent(n, F.col("page_count")).alias("percent"))
