"""Ordered sets of documents.

doc_set: set_id, set_pos (from 0), doc_id, page_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import Result
from .ordering import numbered, prefix_sums
from .pages import renumber


def merge_pages(doc_set: DataFrame, pages: DataFrame) -> Result:
    """All pages of each set's documents in the order of the set: set_id, pos, doc_id, page_index and what else pages has.

    Pages that have pos come in that order, and are counted, as they may have been edited; pages without it are those of the source, in the
    order of page_index, page_count of them. Offsets are sums over the documents of a set; a set of any size is cut into blocks (`prefix_sums`). Pages
    are joined on doc_id alone and never sorted. A document that is loaded twice comes twice. rejected: sets of fewer than two loads.
    """
    members = doc_set.select("set_id", "set_pos", "doc_id", F.col("page_count").alias("_pages"))
    if "pos" in pages.columns:
        counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_pages"))
        members = members.drop("_pages").join(counts, "doc_id", "left")
    placed = prefix_sums(members, "set_id", "set_pos", {"_offset": F.coalesce("_pages", F.lit(0))})
    rest = [c for c in pages.columns if c not in ("doc_id", "pos", "page_index")]
    merged = placed.where("_size >= 2").select("set_id", "doc_id", "_offset").join(pages, "doc_id")
    at = F.col("pos" if "pos" in pages.columns else "page_index")
    accepted = merged.select("set_id", (F.col("_offset") + at).cast("int").alias("pos"), "doc_id", "page_index", *rest)
    rejected = doc_set.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs < 2").withColumn("reject_reason", F.lit("fewer_than_two"))
    return Result(accepted, rejected)


def set_summary(doc_set: DataFrame) -> DataFrame:
    return doc_set.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("n_pages"))


def append_docs(existing: DataFrame, batches: DataFrame, blocks: int | None = None) -> DataFrame:
    """set_id, set_pos, doc_id: what is there, then batches (set_id, batch_no, file_no, doc_id) in their order.

    page_count and what else existing has comes along where batches have it too, so the result is a document set again; what only existing has
    is left out. blocks: as in `numbered`, for sets too large for one task.
    """
    rest = [c for c in existing.columns if c not in ("set_id", "set_pos", "doc_id") and c in batches.columns]
    old = existing.select("set_id", F.lit(0).alias("_new"), F.col("set_pos").cast("bigint").alias("_a"), F.lit(0).cast("bigint").alias("_b"), "doc_id", *rest)
    new = batches.select("set_id", F.lit(1).alias("_new"), F.col("batch_no").cast("bigint").alias("_a"), F.col("file_no").cast("bigint").alias("_b"), "doc_id", *rest)
    return numbered(old.unionByName(new), "set_id", ["_new", "_a", "_b", "doc_id"], "set_pos", blocks).select("set_id", "set_pos", "doc_id", *rest)


def remove_docs(doc_set: DataFrame, removed: DataFrame, cleared: DataFrame | None = None, by: str = "set_pos") -> DataFrame:
    """Without the members of removed (set_id, set_pos) and the sets of cleared (set_id); positions close up.

    A member is one load of a document, which may be in a set several times; `by` names another column that tells loads apart.
    """
    left = doc_set.join(removed.select("set_id", by), ["set_id", by], "left_anti")
    if cleared is not None:
        left = left.join(cleared.select("set_id"), "set_id", "left_anti")
    return renumber(left, "set_id", "set_pos").select(*doc_set.columns)


def surrogate_id(batch_id: Column, file_no: Column, name: Column) -> Column:
    """An id that is the same on every run, and another for each load of the same file. Values go with their lengths, nulls as such, so
    different loads never read the same."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", part(batch_id), part(file_no), part(name)), 256)


def cover_pages(pages: DataFrame, doc_set: DataFrame, docs: DataFrame) -> DataFrame:
    """The first page of each member: set_id, list_no (from 1), doc_id, name, page_count, page_index and what else pages has."""
    first = pages.where(F.col("page_index") == 0).drop("pos")
    members = doc_set.select("set_id", "doc_id", (F.col("set_pos") + 1).alias("list_no")).join(docs.select("doc_id", "name", "page_count"), "doc_id")
    rest = [c for c in first.columns if c not in ("doc_id", "page_index", "page_count")]
    return members.join(first.drop("page_count"), "doc_id").select("set_id", "list_no", "doc_id", "name", "page_count", "page_index", *rest)
