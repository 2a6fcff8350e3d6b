"""Intake of files: which of them are taken in, and which batches are refused.

files: batch_id, file_no, name, mime, via ("drop" or "select"), load_failed, and whatever else a caller keeps with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import Result

PDF = "application/pdf"


def accepts(tokens: list[str], name: Column, mime: Column) -> Column:
    """Whether a file passes an accept list: ".ext" is an ending of the name, in any case; another token is a pattern that the MIME
    type has to contain, case counting. Without tokens all pass; a null name or type fails its tests."""
    tests = [F.lower(name).endswith(t.lower()) if t.startswith(".") else mime.rlike(t) for t in (t.strip() for t in tokens)]
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False)) if tests else F.lit(True)


def accept_filter(files: DataFrame, tokens: list[str]) -> DataFrame:
    return files.where(accepts(tokens, F.col("name"), F.col("mime")))


def intake(files: DataFrame, tokens: list[str]) -> DataFrame:
    """Picked files pass as they are, dropped ones by the accept list; a batch with nothing left has no rows and no reject."""
    return files.where((F.col("via") == "select") | accepts(tokens, F.col("name"), F.col("mime")))


def mime_filter(files: DataFrame, exact: str | None = None, prefix: str | None = None) -> DataFrame:
    """By the exact MIME type, or by how it begins."""
    return files.where(F.col("mime") == exact if exact is not None else F.col("mime").startswith(prefix))


def first_match(files: DataFrame, exact: str = PDF) -> DataFrame:
    """The first file of each batch with this MIME type."""
    row = F.struct(*[F.col(c) for c in files.columns])
    best = mime_filter(files, exact).groupBy("batch_id").agg(F.min_by(row, F.struct("file_no", "name")).alias("row"))
    return best.select("row.*")


def batch_rejects(files: DataFrame, valid: Column, report_via: tuple[str, ...] = ("drop", "select")) -> DataFrame:
    """batch_id, n_files, reject_reason of the batches without a valid file, for the ways of intake that report."""
    per = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(valid).alias("n_valid"), F.max(F.col("via").isin(*report_via)).alias("reports"))
    return per.where((F.col("n_valid") == 0) & F.col("reports")).select("batch_id", "n_files", F.lit("no_valid_file").alias("reject_reason"))


def atomic_batches(files: DataFrame) -> Result:
    """All files of a batch or none: one that failed to load refuses its whole batch."""
    failed = F.max(F.coalesce("load_failed", F.lit(False))).over(Window.partitionBy("batch_id"))
    marked = files.withColumn("_failed", failed)
    return Result(marked.where("not _failed").drop("_failed"), marked.where("_failed").drop("_failed").withColumn("reject_reason", F.lit("batch_load_failed")))
