"""Files in, page tables out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase
from urllib.parse import quote, unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files under path. Contents that aren't selected are never read.

    Files without a byte give no rows: Spark's file sources leave them out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length of the files under path, listed by tasks: for more files than a driver should hold, as read_files' file index does.

    One task lists what is directly in path, then each folder there is listed with all below it by the task it is dealt to; so many files belong into
    many folders. Like Spark, it passes over names that begin with a dot or an underscore; unlike with read_files, files without a byte
    have a row, and signs in paths are written as in URIs (%20).
    """
    local = path.startswith(("file:", "/"))

    def listed(batches: Iterator[pa.RecordBatch], deep: bool) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for at, when, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if length >= 0:
                    found = [(at, when, length)]
                else:
                    system, inner = (fs.LocalFileSystem(), unquote(urlparse(at).path) if at.startswith("file:") else at) if local else fs.FileSystem.from_uri(at)
                    before = "file:" if local else at[: len(at) - len(inner)]
                    infos = [i for i in system.get_file_info(fs.FileSelector(inner, recursive=deep)) if not any(n.startswith(".") or (n.startswith("_") and "=" not in n) for n in i.path[len(inner) :].split("/"))]
                    name = lambda i: before + (quote(i.path) if local else i.path)  # noqa: B023, E731
                    found = [(name(i), i.mtime, i.size) for i in infos if i.is_file and (glob is None or fnmatchcase(i.base_name, glob))]
                    found += [] if deep else [(name(i), None, -1) for i in infos if i.type == fs.FileType.Directory]
                for start in range(0, len(found), 4096):
                    columns = zip(*found[start : start + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.timestamp("us", "UTC"), pa.int64()), strict=True)], ["path", "modificationTime", "length"])

    schema, tasks = "path string, modificationTime timestamp, length bigint", int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = spark.range(1, numPartitions=1).select(F.lit(path).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(-1).cast("bigint").alias("length"))
    folders = root.mapInArrow(lambda batches: listed(batches, False), schema)
    return folders.repartition(tasks, "path").mapInArrow(lambda batches: listed(batches, True), schema)


def stream_files(spark: SparkSession, path: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """read_files as a stream: files are taken in once, as they arrive, in batches of max_files at most."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def write_outputs(pages: DataFrame, path: str, order: str = "pos", buckets: int | None = None, mode: str = "errorifexists") -> None:
    """Writes pages by output_name, in the order of `order` within each file.

    Without buckets each output has a folder of its own. For very many outputs, buckets of them share one, by hash, and output_name
    stays a column. An output's pages are dealt to one task, so a file never holds part of an order.
    """
    if buckets is None:
        pages.repartition("output_name").sortWithinPartitions("output_name", order).write.mode(mode).partitionBy("output_name").parquet(path)
    else:
        dealt = pages.withColumn("bucket", F.pmod(F.hash("output_name"), F.lit(buckets)))
        dealt.repartition("bucket").sortWithinPartitions("bucket", "output_name", order).write.mode(mode).partitionBy("bucket").parquet(path)


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """What write_outputs has written. Names are strings, whatever they look like: 007 and 7 are two outputs."""
    found = spark.read.option("basePath", path).parquet(path).schema
    kinds = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "output_name" else f for f in found])
    return spark.read.schema(kinds).option("basePath", path).parquet(path)


def expand_with(files: DataFrame, fn: Callable[[str, bytes], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """Rows that fn makes of each file (path, content): a caller's own document library plugs in here.

    schema, a StructType or its DDL text, names the fields of fn's rows; path, page_index (from 0, in the order in which fn gives the rows)
    and reject_reason come in front. A file for which fn raises gives one row with the error as its reject_reason and no other rows, so
    its rows are held until fn is through; `register_expand` is a table function whose rows are not.
    """
    made_of = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = made_of.fieldNames()

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "page_index", "reject_reason", *fields]
        rows: list[dict] = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                made = []
                try:
                    made += [{"path": path, "page_index": i, "reject_reason": None, **r} for i, r in enumerate(fn(path, content))]
                except Exception as e:  # noqa: BLE001  whatever a caller's library raises becomes a reject
                    made = [{"path": path, "page_index": None, "reject_reason": f"{type(e).__name__}: {e}"}]
                rows += made
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(expand, T.StructType([*T.StructType.fromDDL("path string, page_index int, reject_reason string"), *made_of]))


def register_expand(spark: SparkSession, name: str, fn: Callable[[str, bytes], Iterator[dict]], schema: str | T.StructType) -> None:
    """A caller's document library as a table function for SQL: SELECT ... FROM files f, LATERAL name(f.path, f.content) p.

    It gives page_index, reject_reason and the fields of schema (a StructType or its DDL text), a row as soon as fn gives it, so a file of
    any number of pages needs the memory of one. Where fn raises, a row with the error follows the rows it gave before, without page_index.
    """
    made_of = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = made_of.fieldNames()
    whole = T.StructType([*T.StructType.fromDDL("page_index int, reject_reason string"), *made_of])

    class Expand:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(path.dataType, T.StringType) or not isinstance(content.dataType, T.BinaryType):
                raise TypeError(f"{name} takes a path (string) and a content (binary)")
            return AnalyzeResult(whole)

        def eval(self, path: str, content: bytes) -> Iterator[tuple]:
            try:
                for i, row in enumerate(fn(path, content)):
                    yield (i, None, *[row.get(c) for c in fields])
            except Exception as e:  # noqa: BLE001  whatever a caller's library raises becomes a reject
                yield (None, f"{type(e).__name__}: {e}", *[None for _ in fields])

    spark.udtf.register(name, udtf(Expand))
