"""Outputs in parts, with a manifest that makes them visible at once; also from streams, each batch exactly once.

A target folder holds data/<id> and manifest/<id> of each attempt, and commits: one row for each version that is complete. An attempt that
fails has no such row, so nothing of it is ever read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.replay import save_edits

_COMMITS = "version bigint, attempt string"


def commits(spark: SparkSession, path: str) -> dict[int, str]:
    """The complete versions and their attempts; of a version that was committed twice, one."""
    try:
        rows = spark.read.schema(_COMMITS).json(f"{path}/commits").collect()  # a row a version
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return {r.version: r.attempt for r in sorted(rows, key=lambda r: r.attempt, reverse=True)}


def write_packed(pages: DataFrame, path: str, order: str = "pos", payload: str = "payload", version: int = 0, part_pages: int = 10_000, file_bytes: int = 128 << 20) -> bool:
    """Writes pages by output_name as a version of the outputs under path; False, without work, if that version is complete already.

    An output is cut into parts of part_pages positions, so a large one is dealt to many tasks, and parts of all outputs are packed into files of about
    file_bytes: an output of one page doesn't cost a file. Within a file the parts are in order. The manifest has a row for each part: output_name,
    part, n_pages, first_pos, last_pos, bytes, sha256 (of the payloads' digests in their order). Names are kept as a column, as they are.
    """
    spark = pages.sparkSession
    if version in commits(spark, path):
        return False
    attempt = uuid.uuid4().hex
    size = F.coalesce(F.octet_length(F.col(payload)), F.lit(0))
    total = pages.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    files = max(1, -(-total // file_bytes))
    parts = pages.withColumn("part", F.floor(F.col(order) / part_pages))
    dealt = parts.withColumn("_file", F.pmod(F.xxhash64("output_name", "part"), F.lit(files))).repartition(files, "_file")
    dealt.sortWithinPartitions("output_name", "part", order).drop("_file").write.parquet(f"{path}/data/{attempt}")
    written = spark.read.parquet(f"{path}/data/{attempt}")
    digests = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.sha2(F.coalesce(F.col(payload).cast("binary"), F.lit(b"")), 256).alias("sha256")))), lambda p: p["sha256"])
    manifest = written.groupBy("output_name", "part").agg(
        F.count(F.lit(1)).alias("n_pages"), F.min(order).alias("first_pos"), F.max(order).alias("last_pos"), F.sum(size).alias("bytes"), F.sha2(F.array_join(digests, ""), 256).alias("sha256")
    )
    manifest.write.parquet(f"{path}/manifest/{attempt}")
    spark.createDataFrame([(version, attempt)], _COMMITS).coalesce(1).write.mode("append").json(f"{path}/commits")  # one file, renamed into place
    return True


def _versions(spark: SparkSession, path: str, what: str) -> DataFrame | None:
    found = commits(spark, path)
    read = lambda v, a: spark.read.parquet(f"{path}/{what}/{a}").withColumn("version", F.lit(v).cast("bigint"))
    rows: DataFrame | None = None
    for version, attempt in sorted(found.items()):
        own = read(version, attempt)
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The parts of the last version of each output, with its version."""
    rows = _versions(spark, path, "manifest")
    if rows is None:
        raise ValueError(f"nothing is complete under {path}")
    last = rows.groupBy(F.col("output_name").alias("_name")).agg(F.max("version").alias("_last"))
    return rows.join(last, F.col("output_name").eqNullSafe(F.col("_name")) & (F.col("version") == F.col("_last"))).drop("_name", "_last")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the last version of each output, with part and version."""
    rows = _versions(spark, path, "data")
    if rows is None:
        raise ValueError(f"nothing is complete under {path}")
    last = read_manifest(spark, path).select(F.col("output_name").alias("_name"), F.col("part").alias("_part"), F.col("version").alias("_last"))
    return rows.join(last, F.col("output_name").eqNullSafe(F.col("_name")) & (F.col("part") == F.col("_part")) & (F.col("version") == F.col("_last"))).drop("_name", "_part", "_last")


def save_stream(states: DataFrame, pages: DataFrame, docs: DataFrame, path: str, log: str, **how) -> StreamingQuery:
    """Saves the changed documents of a stream of states (stream_replay, stream_snapshots), a version of the outputs for each batch.

    A batch that runs again after a failure finds its version complete, and writes nothing, or incomplete, and writes it anew: read_packed
    gives each document as its last batch left it, once. pages and docs are as for save_edits; log is the query's checkpoint folder; how goes to write_packed.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            write_packed(save_edits(pages, batch, docs).accepted, path, version=number, **how)
        finally:
            batch.unpersist()

    return states.writeStream.outputMode("update").option("checkpointLocation", log).foreachBatch(keep).trigger(availableNow=True).start()
