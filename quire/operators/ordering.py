"""Places and running sums within a document or set, however large one of them is.

A plain window keeps each key in one task. Here a key is cut into blocks, which windows take one by one; what is before a block is a sum over
block totals, of which even the largest key has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16  # positions in a block


def _by_blocks(rows: DataFrame, by: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows (with _block) with the sum of each value over the rows before, its sum over the whole key as <name>_all, and the key's rows as _size."""
    block = Window.partitionBy(by, "_block")
    before = block.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    count, sums = F.count(F.lit(1)), {name: F.coalesce(F.sum(v), F.lit(0)) for name, v in values.items()}
    own = {name: F.coalesce(F.sum(v).over(before), F.lit(0)) for name, v in values.items()} | {f"{name}_all": F.coalesce(F.sum(v).over(block), F.lit(0)) for name, v in values.items()}
    local = rows.withColumns(own | {"_size": count.over(block)})
    key, earlier = Window.partitionBy("_block_of"), Window.partitionBy("_block_of").orderBy("_block_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(by).alias("_block_of"), F.col("_block").alias("_block_no")).agg(*[v.alias(name) for name, v in sums.items()], count.alias("_size"))
    steps = totals.select("_block_of", "_block_no", *[F.sum(n).over(earlier).alias(f"_before_{n}") for n in values], *[F.sum(n).over(key).alias(f"_key_{n}") for n in [*values, "_size"]], count.over(key).alias("_blocks"))
    steps = steps.where("_blocks > 1").drop("_blocks")  # few or none: a key of one block is done
    joined = local.join(steps, F.col(by).eqNullSafe(F.col("_block_of")) & (F.col("_block") == F.col("_block_no")), "left")
    whole = {n: F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)) for n in values} | {f"{n}_all": F.coalesce(f"_key_{n}", f"{n}_all") for n in values} | {"_size": F.coalesce("_key__size", "_size")}
    return joined.withColumns(whole).select(*[c for c in rows.columns if c != "_block"], *values, *[f"{n}_all" for n in values], "_size")


def prefix_sums(rows: DataFrame, by: str, pos: str, values: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """rows with, for each of values (name to column), its sum over the rows of the same key with smaller pos, its sum over the key as <name>_all,
    and the key's number of rows as _size.

    pos is a position: a whole number that stands once in a key and isn't much larger than the number of rows, so a block of `width` positions
    has that many rows at most. The rows are shuffled once, by key and block; block totals go by key.
    """
    return _by_blocks(rows.withColumn("_block", F.coalesce(F.floor(F.col(pos) / F.lit(width)), F.lit(-1))), by, [pos], values)


def range_sums(rows: DataFrame, by: str, order: list[str], values: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """prefix_sums by any order. Rows are sorted into ranges of key and order, of about equal size, which cut a large key at any row (as many as
    shuffles have partitions, if blocks doesn't say), and summed in these. The ranges are written to the checkpoint folder, as they have to be the same for rows and totals.
    """
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _by_blocks(rows.repartitionByRange(blocks, by, *order).withColumn("_block", F.spark_partition_id()).checkpoint(), by, order, values)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, one under the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root


def numbered(rows: DataFrame, by: str, order: list[str], name: str, blocks: int | None = None, value: Column | None = None) -> DataFrame:
    """rows with their place within the key (from 0) by any order, as `name`; with a value, with its sum over the rows before.

    Without blocks this is a plain window; with blocks, no key is bound to one task (`range_sums`).
    """
    value = F.lit(1) if value is None else value
    if blocks is None:
        before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("int"))
    return range_sums(rows, by, order, {name: value}, blocks).withColumn(name, F.col(name).cast("int")).drop(f"{name}_all", "_size")


def range_last(rows: DataFrame, by: str, order: list[str], value: Column, name: str, blocks: int | None = None) -> DataFrame:
    """rows with, as `name`, the last value that isn't null among the rows of the same key up to this one, by any order.

    As in range_sums no key is bound to one task: ranges are searched apart, and a range that begins within a key takes over what its earlier
    ranges end with.
    """
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_value", value).repartitionByRange(blocks, by, *order).withColumn("_block", F.spark_partition_id()).checkpoint()
    local = dealt.withColumn(name, F.last("_value", ignorenulls=True).over(Window.partitionBy(by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    there = F.col("_value").isNotNull()
    ends = dealt.groupBy(F.col(by).alias("_block_of"), F.col("_block").alias("_block_no")).agg(F.max_by(F.when(there, F.col("_value")), F.when(there, F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy("_block_of").orderBy("_block_no").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).where("_carried is not null").select("_block_of", "_block_no", "_carried")
    joined = local.join(carried, F.col(by).eqNullSafe(F.col("_block_of")) & (F.col("_block") == F.col("_block_no")), "left")
    return joined.select(*[c for c in rows.columns], F.coalesce(name, "_carried").alias(name))
