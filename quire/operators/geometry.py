"""Geometry over tables of pages and pointer samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import EXPORT_SCALE, SCALE_PRESETS, js_round, percent_label
from .ordering import range_last


def rendition_plan(pages: DataFrame, scale: float = EXPORT_SCALE) -> DataFrame:
    """doc_id, page_number, scale, width_px, height_px, and the pixels as whole numbers, of pages (width_pt, height_pt)."""
    width, height = F.col("width_pt") * F.lit(scale), F.col("height_pt") * F.lit(scale)
    return pages.select(
        "doc_id", (F.col("page_index") + 1).alias("page_number"), F.lit(scale).alias("scale"), width.alias("width_px"), height.alias("height_px"), js_round(width).alias("width_round"), js_round(height).alias("height_round")
    )


def scale_ladder(pages: DataFrame, presets: tuple[float, ...] = SCALE_PRESETS) -> DataFrame:
    """A row for each page and preset scale, with the preset's label. The presets are an array literal: no join."""
    scaled = pages.withColumn("scale", F.explode(F.array(*[F.lit(float(p)) for p in presets])))
    return scaled.select(
        "doc_id", (F.col("page_index") + 1).alias("page_number"), "scale", percent_label(F.col("scale")).alias("label"), (F.col("width_pt") * F.col("scale")).alias("width_px"), (F.col("height_pt") * F.col("scale")).alias("height_px")
    )


def to_page_coords(samples: DataFrame) -> DataFrame:
    """samples (x, y, scale) with page_x, page_y (two decimals) and shown_x, shown_y (whole); null for a zero scale."""
    page = lambda c: js_round(F.try_divide(F.col(c), F.col("scale")) * F.lit(100.0)) / F.lit(100.0)
    return samples.withColumns({"page_x": page("x"), "page_y": page("y"), "shown_x": js_round(F.col("x")), "shown_y": js_round(F.col("y"))})


def with_scale(samples: DataFrame, zooms: DataFrame, by: str = "view_id", initial: float = 1.0, blocks: int | None = None) -> DataFrame:
    """samples (by, ts, and what else) with scale, the scale in force at ts: that of the last of zooms (by, ts, scale) up to then, initial before any.

    A zoom at the same ts counts already; of several at one ts the one with the largest scale. Both are sorted together into ranges, so one busy
    view is dealt to many tasks (`range_last`), and no sample is paired with more than one zoom. Samples without ts have the initial scale.
    """
    own = F.struct(*[F.col(c) for c in samples.columns])
    asked = samples.select(F.col(by).alias("_key"), F.col("ts").alias("_ts"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_scale"), own.alias("_row"))
    told = zooms.where(F.col("ts").isNotNull() & F.col("scale").isNotNull()).select(F.col(by).alias("_key"), F.col("ts").alias("_ts"), F.lit(0).alias("_kind"), F.col("scale").cast("double").alias("_scale"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    found = range_last(asked.unionByName(told), "_key", ["_ts", "_kind", "_scale"], F.col("_scale"), "_found", blocks).where("_kind = 1")
    return found.select("_row.*", F.coalesce("_found", F.lit(float(initial))).alias("scale"))
