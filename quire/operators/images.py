"""Images as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import header_size, image_format
from ..functions.geometry import orientation
from . import Result


def image_manifest(files: DataFrame) -> DataFrame:
    """files (with content) with format, width, height, reject_reason instead of content.

    Sizes are read from the header bytes of PNG, GIF, JPEG and WebP files, JVM-side; no pixel is decoded. A file that is none of them,
    or that breaks off before its size, has the reject_reason undecodable.
    """
    kind, size = image_format(F.col("content")), header_size(F.col("content"))
    reason = F.when(size.isNull(), "undecodable")
    return files.select(*[c for c in files.columns if c != "content"], kind.alias("format"), size["width"].alias("width"), size["height"].alias("height"), reason.alias("reject_reason"))


def images_to_pages(images: DataFrame, order: tuple[str, ...] = ("image_no",)) -> DataFrame:
    """One page per image of a set, as large as the image: set_id, pos, image_id, width, height, orientation."""
    place = F.row_number().over(Window.partitionBy("set_id").orderBy(*order)) - 1
    return images.select("set_id", place.cast("int").alias("pos"), "image_id", "width", "height", orientation(F.col("width"), F.col("height")).alias("orientation"))


def image_sets(sets: DataFrame, images: DataFrame, order: tuple[str, ...] = ("image_no",)) -> Result:
    """images_to_pages, and the sets without images."""
    empty = sets.select("set_id").distinct().join(images.select("set_id"), "set_id", "left_anti").withColumn("reject_reason", F.lit("no_images"))
    return Result(images_to_pages(images, order), empty)
