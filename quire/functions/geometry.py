"""Page geometry as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scales of exported pages, of thumbnails and of the viewer, the preset ladder and the limits of a fitted scale.
EXPORT_SCALE, THUMBNAIL_SCALE, VIEW_SCALE = 2.0, 0.3, 1.5
SCALE_PRESETS = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0)
LEAST_SCALE, MOST_SCALE = 0.25, 5.0
VIEWPORT_PADDING, VIEWPORT_HEIGHT = 32.0, 500.0


def js_round(x: Column) -> Column:
    """To the nearest whole number, halves upwards (-2.5 gives -2), as a bigint; null stays null."""
    whole = F.floor(x)  # x + 0.5 would itself be rounded, upwards for 0.49999999999999994
    return (whole + (x - whole >= 0.5).cast("int")).cast("bigint")


def fit_scale(mode: str, viewport_width: Column, width: Column, height: Column, viewport_height: float = VIEWPORT_HEIGHT) -> Column:
    """The scale at which a page fits the viewport's width (mode "width") or all of it ("page"), within the limits.

    Null for a null or zero page size.
    """
    across = F.try_divide(viewport_width - F.lit(VIEWPORT_PADDING), width)
    if mode == "width":
        scale = across
    elif mode == "page":
        down = F.try_divide(F.lit(viewport_height), height)
        scale = F.when(across.isNotNull() & down.isNotNull(), F.least(across, down))
    else:
        raise ValueError(f"mode is width or page, not {mode}")
    return F.when(scale.isNotNull(), F.greatest(F.lit(LEAST_SCALE), F.least(F.lit(MOST_SCALE), scale)))


def orientation(width: Column, height: Column) -> Column:
    """landscape if wider than high, else portrait; a square is portrait."""
    return F.when(width > height, F.lit("landscape")).otherwise(F.lit("portrait"))


def percent_label(share: Column) -> Column:
    return F.concat(js_round(share * F.lit(100.0)).cast("string"), F.lit("%"))
