"""Data URLs, and image sizes from header bytes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def data_url(mime: Column, content: Column) -> Column:
    """A data URL of binary content. base64 breaks its lines here, so line ends are taken out."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def data_url_mime(url: Column) -> Column:
    """Null if url isn't a data URL."""
    mime = F.regexp_extract(url, r"\Adata:([^;,]*)", 1)
    return F.when(url.startswith("data:"), mime)


def data_url_content(url: Column) -> Column:
    """Null if url isn't a base64 data URL, or what it holds isn't base64."""
    return F.when(url.rlike(r"\Adata:[^,]*;base64,"), F.try_to_binary(F.substring_index(url, ",", -1), F.lit("base64")))


def _number(content: Column, start: int | Column, size: int, little: bool = False) -> Column:
    """The whole number in `size` bytes from place `start` (from 1) on; null behind the end."""
    digits = F.hex(F.substring(content, F.lit(start) if isinstance(start, int) else start, F.lit(size)))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("bigint"))


def image_format(content: Column) -> Column:
    """png, gif, jpeg or webp by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp")
    )


def jpeg_frame(read: Callable[[int, int], bytes]) -> tuple[int, int] | None:
    """Width and height from the frame header of a JPEG file, whose bytes read(place, size) gives, fewer behind the end.

    Goes from marker to marker, whatever lies between and however many there are; None where there is no frame before the image data.
    """
    at = 2
    while True:
        head = read(at, 16)
        if len(head) < 2 or head[0] != 0xFF:
            return None
        mark = head[1]
        if mark == 0xFF:  # filling
            at += next((i for i, b in enumerate(head[1:]) if b != 0xFF), len(head) - 1)
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
        elif mark in (0x00, 0xD9, 0xDA):
            return None
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return (int.from_bytes(head[7:9]), int.from_bytes(head[5:7])) if len(head) >= 9 else None
        else:
            length = int.from_bytes(head[2:4])
            if len(head) < 4 or length < 2:
                return None
            at += 2 + length


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def _jpeg_size(contents: pd.Series) -> pd.DataFrame:
    sizes = [jpeg_frame(lambda at, n, c=c: c[at : at + n]) if c is not None else None for c in contents]
    return pd.DataFrame({"width": [s and s[0] for s in sizes], "height": [s and s[1] for s in sizes]}, dtype="Int64")


def _webp_size(content: Column) -> tuple[Column, Column]:
    """From the first chunk: lossy, lossless or extended."""
    chunk = F.hex(F.substring(content, 13, 4))
    lossy = (chunk == "56503820") & (F.hex(F.substring(content, 24, 3)) == "9D012A")
    lossless, extended = (chunk == "5650384C") & (_number(content, 21, 1) == 0x2F), chunk == "56503858"
    bits = _number(content, 22, 4, True)
    sizes = (
        (_number(content, 27, 2, True).bitwiseAND(0x3FFF), bits.bitwiseAND(0x3FFF) + 1, _number(content, 25, 3, True) + 1),
        (_number(content, 29, 2, True).bitwiseAND(0x3FFF), F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1, _number(content, 28, 3, True) + 1),
    )
    width, height = (F.when(lossy, x).when(lossless, y).when(extended, z) for x, y, z in sizes)
    return width, height


def header_size(content: Column) -> Column:
    """struct(width, height) from the header of a PNG, GIF, JPEG or WebP file; null where it can't be read or fits no int.

    JPEG headers have any number of segments, so they are read in Arrow batches; only JPEG files go there.
    """
    kind = image_format(content)
    jpeg = _jpeg_size(F.when(kind == "jpeg", content))
    known = {
        "png": (_number(content, 17, 4), _number(content, 21, 4)),
        "gif": (_number(content, 7, 2, True), _number(content, 9, 2, True)),
        "jpeg": (jpeg["width"], jpeg["height"]),
        "webp": _webp_size(content),
    }
    size = F.lit(None).cast("struct<width:int,height:int>")
    for name, (width, height) in known.items():
        size = F.when(kind == name, F.struct(width.try_cast("int").alias("width"), height.try_cast("int").alias("height"))).otherwise(size)
    return F.when((size["width"] > 0) & (size["height"] > 0), size)
