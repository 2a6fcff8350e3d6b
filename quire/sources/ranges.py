"""Parts of files: image headers and byte ranges, without reading whole files.

Files come as rows with path and length, from read_files, list_files or stream_files: contents that aren't selected are never read, and a stream's
offsets are Spark's own. Tasks open the paths themselves, through pyarrow's file systems, or by a caller's `opener`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import jpeg_frame

Opener = Callable[[str], BinaryIO]
_HEAD = 64  # bytes that hold the sizes of all formats but JPEG


def open_path(path: str) -> BinaryIO:
    """A file to seek in, by a path as Spark's file sources give it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(unquote(urlparse(path).path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def write_files(files: DataFrame, root: str | None = None) -> int:
    """Writes each row of files (path, content) as a file, from the tasks, and gives their number. A file is written under another name and
    then moved, so a task that runs twice leaves it whole. root: what paths are relative to, if they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        @lru_cache(1 << 12)
        def folder(name: str) -> tuple[fs.FileSystem, str]:
            system, inner = (fs.LocalFileSystem(), urlparse(name).path) if name.startswith(("file:", "/")) else fs.FileSystem.from_uri(name)
            system.create_dir(inner, recursive=True)
            return system, inner

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = f"{root}/{path}" if root else path
                (system, place), last = folder(name.rsplit("/", 1)[0] or "/"), name.rsplit("/", 1)[1]
                with system.open_output_stream(part := f"{place}/{last}.{uuid.uuid4().hex}.part") as out:
                    out.write(content or b"")
                system.move(part, f"{place}/{last}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _read(file: BinaryIO, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


def image_format(head: bytes) -> str | None:
    if head.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png"
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if head.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    return "webp" if head[:4] == b"RIFF" and head[8:12] == b"WEBP" else None


def image_size(kind: str | None, head: bytes, read: Callable[[int, int], bytes]) -> tuple[int, int] | None:
    """Width and height by the first bytes of a file; read gives further ones of a JPEG file."""
    little = lambda a, n: int.from_bytes(head[a : a + n], "little") if len(head) >= a + n else 0
    size: tuple[int, int] | None = None
    if kind == "png" and len(head) >= 24:
        size = int.from_bytes(head[16:20]), int.from_bytes(head[20:24])
    elif kind == "gif":
        size = little(6, 2), little(8, 2)
    elif kind == "jpeg":
        size = jpeg_frame(read)
    elif kind == "webp" and head[12:16] == b"VP8 " and head[23:26] == b"\x9d\x01\x2a":
        size = little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
    elif kind == "webp" and head[12:16] == b"VP8L" and head[20:21] == b"\x2f" and len(head) >= 25:
        size = (little(21, 4) & 0x3FFF) + 1, (little(21, 4) >> 14 & 0x3FFF) + 1
    elif kind == "webp" and head[12:16] == b"VP8X" and len(head) >= 30:
        size = little(24, 3) + 1, little(27, 3) + 1
    return size if size and 0 < size[0] < 1 << 31 and 0 < size[1] < 1 << 31 else None


def image_headers(files: DataFrame, opener: Opener = open_path) -> DataFrame:
    """files (path and what else there is but content) with format, width, height, reject_reason, bytes_read: image_manifest for large files.

    Of a file its first 64 bytes are read, and of a JPEG file 16 bytes at each segment, however many there are; bytes_read is the sum. A file that
    isn't a PNG, GIF, JPEG or WebP file, or breaks off before its size, has the reject_reason undecodable; one that can't be opened has the error. Works on
    batches and streams; no shuffle.
    """
    keep = [c for c in files.columns if c != "content"]
    made = "format string, width int, height int, reject_reason string, bytes_read bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                kind, size, reason, taken = None, None, None, 0
                try:
                    with opener(path) as file:

                        def read(at: int, n: int, file: BinaryIO = file) -> bytes:
                            nonlocal taken
                            got = _read(file, at, n)
                            taken += len(got)
                            return got

                        head = read(0, _HEAD)
                        kind = image_format(head)
                        size = image_size(kind, head, read)
                        reason = None if size else "undecodable"
                except Exception as e:  # noqa: BLE001  a file that can't be read is a reject
                    reason = f"{type(e).__name__}: {e}"
                rows.append((kind, *(size or (None, None)), reason, taken))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            arrays = [*[batch.column(c) for c in keep], *[pa.array(x, t) for x, t in zip(columns, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "format", "width", "height", "reject_reason", "bytes_read"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)
    return files.select(*keep).mapInArrow(run, f"{fields}, {made}")


def read_ranges(files: DataFrame, range_bytes: int = 16 << 20, opener: Opener = open_path) -> DataFrame:
    """The contents of files (path, length) in ranges: path, offset, content, each of range_bytes at most, for files of any size.

    Ranges are dealt to tasks before they are read, so one large file is read by many. A file without a byte has no ranges.
    """
    places = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = files.where("length > 0").select("path", F.explode(places).alias("offset"), "length")
    if not files.isStreaming:
        ranges = ranges.repartition("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, length in zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length")], strict=True):
                with opener(path) as file:
                    content = _read(file, at, min(range_bytes, length - at))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), pa.array([content], pa.binary())], ["path", "offset", "content"])

    return ranges.mapInArrow(run, "path string, offset bigint, content binary")
