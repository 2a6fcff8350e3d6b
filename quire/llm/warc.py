"""WARC archives: records with offsets, and a Merkle fixity audit of replicas."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import staged

_CRLF = "\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n", re.IGNORECASE)


def warc_records(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    per_archive: int = 1024,
    date: str = "1970-01-01T00:00:00Z",
    digests: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """One row per page: id_col, archive, offset, length, sha256, record (binary), and digests: response records as they lie in archive files.

    A record has the fields that WARC 1.0 requires, with `date` for all and an id made of the page's own digest, and an HTTP response
    as its block. An archive takes the pages of per_archive consecutive ids, in the order of the ids, then of the digests; offset is
    where the record starts in its archive. Pages with null ids are dealt to archives of their own, with negative numbers, of per_archive pages
    at most as they come. Null urls and pages are empty, repeated rows are records of their own. Other columns are ignored; no rows give no
    rows. Ids are integers.

    digests (a column name, and what it is of the record) are made before the window that finds the offsets, as sha256 is; where
    `record` isn't selected from the result, the shuffle for that window carries numbers and digests only.
    """
    url, html = (F.coalesce(F.col(c), F.lit("")) for c in (url_col, html_col))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(_CRLF * 2), html)
    own = F.md5(F.concat_ws(" ", F.col(id_col).cast("string"), url, F.md5(html)))
    urn = F.concat(*[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(own, a, n)]])
    head = F.concat(
        F.lit(f"WARC/1.0{_CRLF}WARC-Type: response{_CRLF}WARC-Record-ID: <urn:uuid:"), urn, F.lit(f">{_CRLF}WARC-Date: {date}{_CRLF}WARC-Target-URI: "), F.translate(url, _CRLF, "  "),
        F.lit(f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), F.octet_length(http).cast("string"), F.lit(_CRLF * 2),
    )
    record = F.concat(head, http, F.lit(_CRLF * 2)).cast("binary")
    as_they_come = -1 - F.floor(F.monotonically_increasing_id() / per_archive)
    archive = F.when(F.col(id_col).isNull(), as_they_come).otherwise(F.floor(F.col(id_col) / per_archive)).cast("bigint")
    rows = pages.select(F.col(id_col), archive.alias("archive"), record.alias("record"))
    made = {"sha256": F.sha2("record", 256), **{k: fn(F.col("record")) for k, fn in (digests or {}).items()}}
    rows = rows.withColumn("length", F.octet_length("record").cast("bigint")).withColumns(made)
    before = Window.partitionBy("archive").orderBy(id_col, "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")).select(id_col, "archive", "offset", "length", *made, "record")


def parse_record(record: Column) -> Column:
    """struct(type, id, date, uri, block, payload) of one record (binary), JVM-side; null fields where it isn't a whole record.

    block is what Content-Length covers, payload what follows the HTTP head of a response.
    """
    text = record.cast("string")
    at = F.instr(text, _CRLF * 2)
    head = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(_CRLF))
    field = lambda name: F.nullif(F.regexp_extract(head, rf"(?i)\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    size, start = field("Content-Length").try_cast("int"), F.octet_length(F.substring(text, F.lit(1), at + 3))
    whole = text.startswith("WARC/") & (at > 0) & (F.octet_length(record) >= start + size)
    block = F.substring(record, start + 1, size)
    payload = F.substring(block.cast("string"), F.instr(block.cast("string"), _CRLF * 2) + 4, F.length(block.cast("string")))
    named = {"type": field("WARC-Type"), "id": field("WARC-Record-ID"), "date": field("WARC-Date"), "uri": field("WARC-Target-URI"), "block": block, "payload": payload}
    return F.struct(*[F.when(whole, v).alias(k) for k, v in named.items()])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of archive files under path: path, offset, length, record (binary). See parse_record for their fields.

    Files are the unit of work, as archives of some hundred MB are; a file gives its records one by one and is held once. A file that
    breaks off, or goes on with what is no record, gives the rest as one row that parse_record finds no fields in. In a file of gzip members, offset and
    length are a member's in the file, and record is what it holds, unpacked; a member of several records gives a row for each. A file without a byte has no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data, at = value.as_buffer(), 0
                view = memoryview(data)
                while at < len(view):
                    end, records = _member(view, at) if bytes(view[at : at + 2]) == b"\x1f\x8b" else (end := _record_end(view, at), [bytes(view[at:end])])
                    n = len(records)
                    row = [pa.array([name] * n), pa.array([at] * n, pa.int64()), pa.array([end - at] * n, pa.int64()), pa.array(records, pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, ["path", "offset", "length", "record"])
                    at = end

    return files.mapInArrow(split, "path string, offset bigint, length bigint, record binary")


def _member(data: memoryview, at: int) -> tuple[int, list[bytes]]:
    """Where the gzip member that starts at `at` ends, and its records; the rest of the data as it is if the member is damaged."""
    unpack = zlib.decompressobj(31)
    try:
        held = memoryview(unpack.decompress(data[at:]))
    except zlib.error:
        return len(data), [bytes(data[at:])]
    if not unpack.eof:
        return len(data), [bytes(data[at:])]
    records, start = [], 0
    while start < len(held):
        end = _record_end(held, start)
        records.append(bytes(held[start:end]))
        start = end
    return len(data) - len(unpack.unused_data), records or [b""]


def _record_end(data: memoryview, at: int) -> int:
    """Where the record that starts at `at` ends; the end of the data if none does."""
    for size in (4096, 65536, len(data)):
        head = bytes(data[at : at + size])
        if (n := head.find(b"\r\n\r\n")) >= 0:
            found = _LENGTH.search(head[: n + 2])
            end = at + n + 4 + int(found[1]) + 4 if found and head.startswith(b"WARC/") else len(data)
            return min(end, len(data))
    return len(data)


def _node(children: Column) -> Column:
    """The hash over children in order, with where each begins."""
    ordered = F.array_sort(F.collect_list(children))
    return F.sha2(F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", *[c[i].cast("string") for i in ("at", "size", "hash")])), ","), 256)


class MerkleTree:
    """Over one replica: level 0 hashes the records of each range of range_bytes of an archive, each level above `fanout` ranges.

    The top level has one node an archive. Ranges go by offset, not by rank, so a lost record leaves the others' ranges alone.
    A node takes at most the records that start in range_bytes, or fanout nodes: no group is large.
    """

    def __init__(self, leaves: DataFrame, height: int, range_bytes: int, fanout: int) -> None:
        self.leaves, self.range_bytes, self.fanout = leaves, range_bytes, fanout
        record = F.struct(F.col("offset").alias("at"), F.col("length").alias("size"), F.col("sha256").alias("hash"))
        level = leaves.groupBy("archive", F.floor(F.col("offset") / range_bytes).alias("range")).agg(_node(record).alias("hash"))
        self.levels = [staged(level, "merkle")]
        for _ in range(height):
            child = F.struct(F.col("range").alias("at"), F.lit(0).alias("size"), "hash")
            level = self.levels[-1].groupBy("archive", F.floor(F.col("range") / fanout).alias("range")).agg(_node(child).alias("hash"))
            self.levels.append(staged(level, "merkle"))


def _height(replicas: list[DataFrame], range_bytes: int, fanout: int) -> int:
    last = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas) // range_bytes
    height = 0
    while last:
        last //= fanout
        height += 1
    return height


def audit(ours: DataFrame, theirs: DataFrame, range_bytes: int = 1 << 18, fanout: int = 8, aligned: bool = False) -> DataFrame:
    """Where two replicas (archive, offset, length, sha256) differ: archive, offset, status.

    status: changed (another length or content), missing (not in theirs) or extra (not in ours); repeated rows are equal if they
    repeat as often. A record that is lost, put in or changed in length moves those behind it in an archive that was written anew. With aligned, records that
    differ by offset are matched by length and digest, in order: they are moved, and what is left over is compared with what lies where it would
    be, as far on as the last record before it has moved. their_offset is then where theirs has a changed or moved record. Trees are built over both; only below nodes that differ are the children compared, down to the records of the
    ranges that differ, so intact replicas cost a comparison of roots. Archives that one replica lacks differ as a whole.
    """
    ours, theirs = staged(ours.select("archive", "offset", "length", "sha256"), "replica"), staged(theirs.select("archive", "offset", "length", "sha256"), "replica")
    height = _height([ours, theirs], range_bytes, fanout)
    a, b = (MerkleTree(x, height, range_bytes, fanout) for x in (ours, theirs))
    suspect: DataFrame | None = None
    for k in range(height, -1, -1):
        left, right = a.levels[k], b.levels[k]
        if suspect is not None:
            left, right = (_below(x, suspect, fanout) for x in (left, right))
        same_node = left["archive"].eqNullSafe(right["archive"]) & (left["range"] == right["range"])
        both = left.join(right, same_node, "full_outer").where(~left["hash"].eqNullSafe(right["hash"]))
        # an archive of null is told from a side that lacks the node by the range, which is never null
        archive = F.when(left["range"].isNotNull(), left["archive"]).otherwise(right["archive"])
        suspect = staged(both.select(archive.alias("archive"), F.coalesce(left["range"], right["range"]).alias("range")), "suspect")
        if suspect.isEmpty():
            break
    ours, theirs = (_below(x.withColumn("range", F.floor(F.col("offset") / range_bytes)), suspect, 1) for x in (ours, theirs))
    seen = ours.withColumn("n", F.lit(1)).unionByName(theirs.withColumn("n", F.lit(-1)))
    per = seen.groupBy("archive", "offset", "length", "sha256").agg(F.sum("n").alias("n")).where("n <> 0")
    if aligned:
        return _matched(staged(per, "differing"))
    sides = per.groupBy("archive", "offset").agg(F.max(F.col("n") > 0).alias("ours"), F.max(F.col("n") < 0).alias("theirs"))
    status = F.when(F.col("ours") & F.col("theirs"), "changed").when(F.col("ours"), "missing").otherwise("extra")
    return sides.select("archive", "offset", status.alias("status"))


def _matched(differing: DataFrame) -> DataFrame:
    """The records that differ (archive, offset, length, sha256, n: how many more of ours), as audit gives them."""
    once = differing.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.abs("n").cast("int")))).withColumn("mine", F.col("n") > 0)
    rank = F.row_number().over(Window.partitionBy("archive", "length", "sha256", "mine").orderBy("offset"))
    ranked = once.select("archive", "offset", "length", "sha256", "mine", rank.alias("k"))
    key = ["archive", "length", "sha256", "k"]
    ours, theirs = (ranked.where(F.col("mine") if mine else ~F.col("mine")).select(*[F.col(c).alias(f"{side}_{c}") for c in key], F.col("offset").alias(f"{side}_at")) for mine, side in ((True, "o"), (False, "t")))
    same = reduce(Column.__and__, [F.col(f"o_{c}").eqNullSafe(F.col(f"t_{c}")) for c in key])
    pairs = ours.join(theirs, same, "full_outer")
    # how far a record has moved, or the last one before it that is found in both
    archive, at = F.when(F.col("o_at").isNotNull(), F.col("o_archive")).otherwise(F.col("t_archive")), F.coalesce("o_at", "t_at")
    laid = pairs.select(archive.alias("archive"), "o_at", "t_at", at.alias("at"), (F.col("t_at") - F.col("o_at")).alias("shift"))
    before = Window.partitionBy("archive", F.col("o_at").isNull()).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumn("shift", F.coalesce(F.last("shift", ignorenulls=True).over(before), F.lit(0)))
    moved = laid.where("o_at is not null and t_at is not null").select("archive", F.col("o_at").alias("offset"), F.lit("moved").alias("status"), F.col("t_at").alias("their_offset"))
    lost = laid.where("t_at is null").select(F.col("archive").alias("o_archive"), "o_at", (F.col("o_at") + F.col("shift")).alias("place"))
    new = laid.where("o_at is null").select(F.col("archive").alias("t_archive"), "t_at")
    rest = lost.join(new, F.col("o_archive").eqNullSafe(F.col("t_archive")) & (F.col("place") == F.col("t_at")), "full_outer")
    status = F.when(F.col("o_at").isNull(), "extra").when(F.col("t_at").isNull(), "missing").otherwise("changed")
    archive = F.when(F.col("o_at").isNotNull(), F.col("o_archive")).otherwise(F.col("t_archive"))
    found = rest.select(archive.alias("archive"), F.coalesce("o_at", "t_at").alias("offset"), status.alias("status"), F.when(F.col("o_at").isNotNull(), F.col("t_at")).alias("their_offset"))
    return found.unionByName(moved).distinct()


def _below(nodes: DataFrame, parents: DataFrame, fanout: int) -> DataFrame:
    """The nodes whose parent is among these."""
    up = parents.select(F.col("archive").alias("_archive"), F.col("range").alias("_range"))
    return nodes.join(up, nodes["archive"].eqNullSafe(up["_archive"]) & (F.floor(nodes["range"] / fanout) == up["_range"]), "left_semi")
