"""Large keys, long logs, parts of files, packed outputs, and streams with bounded state."""

from __future__ import annotations

import contextlib
import itertools
import os
import random
import struct
from decimal import Decimal
from urllib.parse import quote, unquote

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import naming
from quire.operators import docsets, geometry, images, ordering, pages, progress, replay, segments
from quire.sources import files, packed, ranges
from quire.streaming.intake import stream_atomic_batches
from quire.streaming.progress import stream_progress
from quire.streaming.replay import late_edits, step
from quire.streaming.snapshots import stream_snapshots

EDITS = "doc_id bigint, ts int, seq bigint, op string, a int, b int"


@contextlib.contextmanager
def conf(spark, **values):
    values = {k.replace("__", "."): v for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


ROCKSDB = {"spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

# --- keys larger than a task


def test_one_set_of_many_documents_is_numbered_in_blocks(spark):
    n = 200_000
    with conf(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="8"):
        members = spark.range(n).selectExpr("1L AS set_id", "cast(id AS int) AS set_pos", "id AS doc_id", "id % 3 AS k")
        placed = ordering.prefix_sums(members, "set_id", "set_pos", {"before": F.col("k")}, width=1000)
        shares = [r[1] for r in placed.groupBy(F.spark_partition_id()).agg(F.count("before"), F.max("before"), F.max("before_all")).collect()]
        assert sum(shares) == n and max(shares) < n / 4
        bad = placed.where("before <> div(set_pos, 3) * 3 + CASE set_pos % 3 WHEN 2 THEN 1 ELSE 0 END OR _size <> 200000 OR before_all <> 199999")
        assert bad.count() == 0


@pytest.mark.parametrize("blocks", [1, 7])
def test_sums_and_last_values_over_ranges(spark, blocks):
    rng = random.Random(blocks)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), rng.choice([*range(40), None]), i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "key int, t int, i int, v int").repartition(3)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    sums = {(r.i): (r.s, r.s_all, r._size) for r in ordering.range_sums(df, "key", ["t", "i"], {"s": F.col("v")}, blocks).collect()}
    lasts = {r.i: r.found for r in ordering.range_last(df, "key", ["t", "i"], F.col("v"), "found", blocks).collect()}
    for key in {r[0] for r in rows}:
        own, total, last = sorted((r for r in rows if r[0] == key), key=order), 0, None
        for r in own:
            last = last if r[3] is None else r[3]
            assert sums[r[2]] == (total, sum(x[3] or 0 for x in own), len(own))
            assert lasts[r[2]] == last
            total += r[3] or 0
    assert len(sums) == len(lasts) == len(rows)


def test_renumber_closes_up_over_blocks(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id % 2 AS doc_id", "cast(id * 3 AS int) AS pos", "cast(id AS int) AS page_index")
    monkeypatch.setattr(ordering.prefix_sums, "__defaults__", (64,))
    got = pages.renumber(rows)
    assert got.columns == rows.columns
    for doc in (0, 1):
        own = got.where(F.col("doc_id") == doc).orderBy("pos").collect()
        assert [(r.pos, r.page_index) for r in own] == [(i, 2 * i + doc) for i in range(500)]


def test_scale_in_force(spark):
    zooms = spark.createDataFrame([(1, 10, 2.0), (1, 20, 0.5), (1, 20, 0.25), (2, 5, None), (1, None, 9.0)], "view_id int, t int, scale double").selectExpr("view_id", "timestamp_seconds(t) AS ts", "scale")
    samples = spark.createDataFrame([(1, 9, 1.0), (1, 10, 2.0), (1, 19, 3.0), (1, 20, 4.0), (2, 7, 5.0), (3, 1, 6.0), (1, None, 7.0)], "view_id int, t int, x double").selectExpr("view_id", "timestamp_seconds(t) AS ts", "x")
    got = {r.x: r.scale for r in geometry.with_scale(samples, zooms, blocks=5).collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 2.0, 4.0: 0.5, 5.0: 1.0, 6.0: 1.0, 7.0: 1.0}


# --- sets


def test_merge_goes_by_the_current_order(spark):
    sets = spark.createDataFrame([(1, 0, 1, 9), (1, 1, 2, 9), (1, 2, 1, 9), (2, 5, 2, 9), (3, 0, 7, 1), (3, 1, 2, 1)], "set_id int, set_pos int, doc_id int, page_count int")
    edited = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (2, 0, 0), (2, 1, 1)], "doc_id int, pos int, page_index int")
    done = docsets.merge_pages(sets, edited)
    got = sorted((r.set_id, r.pos, r.doc_id, r.page_index) for r in done.accepted.collect())
    assert got == [(1, 0, 1, 2), (1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 2, 1), (1, 4, 1, 2), (1, 5, 1, 0), (3, 0, 2, 0), (3, 1, 2, 1)]
    assert [r.set_id for r in done.rejected.collect()] == [2]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_set_edits_name_their_document(spark, kind):
    edits = spark.createDataFrame([(1, 1, 5, "append", 0, 0, 777), (1, 2, 6, "append", 0, 0, 778), (1, 3, 7, "move_up", 1, 0, None), (1, 4, 8, "append", 0, 0, 777)], "set_id int, t int, seq bigint, op string, a int, b int, doc_id bigint")
    edits = edits.withColumns({"ts": F.timestamp_seconds("t"), "doc_id": F.col("doc_id").cast(kind)})
    start = spark.createDataFrame([(1, 0, 3), (2, 0, 4)], "set_id int, set_pos int, doc_id int")
    same = lambda *x: [str(v) if kind == "string" else v for v in x]
    by_set = lambda rows, s: [r.doc_id for r in sorted(rows, key=lambda r: r.set_pos) if r.set_id == s]
    assert by_set(replay.replay_set_edits(edits).collect(), 1) == same(778, 777, 777)
    got = replay.replay_set_edits(edits, start).collect()
    assert by_set(got, 1) == same(777, 3, 778, 777)
    assert by_set(got, 2) == same(4)


@pytest.mark.parametrize("blocks", [None, 3])
def test_append_keeps_page_counts(spark, blocks):
    old = spark.createDataFrame([(1, 0, 7, 3, "x")], "set_id int, set_pos int, doc_id int, page_count int, only_here string")
    new = spark.createDataFrame([(1, 2, 1, 8, 4), (1, 1, 2, 9, 5)], "set_id int, batch_no int, file_no int, doc_id int, page_count int")
    got = docsets.append_docs(old, new, blocks)
    assert [tuple(r) for r in got.orderBy("set_pos").collect()] == [(1, 0, 7, 3), (1, 1, 9, 5), (1, 2, 8, 4)]
    assert docsets.set_summary(got).first().n_pages == 12


# --- long logs


def folded(sizes, edits):
    states = {d: (list(range(n)), [], False) for d, n in sizes.items()}
    for d, _, _, op, a, b in edits:
        if d in states:
            states[d] = step(*states[d], sizes[d], op, a, b)
    return states


def logs_of(spark, edits):
    return spark.createDataFrame(edits, EDITS).withColumn("ts", F.timestamp_seconds("ts"))


@pytest.mark.parametrize("segment", [1, 4, 1000])
def test_segments_equal_the_fold(spark, segment):
    rng = random.Random(segment)
    sizes = {d: rng.randint(0, 8) for d in range(30)}
    ops = ["toggle"] * 5 + ["move"] * 4 + ["delete", "select_all", "reset", "touch", "what"]
    edits = [(d, i // 3, i, rng.choice(ops), rng.choice([None, *range(-1, 9)]), rng.choice([None, *range(-1, 9)])) for i in range(900) for d in [rng.randrange(32)]]
    docs = spark.createDataFrame([*sizes.items()], "doc_id bigint, page_count int")
    got = {r.doc_id: (r.ord, r.sel, r.dirty) for r in segments.replay_long_edits(docs, logs_of(spark, edits), segment, blocks=5).collect()}
    assert got == folded(sizes, edits)


def test_one_long_log_is_dealt_to_many_tasks(spark):
    n, size = 60_000, 50
    rng = random.Random(8)
    edits = [(1, i, i, "move", rng.randrange(size), rng.randrange(size)) for i in range(n)]
    edits[1000], edits[40_000], edits[40_001] = (1, 1000, 1000, "toggle", 7, None), (1, 40_000, 40_000, "delete", None, None), (1, 40_001, 40_001, "toggle", 3, None)
    docs = spark.createDataFrame([(1, size), (2, 0)], "doc_id bigint, page_count int")
    done = segments.replay_long_edits(docs, logs_of(spark, edits), segment=1000, blocks=8)
    assert {r.doc_id: (r.ord, r.sel, r.dirty) for r in done.collect()} == folded({1: size, 2: 0}, edits)
    assert "collect_list" not in done._jdf.queryExecution().toString()


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_set_segments_equal_the_fold(spark, segment):
    rng = random.Random(segment)
    ops = ["append"] * 5 + ["remove"] * 4 + ["move", "move_up", "move_down", "clear", "what"]
    edits = [(s, i // 2, i, rng.choice(ops), rng.choice([None, *range(-1, 7)]), rng.choice([None, *range(-1, 7)]), f"d{i}") for i in range(500) for s in [rng.randrange(12)]]
    logs = spark.createDataFrame(edits, "set_id int, ts int, seq bigint, op string, a int, b int, doc_id string").withColumn("ts", F.timestamp_seconds("ts"))
    start = spark.createDataFrame([(s, 3 * p, f"m{s}.{p}") for s in range(3, 15) for p in range(s % 5)], "set_id int, set_pos int, doc_id string")
    for initial in (None, start):
        listed = lambda df: sorted(tuple(r) for r in df.collect())
        assert listed(segments.replay_long_set_edits(logs, initial, segment, blocks=5)) == listed(replay.replay_set_edits(logs, initial))


def no_call_a_group(*_):
    raise AssertionError("one Python call for each group")


def test_small_set_segments_share_calls(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandas", no_call_a_group)
    ops = ["append", "append", "move", "remove", "move_up", "clear", "move_down", "append"]
    edits = [(float("nan") if s == 7 else float(s), i, i, ops[(i * i + s) % 8], (i * s) % 5, i % 3) for s in range(40) for i in range(50)]
    logs = spark.createDataFrame(edits, "set_id double, ts int, seq bigint, op string, a int, b int").withColumn("ts", F.timestamp_seconds("ts"))
    listed = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert listed(segments.replay_long_set_edits(logs, segment=2)) == listed(replay.replay_set_edits(logs))


def test_small_segments_share_calls(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandas", no_call_a_group)
    ops = ["toggle", "move", "toggle", "select_all", "delete", "move", "touch", "reset"]
    edits = [(d, i, i, ops[(i * i + d) % 8], (i * d) % 5 if i % 6 else None, i % 3) for d in range(40) for i in range(50)]
    docs = spark.createDataFrame([(d, d % 9) for d in range(40)], "doc_id bigint, page_count int")
    listed = lambda df: sorted(tuple(r) for r in df.collect())
    assert listed(segments.replay_long_edits(docs, logs_of(spark, edits), segment=2)) == listed(replay.replay_edits(docs, logs_of(spark, edits)))


def test_long_logs_read_their_documents_once(spark):
    edits = [(d, i, i, ["toggle", "delete", "move"][i % 3], (i * d) % 5, i % 4) for d in range(40) for i in range(12)]
    read = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(d, d % 9) for d in range(40)], 2).map(lambda row: (read.add(1), row)[1]), "doc_id bigint, page_count int")
    got = {r.doc_id: (r.ord, r.sel, r.dirty) for r in segments.replay_long_edits(docs, logs_of(spark, edits), segment=4).collect()}
    assert read.value == 40
    assert got == folded({d: d % 9 for d in range(40)}, edits)


# --- files


def jpeg(width, height, before=b""):
    return b"\xff\xd8" + before + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00"


def test_image_sizes_of_odd_headers(spark, tmp_path):
    app = b"\xff\xe1" + struct.pack(">H", 40) + b"\xff" * 38
    made = {
        "fill": jpeg(300, 200, b"\xff" * 3000),
        "segments": jpeg(301, 200, app * 2500),
        "overflow": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 0xFFFFFFFF, 1),
        "large": jpeg(302, 200, b"\xff\xe1" + struct.pack(">H", 65535) + b"x" * 65533) + b"\0" * 5_000_000,
        "gif": b"GIF89a" + struct.pack("<HH", 7, 9),
        "png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 8, 6),
        "lossy": b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 5, 4),
        "lossless": b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 4 | 3 << 14),
        "extended": b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + b"\x04\0\0\x03\0\0",
        "cut": jpeg(1, 1)[:8], "cut png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0", "text": b"hello", "no frame": b"\xff\xd8\xff\xda\0\x02",
    }
    for name, content in made.items():
        (tmp_path / f"{name}.img").write_bytes(content)
    expected = {"fill": (300, 200), "segments": (301, 200), "large": (302, 200), "gif": (7, 9), "png": (8, 6), "lossy": (5, 4), "lossless": (5, 4), "extended": (5, 4)}
    found = files.read_files(spark, str(tmp_path))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.img$", 1), "%20", " ").alias("name")
    whole = {r.name: r for r in images.image_manifest(found).select(name, "*").collect()}
    heads = {r.name: r for r in ranges.image_headers(found).select(name, "*").collect()}
    for rows in (whole, heads):
        assert {k: (r.width, r.height) for k, r in rows.items() if r.reject_reason is None} == expected
        assert {r.reject_reason for k, r in rows.items() if k not in expected} == {"undecodable"}
    assert {k: r.format for k, r in whole.items()} == {k: r.format for k, r in heads.items()}
    assert max(r.bytes_read for r in heads.values()) < 65536 and heads["large"].bytes_read < 200
    gone = spark.createDataFrame([(f"file:{tmp_path}/none.img", 3)], "path string, length bigint")
    assert "FileNotFoundError" in ranges.image_headers(gone).first().reject_reason


def test_files_are_listed_by_tasks(spark, tmp_path):
    root = tmp_path / "in put"
    for name in ("a.img", "b/c d.img", "b/e/f%20#.img", "b/g.txt", "h/_i/j.img", "h/.k.img", "h/x=1/l.img", "_m.img"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"GIF89a" + struct.pack("<HH", len(name), 9))
    listed = files.list_files(spark, str(root), "*.img")
    assert "InMemoryFileIndex" not in listed._jdf.queryExecution().toString()
    found = {(os.path.basename(r.path), r.length, r.modificationTime.year > 2000) for r in files.read_files(spark, str(root), "*.img").collect()}
    assert {(os.path.basename(unquote(r.path)), r.length, r.modificationTime.year > 2000) for r in listed.collect()} == found
    assert sorted(r.width for r in ranges.image_headers(listed).collect()) == [5, 9, 11, 13]
    assert files.list_files(spark, f"file:{quote(str(root))}").count() == 5


def test_image_headers_needs_no_file_index(spark, sf, monkeypatch):
    from quire.plans import queries

    def no_index(*_):
        raise AssertionError("all files listed by the driver")

    monkeypatch.setattr(queries.sources, "read_files", no_index)
    got = queries.QUERIES["image_headers"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, queries.QUERIES["image_manifest"](spark, sf).select(got.columns).collect()))


def test_image_headers_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 7, 9))
    stream = ranges.image_headers(files.stream_files(spark, str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.format, row.width, row.height) == ("gif", 7, 9)


def test_ranges_of_files(spark, tmp_path):
    content = bytes(random.Random(1).randbytes(10_000))
    (tmp_path / "with space.bin").write_bytes(content)
    (tmp_path / "b.bin").write_bytes(b"xy")
    got = ranges.read_ranges(files.read_files(spark, str(tmp_path)).select("path", "length"), 999).collect()
    assert all(len(r.content) <= 999 for r in got) and len(got) == 12
    parts = sorted((r.offset, bytes(r.content)) for r in got if "space" in r.path)
    assert b"".join(c for _, c in parts) == content


def test_names_come_back_as_they_were(spark, tmp_path):
    rows = spark.createDataFrame([("007", 0, "a"), ("7", 0, "b"), ("1.0", 0, "c"), ("a/b=c", 0, "d"), ("2020-01-01", 0, "e")], "output_name string, pos int, payload string")
    files.write_outputs(rows, str(tmp_path / "plain"))
    packed.write_packed(rows, str(tmp_path / "packed"))
    for back in (files.read_outputs(spark, str(tmp_path / "plain")), packed.read_packed(spark, str(tmp_path / "packed"))):
        assert {r.output_name: r.payload for r in back.collect()} == {r.output_name: r.payload for r in rows.collect()}


def test_packed_outputs(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 'large' ELSE concat('small', id % 50) END AS output_name", "cast(CASE WHEN id < 4000 THEN id ELSE div(id - 4000, 50) END AS int) AS pos", "repeat(cast(id AS string), 5) AS payload")
    assert packed.write_packed(rows, path, part_pages=300, file_bytes=20_000)
    manifest = {(r.output_name, r.part): r for r in packed.read_manifest(spark, path).collect()}
    assert sum(r.n_pages for r in manifest.values()) == 5000 and [manifest["large", p].first_pos for p in range(14)] == [300 * p for p in range(14)]
    back = packed.read_packed(spark, path)
    assert sorted((r.output_name, r.pos, r.payload) for r in back.collect()) == sorted(tuple(r) for r in rows.collect())
    holding = spark.read.parquet(f"{path}/data/*").where("output_name = 'large'").select("_metadata.file_path")
    assert holding.distinct().count() > 1
    # a failed attempt leaves nothing to read, and a complete version isn't written again
    bad = rows.withColumn("payload", F.when(F.col("pos") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="broken"):
        packed.write_packed(bad, path, version=1)
    assert packed.commits(spark, path).keys() == {0}
    assert not packed.write_packed(rows.limit(0), path)
    assert packed.write_packed(rows.where("output_name = 'small3'").withColumn("payload", F.lit("new")), path, version=1)
    again = packed.read_packed(spark, path)
    assert again.count() == 5000 and again.where("payload = 'new'").count() == 20


def test_expand_with_any_schema(spark):
    df = spark.createDataFrame([("p", bytearray(b"abc"))], "path string, content binary")
    kinds = T.StructType([T.StructField("price, net", T.DecimalType(10, 2)), T.StructField("tags", T.ArrayType(T.StringType()))])
    for schema in (kinds, "`price, net` decimal(10,2), tags array<string>"):
        got = files.expand_with(df, lambda path, content: iter([{"price, net": Decimal("1.50"), "tags": ["x", "y"]}]), schema).first()
        assert (got["price, net"], list(got.tags)) == (Decimal("1.50"), ["x", "y"])

    def fails(path, content):
        raise ValueError("y" * 2000)

    assert len(files.expand_with(df, fails, "a int").first().reject_reason) == 2012


def test_expand_as_a_table_function(spark):
    def split(path, content):
        for part in content.decode().split(","):
            if part == "!":
                raise ValueError("odd")
            yield {"body": part}

    files.register_expand(spark, "expand_pages", split, T.StructType([T.StructField("body", T.StringType())]))
    spark.createDataFrame([("p", bytearray(b"a,b")), ("q", bytearray(b"c,!"))], "path string, content binary").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT f.path, p.* FROM some_files f, LATERAL expand_pages(f.path, f.content) p").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([("p", 0, None, "a"), ("p", 1, None, "b"), ("q", 0, None, "c"), ("q", None, "ValueError: odd", None)], key=repr)
    many = spark.sql("SELECT count(*), max(page_index) FROM (SELECT cast('x' AS string) AS path, cast(repeat('a,', 300000) AS binary) AS content) f, LATERAL expand_pages(f.path, f.content) p").first()
    assert tuple(many) == (300_001, 300_000)
    with pytest.raises(Exception, match="takes a path"):
        spark.sql("SELECT * FROM expand_pages(1, 2)").collect()


@pytest.mark.parametrize(("text", "expected"), [("0x10", 16), ("-0X1f", -31), ("0x", None), ("0xg", None), (" 12", 12), ("﻿　 7", 7), ("+5", 5), ("0x7fffffff", 2147483647), ("0x80000000", None), ("0x00000000000a", 10), ("010", 10), ("- 1", None)])
def test_parse_int_as_a_browser_does(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(naming.parse_int(F.col("t"))).first()[0] == expected


# --- progress


def test_pages_delivered_again_change_nothing(spark):
    docs = spark.createDataFrame([(1, 4), (2, 70_000), (3, 1)], "doc_id int, page_count int")
    done = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 3), (1, 3, 3), (1, 4, 1)], "doc_id int, done_no int, page_index int")
    assert [r.percent for r in progress.progress(done, docs).orderBy("done_no").collect()] == [25.0, 25.0, 50.0, 50.0, 75.0]
    marks = spark.createDataFrame([(1, p) for p in (0, 0, 3)] + [(2, p) for p in (0, 32767, 32768, 69_999, 69_999)], "doc_id int, page_index int")
    parts = progress.done_bitmaps(marks), progress.done_bitmaps(marks.where("page_index > 2"))
    got = {r.doc_id: (r.n_done, r.percent) for r in progress.progress_of(progress.merge_bitmaps(*parts), docs).collect()}
    assert got == {1: (2, 50.0), 2: (4, 100 * 4 / 70_000), 3: (0, 0.0)}


# --- streams


def batches_of(spark, tmp_path, schema, batches, run, mode="update"):
    """The rows that a stream gives for each batch, and its state's rows after it."""
    got, states = [], []
    with conf(spark, **ROCKSDB, spark__sql__shuffle__partitions="2"):
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            made = []
            stream = run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "log")).foreachBatch(lambda rows, _, made=made: made.extend(rows.collect())).trigger(availableNow=True).start()
            query.awaitTermination()
            got.append(made)
            states.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
    return got, states


def test_snapshots_keep_their_state_flat(spark, tmp_path):
    rng = random.Random(4)
    size, ops = 6, ["toggle", "toggle", "move", "move", "delete", "select_all", "touch"]
    edits = [(1, size, 10 * i, i, rng.choice(ops), rng.randrange(size), rng.randrange(size)) for i in range(60)]
    late = (1, size, 5, 1000, "move", 0, 1)
    # each batch brings four edits, the last two of them in the next batch's place now and then
    order = sorted(edits, key=lambda e: (e[3] + (6 if e[3] % 5 == 0 else 0)))
    batches = [order[i : i + 4] for i in range(0, 60, 4)] + [[late, edits[-1]]]
    run = lambda s: stream_snapshots(s.selectExpr("doc_id", "n", "timestamp_seconds(at) AS ts", "seq", "op", "a", "b"), "100 seconds")
    got, states = batches_of(spark, tmp_path, "doc_id bigint, n int, at bigint, seq bigint, op string, a int, b int", batches, run)
    expected = folded({1: size}, [(1, 0, 0, *e[4:]) for e in edits])[1]
    assert (list(got[-1][0].ord), list(got[-1][0].sel), got[-1][0].dirty) == expected
    assert [r[0].n_late for r in got] == [0] * 15 + [1] and got[-1][0].late[0].seq == 1000
    assert max(states[8:]) <= max(states[4:8]) + 4 and max(states) < 40
    rows = late_edits(spark.createDataFrame(got[-1], "doc_id bigint, ord array<int>, sel array<int>, dirty boolean, n_late bigint, late array<struct<ts:bigint,seq:bigint,op:string,a:int,b:int>>"))
    assert [(r.seq, r.op) for r in rows.collect()] == [(1000, "move")]


def test_stream_counts_a_page_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, 4), (2, 100_000)], "doc_id bigint, page_count int")
    batches = [[(1, 0), (1, 0), (2, 99_999)], [(1, 0), (1, 3), (2, 99_999), (2, None)], [(2, 5)]]
    got, _ = batches_of(spark, tmp_path, "doc_id bigint, page_index int", batches, lambda s: stream_progress(s, docs))
    assert [sorted((r.doc_id, r.n_done, r.percent) for r in b) for b in got] == [[(1, 1, 25.0), (2, 1, 0.001)], [(1, 2, 50.0), (2, 1, 0.001)], [(2, 2, 0.002)]]


def test_stream_takes_batches_in_whole(spark, tmp_path):
    kind = "batch_id bigint, n_files int, file_no int, name string, load_failed boolean, at bigint"
    batches = [
        [(1, 2, 1, "b", False, 0), (2, 2, 0, "c", True, 0), (3, 3, 0, "d", False, 0)],
        [(1, 2, 0, "a", False, 60), (2, 2, 1, None, False, 60), (3, 3, 0, "d again", False, 60)],
        [(1, 2, 5, "late", False, 61), (4, 1, 0, "e", None, 100_000)],
        [(5, 1, 0, "f", False, 100_001)],
    ]
    run = lambda s: stream_atomic_batches(s.selectExpr("batch_id", "n_files", "file_no", "name", "load_failed", "timestamp_seconds(at) AS ts"), "1 hour", "10 seconds")
    got, _ = batches_of(spark, tmp_path, kind, batches, run, "append")
    rows = [(r.batch_id, r.file_no, r.name, r.reject_reason) for r in itertools.chain(*got)]
    assert sorted(rows, key=repr) == sorted([(1, 0, "a", None), (1, 1, "b", None), (2, 0, "c", "batch_load_failed"), (2, 1, None, "batch_load_failed"), (1, 5, "late", "batch_closed"), (4, 0, "e", None), (3, 0, "d again", "batch_incomplete"), (5, 0, "f", None)], key=repr)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, 3, "a.pdf"), (2, 2, "b.pdf")], "doc_id bigint, page_count int, name string")
    rows = pages.page_manifest(docs).withColumn("payload", F.concat_ws("-", "doc_id", "page_index"))
    schema = "doc_id bigint, n int, at bigint, seq bigint, op string, a int, b int"
    spark.createDataFrame([(1, 3, 1, 1, "move", 0, 2), (2, 2, 1, 2, "move", 0, 1)], schema).write.parquet(str(tmp_path / "in"))
    out, real, calls = str(tmp_path / "out"), packed.write_packed, []

    def breaks(*args, **how):
        calls.append(real(*args, **how))
        if len(calls) == 1:
            raise RuntimeError("lost after the commit")

    monkeypatch.setattr(packed, "write_packed", breaks)
    with conf(spark, **ROCKSDB, spark__sql__shuffle__partitions="2"):
        for _ in range(2):
            edits = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).selectExpr("doc_id", "n", "timestamp_seconds(at) AS ts", "seq", "op", "a", "b")
            query = packed.save_stream(stream_snapshots(edits, "1 day"), rows, docs, out, str(tmp_path / "log"))
            with contextlib.suppress(Exception):
                query.awaitTermination()
    assert calls == [True, False]
    assert sorted((r.output_name, r.pos, r.payload) for r in packed.read_packed(spark, out).collect()) == [("a_edited.pdf", 0, "1-1"), ("a_edited.pdf", 1, "1-2"), ("a_edited.pdf", 2, "1-0"), ("b_edited.pdf", 0, "2-1"), ("b_edited.pdf", 1, "2-0")]
