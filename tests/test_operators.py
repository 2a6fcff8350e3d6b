"""Golden cases and properties of the page operators."""

from __future__ import annotations

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quire.functions import encoding, geometry, naming
from quire.operators import docsets, images, intake, pages, progress, replay
from quire.sources import files
from quire.streaming.replay import step


def order_of(spark, *orders):
    return spark.createDataFrame([(d, p, x) for d, o in enumerate(orders) for p, x in enumerate(o)], "doc_id bigint, pos int, page_index int")


def listed(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.pos)):
        found.setdefault(r.doc_id, []).append(r.page_index)
        assert r.pos == len(found[r.doc_id]) - 1
    return found


def test_page_manifest_of_nothing(spark):
    docs = spark.createDataFrame([(1, 0), (2, 2), (3, None)], "doc_id bigint, page_count int")
    assert listed(pages.page_manifest(docs)) == {2: [0, 1]}


def test_paginate(spark):
    docs = spark.createDataFrame([(1, "abcde"), (2, ""), (3, None), (4, "abcd")], "doc_id bigint, text string")
    got = {(r.doc_id, r.pos): r.payload for r in pages.paginate(docs, 2).collect()}
    assert got == {(1, 0): "ab", (1, 1): "cd", (1, 2): "e", (4, 0): "ab", (4, 1): "cd"}


def test_delete_pages(spark):
    gone = spark.createDataFrame([(0, 1), (0, 3), (0, 3), (0, 9)], "doc_id bigint, page_index int")
    assert listed(pages.delete_pages(order_of(spark, range(5)), gone)) == {0: [0, 2, 4]}


def test_delete_selected(spark):
    picked = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (2, 0), (2, 3)], "doc_id bigint, pos int")
    done = pages.delete_selected(order_of(spark, range(3), range(3), [3, 1, 2, 0]), picked)
    assert listed(done.accepted) == {0: [0, 1, 2], 1: [0, 1, 2], 2: [1, 2]}
    assert [tuple(r) for r in done.rejected.collect()] == [(0, "all_pages_selected")]


def test_reorder_pages(spark):
    wanted = spark.createDataFrame([(0, 0, 2), (0, 1, 0), (0, 2, 0), (0, 3, 7)], "doc_id bigint, j int, src int")
    done = pages.reorder_pages(order_of(spark, range(4)), wanted)
    assert listed(done.accepted) == {0: [2, 0, 0]}
    assert [r.src for r in done.rejected.collect()] == [7]


@pytest.mark.parametrize(("first", "last", "expected"), [(1, 3, [1, 2, 3]), (-1, 2, None), (2, 5, None), (3, 2, None), (0, 4, [0, 1, 2, 3, 4])])
def test_extract_pages(spark, first, last, expected):
    docs = spark.createDataFrame([(0, 5)], "doc_id bigint, page_count int")
    done = pages.extract_pages(order_of(spark, range(5)), spark.createDataFrame([(0, first, last)], "doc_id bigint, first_page int, last_page int"), docs)
    assert listed(done.accepted) == ({0: expected} if expected else {})
    assert done.rejected.count() == (0 if expected else 1)


def test_extract_from_request(spark):
    docs = spark.createDataFrame([(i, 5, "a.pdf") for i in range(5)], "doc_id bigint, page_count int, name string")
    asked = spark.createDataFrame([(0, "1", "5"), (1, "0", "2"), (2, "2", "6"), (3, "", "2"), (4, " 2x", "+3")], "doc_id bigint, start_txt string, end_txt string")
    done = pages.extract_from_request(asked, docs)
    assert listed(done.accepted) == {0: [0, 1, 2, 3, 4], 4: [1, 2]}
    assert sorted(r.doc_id for r in done.rejected.collect()) == [1, 2, 3]
    assert {r.output_name for r in done.accepted.collect()} == {"a_pages_1-5.pdf", "a_pages_2-3.pdf"}


def test_move_item(spark):
    cases = [(0, 2), (3, 1), (2, 2), (0, 9)]
    moves = spark.createDataFrame([(i, *m) for i, m in enumerate(cases)], "doc_id bigint, from_pos int, to_pos int")
    done = pages.move_item(order_of(spark, *[range(4)] * 5), moves)
    assert listed(done.accepted) == {0: [1, 2, 0, 3], 1: [0, 3, 1, 2], 2: [0, 1, 2, 3], 3: [0, 1, 2, 3], 4: [0, 1, 2, 3]}
    assert [r.doc_id for r in done.rejected.collect()] == [3]


def test_moves_of_one_document(spark):
    moves = spark.createDataFrame([(0, 0, 2), (0, 1, 2), (1, 0, 2), (1, 0, 2), (7, 0, 1), (2, None, 1)], "doc_id bigint, from_pos int, to_pos int")
    done = pages.move_item(order_of(spark, *[range(3)] * 4), moves)
    assert listed(done.accepted) == {0: [0, 1, 2], 1: [1, 2, 0], 2: [0, 1, 2], 3: [0, 1, 2]}
    assert sorted(((r.doc_id, r.from_pos, r.reject_reason) for r in done.rejected.collect()), key=repr) == [(0, 0, "several_moves"), (0, 1, "several_moves"), (2, None, "no_such_position"), (7, 0, "no_such_document")]
    steps = spark.createDataFrame([(0, 2, -1), (0, 0, 1)], "doc_id bigint, at_pos int, step int")
    assert listed(pages.move_step(order_of(spark, range(3)), steps)) == {0: [1, 0, 2]}


def test_move_there_and_back(spark):
    rng = random.Random(3)
    orders = [list(range(rng.randint(1, 9))) for _ in range(20)]
    there = [(i, rng.randrange(len(o)), rng.randrange(len(o))) for i, o in enumerate(orders)]
    kind = "doc_id bigint, from_pos int, to_pos int"
    once = pages.move_item(order_of(spark, *orders), spark.createDataFrame(there, kind)).accepted
    back = pages.move_item(once, spark.createDataFrame([(i, b, a) for i, a, b in there], kind)).accepted
    assert listed(back) == dict(enumerate(orders))
    for i, a, b in there:
        orders[i].insert(b, orders[i].pop(a))
    assert listed(once) == dict(enumerate(orders))


def test_move_step(spark):
    steps = spark.createDataFrame([(0, 0, -1), (1, 2, -1), (2, 2, 1)], "doc_id bigint, at_pos int, step int")
    assert listed(pages.move_step(order_of(spark, *[range(3)] * 3), steps)) == {0: [0, 1, 2], 1: [0, 2, 1], 2: [0, 1, 2]}


def test_selection(spark):
    toggles = spark.createDataFrame([(0, 1), (0, 2), (0, 1)], "doc_id bigint, pos int")
    picked = pages.selection_from_toggles(toggles)
    assert [tuple(r) for r in picked.collect()] == [(0, 2)]
    assert [r.pos for r in pages.with_selection(order_of(spark, range(3)), picked).where("selected").collect()] == [2]


def log(spark, *edits):
    rows = [(0, i, i, *e, *[None] * (3 - len(e))) for i, e in enumerate(edits)]
    return spark.createDataFrame(rows, "doc_id bigint, ts int, seq bigint, op string, a int, b int").withColumn("ts", F.timestamp_seconds("ts"))


def test_replay_keeps_selected_positions(spark):
    docs = spark.createDataFrame([(0, 4), (1, 2), (2, 0)], "doc_id bigint, page_count int")
    done = {r.doc_id: r for r in replay.replay_edits(docs, log(spark, ("toggle", 1), ("move", 0, 2), ("delete",))).collect()}
    assert (done[0].ord, done[0].sel, done[0].dirty, done[0].order_differs) == ([1, 0, 3], [], True, True)
    assert (done[1].ord, done[1].dirty, done[2].ord) == ([0, 1], False, [])
    done = replay.replay_edits(docs, log(spark, ("toggle", 1), ("move", 0, 2), ("select_all",), ("reset",))).where("doc_id = 0").first()
    assert (done.ord, done.sel, done.dirty) == ([0, 1, 2, 3], [], False)
    done = replay.replay_edits(docs, log(spark, ("touch",), ("toggle", 9), ("move", 0, 9), ("what",))).where("doc_id = 0").first()
    assert (done.ord, done.sel, done.dirty, done.order_differs) == ([0, 1, 2, 3], [], True, False)


def test_replay_equals_steps(spark):
    rng = random.Random(5)
    sizes = [rng.randint(1, 7) for _ in range(30)]
    edits = [(d, i, i, rng.choice(["toggle", "toggle", "move", "delete", "select_all", "reset", "touch"]), rng.randint(0, 7), rng.randint(0, 7)) for i in range(600) for d in [rng.randrange(30)]]
    kind = "doc_id bigint, ts int, seq bigint, op string, a int, b int"
    logs = spark.createDataFrame(edits, kind).withColumn("ts", F.timestamp_seconds("ts"))
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, page_count int")
    states = {d: (list(range(n)), [], False) for d, n in enumerate(sizes)}
    for d, _, _, op, a, b in edits:
        states[d] = step(*states[d], sizes[d], op, a, b)
    assert {r.doc_id: (r.ord, r.sel, r.dirty) for r in replay.replay_edits(docs, logs).collect()} == states


def test_clear_and_reset_stay_apart(spark):
    docs = spark.createDataFrame([(0, 3)], "doc_id bigint, page_count int")
    assert replay.replay_edits(docs, log(spark, ("move", 0, 2), ("clear",))).first().ord == [1, 2, 0]
    edits = [(1, 1, 10, "append", 0, 0), (1, 2, 11, "append", 0, 0), (1, 3, 12, "reset", 0, 0), (2, 1, 20, "append", 0, 0), (2, 2, 21, "clear", 0, 0), (2, 3, 22, "append", 0, 0)]
    logs = spark.createDataFrame(edits, "set_id bigint, ts int, seq bigint, op string, a int, b int").withColumn("ts", F.timestamp_seconds("ts"))
    start = spark.createDataFrame([(2, 0, 5)], "set_id bigint, set_pos int, doc_id bigint")
    for initial in (None, start):
        assert sorted(tuple(r) for r in replay.replay_set_edits(logs, initial).collect()) == [(1, 0, 10), (1, 1, 11), (2, 0, 22)]


def test_collapse_drags(spark):
    steps = spark.createDataFrame([(0, 1, 0, 0, 1), (0, 1, 1, 1, 2), (0, 1, 2, 2, 3), (0, 2, 0, 1, 2), (0, 2, 1, 2, 1), (0, 3, 0, 2, 2)], "doc_id bigint, gesture_id int, step int, from_pos int, to_pos int")
    assert sorted(tuple(r) for r in replay.collapse_drags(steps).collect()) == [(0, 1, "move", 0, 3), (0, 2, "touch", 1, 1)]


def test_replay_set_edits_from_members(spark):
    edits = spark.createDataFrame([(1, 1, 10, "append", 0, 0), (1, 2, 11, "move_up", 2, 0), (1, 3, 12, "remove", 0, 0)], "set_id bigint, ts int, seq bigint, op string, a int, b int").withColumn("ts", F.timestamp_seconds("ts"))
    start = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 7)], "set_id bigint, set_pos int, doc_id bigint")
    got = sorted(tuple(r) for r in replay.replay_set_edits(edits, start).collect())
    assert got == [(1, 0, 10), (1, 1, 6), (2, 0, 7)]


def test_merge_pages(spark):
    sets = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 1, 3), (2, 0, 0, 2)], "set_id bigint, set_pos int, doc_id bigint, page_count int")
    done = docsets.merge_pages(sets, order_of(spark, range(2), range(3)))
    assert [(r.doc_id, r.page_index) for r in done.accepted.orderBy("pos").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    assert [r.set_id for r in done.rejected.collect()] == [2]


def test_accepts(spark):
    names = [("A.PDF", ""), ("x.bin", "application/pdf"), ("x.png", "image/png"), ("y", "ximage"), ("z", "IMAGE/PNG"), (None, None)]
    df = spark.createDataFrame(names, "name string, mime string")
    passed = lambda tokens: [r[0] for r in df.select(intake.accepts(tokens, F.col("name"), F.col("mime"))).collect()]
    assert passed([".pdf", "application/pdf"]) == [True, True, False, False, False, False]
    assert passed(["image/*"]) == [False, False, True, True, False, False]
    assert passed([]) == [True] * 6


def test_batches(spark):
    rows = [(1, 0, "a", intake.PDF, "drop", False), (1, 1, "b", intake.PDF, "drop", True), (2, 0, "c", "", "drop", False), (3, 0, "d", "", "select", False)]
    df = spark.createDataFrame(rows, "batch_id bigint, file_no int, name string, mime string, via string, load_failed boolean")
    done = intake.atomic_batches(df)
    assert sorted(r.name for r in done.accepted.collect()) == ["c", "d"]
    assert done.accepted.count() + done.rejected.count() == df.count()
    assert [r.batch_id for r in intake.batch_rejects(df, F.col("mime") == intake.PDF, ("drop",)).collect()] == [2]
    assert [r.name for r in intake.first_match(df).collect()] == ["a"]


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(("name", "expected"), [("a.pdf", "a"), ("a.pdf.pdf", "a.pdf"), ("A.PDF", "A.PDF"), ("x.pdf.png", "x.png"), ("", ""), (None, None)])
def test_base_name(spark, name, expected):
    assert one(spark, name, "string", naming.base_name) == expected


@pytest.mark.parametrize(("text", "expected"), [(" 12ab", 12), ("3.7", 3), ("-3", -3), ("", None), ("x1", None), ("99999999999", None), (None, None)])
def test_parse_int(spark, text, expected):
    assert one(spark, text, "string", naming.parse_int) == expected


@pytest.mark.parametrize(("x", "expected"), [(2.5, 3), (-2.5, -2), (0.49, 0), (0.49999999999999994, 0), (-0.5, 0), (4503599627370497.0, 4503599627370497), (None, None)])
def test_js_round(spark, x, expected):
    assert one(spark, x, "double", geometry.js_round) == expected


@pytest.mark.parametrize(("mode", "w", "h", "expected"), [("width", 600.0, 1000.0, 1.0), ("page", 600.0, 1000.0, 0.5), ("width", 60.0, 10.0, 5.0), ("width", 6000.0, 10.0, 0.25), ("page", 0.0, 10.0, None), ("width", None, 10.0, None)])
def test_fit_scale(spark, mode, w, h, expected):
    df = spark.createDataFrame([(632.0, w, h)], "v double, w double, h double")
    assert df.select(geometry.fit_scale(mode, F.col("v"), F.col("w"), F.col("h"))).first()[0] == expected


def test_progress(spark):
    done = spark.createDataFrame([(0, i) for i in range(3)], "doc_id bigint, done_no int")
    got = progress.progress(done, spark.createDataFrame([(0, 3)], "doc_id bigint, page_count int")).orderBy("done_no").collect()
    assert [round(r.percent, 3) for r in got] == [33.333, 66.667, 100.0]
    assert [r.label for r in got] == ["33%", "67%", "100%"]


def png(width, height):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    pixels = b"".join(b"\0" + b"\x7f\x7f\x7f" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")


def segment(mark, body):
    return b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body


def riff(chunk):
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def test_image_files(spark, tmp_path):
    frame = struct.pack(">BHHB", 8, 200, 300, 3) + b"\1\x11\0" * 3
    found = {
        "a.png": png(300, 200), "b.png": png(10, 10), "c.gif": b"GIF89a" + struct.pack("<HH", 7, 9) + b"\0\0\0", "d.png": b"\x89P", "e.webp": b"RIFF\0\0\0\0WEBPVP8 ", "f.jpg": b"\xff\xd8\xff\xe0\0\0",
        "g.jpg": b"\xff\xd8" + segment(0xE1, b"x" * 60_000) * 4 + b"\xff\xff\xff" + segment(0xC4, b"\0" * 19) + segment(0xC2, frame) + b"\xff\xda",
        "h.jpg": b"\xff\xd8" + segment(0xFE, b"no frame") + b"\xff\xd9", "i.jpg": b"\xff\xd8" + segment(0xC0, frame)[:7], "j.jpg": b"\xff\xd8" + segment(0xDB, b"") + b"junk",
        "k.webp": riff(b"VP8 \0\0\0\0\x30\1\0\x9d\1\x2a" + struct.pack("<HH", 640 | 1 << 14, 480)), "l.webp": riff(b"VP8L\0\0\0\0\x2f" + struct.pack("<I", 639 | 479 << 14)),
        "m.webp": riff(b"VP8X\x0a\0\0\0\0\0\0\0" + struct.pack("<I", 20_000)[:3] + struct.pack("<I", 30_000)[:3]), "n.txt": b"text",
    }
    image = spark._jvm.java.awt.image.BufferedImage(33, 44, 1)
    assert spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(tmp_path / "p.jpg")))
    for name, content in found.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.width, r.height, r.reject_reason) for r in images.image_manifest(files.read_files(spark, str(tmp_path))).collect()}
    bad = "undecodable"
    assert got == {
        "a.png": ("png", 300, 200, None), "b.png": ("png", 10, 10, None), "c.gif": ("gif", 7, 9, None), "d.png": (None, None, None, bad), "e.webp": ("webp", None, None, bad), "f.jpg": ("jpeg", None, None, bad),
        "g.jpg": ("jpeg", 300, 200, None), "h.jpg": ("jpeg", None, None, bad), "i.jpg": ("jpeg", None, None, bad), "j.jpg": ("jpeg", None, None, bad), "k.webp": ("webp", 640, 480, None),
        "l.webp": ("webp", 640, 480, None), "m.webp": ("webp", 20_001, 30_001, None), "n.txt": (None, None, None, bad), "p.jpg": ("jpeg", 33, 44, None),
    }


def test_images_to_pages(spark):
    rows = [(1, 0, "x", 300, 200), (1, 1, "y", 200, 300), (1, 2, "z", 10, 10)]
    df = spark.createDataFrame(rows, "set_id bigint, image_no int, image_id string, width int, height int")
    done = images.image_sets(spark.createDataFrame([(1,), (2,)], "set_id bigint"), df)
    assert [r.orientation for r in done.accepted.orderBy("pos").collect()] == ["landscape", "portrait", "portrait"]
    assert [r.set_id for r in done.rejected.collect()] == [2]


def test_data_url_round_trip(spark):
    contents = [b"", b"a", bytes(range(256)) * 3]
    df = spark.createDataFrame([(bytearray(c),) for c in contents], "c binary").withColumn("u", encoding.data_url(F.lit("image/png"), F.col("c")))
    back = df.select(encoding.data_url_mime(F.col("u")), encoding.data_url_content(F.col("u"))).collect()
    assert [bytes(r[1]) for r in back] == contents
    assert {r[0] for r in back} == {"image/png"}
    bad = spark.createDataFrame([("x",), ("data:a;base64,???",), (None,)], "u string")
    assert [r[0] for r in bad.select(encoding.data_url_content(F.col("u"))).collect()] == [None] * 3


@pytest.mark.parametrize("buckets", [None, 3])
def test_write_outputs(spark, tmp_path, buckets):
    made = order_of(spark, range(4), range(2)).withColumn("output_name", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    files.write_outputs(made, str(tmp_path / "out"), buckets=buckets)
    back = files.read_outputs(spark, str(tmp_path / "out"))
    assert sorted((r.output_name, r.pos) for r in back.collect()) == sorted((r.output_name, r.pos) for r in made.collect())


def test_expand_with_rejects(spark):
    df = spark.createDataFrame([("p", bytearray(b"a\fb")), ("q", bytearray(b""))], "path string, content binary")

    def split(path, content):
        if not content:
            raise ValueError("empty")
        for part in content.decode().split("\f"):
            yield {"body": part}

    got = sorted((r.path, r.page_index, r.body, r.reject_reason) for r in files.expand_with(df, split, "body string").collect())
    assert got == [("p", 0, "a", None), ("p", 1, "b", None), ("q", None, None, "ValueError: empty")]


def test_surrogate_ids_differ_by_load(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, 0, "a")], "b bigint, n int, name string")
    got = [r[0] for r in df.select(docsets.surrogate_id(F.col("b"), F.col("n"), F.col("name"))).collect()]
    assert len(set(got)) == 2
    df = spark.createDataFrame([("1", 2, "3|x"), ("1|2", 3, "x"), (None, 2, "x"), ("-", 2, "x"), ("", 2, "x"), ("1", None, "x"), ("1", 2, None), ("1", 2, "")], "b string, n int, name string")
    assert df.select(docsets.surrogate_id(F.col("b"), F.col("n"), F.col("name"))).distinct().count() == 8


def test_remove_one_load(spark):
    members = spark.createDataFrame([(1, 0, 7, 2), (1, 1, 7, 2), (1, 2, 8, 1)], "set_id bigint, set_pos int, doc_id bigint, page_count int")
    gone = spark.createDataFrame([(1, 0)], "set_id bigint, set_pos int")
    assert sorted(tuple(r) for r in docsets.remove_docs(members, gone).collect()) == [(1, 0, 7, 2), (1, 1, 8, 1)]
    assert [r.doc_id for r in docsets.remove_docs(members, members.where("doc_id = 7"), by="doc_id").collect()] == [8]
