"""One query per operator, over the given tables, and its SQL twin.

A query is named as its operator; <operator>_rejects gives what it refuses.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import encoding, geometry, naming
from ..operators import docsets, images, intake, pages, progress, replay, segments
from ..operators import geometry as plans
from ..operators.ordering import checkpoint_dir, range_sums
from ..sources import files as sources
from ..sources import packed, ranges
from ..streaming import intake as stream_intake_ops
from ..streaming import progress as stream_progress_ops
from ..streaming import replay as stream_replay_ops
from ..streaming import snapshots as stream_snapshot_ops
from .views import PAGE_CHARS, VIEWS, frame, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = oracle(sql)
        return fn

    return register


def scratch(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{checkpoint_dir(spark)}/quire-{uuid.uuid4().hex}"


# --- sources and sinks


@query("SELECT doc_id, CAST(i AS INT) AS pos, CAST(i AS INT) AS page_index FROM (SELECT doc_id, unnest(range(0, page_count)) AS i FROM {fx_docs})")
def page_manifest(spark, d):
    return pages.page_manifest(frame(spark, d, "fx_docs"))


@query("SELECT doc_id, pos, page_index, page_count, payload FROM {fx_pages}")
def paginate(spark, d):
    return pages.paginate(frame(spark, d, "documents"), PAGE_CHARS)


_SHELF = 200  # documents in a file
_SHELVES = f"""SELECT CAST(floor(doc_id / {_SHELF}.0) AS BIGINT) AS shelf, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS length,
  sha256(string_agg(concat(text, chr(10)), '' ORDER BY doc_id)) AS sha256 FROM {{documents}} GROUP BY 1"""


def _shelves(spark: SparkSession, d: str) -> str:
    """A folder of files that hold the texts of documents, a line end behind each."""
    path = f"{scratch(spark)}/shelves"
    docs = frame(spark, d, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / _SHELF).alias("shelf"))
    docs.repartition("shelf").sortWithinPartitions("shelf", "doc_id").select("shelf", "text").write.partitionBy("shelf").text(path)
    return path


def _digests(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("path", r"shelf=(-?\d+)", 1).cast("bigint").alias("shelf"), "length", F.sha2("content", 256).alias("sha256"))


@query(_SHELVES)
def read_files(spark, d):
    return _digests(sources.read_files(spark, _shelves(spark, d), "*.txt"))


@query(_SHELVES)
def stream_files(spark, d):
    path = scratch(spark)
    stream = _digests(sources.stream_files(spark, _shelves(spark, d), "*.txt"))
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query(_SHELVES)
def read_ranges(spark, d):
    """The same files in ranges of 64 KB, put together again."""
    found = ranges.read_ranges(sources.read_files(spark, _shelves(spark, d), "*.txt").select("path", "length"), 1 << 16)
    files = found.groupBy("path").agg(F.sum(F.octet_length("content")).alias("length"))
    content = F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["content"]))
    whole = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("offset", "content"))).alias("parts")).join(files, "path")
    return _digests(whole.select("path", "length", content.alias("content")))


@query("""SELECT concat('out-', doc_id) AS output_name, CAST(floor(pos / 3) AS BIGINT) AS part, count(*) AS n_pages, min(pos) AS first_pos, max(pos) AS last_pos, CAST(sum(strlen(payload)) AS BIGINT) AS bytes,
  sha256(string_agg(sha256(payload), '' ORDER BY pos)) AS sha256 FROM {fx_pages} GROUP BY ALL""")
def write_packed(spark, d):
    """One output a document, in parts of three pages, packed into files; the manifest of what can be read back."""
    path = scratch(spark)
    rows = pages.paginate(frame(spark, d, "documents"), PAGE_CHARS).withColumn("output_name", F.concat(F.lit("out-"), F.col("doc_id").cast("string")))
    packed.write_packed(rows, path, part_pages=3, file_bytes=1 << 22)
    return packed.read_manifest(spark, path).drop("version")


@query("""SELECT concat('out-', doc_id) AS output_name, count(*) AS n_pages, CAST(sum(page_index) AS BIGINT) AS sum_index, true AS in_order, sha256(string_agg(payload, '' ORDER BY pos)) AS payload_sha256
FROM {fx_pages} GROUP BY doc_id""")
def write_outputs(spark, d):
    """One output a document, in as many buckets as the documents need, read back with the order and the payload of each."""
    path, docs = scratch(spark), frame(spark, d, "documents")
    rows = pages.paginate(docs, PAGE_CHARS).withColumn("output_name", F.concat(F.lit("out-"), F.col("doc_id").cast("string")))
    sources.write_outputs(rows, path, buckets=docs.count() // 500 + 1)
    back = sources.read_outputs(spark, path).select("output_name", "pos", "page_index", "payload", "_metadata.file_path", "_metadata.row_index")
    place = F.row_number().over(Window.partitionBy("output_name").orderBy("file_path", "row_index")) - 1
    per = back.withColumn("place", place).groupBy("output_name")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "payload"))), lambda p: p["payload"]), "")
    return per.agg(F.count(F.lit(1)).alias("n_pages"), F.sum("page_index").alias("sum_index"), F.bool_and(F.col("pos") == F.col("place")).alias("in_order"), F.sha2(said, 256).alias("payload_sha256"))


@query(r"SELECT p.doc_id, page_index + 1 AS page_number, concat(regexp_replace(name, '\.pdf', ''), '_page_', page_index + 1, '.png') AS output_name FROM {fx_pages} p JOIN {fx_docs} d ON d.doc_id = p.doc_id")
def page_outputs(spark, d):
    return pages.page_outputs(pages.page_manifest(frame(spark, d, "fx_docs"), "name"))


# --- intake

_TOKENS = [".pdf", "application/pdf"]
_ACCEPTED = "(ends_with(lower(name), '.pdf') OR regexp_matches(mime, 'application/pdf'))"


@query(f"SELECT batch_id, file_no, name, mime FROM {{fx_files}} WHERE {_ACCEPTED}")
def accept_filter(spark, d):
    return intake.accept_filter(frame(spark, d, "fx_files"), _TOKENS).select("batch_id", "file_no", "name", "mime")


@query(f"SELECT batch_id, file_no, name, via FROM {{fx_files}} WHERE via = 'select' OR {_ACCEPTED}")
def intake_paths(spark, d):
    return intake.intake(frame(spark, d, "fx_files"), _TOKENS).select("batch_id", "file_no", "name", "via")


@query("SELECT name, 'pdf' AS kind FROM {fx_files} WHERE mime = 'application/pdf' UNION ALL SELECT name, 'image' AS kind FROM {fx_files} WHERE starts_with(mime, 'image/')")
def mime_filter(spark, d):
    f = frame(spark, d, "fx_files")
    pdf, image = intake.mime_filter(f, exact=intake.PDF), intake.mime_filter(f, prefix="image/")
    return pdf.select("name", F.lit("pdf").alias("kind")).unionByName(image.select("name", F.lit("image").alias("kind")))


@query("SELECT batch_id, file_no, name FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY file_no) AS k FROM {fx_files} WHERE mime = 'application/pdf') WHERE k = 1")
def first_match(spark, d):
    return intake.first_match(frame(spark, d, "fx_files")).select("batch_id", "file_no", "name")


@query("SELECT batch_id, count(*) AS n_files, 'no_valid_file' AS reject_reason FROM {fx_files} GROUP BY batch_id HAVING count_if(mime = 'application/pdf') = 0 AND bool_or(via = 'drop')")
def batch_rejects(spark, d):
    return intake.batch_rejects(frame(spark, d, "fx_files"), F.col("mime") == intake.PDF, ("drop",))


@query("SELECT batch_id, file_no, name FROM {fx_files} WHERE batch_id NOT IN (SELECT batch_id FROM {fx_files} WHERE load_failed)")
def atomic_batches(spark, d):
    return intake.atomic_batches(frame(spark, d, "fx_files")).accepted.select("batch_id", "file_no", "name")


@query("SELECT batch_id, file_no, name, 'batch_load_failed' AS reject_reason FROM {fx_files} WHERE batch_id IN (SELECT batch_id FROM {fx_files} WHERE load_failed)")
def atomic_batches_rejects(spark, d):
    return intake.atomic_batches(frame(spark, d, "fx_files")).rejected.select("batch_id", "file_no", "name", "reject_reason")


# --- pages


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS INT) AS pos, page_index FROM {fx_pages} WHERE (doc_id + page_index) % 3 <> 0")
def delete_pages(spark, d):
    docs = frame(spark, d, "fx_docs")
    p = pages.page_manifest(docs)
    return pages.delete_pages(p, p.where("(doc_id + page_index) % 3 = 0").select("doc_id", "page_index")).select("doc_id", "pos", "page_index")


_SELECTED = "((doc_id + pos) % 2 = 0 OR doc_id % 5 = 0)"
_DELETED = f"SELECT *, count_if({_SELECTED}) OVER (PARTITION BY doc_id) = count(*) OVER (PARTITION BY doc_id) AS everything FROM {{fx_talks}}"


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS pos, page_index FROM ({_DELETED}) WHERE everything OR NOT {_SELECTED}")
def delete_selected(spark, d):
    p = frame(spark, d, "fx_talks")
    return pages.delete_selected(p, p.where(_SELECTED)).accepted.select("doc_id", "pos", "page_index")


@query(f"SELECT DISTINCT doc_id, 'all_pages_selected' AS reject_reason FROM ({_DELETED}) WHERE everything")
def delete_selected_rejects(spark, d):
    p = frame(spark, d, "fx_talks")
    return pages.delete_selected(p, p.where(_SELECTED)).rejected


@query("SELECT o.doc_id, CAST(j AS INT) AS pos, page_index, payload FROM {fx_reorder} o JOIN {fx_pages} p ON p.doc_id = o.doc_id AND p.page_index = o.src")
def reorder_pages(spark, d):
    return pages.reorder_pages(frame(spark, d, "fx_pages"), frame(spark, d, "fx_reorder")).accepted.select("doc_id", "pos", "page_index", "payload")


@query("SELECT o.doc_id, j, src, 'no_such_page' AS reject_reason FROM {fx_bad_reorder} o LEFT JOIN {fx_pages} p ON p.doc_id = o.doc_id AND p.page_index = o.src WHERE p.doc_id IS NULL")
def reorder_pages_rejects(spark, d):
    return pages.reorder_pages(pages.page_manifest(frame(spark, d, "fx_docs")), frame(spark, d, "fx_bad_reorder")).rejected


@query(r"""SELECT p.doc_id, page_index - 1 AS pos, page_index, payload, concat(regexp_replace(name, '\.pdf', ''), '_pages_2-3.pdf') AS output_name
FROM {fx_pages} p JOIN {fx_docs} d ON d.doc_id = p.doc_id WHERE p.page_count >= 3 AND page_index BETWEEN 1 AND 2""")
def extract_pages(spark, d):
    docs = frame(spark, d, "documents").select("doc_id", "text").withColumn("name", _doc_name())
    return pages.extract_fixed(docs, PAGE_CHARS, 1, 2).accepted


def _doc_name():
    """The name that fx_docs gives a document."""
    kind = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PDF", ".png", ".jpg", "", ".pdf.pdf")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), kind)


@query("SELECT doc_id, page_count, 'bad_range' AS reject_reason FROM {fx_docs} WHERE page_count < 3")
def extract_pages_rejects(spark, d):
    docs = frame(spark, d, "documents").select("doc_id", "text").withColumn("name", _doc_name())
    return pages.extract_fixed(docs, PAGE_CHARS, 1, 2).rejected


@query("""SELECT p.doc_id, page_index - CAST(p.doc_id % 3 AS INT) AS pos, page_index, payload FROM {fx_pages} p
WHERE page_index BETWEEN doc_id % 3 AND doc_id % 3 + doc_id % 2 AND doc_id % 3 + doc_id % 2 < page_count""")
def extract_ranges(spark, d):
    docs = frame(spark, d, "fx_docs")
    ranges = docs.selectExpr("doc_id", "cast(doc_id % 3 AS int) AS first_page", "cast(doc_id % 3 + doc_id % 2 AS int) AS last_page")
    return pages.extract_pages(frame(spark, d, "fx_pages"), ranges, docs).accepted.select("doc_id", "pos", "page_index", "payload")


@query("""SELECT doc_id, CAST(doc_id % 3 + 1 AS INT) AS first_number, CAST(doc_id % 3 + doc_id % 2 + 1 AS INT) AS last_number, page_count, 'bad_range' AS reject_reason
FROM {fx_docs} WHERE doc_id % 3 + doc_id % 2 >= page_count""")
def extract_ranges_rejects(spark, d):
    docs = frame(spark, d, "fx_docs")
    ranges = docs.selectExpr("doc_id", "cast(doc_id % 3 AS int) AS first_page", "cast(doc_id % 3 + doc_id % 2 AS int) AS last_page")
    return pages.extract_pages(pages.page_manifest(docs), ranges, docs).rejected


_TYPED = r"""SELECT r.doc_id, start_txt, end_txt, name, page_count, TRY_CAST(regexp_extract(start_txt, '^\s*([+-]?\d+)', 1) AS INT) AS s, TRY_CAST(regexp_extract(end_txt, '^\s*([+-]?\d+)', 1) AS INT) AS e
FROM {fx_ranges} r JOIN {fx_docs} d ON d.doc_id = r.doc_id"""
_VALID = "coalesce(s >= 1 AND e <= page_count AND s <= e, false)"


@query(rf"""SELECT doc_id, CAST(i AS INT) AS pos, CAST(s - 1 + i AS INT) AS page_index, concat(regexp_replace(name, '\.pdf', ''), '_pages_', s, '-', e, '.pdf') AS output_name
FROM (SELECT *, unnest(range(0, e - s + 1)) AS i FROM ({_TYPED}) WHERE {_VALID})""")
def extract_from_request(spark, d):
    return pages.extract_from_request(frame(spark, d, "fx_ranges"), frame(spark, d, "fx_docs")).accepted


@query(f"SELECT doc_id, start_txt, end_txt, 'bad_range' AS reject_reason FROM ({_TYPED}) WHERE NOT {_VALID}")
def extract_from_request_rejects(spark, d):
    return pages.extract_from_request(frame(spark, d, "fx_ranges"), frame(spark, d, "fx_docs")).rejected


@query("""SELECT t.doc_id, CAST(CASE WHEN pos = from_pos THEN to_pos WHEN from_pos < pos AND pos <= to_pos THEN pos - 1 WHEN to_pos <= pos AND pos < from_pos THEN pos + 1 ELSE pos END AS INT) AS pos, page_index
FROM {fx_talks} t JOIN {fx_moves} m ON m.doc_id = t.doc_id""")
def move_item(spark, d):
    return pages.move_item(frame(spark, d, "fx_talks"), frame(spark, d, "fx_moves")).accepted.select("doc_id", "pos", "page_index")


@query("""SELECT doc_id, from_pos, to_pos, CASE WHEN several > 1 THEN 'several_moves' WHEN page_count IS NULL THEN 'no_such_document' ELSE 'no_such_position' END AS reject_reason
FROM (SELECT m.*, page_count, count(*) OVER (PARTITION BY m.doc_id) AS several FROM {fx_bad_moves} m LEFT JOIN {fx_talk_docs} t ON t.doc_id = m.doc_id)
WHERE several > 1 OR page_count IS NULL OR from_pos >= page_count OR to_pos >= page_count""")
def move_item_rejects(spark, d):
    return pages.move_item(frame(spark, d, "fx_talks"), frame(spark, d, "fx_bad_moves")).rejected


@query("""SELECT doc_id, CAST(CASE WHEN p + step NOT BETWEEN 0 AND n - 1 THEN pos WHEN pos = p THEN p + step WHEN pos = p + step THEN p ELSE pos END AS INT) AS pos, page_index
FROM (SELECT t.doc_id, pos, page_index, from_pos AS p, CASE WHEN t.doc_id % 2 = 0 THEN -1 ELSE 1 END AS step, count(*) OVER (PARTITION BY t.doc_id) AS n FROM {fx_talks} t JOIN {fx_moves} m ON m.doc_id = t.doc_id)""")
def move_step(spark, d):
    steps = frame(spark, d, "fx_moves").selectExpr("doc_id", "from_pos AS at_pos", "CASE WHEN doc_id % 2 = 0 THEN -1 ELSE 1 END AS step")
    return pages.move_step(frame(spark, d, "fx_talks"), steps).select("doc_id", "pos", "page_index")


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS pos, page_index FROM {fx_talks} WHERE role <> 'system'")
def renumber(spark, d):
    return pages.renumber(frame(spark, d, "fx_talks").where("role <> 'system'")).select("doc_id", "pos", "page_index")


@query("SELECT doc_id, a AS pos FROM {fx_edits} WHERE op = 'toggle' GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def selection_from_toggles(spark, d):
    return pages.selection_from_toggles(frame(spark, d, "fx_edits").where("op = 'toggle'").select("doc_id", F.col("a").alias("pos")))


@query(f"SELECT doc_id, pos, page_index, {_SELECTED} AS selected FROM {{fx_talks}}")
def with_selection(spark, d):
    p = frame(spark, d, "fx_talks")
    return pages.with_selection(p, p.where(_SELECTED).select("doc_id", "pos")).select("doc_id", "pos", "page_index", "selected")


@query("""SELECT doc_id, gesture_id, seq, CASE WHEN a <> b THEN 'move' ELSE 'touch' END AS op, a, b
FROM (SELECT doc_id, gesture_id, min(seq) AS seq, arg_min(from_pos, step) AS a, arg_max(to_pos, step) AS b, bool_or(from_pos <> to_pos) AS any_move FROM {fx_drags} GROUP BY 1, 2) WHERE a <> b OR any_move""")
def collapse_drags(spark, d):
    return replay.collapse_drags(frame(spark, d, "fx_drags")).drop("ts")


_REPLAY = """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, seq) AS k FROM {fx_edits}),
states AS (
  SELECT doc_id, page_count AS n, 0::BIGINT AS k, CAST(range(0, page_count) AS INT[]) AS ord, CAST([] AS INT[]) AS sel, false AS dirty FROM {fx_edit_docs}
  UNION ALL
  SELECT s.doc_id, s.n, e.k,
    CASE WHEN e.op = 'move' AND a <> b AND a < len(ord) AND b < len(ord)
           THEN list_concat(list_concat(list_slice(list_filter(ord, lambda x, i: i <> a + 1), 1, b), [ord[a + 1]]), list_slice(list_filter(ord, lambda x, i: i <> a + 1), b + 1, len(ord)))
         WHEN e.op = 'delete' AND len(sel) > 0 AND len(sel) < len(ord) THEN list_filter(ord, lambda x, i: NOT list_contains(sel, i - 1))
         WHEN e.op = 'reset' THEN CAST(range(0, s.n) AS INT[]) ELSE ord END,
    CASE WHEN e.op = 'toggle' AND a < len(ord) THEN CASE WHEN list_contains(sel, a) THEN list_filter(sel, lambda x: x <> a) ELSE list_append(sel, a) END
         WHEN e.op = 'select_all' THEN CASE WHEN len(sel) = len(ord) THEN CAST([] AS INT[]) ELSE CAST(range(0, len(ord)) AS INT[]) END
         WHEN e.op = 'reset' OR (e.op = 'delete' AND len(sel) > 0 AND len(sel) < len(ord)) THEN CAST([] AS INT[]) ELSE sel END,
    CASE WHEN e.op = 'reset' THEN false WHEN e.op = 'delete' AND len(sel) > 0 AND len(sel) < len(ord) THEN true
         WHEN e.op = 'move' AND a <> b AND a < len(ord) AND b < len(ord) THEN true ELSE dirty END
  FROM states s JOIN numbered e ON e.doc_id = s.doc_id AND e.k = s.k + 1),
final AS (SELECT doc_id, n, arg_max(ord, k) AS ord, arg_max(sel, k) AS sel, arg_max(dirty, k) AS dirty FROM states GROUP BY 1, 2),
placed AS (SELECT *, unnest(range(0, len(ord))) AS i FROM final)
"""


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay_edits(frame(spark, d, "fx_edit_docs"), frame(spark, d, "fx_edits"))


_FINAL_PAGES = "SELECT doc_id, CAST(i AS INT) AS pos, ord[i + 1] AS page_index, list_contains(sel, CAST(i AS INT)) AS selected FROM placed"


@query(_REPLAY + _FINAL_PAGES)
def replay_edits(spark, d):
    return replay.final_pages(_replayed(spark, d))


@query(_REPLAY + _FINAL_PAGES)
def replay_long_edits(spark, d):
    """The same logs in segments of 32 edits, as logs that are too long for one array are replayed."""
    return replay.final_pages(segments.replay_long_edits(frame(spark, d, "fx_edit_docs"), frame(spark, d, "fx_edits"), segment=32))


@query(_REPLAY.replace("ORDER BY ts, seq) AS k FROM {fx_edits}", "ORDER BY ts, seq, step) AS k FROM {fx_hovers}") + _FINAL_PAGES)
def replay_drags(spark, d):
    """Gestures as one edit each, in one log with the other edits, against the replay of every hover."""
    others = frame(spark, d, "fx_edits").where("op not in ('move', 'delete')")
    log = others.unionByName(replay.collapse_drags(frame(spark, d, "fx_drags")), allowMissingColumns=True)
    return replay.final_pages(replay.replay_edits(frame(spark, d, "fx_edit_docs"), log))


@query(_REPLAY + "SELECT doc_id, ord <> CAST(range(0, n) AS INT[]) AS order_differs FROM final WHERE dirty")
def changed_docs(spark, d):
    return replay.changed_docs(_replayed(spark, d))


@query(_REPLAY + "SELECT doc_id, CAST(i AS INT) AS pos, ord[i + 1] AS page_index, concat('doc_', doc_id, '_edited.pdf') AS output_name FROM placed WHERE dirty")
def save_edits(spark, d):
    docs = frame(spark, d, "fx_edit_docs")
    return replay.save_edits(pages.page_manifest(docs), _replayed(spark, d), docs).accepted.select("doc_id", "pos", "page_index", "output_name")


# --- sets of documents


@query("""SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY set_pos, page_index) - 1 AS INT) AS pos, doc_id, page_index, width_pt, height_pt
FROM (SELECT s.set_id, s.set_pos, l.*, n FROM (SELECT *, count(*) OVER (PARTITION BY set_id) AS n FROM {fx_set}) s JOIN {fx_lines} l ON l.doc_id = s.doc_id) WHERE n >= 2""")
def merge_pages(spark, d):
    return docsets.merge_pages(frame(spark, d, "fx_set"), frame(spark, d, "fx_lines")).accepted


@query("""SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY file_no, j) - 1 AS INT) AS pos, doc_id, page_index, payload
FROM (SELECT d.batch_id AS set_id, d.file_no, o.j, p.doc_id, p.page_index, p.payload, sum(1) OVER (PARTITION BY d.batch_id) AS some FROM {fx_docs} d JOIN {fx_reorder} o ON o.doc_id = d.doc_id JOIN {fx_pages} p ON p.doc_id = o.doc_id AND p.page_index = o.src)
WHERE set_id IN (SELECT batch_id FROM {fx_docs} GROUP BY 1 HAVING count(*) > 1)""")
def merge_edited(spark, d):
    """Documents that were reordered, shortened and lengthened first: page counts and page indexes no longer tell the places."""
    edited = pages.renumber(pages.reorder_pages(frame(spark, d, "fx_pages").drop("page_count"), frame(spark, d, "fx_reorder")).accepted)
    return docsets.merge_pages(frame(spark, d, "fx_docs").selectExpr("batch_id AS set_id", "file_no AS set_pos", "doc_id", "page_count"), edited).accepted


@query("SELECT set_id, count(*) AS n_docs, 'fewer_than_two' AS reject_reason FROM {fx_set} GROUP BY set_id HAVING count(*) < 2")
def merge_pages_rejects(spark, d):
    return docsets.merge_pages(frame(spark, d, "fx_set"), frame(spark, d, "fx_lines")).rejected


@query("SELECT set_id, count(*) AS n_docs, CAST(sum(page_count) AS BIGINT) AS n_pages FROM {fx_set} GROUP BY set_id")
def set_summary(spark, d):
    return docsets.set_summary(frame(spark, d, "fx_set"))


@query("""SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY new, a, b) - 1 AS INT) AS set_pos, doc_id, page_count FROM (
  SELECT set_id, 0 AS new, set_pos AS a, 0 AS b, doc_id, page_count FROM {fx_set} UNION ALL SELECT set_id, 1, batch_no, file_no, doc_id, page_count FROM {fx_append})""")
def append_docs(spark, d):
    return docsets.append_docs(frame(spark, d, "fx_set"), frame(spark, d, "fx_append"))


@query("SELECT set_id, count(*) AS n_docs, CAST(sum(page_count) AS BIGINT) AS n_pages FROM (SELECT set_id, page_count FROM {fx_set} UNION ALL SELECT set_id, page_count FROM {fx_append}) GROUP BY set_id")
def append_docs_summary(spark, d):
    """What append_docs gives is a document set again; numbered over ranges, as sets too large for one task are."""
    return docsets.set_summary(docsets.append_docs(frame(spark, d, "fx_set"), frame(spark, d, "fx_append"), blocks=16))


@query("""SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY set_pos) - 1 AS INT) AS set_pos, doc_id, page_count FROM {fx_loads} WHERE set_pos % 4 <> 0 AND set_id % 7 <> 0""")
def remove_docs(spark, d):
    """Of every other document one of its two loads goes."""
    s = frame(spark, d, "fx_loads")
    return docsets.remove_docs(s, s.where("set_pos % 4 = 0").select("set_id", "set_pos"), s.where("set_id % 7 = 0").select("set_id"))


@query("""SELECT doc_id, sha256(concat_ws('|', coalesce(length(CAST(batch_id AS VARCHAR)) || ':' || batch_id, '-'), coalesce(length(CAST(file_no AS VARCHAR)) || ':' || file_no, '-'), coalesce(length(name) || ':' || name, '-'))) AS surrogate_id
FROM {fx_docs}""")
def surrogate_id(spark, d):
    return frame(spark, d, "fx_docs").select("doc_id", docsets.surrogate_id(F.col("batch_id"), F.col("file_no"), F.col("name")).alias("surrogate_id"))


@query("SELECT batch_id AS set_id, file_no + 1 AS list_no, d.doc_id, name, d.page_count, page_index, payload FROM {fx_docs} d JOIN {fx_pages} p ON p.doc_id = d.doc_id AND page_index = 0")
def cover_pages(spark, d):
    docs = frame(spark, d, "fx_docs")
    members = docs.select(F.col("batch_id").alias("set_id"), F.col("file_no").alias("set_pos"), "doc_id")
    return docsets.cover_pages(pages.paginate(frame(spark, d, "documents"), PAGE_CHARS), members, docs)


_SET_REPLAY = """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY ts, seq) AS k FROM {fx_set_edits}),
states AS (
  SELECT DISTINCT set_id, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS m FROM {fx_set_edits}
  UNION ALL
  SELECT s.set_id, e.k,
    CASE op WHEN 'append' THEN list_append(m, doc_id) WHEN 'clear' THEN CAST([] AS BIGINT[]) WHEN 'remove' THEN list_filter(m, lambda x, i: i <> a + 1)
      WHEN 'move' THEN CASE WHEN a <> b AND a < len(m) AND b < len(m) THEN list_concat(list_concat(list_slice(list_filter(m, lambda x, i: i <> a + 1), 1, b), [m[a + 1]]), list_slice(list_filter(m, lambda x, i: i <> a + 1), b + 1, len(m))) ELSE m END
      WHEN 'move_up' THEN CASE WHEN a > 0 AND a < len(m) THEN list_concat(list_concat(list_slice(m, 1, a - 1), [m[a + 1], m[a]]), list_slice(m, a + 2, len(m))) ELSE m END
      ELSE CASE WHEN a < len(m) - 1 THEN list_concat(list_concat(list_slice(m, 1, a), [m[a + 2], m[a + 1]]), list_slice(m, a + 3, len(m))) ELSE m END END
  FROM states s JOIN numbered e ON e.set_id = s.set_id AND e.k = s.k + 1),
final AS (SELECT set_id, arg_max(m, k) AS m FROM states GROUP BY 1)
SELECT set_id, CAST(i AS INT) AS set_pos, m[i + 1] AS doc_id FROM (SELECT *, unnest(range(0, len(m))) AS i FROM final)"""


@query(_SET_REPLAY)
def replay_set_edits(spark, d):
    return replay.replay_set_edits(frame(spark, d, "fx_set_edits"))


@query(_SET_REPLAY)
def replay_long_set_edits(spark, d):
    """The same logs in segments of eight edits, as logs that are too long for one array are replayed."""
    return segments.replay_long_set_edits(frame(spark, d, "fx_set_edits"), segment=8)


# --- images


def _image_contents(spark: SparkSession, d: str) -> DataFrame:
    """set_id, image_id, content: headers that the sizes of fx_images are written into, in the four formats."""

    def number(c: str, size: int, little: bool = False, less: int = 0) -> Column:
        digits = F.lpad(F.hex(F.greatest(F.col(c), F.lit(0)) - less), 2 * size, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]) if little else digits)

    fixed = lambda digits: F.unhex(F.lit(digits))
    png = F.concat(fixed("89504E470D0A1A0A0000000D49484452"), number("width", 4), number("height", 4), fixed("0802000000"))
    gif = F.concat(fixed("474946383961"), number("width", 2, True), number("height", 2, True), fixed("000000"))
    jpeg = F.concat(fixed("FFD8FFE000104A46494600010100000100010000FFFFDB000400AAFFC0001108"), number("height", 2), number("width", 2), fixed("03011100"))
    webp = F.concat(fixed("52494646000000005745425056503858" + "0A000000" + "00000000"), number("width", 3, True, 1), number("height", 3, True, 1))
    kind = F.col("image_id") % 4
    header = F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, jpeg).otherwise(webp)
    return frame(spark, d, "fx_images").select("set_id", "image_id", header.alias("content"))


_IMAGE_SIZES = """SELECT set_id, image_id, CASE image_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'jpeg' ELSE 'webp' END AS format, CASE WHEN width > 0 AND height > 0 THEN width END AS width,
  CASE WHEN width > 0 AND height > 0 THEN height END AS height, CASE WHEN width > 0 AND height > 0 THEN NULL ELSE 'undecodable' END AS reject_reason FROM {fx_images}"""


@query(_IMAGE_SIZES)
def image_manifest(spark, d):
    return images.image_manifest(_image_contents(spark, d))


@query(_IMAGE_SIZES)
def image_headers(spark, d):
    """The same images as files of their own, of which only the headers are read; about a thousand files a folder, which tasks write, list and read."""
    path, rows = scratch(spark), _image_contents(spark, d)
    n = rows.count()
    folder = F.pmod(F.xxhash64("image_id"), F.lit(n // 1000 + 1)).cast("string")
    named = rows.select(F.concat(F.lit(f"{path}/"), folder, F.lit("/"), F.col("image_id").cast("string"), F.lit(".img")).alias("path"), "content", folder.alias("folder"))
    assert ranges.write_files(named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder")) == n
    ids = F.regexp_extract("path", r"(-?\d+)\.img$", 1).cast("bigint")
    found = ranges.image_headers(sources.list_files(spark, path, "*.img").select("path")).select(ids.alias("image_id"), "format", "width", "height", "reject_reason")
    return rows.select("set_id", "image_id").join(found, "image_id").select("set_id", "image_id", "format", "width", "height", "reject_reason")


_WIDE = 450


@query(f"SELECT DISTINCT set_id, 'no_images' AS reject_reason FROM {{fx_images}} WHERE set_id NOT IN (SELECT set_id FROM {{fx_images}} WHERE width > {_WIDE})")
def image_sets_rejects(spark, d):
    rows = frame(spark, d, "fx_images")
    return images.image_sets(rows.select("set_id"), rows.where(F.col("width") > _WIDE), ("image_id",)).rejected


@query("SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY image_id) - 1 AS INT) AS pos, image_id, width, height, CASE WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation FROM {fx_images}")
def images_to_pages(spark, d):
    return images.images_to_pages(frame(spark, d, "fx_images"), ("image_id",))


@query("SELECT doc_id, concat('data:text/plain;base64,', base64(encode(text))) AS url FROM {documents}")
def data_url(spark, d):
    docs = frame(spark, d, "documents")
    return docs.select("doc_id", encoding.data_url(F.lit("text/plain"), F.col("text").cast("binary")).alias("url"))


@query("SELECT doc_id, 'text/plain' AS mime, text FROM {documents}")
def parse_data_url(spark, d):
    url = encoding.data_url(F.lit("text/plain"), F.col("text").cast("binary"))
    docs = frame(spark, d, "documents").select("doc_id", url.alias("url"))
    return docs.select("doc_id", encoding.data_url_mime(F.col("url")).alias("mime"), encoding.data_url_content(F.col("url")).cast("string").alias("text"))


# --- geometry


@query("""SELECT doc_id, page_index + 1 AS page_number, CAST(2.0 AS DOUBLE) AS scale, width_pt * 2.0::DOUBLE AS width_px, height_pt * 2.0::DOUBLE AS height_px,
  CAST(floor(width_pt * 2.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS width_round, CAST(floor(height_pt * 2.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS height_round FROM {fx_lines}""")
def rendition_plan(spark, d):
    return plans.rendition_plan(frame(spark, d, "fx_lines"))


_VIEW = "CAST(400 + doc_id % 900 AS DOUBLE)"
_ACROSS = f"({_VIEW} - 32.0::DOUBLE) / nullif(width_pt, 0)"


@query(f"""SELECT doc_id, page_index, greatest(0.25::DOUBLE, least(5.0::DOUBLE, {_ACROSS})) AS fit_width,
  greatest(0.25::DOUBLE, least(5.0::DOUBLE, least({_ACROSS}, 500.0::DOUBLE / nullif(height_pt, 0)))) AS fit_page FROM {{fx_lines}}""")
def fit_scale(spark, d):
    view = F.expr(_VIEW)
    size = (F.col("width_pt"), F.col("height_pt"))
    return frame(spark, d, "fx_lines").select("doc_id", "page_index", geometry.fit_scale("width", view, *size).alias("fit_width"), geometry.fit_scale("page", view, *size).alias("fit_page"))


@query("""SELECT doc_id, page_index + 1 AS page_number, scale, concat(CAST(floor(scale * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT), '%') AS label, width_pt * scale AS width_px, height_pt * scale AS height_px
FROM (SELECT *, unnest(CAST([0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0] AS DOUBLE[])) AS scale FROM {fx_lines})""")
def scale_ladder(spark, d):
    return plans.scale_ladder(frame(spark, d, "fx_lines"))


@query("""SELECT event_id, x, y, scale, floor(x / scale * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS page_x, floor(y / scale * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS page_y,
  CAST(floor(x + 0.5::DOUBLE) AS BIGINT) AS shown_x, CAST(floor(y + 0.5::DOUBLE) AS BIGINT) AS shown_y FROM {fx_pointer}""")
def to_page_coords(spark, d):
    return plans.to_page_coords(frame(spark, d, "fx_pointer"))


@query("SELECT event_id, CAST(floor(v) + CASE WHEN v - floor(v) >= 0.5::DOUBLE THEN 1 ELSE 0 END AS BIGINT) AS rounded FROM (SELECT event_id, value - 50.0::DOUBLE AS v FROM {events})")
def js_round(spark, d):
    return frame(spark, d, "events").select("event_id", geometry.js_round(F.col("value") - F.lit(50.0)).alias("rounded"))


# --- names


@query(r"SELECT doc_id, regexp_replace(name, '\.pdf', '') AS base_name FROM {fx_docs}")
def base_name(spark, d):
    return frame(spark, d, "fx_docs").select("doc_id", naming.base_name(F.col("name")).alias("base_name"))


@query(r"SELECT doc_id, concat(regexp_replace(name, '\.pdf', ''), '_page_', page_count, '.png') AS page_name FROM {fx_docs}")
def page_name(spark, d):
    return frame(spark, d, "fx_docs").select("doc_id", naming.page_name(F.col("name"), F.col("page_count")).alias("page_name"))


@query(r"""SELECT doc_id, concat(regexp_replace(name, '\.pdf', ''), '_pages_1-', page_count, '.pdf') AS extracted, concat(regexp_replace(name, '\.pdf', ''), '_edited.pdf') AS edited,
  concat('merged/', batch_id) AS merged, concat('images_to_pdf/', batch_id) AS from_images FROM {fx_docs}""")
def job_name(spark, d):
    name = F.col("name")
    return frame(spark, d, "fx_docs").select(
        "doc_id",
        naming.extract_name(name, F.lit(1), F.col("page_count")).alias("extracted"),
        naming.edited_name(name).alias("edited"),
        naming.merged_name(F.col("batch_id")).alias("merged"),
        naming.images_name(F.col("batch_id")).alias("from_images"),
    )


@query(r"SELECT doc_id, TRY_CAST(regexp_extract(start_txt, '^\s*([+-]?\d+)', 1) AS INT) AS start_no, TRY_CAST(regexp_extract(end_txt, '^\s*([+-]?\d+)', 1) AS INT) AS end_no FROM {fx_ranges}")
def parse_int(spark, d):
    return frame(spark, d, "fx_ranges").select("doc_id", naming.parse_int(F.col("start_txt")).alias("start_no"), naming.parse_int(F.col("end_txt")).alias("end_no"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN CAST(concat(CASE doc_id % 4 WHEN 0 THEN '-' ELSE '' END, CAST('0x1' || doc_id % 10 AS INT)) AS INT)
  WHEN doc_id % 6 IN (1, 3) THEN NULL ELSE TRY_CAST(regexp_extract(regexp_replace(typed, '^[\s\x{A0}]+', ''), '^[+-]?\d+') AS INT) END AS number FROM {fx_typed}""")
def parse_typed(spark, d):
    """Texts with hexadecimal numbers, signs and no-break spaces."""
    return frame(spark, d, "fx_typed").select("doc_id", naming.parse_int(F.col("typed")).alias("number"))


@query("""SELECT s.event_id, s.view_id, s.x, s.y, coalesce(z.scale, 1.0::DOUBLE) AS scale, floor(s.x / coalesce(z.scale, 1.0::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS page_x,
  floor(s.y / coalesce(z.scale, 1.0::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS page_y FROM {fx_moves_of_pointer} s ASOF LEFT JOIN {fx_zooms} z ON s.view_id = z.view_id AND s.ts >= z.ts""")
def scale_in_force(spark, d):
    """Pointer samples at the scale that the last zoom of their view has set."""
    found = plans.with_scale(frame(spark, d, "fx_moves_of_pointer"), frame(spark, d, "fx_zooms"), blocks=16)
    return plans.to_page_coords(found).select("event_id", "view_id", "x", "y", "scale", "page_x", "page_y")


# --- progress and streams


@query("""SELECT conv_id AS doc_id, turn AS done_no, k * 100.0::DOUBLE / n AS percent, concat(CAST(floor(k * 100.0::DOUBLE / n + 0.5::DOUBLE) AS BIGINT), '%') AS label
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM {conversations})""")
def progress_of_pages(spark, d):
    done = frame(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("done_no"))
    return progress.progress(done, frame(spark, d, "fx_talk_docs"))


_AGAIN = "SELECT conv_id AS doc_id, turn AS done_no, turn AS page_index FROM {conversations} UNION ALL SELECT conv_id, turn + 3 AS done_no, turn AS page_index FROM {conversations} WHERE turn % 2 = 0"


@query(f"""SELECT doc_id, done_no, new * 100.0::DOUBLE / n AS percent, concat(CAST(floor(new * 100.0::DOUBLE / n + 0.5::DOUBLE) AS BIGINT), '%') AS label
FROM (SELECT doc_id, done_no, sum(first) OVER (PARTITION BY doc_id ORDER BY done_no, first DESC, page_index ROWS UNBOUNDED PRECEDING) AS new, n
  FROM (SELECT d.*, page_count AS n, CASE WHEN row_number() OVER (PARTITION BY d.doc_id, page_index ORDER BY done_no) = 1 THEN 1 ELSE 0 END AS first FROM ({_AGAIN}) d JOIN {{fx_talk_docs}} t ON t.doc_id = d.doc_id))""")
def progress_again(spark, d):
    """Pages that are delivered twice count once; over ranges, as documents too large for one task are numbered."""
    talks = frame(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("done_no"), F.col("turn").alias("page_index"))
    again = talks.where("page_index % 2 = 0").withColumn("done_no", F.col("done_no") + 3)
    return progress.progress(talks.unionByName(again), frame(spark, d, "fx_talk_docs"), blocks=16)


@query("SELECT conv_id AS doc_id, count_if(turn % 3 <> 1) AS n_done, count_if(turn % 3 <> 1) * 100.0::DOUBLE / count(*) AS percent FROM {conversations} GROUP BY 1")
def progress_bitmaps(spark, d):
    """Two overlapping parts of a log of done pages, merged."""
    done = frame(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"))
    parts = [progress.done_bitmaps(done.where(p)) for p in ("page_index % 3 = 0", "page_index % 3 = 2 OR page_index % 2 = 0 AND page_index % 3 <> 1")]
    return progress.progress_of(progress.merge_bitmaps(*parts), frame(spark, d, "fx_talk_docs"))


QUERIES["progress"], ORACLES["progress"] = QUERIES.pop("progress_of_pages"), ORACLES.pop("progress_of_pages")


def _latest(spark: SparkSession, stream: DataFrame, key: str) -> DataFrame:
    """Runs a stream in update mode over all that is there, and gives the last row of each key."""
    path = scratch(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("append").parquet(f"{path}/out")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/log").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    row = F.struct(*[c for c in rows.columns if c not in (key, "batch_no")])
    return rows.groupBy(key).agg(F.max_by(row, "batch_no").alias("row")).select(key, "row.*")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of files; it may be one file or a folder of them."""
    table = frame(spark, d, name)
    one_file = len(table.inputFiles()) == 1 and table.inputFiles()[0].endswith(f"/{name}.parquet")
    reader = spark.readStream.schema(table.schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if one_file else reader.parquet(f"{d}/{name}.parquet")


_BATCHES = 4


@query(_REPLAY + _FINAL_PAGES)
def stream_replay(spark, d):
    with_rocksdb = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(with_rocksdb)
    spark.conf.set(with_rocksdb, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # in batches that are dealt by hash, so each one but the first brings edits that are late
        events, path = frame(spark, d, "events"), f"{scratch(spark)}/events"
        events.repartition(_BATCHES, "event_id").write.parquet(path)
        edits = spark.sql(VIEWS["fx_edits"][0], events=spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(path))
        final = _latest(spark, stream_replay_ops.stream_replay(edits), "doc_id")
    finally:
        spark.conf.set(with_rocksdb, was)
    return replay.final_pages(final)


@query(f"""WITH e AS (SELECT *, seq % {_BATCHES} AS batch FROM {{fx_edits}})
SELECT doc_id, seq, op, a, b FROM e WHERE EXISTS (SELECT 1 FROM e x WHERE x.doc_id = e.doc_id AND x.batch < e.batch AND (x.ts > e.ts OR (x.ts = e.ts AND x.seq >= e.seq)))""")
def stream_late(spark, d):
    """The edits that come in a later batch than edits behind them, of a stream that runs once for each batch."""
    with_rocksdb = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(with_rocksdb)
    spark.conf.set(with_rocksdb, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events, path = frame(spark, d, "events"), scratch(spark)
    try:
        for batch in range(_BATCHES):
            events.where(F.col("event_id") % _BATCHES == batch).write.mode("append").parquet(f"{path}/events")
            edits = spark.sql(VIEWS["fx_edits"][0], events=spark.readStream.schema(events.schema).parquet(f"{path}/events"))
            late = stream_replay_ops.late_edits(stream_replay_ops.stream_replay(edits))
            keep = lambda rows, _: rows.write.mode("append").parquet(f"{path}/late")
            late.writeStream.outputMode("update").option("checkpointLocation", f"{path}/log").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(with_rocksdb, was)
    return spark.read.schema(late.schema).parquet(f"{path}/late").drop("ts")


def _arrivals(spark: SparkSession, rows: DataFrame, batch: str, run: Callable[[DataFrame], DataFrame], columns: list[str], mode: str = "update") -> DataFrame:
    """What a stream gives that takes rows in one batch for each value of `batch`, in order, with batch_no."""
    path, out = scratch(spark), None
    with_rocksdb = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(with_rocksdb)
    spark.conf.set(with_rocksdb, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keep = lambda made, number: made.withColumn("batch_no", F.lit(number)).write.mode("append").parquet(f"{path}/out")
    try:
        rows.repartition(batch, F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.partitionBy(batch).parquet(f"{path}/rows")
        whole = spark.read.parquet(f"{path}/rows")
        for number in sorted(r[0] for r in whole.select(batch).distinct().collect()):  # a handful of batches
            whole.where(F.col(batch) == number).write.mode("append").parquet(f"{path}/in")
            out = run(spark.readStream.schema(whole.schema).parquet(f"{path}/in"))
            out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(with_rocksdb, was)
    return spark.read.schema(T.StructType([*out.schema, T.StructField("batch_no", T.IntegerType())])).parquet(f"{path}/out").select(*columns)


_DELAY_DAYS = 3650  # over all of the events


def _edits_that_arrive(spark: SparkSession, d: str) -> DataFrame:
    """fx_arrivals; its ntile is found over ranges, as a window over all rows would bind them to one task."""
    placed = range_sums(frame(spark, d, "fx_edits").withColumn("all", F.lit(0)), "all", ["ts", "seq"], {"k": F.lit(1)})
    tiles = placed.withColumns({"q": F.expr("k_all div 4"), "r": F.expr("k_all % 4")})
    slot = "CASE WHEN k < r * (q + 1) THEN k div (q + 1) ELSE r + (k - r * (q + 1)) div greatest(q, 1) END"
    return tiles.withColumn("slot", F.expr(slot)).selectExpr("doc_id", "n", "ts", "seq", "op", "a", "b", "CAST(CASE WHEN seq % 100 = 0 THEN 3 WHEN seq % 7 = 0 THEN least(slot + 1, 3) ELSE slot END AS INT) AS batch")


@query(_REPLAY + _FINAL_PAGES)
def stream_snapshots(spark, d):
    """Edits that arrive about in order, some a batch later and some far behind, within the delay: none is too late."""
    found = _arrivals(spark, _edits_that_arrive(spark, d), "batch", lambda s: stream_snapshot_ops.stream_snapshots(s, f"{_DELAY_DAYS} days"), ["doc_id", "ord", "sel", "batch_no"])
    return replay.final_pages(found.groupBy("doc_id").agg(F.max_by("ord", "batch_no").alias("ord"), F.max_by("sel", "batch_no").alias("sel")))


@query("""WITH seen AS (SELECT batch, max(max(epoch_us(ts))) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - 86400000000 AS watermark FROM {fx_arrivals} GROUP BY batch)
SELECT doc_id, seq, op, a, b FROM {fx_arrivals} e JOIN seen ON seen.batch = e.batch WHERE epoch_us(ts) < watermark""")
def stream_snapshots_late(spark, d):
    """With a delay of one day: the edits that come after the watermark has passed them."""
    late = lambda s: stream_replay_ops.late_edits(stream_snapshot_ops.stream_snapshots(s, "1 day"))
    return _arrivals(spark, _edits_that_arrive(spark, d), "batch", late, ["doc_id", "seq", "op", "a", "b"])


@query("""SELECT batch_id, file_no, name, CASE WHEN batch_id % 10 = 3 THEN 'batch_incomplete' WHEN bool_or(load_failed) OVER (PARTITION BY batch_id) THEN 'batch_load_failed' END AS reject_reason
FROM {fx_bad_loads}""")
def stream_atomic_batches(spark, d):
    """Files in shuffled order over five batches of arrival; every tenth intake batch declares a file that never comes."""
    rows = frame(spark, d, "fx_bad_loads").withColumn("arrival", F.pmod(F.xxhash64("batch_id", "file_no"), F.lit(4)).cast("int"))
    # an hour for each arrival, and one file long after, which moves the watermark over all that is open
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("arrival") * 3600)).select("batch_id", "n_files", "file_no", "name", "load_failed", "ts", "arrival")
    last = rows.limit(1).select(F.lit(-1).cast("bigint").alias("batch_id"), F.lit(1).cast("bigint").alias("n_files"), F.lit(0).alias("file_no"), F.lit("-").alias("name"), F.lit(False).alias("load_failed"), F.timestamp_seconds(F.lit(10**7)).alias("ts"), F.lit(4).alias("arrival"))
    found = _arrivals(spark, rows.unionByName(last), "arrival", lambda s: stream_intake_ops.stream_atomic_batches(s, "1 day", "10 minutes"), ["batch_id", "file_no", "name", "reject_reason"], "append")
    return found.where("batch_id >= 0").withColumn("file_no", F.col("file_no").cast("int"))


@query(_REPLAY + "SELECT concat('doc_', doc_id, '_edited.pdf') AS output_name, CAST(i AS INT) AS pos, ord[i + 1] AS page_index FROM placed WHERE dirty")
def save_stream(spark, d):
    """Saves the changed documents of a stream of edits, a version for each batch, and reads the last version of each back."""
    docs, path = frame(spark, d, "fx_edit_docs"), scratch(spark)
    manifest = pages.page_manifest(docs).withColumn("payload", F.col("page_index").cast("string"))
    with_rocksdb = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(with_rocksdb)
    spark.conf.set(with_rocksdb, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        arrivals = frame(spark, d, "fx_arrivals").drop("batch")
        arrivals.write.parquet(f"{path}/in")
        states = stream_snapshot_ops.stream_snapshots(spark.readStream.schema(arrivals.schema).parquet(f"{path}/in"), f"{_DELAY_DAYS} days")
        packed.save_stream(states, manifest, docs, f"{path}/saved", f"{path}/log").awaitTermination()
    finally:
        spark.conf.set(with_rocksdb, was)
    return packed.read_packed(spark, f"{path}/saved").select("output_name", "pos", "page_index")


@query("SELECT conv_id AS doc_id, count(*) AS n_done, 100.0::DOUBLE AS percent FROM {conversations} GROUP BY 1")
def stream_progress_again(spark, d):
    """Pages in three batches, each third of them delivered in two."""
    talks = frame(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), (F.col("turn") % 3).cast("int").alias("arrival"))
    again = talks.where("arrival < 2").withColumn("arrival", F.col("arrival") + 1)
    found = _arrivals(spark, talks.unionByName(again), "arrival", lambda s: stream_progress_ops.stream_progress(s, frame(spark, d, "fx_talk_docs")), ["doc_id", "n_done", "percent", "batch_no"])
    return found.groupBy("doc_id").agg(F.max_by("n_done", "batch_no").alias("n_done"), F.max_by("percent", "batch_no").alias("percent"))


@query("SELECT conv_id AS doc_id, count(*) AS n_done, 100.0::DOUBLE AS percent FROM {conversations} GROUP BY 1")
def stream_progress(spark, d):
    done = _stream(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    return _latest(spark, stream_progress_ops.stream_progress(done, frame(spark, d, "fx_talk_docs")), "doc_id")


_LINES = """SELECT concat('doc/', doc_id) AS path, CAST(i AS INT) AS page_index, CAST(NULL AS VARCHAR) AS reject_reason, CAST(strlen(lines[i + 1]) AS BIGINT) AS n_bytes
FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {documents}))"""


def _lines(path: str, content: bytes):
    for line in content.decode().split("\n"):
        yield {"n_bytes": len(line.encode())}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))


@query(_LINES)
def expand_with(spark, d):
    """Documents as files of line-separated pages, taken apart by a caller's function."""
    return sources.expand_with(_texts(spark, d), _lines, "n_bytes bigint")


@query(_LINES)
def expand_in_sql(spark, d):
    """The same function as a table function, in SQL."""
    sources.register_expand(spark, "pages_of", _lines, "n_bytes bigint")
    return spark.sql("SELECT f.path, p.* FROM {files} f, LATERAL pages_of(f.path, f.content) p", files=_texts(spark, d))
