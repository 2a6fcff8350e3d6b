"""Page operators.

docs: doc_id, page_count (and name). pages: doc_id, pos (place in the current order, from 0), page_index (page of the source, from 0),
and a payload that is carried along. A position stands once in a document. Payloads move once at most: keys are worked on alone, and joined
with the payload last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import extract_name, page_name, parse_int
from . import Result
from .ordering import prefix_sums


def page_manifest(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per page in source order: doc_id, pos, page_index, and the columns keep. A document without pages has no rows."""
    some = docs.where(F.col("page_count") > 0)  # sequence(0, -1) would count down
    rows = some.select("doc_id", *keep, F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("pos"))
    return rows.select("doc_id", "pos", F.col("pos").alias("page_index"), *keep)


def paginate(docs: DataFrame, page_chars: int, text_col: str = "text") -> DataFrame:
    """Texts as pages of page_chars characters, the last one shorter: doc_id, pos, page_index, page_count, payload. No shuffle."""
    n = F.ceil(F.length(text_col) / F.lit(page_chars)).cast("int")
    counted = docs.select("doc_id", text_col, n.alias("page_count")).where("page_count > 0")
    rows = counted.select("doc_id", "page_count", text_col, F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("pos"))
    payload = F.substring(F.col(text_col), F.col("pos") * page_chars + 1, F.lit(page_chars))
    return rows.select("doc_id", "pos", F.col("pos").alias("page_index"), "page_count", payload.alias("payload"))


def renumber(pages: DataFrame, by: str = "doc_id", order: str = "pos") -> DataFrame:
    """Positions close up, from 0, in the order they have. A document of any size is cut into blocks (`prefix_sums`)."""
    return prefix_sums(pages, by, order, {"_place": F.lit(1)}).withColumn(order, F.col("_place").cast("int")).drop("_place", "_place_all", "_size")


def _with_payload(kept: DataFrame, pages: DataFrame) -> DataFrame:
    """kept (doc_id, _was: the old position, pos, page_index) with what else pages has, in one join."""
    if not set(pages.columns) - {"doc_id", "pos", "page_index"}:
        return kept.select(*pages.columns)
    return kept.join(pages.drop("page_index").withColumnRenamed("pos", "_was"), ["doc_id", "_was"]).select(*pages.columns)


def delete_pages(pages: DataFrame, deleted: DataFrame) -> DataFrame:
    """Without the source pages of deleted (doc_id, page_index); an index named twice goes once, an unknown one is nothing."""
    keys = pages.select("doc_id", F.col("pos").alias("_was"), "pos", "page_index")
    return _with_payload(renumber(keys.join(deleted, ["doc_id", "page_index"], "left_anti")), pages)


def delete_selected(pages: DataFrame, selection: DataFrame) -> Result:
    """Without the selected positions (doc_id, pos). Selecting nothing changes nothing; selecting all pages is refused.

    rejected: doc_id, reject_reason, of documents that pass through unchanged.
    """
    marks = selection.select("doc_id", "pos").distinct().withColumn("_hit", F.lit(1))
    whole = Window.partitionBy("doc_id")
    keys = pages.select("doc_id", F.col("pos").alias("_was"), "pos", "page_index")
    marked = keys.join(marks, ["doc_id", "pos"], "left").withColumn("_hits", F.count("_hit").over(whole)).withColumn("_all", F.count(F.lit(1)).over(whole) == F.col("_hits"))
    kept = renumber(marked.where(F.col("_all") | F.col("_hit").isNull()).drop("_hit", "_hits", "_all"))
    refused = marked.where("_all").select("doc_id").distinct().withColumn("reject_reason", F.lit("all_pages_selected"))
    return Result(_with_payload(kept, pages), refused)


def reorder_pages(pages: DataFrame, order: DataFrame) -> Result:
    """Place j of the output is the source page src (order: doc_id, j, src): unnamed pages go, repeated ones come twice.

    What else order has is carried along, behind the columns of pages. rejected: places whose page doesn't exist.
    """
    more = [c for c in order.columns if c not in ("doc_id", "j", "src", *pages.columns)]
    wanted = order.select("doc_id", F.col("j").alias("_j"), F.col("src").alias("page_index"), *more)
    source = pages.drop("pos").withColumn("_there", F.lit(True))
    found = wanted.join(source, ["doc_id", "page_index"], "left")
    accepted = found.where("_there").withColumn("pos", F.col("_j").cast("int")).select(*pages.columns, *more)
    missing = found.where("_there is null").select("doc_id", F.col("_j").alias("j"), F.col("page_index").alias("src"), F.lit("no_such_page").alias("reject_reason"))
    return Result(accepted, missing)


def _bad_range(first: Column, last: Column, n: Column) -> Column:
    """For a range from 0, both ends included."""
    bad = first.isNull() | last.isNull() | n.isNull() | (first < 0) | (last >= n) | (first > last)
    return F.coalesce(bad, F.lit(True))


def extract_pages(pages: DataFrame, ranges: DataFrame, docs: DataFrame) -> Result:
    """Pages first_page to last_page (from 0, both included) of each document in ranges (doc_id, first_page, last_page).

    docs (doc_id, page_count) tells which ranges are valid. accepted has the columns of pages and first_page, last_page; rejected has
    the range, counted from 1, as messages show it. ranges may name a document more than once. Documents outside the first and the last that a
    valid range names, and pages outside the lowest and the highest that any asks for, aren't read.
    """
    asked = ranges.join(docs.select("doc_id", "page_count"), "doc_id", "left").withColumn("_bad", _bad_range(F.col("first_page"), F.col("last_page"), F.col("page_count")))
    good = asked.where("not _bad").select("doc_id", "first_page", "last_page")
    low, high = good.agg(F.min("first_page")).scalar(), good.agg(F.max("last_page")).scalar()
    first, last = good.agg(F.min("doc_id")).scalar(), good.agg(F.max("doc_id")).scalar()
    near = (F.col("page_index") >= low) & (F.col("page_index") <= high) & (F.col("doc_id") >= first) & (F.col("doc_id") <= last)
    taken = pages.where(near).join(good, "doc_id").where(F.col("page_index").between(F.col("first_page"), F.col("last_page")))
    accepted = taken.withColumn("pos", (F.col("page_index") - F.col("first_page")).cast("int")).select(*pages.columns, "first_page", "last_page")
    rejected = asked.where("_bad").select("doc_id", (F.col("first_page") + 1).alias("first_number"), (F.col("last_page") + 1).alias("last_number"), "page_count", F.lit("bad_range").alias("reject_reason"))
    return Result(accepted, rejected)


def extract_fixed(docs: DataFrame, page_chars: int, first_page: int, last_page: int, text_col: str = "text") -> Result:
    """The same range of every text document, without a join: only the characters of the wanted pages are cut out.

    docs: doc_id, name, text. accepted: doc_id, pos, page_index, payload, output_name; rejected: doc_id, page_count, reject_reason.
    """
    counted = docs.withColumn("page_count", F.ceil(F.length(text_col) / F.lit(page_chars)).cast("int"))
    bad = _bad_range(F.lit(first_page), F.lit(last_page), F.col("page_count"))
    rows = counted.where(~bad).withColumn("page_index", F.explode(F.sequence(F.lit(first_page), F.lit(last_page))))
    accepted = rows.select(
        "doc_id",
        (F.col("page_index") - first_page).alias("pos"),
        "page_index",
        F.substring(F.col(text_col), F.col("page_index") * page_chars + 1, F.lit(page_chars)).alias("payload"),
        extract_name(F.col("name"), F.lit(first_page + 1), F.lit(last_page + 1)).alias("output_name"),
    )
    return Result(accepted, counted.where(bad).select("doc_id", "page_count", F.lit("bad_range").alias("reject_reason")))


def extract_from_request(requests: DataFrame, docs: DataFrame) -> Result:
    """Typed ranges (doc_id, start_txt, end_txt; from 1) against the unedited documents (doc_id, page_count, name).

    accepted: doc_id, pos, page_index, output_name; rejected: doc_id, start_txt, end_txt, reject_reason.
    """
    first, last = parse_int(F.col("start_txt")), parse_int(F.col("end_txt"))
    asked = requests.withColumn("_first", first).withColumn("_last", last).join(docs.select("doc_id", "page_count", "name"), "doc_id", "left")
    asked = asked.withColumn("_bad", _bad_range(F.col("_first") - 1, F.col("_last") - 1, F.col("page_count")))
    rows = asked.where("not _bad").withColumn("page_index", F.explode(F.sequence(F.col("_first") - 1, F.col("_last") - 1)))
    accepted = rows.select("doc_id", (F.col("page_index") - F.col("_first") + 1).alias("pos"), "page_index", extract_name(F.col("name"), F.col("_first"), F.col("_last")).alias("output_name"))
    return Result(accepted, asked.where("_bad").select("doc_id", "start_txt", "end_txt", F.lit("bad_range").alias("reject_reason")))


def moved(pos: Column, source: Column, target: Column) -> Column:
    """Where a position ends up when one element moves from source to target."""
    return (
        F.when(pos == source, target)
        .when((source < pos) & (pos <= target), pos - 1)
        .when((target <= pos) & (pos < source), pos + 1)
        .otherwise(pos)
    )


def _sized(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """asked with _n, the number of pages of its document."""
    return asked.join(pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")), "doc_id", "left")


def move_item(pages: DataFrame, moves: DataFrame) -> Result:
    """One move for each document in moves (doc_id, from_pos, to_pos); others keep their order.

    rejected: moves that leave the document, of unknown documents, and all moves of a document that has several different ones, whose
    order nothing tells. Closed form: one join with the pages, no list is built.
    """
    asked = moves.select("doc_id", "from_pos", "to_pos").distinct()
    asked = _sized(asked.withColumn("_moves", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))), pages)
    inside = F.coalesce(F.col("from_pos").between(0, F.col("_n") - 1) & F.col("to_pos").between(0, F.col("_n") - 1), F.lit(False))
    asked = asked.withColumn("reject_reason", F.when(F.col("_moves") > 1, "several_moves").when(F.col("_n").isNull(), "no_such_document").when(~inside, "no_such_position"))
    joined = pages.join(asked.where("reject_reason is null").select("doc_id", "from_pos", "to_pos"), "doc_id", "left")
    placed = F.when(F.col("from_pos").isNull(), F.col("pos")).otherwise(moved(F.col("pos"), F.col("from_pos"), F.col("to_pos")))
    accepted = joined.withColumn("pos", placed.cast("int")).select(*pages.columns)
    return Result(accepted, asked.where("reject_reason is not null").select("doc_id", "from_pos", "to_pos", "reject_reason"))


def move_step(pages: DataFrame, steps: DataFrame) -> DataFrame:
    """One step up (step -1) or down (step 1) for a position of each document in steps (doc_id, at_pos, step); at the ends nothing moves.

    Of several steps of a document, the one with the smallest at_pos, then step, counts.
    """
    first = steps.groupBy("doc_id").agg(F.min(F.struct("at_pos", "step")).alias("_s")).select("doc_id", "_s.at_pos", "_s.step")
    target = F.col("at_pos") + F.col("step")
    inside = F.col("at_pos").between(0, F.col("_n") - 1) & target.between(0, F.col("_n") - 1)
    joined = pages.join(_sized(first, pages).where(inside).select("doc_id", "at_pos", target.alias("_to")), "doc_id", "left")
    placed = F.when(F.col("at_pos").isNull(), F.col("pos")).otherwise(moved(F.col("pos"), F.col("at_pos"), F.col("_to")))
    return joined.withColumn("pos", placed.cast("int")).select(*pages.columns)


def selection_from_toggles(toggles: DataFrame) -> DataFrame:
    """The positions that are selected after all toggles (doc_id, pos): those toggled an odd number of times."""
    return toggles.groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select("doc_id", "pos")


def with_selection(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """pages with selected."""
    marks = selection.select("doc_id", "pos").distinct().withColumn("_hit", F.lit(True))
    return pages.join(marks, ["doc_id", "pos"], "left").withColumn("selected", F.col("_hit").isNotNull()).drop("_hit")


def page_outputs(pages: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """An output for each page: doc_id, page_number, output_name. Pages carry the name of their document, or docs (doc_id, name) has it."""
    number = (F.col("page_index") + 1).alias("page_number")
    named = pages.select("doc_id", number, "name") if docs is None else pages.select("doc_id", number).join(docs.select("doc_id", "name"), "doc_id")
    return named.withColumn("output_name", page_name(F.col("name"), F.col("page_number"))).drop("name")
