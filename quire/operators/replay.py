"""Replay of edit logs into final orders, as SQL folds.

edits: doc_id, ts, seq, op, a, b; positions count from 0. A log is ordered by ts, then seq, and has to fit one array a document;
what is before its last reset is left out first, and drags collapse (collapse_drags).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import edited_name
from . import Result
from .pages import reorder_pages

#: The state of a document is its order (page indexes), the selected positions, and whether it was changed. A move leaves the
#: selection where it is: it holds positions. Edits that reach outside, and unknown ones, do nothing.
_STATE = "struct<ord:array<int>,sel:array<int>,dirty:boolean>"
_NEXT_ORDER = """CASE
  WHEN e.op = 'move' AND e.a <> e.b AND e.a >= 0 AND e.b >= 0 AND e.a < size(s.ord) AND e.b < size(s.ord)
    THEN array_insert(filter(s.ord, (x, i) -> i <> e.a), e.b + 1, get(s.ord, e.a))
  WHEN e.op = 'delete' AND size(s.sel) > 0 AND size(s.sel) < size(s.ord) THEN filter(s.ord, (x, i) -> NOT array_contains(s.sel, i))
  WHEN e.op = 'reset' THEN initial
  ELSE s.ord END"""
_NEXT_SELECTION = """CASE
  WHEN e.op = 'toggle' AND e.a >= 0 AND e.a < size(s.ord) THEN if(array_contains(s.sel, e.a), array_remove(s.sel, e.a), array_append(s.sel, e.a))
  WHEN e.op = 'select_all' THEN if(size(s.sel) = size(s.ord) OR size(s.ord) = 0, cast(array() AS array<int>), sequence(0, size(s.ord) - 1))
  WHEN e.op = 'reset' OR (e.op = 'delete' AND size(s.sel) > 0 AND size(s.sel) < size(s.ord)) THEN cast(array() AS array<int>)
  ELSE s.sel END"""
_NEXT_DIRTY = """CASE
  WHEN e.op = 'reset' THEN false
  WHEN e.op = 'touch' OR (e.op = 'delete' AND size(s.sel) > 0 AND size(s.sel) < size(s.ord)) THEN true
  WHEN e.op = 'move' AND e.a <> e.b AND e.a >= 0 AND e.b >= 0 AND e.a < size(s.ord) AND e.b < size(s.ord) THEN true
  ELSE s.dirty END"""
_FOLD = f"""aggregate(log, named_struct('ord', initial, 'sel', cast(array() AS array<int>), 'dirty', false),
  (s, e) -> cast(named_struct('ord', {_NEXT_ORDER}, 'sel', {_NEXT_SELECTION}, 'dirty', {_NEXT_DIRTY}) AS {_STATE}))"""


def collapse_drags(steps: DataFrame) -> DataFrame:
    """One edit for each gesture of hover steps (gesture_id, doc_id, step, from_pos, to_pos): its net move.

    doc_id, gesture_id, op (move, or touch where the gesture ends where it began: the document counts as changed), a, b. Where steps have
    ts and seq, so has the edit, those of its first step: replay_edits takes the edits of gestures, with the others of the log, as they are.
    """
    when = [c for c in ("ts", "seq") if c in steps.columns]
    ends = steps.groupBy("doc_id", "gesture_id").agg(F.min_by("from_pos", "step").alias("a"), F.max_by("to_pos", "step").alias("b"), F.max(F.col("from_pos") != F.col("to_pos")).alias("_any"), *[F.min_by(c, "step").alias(c) for c in when])
    op = F.when(F.col("a") != F.col("b"), "move").when(F.col("_any"), "touch")
    return ends.withColumn("op", op).where("op is not null").select("doc_id", "gesture_id", *when, "op", "a", "b")


def _since_last(edits: DataFrame, op: str, key: str) -> DataFrame:
    """The edits from the last `op` on, which leaves nothing of what was before; all where there is none."""
    at = F.struct("ts", "seq")
    last = F.max(F.when(F.col("op") == op, at)).over(Window.partitionBy(key))
    return edits.withColumn("_last", last).where(F.col("_last").isNull() | (at >= F.col("_last"))).drop("_last")


def replay_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """The state of each document of docs (doc_id, page_count) after its edits: doc_id, ord, sel, dirty, order_differs.

    ord holds the page index at each position, sel the selected positions in the order of selection. A document without edits is
    unchanged; edits of unknown documents are ignored. One shuffle by document; the fold stays in the JVM.
    """
    entry = F.struct("ts", "seq", "op", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    logs = _since_last(edits, "reset", "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("log"))
    joined = docs.select("doc_id", F.col("page_count").cast("int").alias("page_count")).join(logs, "doc_id", "left")
    ready = joined.selectExpr(
        "doc_id",
        "if(page_count > 0, sequence(0, greatest(page_count, 1) - 1), cast(array() AS array<int>)) AS initial",
        "coalesce(log, cast(array() AS array<struct<ts:timestamp,seq:bigint,op:string,a:int,b:int>>)) AS log",
    )
    return ready.selectExpr("doc_id", "initial", f"{_FOLD} AS st").selectExpr("doc_id", "st.ord AS ord", "st.sel AS sel", "st.dirty AS dirty", "st.ord <> initial AS order_differs")


def final_pages(replayed: DataFrame) -> DataFrame:
    """One row per page of the final orders: doc_id, pos, page_index, selected."""
    rows = replayed.select("doc_id", "sel", F.posexplode("ord").alias("pos", "page_index"))
    return rows.select("doc_id", "pos", "page_index", F.array_contains("sel", F.col("pos")).alias("selected"))


def changed_docs(replayed: DataFrame) -> DataFrame:
    """Documents that count as changed: doc_id, order_differs. A move there and back leaves a changed document in its old order."""
    return replayed.where("dirty").select("doc_id", "order_differs")


def save_edits(pages: DataFrame, replayed: DataFrame, docs: DataFrame) -> Result:
    """The pages of changed documents in their final order, gathered from the source in one join, with output_name."""
    names = docs.select("doc_id", edited_name(F.col("name")).alias("output_name"))
    changed = replayed.where("dirty").select("doc_id", "ord").join(names, "doc_id", "left")
    return reorder_pages(pages, changed.select("doc_id", F.posexplode("ord").alias("j", "src"), "output_name"))


_SET_STEP = """CASE e.op
  WHEN 'append' THEN array_append(s, e.doc)
  WHEN 'clear' THEN filter(s, x -> false)
  WHEN 'remove' THEN filter(s, (x, i) -> NOT i <=> e.a)
  WHEN 'move' THEN if(e.a <> e.b AND e.a >= 0 AND e.b >= 0 AND e.a < size(s) AND e.b < size(s), array_insert(filter(s, (x, i) -> i <> e.a), e.b + 1, get(s, e.a)), s)
  WHEN 'move_up' THEN if(e.a > 0 AND e.a < size(s), array_insert(filter(s, (x, i) -> i <> e.a), e.a, get(s, e.a)), s)
  WHEN 'move_down' THEN if(e.a >= 0 AND e.a < size(s) - 1, array_insert(filter(s, (x, i) -> i <> e.a), e.a + 2, get(s, e.a)), s)
  ELSE s END"""


def replay_set_edits(edits: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The members of each set after its log (set_id, ts, seq, op, a, b, doc_id): set_id, set_pos, doc_id.

    append adds the edit's document doc_id, of any type, at the end (edits without such a column: the number seq); remove, move, move_up and
    move_down go by position, clear takes all. initial (set_id, set_pos, doc_id) is what the sets hold before; without it they start
    empty. Sets that end empty have no rows.
    """
    doc = F.col("doc_id") if "doc_id" in edits.columns else F.col("seq").cast("bigint")
    kind = edits.select(doc.alias("doc")).schema["doc"].dataType.simpleString()
    logs = _since_last(edits, "clear", "set_id")
    entry = F.struct("ts", "seq", "op", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), doc.alias("doc"))
    folded = logs.groupBy("set_id").agg(F.array_sort(F.collect_list(entry)).alias("log"))
    if initial is None:
        folded = folded.withColumn("start", F.expr(f"cast(array() AS array<{kind}>)"))
    else:
        members = F.transform(F.array_sort(F.collect_list(F.struct("set_pos", F.col("doc_id").cast(kind).alias("doc_id")))), lambda m: m["doc_id"])
        folded = initial.groupBy("set_id").agg(members.alias("start")).join(folded, "set_id", "full_outer")
        folded = folded.withColumns({"start": F.coalesce("start", F.array().cast(f"array<{kind}>")), "log": F.coalesce("log", F.array().cast(folded.schema["log"].dataType))})
    final = folded.selectExpr("set_id", f"aggregate(log, start, (s, e) -> {_SET_STEP}) AS members")
    return final.select("set_id", F.posexplode("members").alias("set_pos", "doc_id"))
