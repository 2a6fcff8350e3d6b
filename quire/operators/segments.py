"""Replay of logs that don't fit one array: segments of a log are folded apart, and put together.

What an edit does to the pages depends on the document's size and selection, but not on the order that the pages have. So the selection is
followed first, from summaries of the toggles; then each segment of the log becomes one list, which old position each new one comes from, and
such lists are composed, which is associative, by a tree over the segments.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .ordering import numbered, range_sums

_FAN = 16  # lists that are composed at once
_ORDER = ["ts", "seq", "op", "a", "b"]
_OUT = 1 << 18  # rows and list items in a batch of results
_NAN = object()

Fold = Callable[[tuple, Iterator[tuple]], Iterator[tuple]]


def _folded(rows: DataFrame, by: list[str], order: list[str], fold: Fold, made: str) -> DataFrame:
    """The rows (made, as DDL) that fold gives for each group: of its key, and of its rows in order, without the key.

    Groups lie next to each other in sorted partitions, and a task goes through its groups in one call. So a group of a few rows costs little more
    than its rows, and of a large one a batch is held at a time.
    """
    names, kind = [*by, *[c for c in rows.columns if c not in by]], T.StructType.fromDDL(made)
    schema, n, lists = to_arrow_schema(kind), len(by), [i for i, f in enumerate(kind) if isinstance(f.dataType, T.ArrayType)]
    fractions = any(isinstance(rows.schema[c].dataType, T.FractionalType) for c in by)
    key_of = (lambda r: tuple(_NAN if x != x else x for x in r[:n])) if fractions else itemgetter(slice(0, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        every = chain.from_iterable(zip(*[c.to_pylist() for c in b.columns], strict=True) for b in batches)
        found, size = [], 0
        for _, group in groupby(every, key_of):
            first = next(group)
            for row in fold(first[:n], (r[n:] for r in chain((first,), group))):
                found.append(row)
                size += 1 + sum(len(row[i]) for i in lists)
                if size >= _OUT:
                    yield batch_of(found)
                    found, size = [], 0
        if found:
            yield batch_of(found)

    return rows.select(*names).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, kind)


def _selections(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Follows the selection of one document: its effective deletes (k, gone), and last, with k null, what is selected in the end.

    rows: op size (a: the number of pages), toggle (a: the position, odd: how often modulo 2, k: the last time) of each stretch sub without another
    op, and delete and select_all, which end a stretch.
    """
    size, selected = 0, {}
    for op, a, odd, k in rows:
        if op == "size":
            size = a
        elif op == "toggle" and 0 <= a < size:
            was = selected.pop(a, None) is not None
            if was != bool(odd):
                selected[a] = True  # toggled positions stand behind the others, by their last toggle
        elif op == "select_all":
            selected = {} if len(selected) == size else dict.fromkeys(range(size), True)
        elif op == "delete" and 0 < len(selected) < size:
            yield *key, k, sorted(selected)
            size -= len(selected)
            selected = {}
    yield *key, None, list(selected)


def _segment(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """One segment of a document as a list: where each of its last positions comes from, of those there are at its start."""
    order: list[int] = []
    moved = False
    for op, a, b, gone in rows:
        if op == "size":
            order = list(range(a))
        elif op == "delete":
            left = set(gone)
            order = [x for i, x in enumerate(order) if i not in left]
        elif a is not None and b is not None and 0 <= a < len(order) and 0 <= b < len(order) and a != b:
            order.insert(b, order.pop(a))
            moved = True
    yield *key, order, moved


def _composed(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Lists of segments that follow each other, as one. Numbers below 0 stand for themselves."""
    whole, moved = next(rows)
    for order, also in rows:
        whole, moved = [x if x < 0 else whole[x] for x in order], moved or also
    yield *key, whole, moved


def _tree(lists: DataFrame, made: str) -> DataFrame:
    """One list for each document, composed of those of its segments, _FAN at a time."""
    most = lists.agg(F.max("seg")).first()[0] or 0
    while most > 0:
        lists = lists.select("doc_id", F.floor(F.col("seg") / _FAN).alias("seg"), F.col("seg").alias("_seg"), "ord", "moved")
        lists, most = _folded(lists, ["doc_id", "seg"], ["_seg"], lambda key, rows: _composed(key, (r[1:] for r in rows)), made), most // _FAN
    return lists


def replay_long_edits(docs: DataFrame, edits: DataFrame, segment: int = 4096, blocks: int | None = None) -> DataFrame:
    """replay_edits, with the same columns and results, for logs of any length: doc_id, ord, sel, dirty, order_differs.

    Edits are numbered over ranges of (doc_id, ts, seq), so a document's log is dealt to many tasks from the start (`range_sums`); what is before its
    last reset goes. Its selection is followed in one task, from one row a toggled position and stretch between deletes and
    select_alls. Then segments of `segment` edits are folded, each by itself, and their lists composed, 16 at a time. A document's order and
    selection still fit a row each. Edits of unknown documents are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = edits.select("doc_id", "ts", "seq", "op", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    is_op = lambda *ops: F.coalesce(F.col("op").isin(*ops), F.lit(False)).cast("int")
    placed = range_sums(rows, "doc_id", _ORDER, {"k": F.lit(1), "resets": is_op("reset"), "sub": is_op("delete", "select_all")}, blocks)
    log = placed.where("resets = resets_all").select("doc_id", "op", "a", "b", "k", "sub").checkpoint()
    known = docs.select("doc_id", F.coalesce(F.col("page_count").cast("int"), F.lit(0)).alias("page_count")).checkpoint()  # read three times

    none = F.lit(None)
    toggles = log.where("op = 'toggle' AND a >= 0").groupBy("doc_id", "sub", "a").agg((F.count(F.lit(1)) % 2).cast("int").alias("odd"), F.max("k").alias("k"))
    marks = log.where("op IN ('delete', 'select_all')").select("doc_id", "sub", none.cast("int").alias("a"), none.cast("int").alias("odd"), "k", "op", F.lit(1).alias("ends"))
    stretches = toggles.withColumns({"op": F.lit("toggle"), "ends": F.lit(0)}).unionByName(marks)
    selecting = stretches.select("doc_id").distinct()
    sizes = known.join(selecting, "doc_id").select("doc_id", F.lit(-1).cast("bigint").alias("sub"), F.col("page_count").alias("a"), none.cast("int").alias("odd"), F.lit(-1).cast("bigint").alias("k"), F.lit("size").alias("op"), F.lit(0).alias("ends"))
    followed = _folded(stretches.unionByName(sizes).select("doc_id", "op", "a", "odd", "k", "sub", "ends"), ["doc_id"], ["sub", "ends", "k"], lambda key, rows: _selections(key, (r[:4] for r in rows)), f"doc_id {kind}, k bigint, gone array<int>").checkpoint()
    deletes = followed.where("k is not null").select("doc_id", F.floor(F.col("k") / segment).alias("seg"), "k", "gone")

    moves = log.where("op = 'move'").select("doc_id", F.floor(F.col("k") / segment).alias("seg"), "k", "op", "a", "b", none.cast("array<int>").alias("gone"))
    worked = moves.unionByName(deletes.withColumns({"op": F.lit("delete"), "a": none.cast("int"), "b": none.cast("int")}))
    # the size at each segment's start: pages less what earlier segments have deleted
    per = worked.groupBy("doc_id", "seg").agg(F.sum(F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))).alias("fewer"))
    earlier = F.sum("fewer").over(Window.partitionBy("doc_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.withColumn("fewer", F.coalesce(earlier, F.lit(0))).join(known, "doc_id")
    starts = starts.select("doc_id", "seg", F.lit(-1).cast("bigint").alias("k"), F.lit("size").alias("op"), (F.col("page_count") - F.col("fewer")).cast("int").alias("a"), none.cast("int").alias("b"), none.cast("array<int>").alias("gone"))
    made = f"doc_id {kind}, seg bigint, ord array<int>, moved boolean"
    lists = _tree(_folded(worked.unionByName(starts).select("doc_id", "seg", "op", "a", "b", "gone", "k"), ["doc_id", "seg"], ["k"], lambda key, rows: _segment(key, (r[:4] for r in rows)), made).checkpoint(), made)
    touched = log.where("op = 'touch'").select("doc_id").distinct().withColumn("_touched", F.lit(True))
    deleted = deletes.select("doc_id").distinct().withColumn("_deleted", F.lit(True))
    initial = F.when(F.col("page_count") > 0, F.sequence(F.lit(0), F.greatest("page_count", F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    out = known.join(lists.drop("seg"), "doc_id", "left").join(followed.where("k is null").select("doc_id", F.col("gone").alias("_sel")), "doc_id", "left").join(touched, "doc_id", "left").join(deleted, "doc_id", "left")
    order, dirty = F.coalesce("ord", initial), F.coalesce("moved", F.lit(False)) | F.coalesce("_touched", "_deleted", F.lit(False))
    return out.select("doc_id", order.alias("ord"), F.coalesce("_sel", F.array().cast("array<int>")).alias("sel"), dirty.alias("dirty"), (order != initial).alias("order_differs"))


def _growth(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """What one segment makes of a set's size: size + base - the number of falls up to size.

    A remove at position a takes one from the sizes that are above a by then, which are those from some size at the start on: a fall.
    """
    base, falls = 0, []
    for op, a, _ in rows:
        if op == "append":
            base += 1
        elif op == "remove" and a is not None and a >= 0:
            low, high = 0, max(0, a + 1 - base + len(falls))  # the least size at the start that is above a by now
            while low < high:
                mid = (low + high) // 2
                if mid + base - bisect_right(falls, mid) > a:
                    high = mid
                else:
                    low = mid + 1
            insort(falls, low)
    yield *key, base, falls


def _sizes(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The size of one set at the start of each segment; the row of segment -1 has the size before all in base."""
    size = 0
    for seg, base, falls in rows:
        if seg >= 0:
            yield *key, seg, size
        size += base - bisect_right(falls, size)


def _set_segment(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """One segment of a set as a list: the position at its start of each last member, or -1 - k for the one that edit k appended."""
    members: list[int] = []
    for k, op, a, b in rows:
        n = len(members)
        if op == "size":
            members = list(range(a))
        elif op == "append":
            members.append(-1 - k)
        elif a is None or not 0 <= a < n:
            continue
        elif op == "remove":
            del members[a]
        else:
            b = a - 1 if op == "move_up" else a + 1 if op == "move_down" else b
            if b is not None and 0 <= b < n and a != b:
                members.insert(b, members.pop(a))
    yield *key, members, True


def replay_long_set_edits(edits: DataFrame, initial: DataFrame | None = None, segment: int = 4096, blocks: int | None = None) -> DataFrame:
    """replay_set_edits, with the same columns and results, for logs of any length: set_id, set_pos, doc_id.

    As in replay_long_edits: numbered over ranges; what is before the last clear goes; one task a set follows its size, from what each segment
    does to any size (`_growth`), whose parts are as many as the segment's removes; segments are folded apart and their lists composed. A set's order still fits a row.
    """
    doc = F.col("doc_id") if "doc_id" in edits.columns else F.col("seq").cast("bigint")
    rows = edits.select(F.col("set_id").alias("doc_id"), "ts", "seq", "op", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), doc.alias("doc"))
    kind, doc_kind = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "doc"))
    cleared = F.coalesce(F.col("op") == "clear", F.lit(False)).cast("int")
    placed = range_sums(rows, "doc_id", [*_ORDER, "doc"], {"k": F.lit(1), "clears": cleared}, blocks)
    log = placed.where("clears = clears_all AND op IN ('append', 'remove', 'move', 'move_up', 'move_down')").withColumn("seg", F.floor(F.col("k") / segment)).select("doc_id", "seg", "k", "op", "a", "b", "doc").checkpoint()
    start = edits.sparkSession.createDataFrame([], f"doc_id {kind}, set_pos int, doc {doc_kind}")
    if initial is not None:
        emptied = edits.where("op = 'clear'").select(F.col("set_id").alias("doc_id")).distinct()
        members = initial.select(F.col("set_id").cast(kind).alias("doc_id"), "set_pos", F.col("doc_id").cast(doc_kind).alias("doc"))
        start = numbered(members.join(emptied, "doc_id", "left_anti"), "doc_id", ["set_pos", "doc"], "at", blocks).select("doc_id", F.col("at").alias("set_pos"), "doc")
    none, first = F.lit(None), F.lit(-1).cast("bigint")
    grown = _folded(log.select("doc_id", "seg", "op", "a", "k"), ["doc_id", "seg"], ["k"], _growth, f"doc_id {kind}, seg bigint, base bigint, falls array<bigint>")
    before = start.groupBy("doc_id").agg(F.count(F.lit(1)).alias("base")).select("doc_id", first.alias("seg"), "base", F.array().cast("array<bigint>").alias("falls"))
    sizes = _folded(grown.unionByName(before), ["doc_id"], ["seg"], _sizes, f"doc_id {kind}, seg bigint, size bigint")
    starts = sizes.select("doc_id", "seg", first.alias("k"), F.lit("size").alias("op"), F.col("size").cast("int").alias("a"), none.cast("int").alias("b"))
    # sets without a log keep what they have
    quiet = before.join(log.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).cast("bigint").alias("seg"), first.alias("k"), F.lit("size").alias("op"), F.col("base").cast("int").alias("a"), none.cast("int").alias("b"))
    made = f"doc_id {kind}, seg bigint, ord array<bigint>, moved boolean"
    lists = _tree(_folded(log.drop("doc").unionByName(starts).unionByName(quiet), ["doc_id", "seg"], ["k"], _set_segment, made).checkpoint(), made)
    found = lists.select("doc_id", F.posexplode("ord").alias("at", "source"))
    appended = log.where("op = 'append'").select("doc_id", (-1 - F.col("k")).alias("source"), "doc")
    known = appended.unionByName(start.select("doc_id", F.col("set_pos").cast("bigint").alias("source"), "doc"))
    return found.join(known, ["doc_id", "source"]).select(F.col("doc_id").alias("set_id"), F.col("at").alias("set_pos"), F.col("doc").alias("doc_id"))
