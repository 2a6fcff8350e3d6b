"""Replay of edits as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .buckets import by_bucket, by_key

STATE = "ts array<bigint>, seq array<bigint>, op array<string>, a array<int>, b array<int>"
OUTPUT = "ord array<int>, sel array<int>, dirty boolean, n_late bigint, late array<struct<ts:bigint,seq:bigint,op:string,a:int,b:int>>"


def step(order: list[int], selected: list[int], dirty: bool, n: int, op: str, a: int | None, b: int | None) -> tuple[list[int], list[int], bool]:
    """One edit of a document of n pages."""
    size = len(order)
    inside = lambda p: p is not None and 0 <= p < size
    if op == "toggle" and inside(a):
        return order, [p for p in selected if p != a] if a in selected else [*selected, a], dirty
    if op == "select_all":
        return order, [] if len(selected) == size else list(range(size)), dirty
    if op == "move" and inside(a) and inside(b) and a != b:
        rest = order[:a] + order[a + 1 :]
        return [*rest[:b], order[a], *rest[b:]], selected, True
    if op == "delete" and 0 < len(selected) < size:
        gone = set(selected)
        return [x for i, x in enumerate(order) if i not in gone], [], True
    if op == "reset":
        return list(range(n)), [], False
    return order, selected, dirty or op == "touch"


def place(e: tuple) -> tuple:
    """Where an edit (ts, seq, ...) stands; nulls come first, as in the batch form."""
    return e[0] is not None, e[0] or 0, e[1] is not None, e[1] or 0


class _Replay(StatefulProcessor):
    def __init__(self, kind: str) -> None:
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.logs = handle.getMapState("logs", f"doc_id {self.kind}", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        for doc, found in by_key(rows, "doc_id", ["us", "seq", "op", "a", "b", "n"]).items():
            n = next((e[5] for e in found if e[5] is not None), 0)
            new, was = [e[:5] for e in found], self.logs.getValue((doc,))
            log = list(zip(*was, strict=True)) if was else []  # from the last reset on, in order
            late = [e for e in sorted(new, key=place) if log and place(e) <= place(log[-1])]
            log = sorted([*log, *new], key=place)
            log = log[max((i for i, e in enumerate(log) if e[2] == "reset"), default=0) :]
            order, selected, dirty = list(range(n)), [], False
            for _, _, op, a, b in log:
                order, selected, dirty = step(order, selected, dirty, n, op, a, b)
            self.logs.updateValue((doc,), tuple(list(x) for x in zip(*log, strict=True)))
            said = [dict(zip(("ts", "seq", "op", "a", "b"), e, strict=True)) for e in late]
            yield Row(doc_id=doc, ord=order, sel=selected, dirty=dirty, n_late=len(late), late=said)

    def close(self) -> None:
        pass


def stream_replay(edits: DataFrame) -> DataFrame:
    """The state of each document after each batch of edits (a stream of doc_id, n, ts, seq, op, a, b), in update mode.

    doc_id, ord, sel, dirty, n_late, late. Edits are applied by (ts, seq), whatever batch they come in: a document's log from its last
    reset on is kept and replayed. late are the edits of the batch that aren't behind the last one of earlier batches, in their order, n_late is
    their number; late_edits makes rows of them. n is the number of pages, the same in all edits of a document. State is one row a
    document, with a log that has to fit it (documents share calls, by_bucket), in RocksDB, which the session must name as its state store (spark.sql.streaming.stateStore.providerClass).
    """
    kind = edits.schema["doc_id"].dataType.simpleString()
    rows = edits.select("doc_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("seq").cast("bigint").alias("seq"), "op", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("n").cast("int").alias("n"))
    return by_bucket(rows, "doc_id").transformWithState(statefulProcessor=_Replay(kind), outputStructType=f"doc_id {kind}, {OUTPUT}", outputMode="Update", timeMode="None")


def late_edits(states: DataFrame) -> DataFrame:
    """The late edits of stream_replay, one row each: doc_id, ts, seq, op, a, b."""
    rows = states.select("doc_id", F.explode("late").alias("e"))
    return rows.select("doc_id", F.timestamp_micros("e.ts").alias("ts"), "e.seq", "e.op", "e.a", "e.b")
