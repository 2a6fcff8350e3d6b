"""Replay of edits as they arrive, with state that doesn't grow with the log."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .buckets import by_bucket, by_key
from .replay import OUTPUT, STATE, place, step

_STATE = "n int, ord array<int>, sel array<int>, dirty boolean, ts bigint, seq bigint"
_NO_SEQ = -(1 << 63)  # an edit without seq comes first among those of its time


class _Snapshots(StatefulProcessor):
    """Of each document: the snapshot, with all edits older than the watermark in it; the tail of the others, in a part for each batch that brought some;
    and the state after these, with the numbers of the parts and the oldest ts of each."""

    def __init__(self, kind: str) -> None:
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.folded = handle, set()
        self.snapshots = handle.getMapState("snapshots", f"doc_id {self.kind}", _STATE)
        self.current = handle.getMapState("current", f"doc_id {self.kind}", f"{_STATE}, parts array<bigint>, oldest array<bigint>")
        self.tails = handle.getMapState("tails", f"doc_id {self.kind}, part bigint", STATE)

    @staticmethod
    def _apply(state: tuple, edits: list[tuple]) -> tuple:
        n, order, selected, dirty, ts, seq = state
        order, selected = list(order), list(selected)
        for (ts, seq), (op, a, b) in edits:  # noqa: B007  the last place stays
            order, selected, dirty = step(order, selected, dirty, n, op, a, b)
        return n, order, selected, dirty, ts, seq

    def _tail(self, doc: object, parts: list[int]) -> dict[tuple, tuple]:
        """The edits of parts by place; one that came again stands as it came last."""
        return {(ts, seq): (op, a, b) for part in parts for ts, seq, op, a, b in zip(*self.tails.getValue((doc, part)), strict=True)}

    def _keep(self, doc: object, part: int, edits: list[tuple]) -> None:
        self.tails.updateValue((doc, part), tuple(list(x) for x in zip(*[(*at, *edit) for at, edit in edits], strict=True)))

    def _snapshot(self, doc: object, n: int) -> tuple:
        return tuple(self.snapshots.getValue((doc,)) or (n, list(range(n)), [], False, None, None))

    def _fold(self, doc: object, state: tuple, watermark: int) -> None:
        """Edits that nothing can come before any more go from the tail into the snapshot."""
        *current, parts, oldest = state
        passed = [p for p, ts in zip(parts, oldest, strict=True) if ts < watermark]
        if not passed:
            return
        # of an edit that stands in several parts the last one counts, and all of them are as old
        old, kept = {}, {p: ts for p, ts in zip(parts, oldest, strict=True) if ts >= watermark}
        for p in passed:
            tail = sorted(self._tail(doc, [p]).items())
            old |= {e[0]: e[1] for e in tail if e[0][0] < watermark}
            left = [e for e in tail if e[0][0] >= watermark]
            if left:
                self._keep(doc, p, left)
                kept[p] = left[0][0][0]
            else:
                self.tails.removeKey((doc, p))
        self.snapshots.updateValue((doc,), self._apply(self._snapshot(doc, current[0]), sorted(old.items())))
        self.current.updateValue((doc,), (*current, sorted(kept), [kept[p] for p in sorted(kept)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        watermark, newest = timerValues.getCurrentWatermarkInMs() * 1000, None
        for doc, found in by_key(rows, "doc_id", ["us", "seq", "op", "a", "b", "n"]).items():
            late = sorted((e[:5] for e in found if e[0] is None or e[0] < watermark), key=place)
            new = sorted({(e[0], _NO_SEQ if e[1] is None else e[1]): e[2:5] for e in found if e[0] is not None and e[0] >= watermark}.items())
            was = self.current.getValue((doc,))
            if was:
                *current, parts, oldest = was
            else:
                n = next((e[5] for e in found if e[5] is not None), 0)
                current, parts, oldest = (n, list(range(n)), [], False, None, None), [], []
            current, parts, oldest = tuple(current), list(parts), list(oldest)
            if new:
                in_order = current[4] is None or new[0][0] > (current[4], current[5])
                newest = max(newest or new[-1][0][0], new[-1][0][0])
                # edits behind all others go on from the state there is; others, and edits delivered again, need the tail
                if in_order:
                    current = self._apply(current, new)
                else:
                    current = self._apply(self._snapshot(doc, current[0]), sorted((self._tail(doc, parts) | dict(new)).items()))
                part = parts[-1] + 1 if parts else 0
                self._keep(doc, part, new)
                parts, oldest = [*parts, part], [*oldest, new[0][0][0]]
            if new or not was:
                self.current.updateValue((doc,), (*current, parts, oldest))
            _, order, selected, dirty, *_ = current
            said = [dict(zip(("ts", "seq", "op", "a", "b"), e, strict=True)) for e in late]
            yield Row(doc_id=doc, ord=list(order), sel=list(selected), dirty=dirty, n_late=len(late), late=said)
        if newest is not None:
            self.handle.registerTimer(newest // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        if (key, watermark) not in self.folded:  # once for all timers of a bucket that are over
            self.folded.add((key, watermark))
            for (doc,), state in [(tuple(k), tuple(v)) for k, v in self.current.iterator()]:
                self._fold(doc, state, watermark)
        return iter([])

    def close(self) -> None:
        pass


def stream_snapshots(edits: DataFrame, delay: str) -> DataFrame:
    """The state of each document after each batch of edits (a stream of doc_id, n, ts, seq, op, a, b), in update mode.

    doc_id, ord, sel, dirty, n_late, late, as from stream_replay, but with bounded state: edits are applied by (ts, seq) as long as they aren't older than
    the watermark, the largest ts of earlier batches less `delay`; older ones, and those without ts, are not applied, they are
    given in late (late_edits makes rows of them). (ts, seq) names an edit: one that is delivered again while it is in the tail counts once. n is
    the number of pages, the same in all edits of a document.

    A document's state is a snapshot and a tail, the edits of the last `delay` in a part for each batch; documents share calls (by_bucket). Event-time timers fold the tail into the snapshot as the
    watermark passes, whether or not the document gets further edits. Edits that come in order go on from the state there is; others replay the
    tail. State is in RocksDB, which the session must name as its state store (spark.sql.streaming.stateStore.providerClass).
    """
    kind = edits.schema["doc_id"].dataType.simpleString()
    # rows with the watermark's own column would be left out once they are late; a copy of its value isn't, so late edits can be given out
    rows = edits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select("doc_id", F.col("n").cast("int").alias("n"), F.unix_micros("ts").alias("us"), F.col("seq").cast("bigint").alias("seq"), "op", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    return by_bucket(rows, "doc_id").transformWithState(statefulProcessor=_Snapshots(kind), outputStructType=f"doc_id {kind}, {OUTPUT}", outputMode="Update", timeMode="EventTime")
