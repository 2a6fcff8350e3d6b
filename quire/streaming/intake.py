"""Atomic intake of files that arrive one by one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Batches(StatefulProcessor):
    """The files of each batch that have arrived, until they are as many as declared or the time is over."""

    def __init__(self, names: list[str], fields: str, wait_ms: int) -> None:
        self.names, self.fields, self.wait_ms = names, fields, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file_no bigint", self.fields)
        self.over = handle.getValueState("over", "over boolean")

    def _out(self, key: tuple, rows: list[tuple], reason: str | None) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.names, dtype=object)
        out.insert(0, "batch_id", [key[0]] * len(rows))
        out["reject_reason"] = [reason] * len(rows)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        clean = lambda x: None if pd.isna(x) else x.item() if hasattr(x, "item") else x
        arrived = [tuple(map(clean, r)) for b in rows for r in b[[*self.names, "us"]].itertuples(index=False, name=None)]
        at = {c: i for i, c in enumerate(self.names)}
        if self.over.exists():
            yield self._out(key, [r[:-1] for r in arrived], "batch_closed")
            return
        first = not self.files.exists()
        for r in arrived:
            self.files.updateValue((r[at["file_no"]],), r[:-1])
        held = [tuple(v) for _, v in sorted(self.files.iterator(), key=lambda x: x[0])]
        if len(held) >= max(r[at["n_files"]] for r in held):
            yield self._close(key, held, "batch_load_failed" if any(r[at["load_failed"]] for r in held) else None)
        elif first:
            self.handle.registerTimer(min(r[-1] for r in arrived) // 1000 + self.wait_ms)

    def _close(self, key: tuple, held: list[tuple], reason: str | None) -> pd.DataFrame:
        self.files.clear()
        self.over.update((True,))
        return self._out(key, held, reason)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = [tuple(v) for _, v in sorted(self.files.iterator(), key=lambda x: x[0])]
        if held and not self.over.exists():
            yield self._close(key, held, "batch_incomplete")

    def close(self) -> None:
        pass


def stream_atomic_batches(files: DataFrame, wait: str, delay: str) -> DataFrame:
    """files (a stream of batch_id, n_files, file_no, load_failed, ts and what else) with reject_reason, in append mode, batch by batch.

    A batch comes out when n_files of its files have arrived, whatever the order: all of them with a null reject_reason, or, if one failed to load, all as
    batch_load_failed. A batch that isn't complete `wait` after its first file (by ts; the watermark is `delay` behind) comes out as batch_incomplete, and
    files that arrive once their batch is out as batch_closed. A file_no that is delivered again before that counts once, as it came last. State
    holds open batches, and a mark for each closed one, in RocksDB, which the session must name as its state store.
    """
    kept = [f for f in files.schema if f.name not in ("batch_id", "ts")]
    fields = ", ".join(f"`{f.name}` {'bigint' if f.name in ('file_no', 'n_files') else f.dataType.simpleString()}" for f in kept)
    names, kind = [f.name for f in kept], files.schema["batch_id"].dataType.simpleString()
    rows = files.withWatermark("ts", delay).select("batch_id", *[F.col(c).cast("bigint").alias(c) if c in ("file_no", "n_files") else F.col(c) for c in names], F.unix_micros("ts").alias("us"))
    wait_ms = int(files.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {wait}) AS ms").first().ms)
    processor = _Batches(names, fields, wait_ms)
    return rows.groupBy("batch_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"batch_id {kind}, {fields}, reject_reason string", outputMode="Append", timeMode="EventTime")
