"""Progress as pages complete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.progress import BITS, percent


class _Done(StatefulProcessor):
    """The done pages of each document as bitmaps of BITS pages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bits = handle.getMapState("bits", "bucket bigint", "bitmap binary")
        self.number = handle.getValueState("number", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        pages = np.unique(np.concatenate([b["page_index"].dropna().to_numpy(np.int64) for b in rows]))
        pages = pages[pages >= 0]
        n = self.number.get()[0] if self.number.exists() else 0
        for bucket in np.unique(pages // BITS):
            own = pages[pages // BITS == bucket] % BITS
            place = (int(bucket),)
            bitmap = np.frombuffer(bytes(self.bits.getValue(place)[0]) if self.bits.containsKey(place) else bytes(BITS // 8), np.uint8).copy()
            before = int(np.bitwise_count(bitmap).sum())
            np.bitwise_or.at(bitmap, own // 8, (1 << (own % 8)).astype(np.uint8))
            n += int(np.bitwise_count(bitmap).sum()) - before
            self.bits.updateValue(place, (bytes(bitmap),))
        self.number.update((n,))
        yield pd.DataFrame({"doc_id": [key[0]], "n_done": [n]})

    def close(self) -> None:
        pass


def stream_progress(done: DataFrame, docs: DataFrame) -> DataFrame:
    """done (a stream of doc_id, maybe page_index) as a stream, in update mode, of doc_id, n_done, percent, by the static docs (doc_id, page_count).

    With page_index, a page that is delivered again counts once: a document's state is one bit a page, in RocksDB, which the session must name as its
    state store. Without it, rows are counted.
    """
    if "page_index" in done.columns:
        kind = done.schema["doc_id"].dataType.simpleString()
        rows = done.select("doc_id", F.col("page_index").cast("bigint").alias("page_index"))
        counted = rows.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=_Done(), outputStructType=f"doc_id {kind}, n_done bigint", outputMode="Update", timeMode="None")
    else:
        counted = done.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_done"))
    return counted.join(docs.select("doc_id", "page_count"), "doc_id").select("doc_id", "n_done", percent(F.col("n_done"), F.col("page_count")).alias("percent"))
