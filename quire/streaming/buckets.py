"""Many keys of a stream to one grouped call: each call, and each access to state from it, costs more than a few rows do."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

BUCKETS = 1 << 10  # calls in a batch, at most; must stay the same while a stream's checkpoint is used
_NAN = float("nan")


def by_bucket(rows: DataFrame, key: str, buckets: int = BUCKETS):  # noqa: ANN201
    """rows grouped by a hash of key. State is kept by key within a bucket, so what is read and written are the keys that a batch touches."""
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy("_bucket")


def by_key(rows: Iterator[Row], key: str, names: list[str]) -> dict[object, list[tuple]]:
    """The rows of a bucket by key, as tuples of the columns names."""
    found: dict[object, list[tuple]] = {}
    take = None
    for row in rows:
        if take is None:
            at = row.__fields__.index
            own, take = at(key), itemgetter(*[at(n) for n in names])
        of = row[own]
        found.setdefault(of if of == of else _NAN, []).append(take(row))
    return found
