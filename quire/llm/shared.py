"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A-Z lower-cased. bytes.split() then cuts at the white space of ASCII.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE = 1 << 20  # bytes of text that are split at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a new folder in local mode, in
    which driver and executors are one process; on a cluster it has to be set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written once as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and two uses don't compute df twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, as the contracts ask, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text, cut at white space."""
    at = 0
    while len(text) - at > _PIECE:
        end = max(text.rfind(c, at, at + _PIECE) for c in (b" ", b"\n"))
        end = end if end > at else min((x for c in (b" ", b"\n") if (x := text.find(c, at + _PIECE)) > 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def ascii_words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased and cut at the white space of ASCII, a stretch of a long text at a time."""
    for piece in _pieces(text) if len(text) > _PIECE else (text,):
        yield piece.translate(_LOWER).split()


def quoted(name: str) -> Column:
    """A column by its name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, df: DataFrame) -> str:
    """name, with underscores in front until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lookup(rows: DataFrame, groups: DataFrame, key: str, n: str, most: int = 200_000) -> DataFrame:
    """rows with the other columns of groups, which has one row for each key of rows and in n how many rows have it. Null keys are equal.

    Up to `most` groups are broadcast. Beyond that, keys of more than rows / most rows are hot: there are fewer than `most` of them, which are
    broadcast, so their rows stay where they are; the rest goes by a shuffle, in which no key has more than rows / most rows.
    """
    k = unused("_key", rows)
    groups = staged(groups, "groups").withColumnRenamed(key, k)
    same = quoted(key).eqNullSafe(F.col(k))
    total, many = groups.agg(F.coalesce(F.sum(n), F.lit(0)), F.count(F.lit(1))).first()
    if many <= most:
        return rows.join(F.broadcast(groups.drop(n)), same).drop(k)
    hot, rest = groups.where(F.col(n) > total // most).drop(n), groups.where(F.col(n) <= total // most).drop(n)
    cold = rows.join(F.broadcast(hot.select(k)), same, "left_anti").join(rest, same)
    return rows.join(F.broadcast(hot), same).unionByName(cold).drop(k)


_memory: dict[str, object] = {}


def worker_memory(owner: str, make: Callable[[], T]) -> T:
    """What make gives, kept by a Python worker from task to task until a task asks for another owner's: of the memories of several
    operators a worker holds one."""
    if owner not in _memory:
        _memory.clear()
        _memory[owner] = make()
    return _memory[owner]


def release_memory() -> None:
    """For tasks that remember nothing themselves: a Python worker that other operators have used before holds nothing of theirs any more."""
    _memory.clear()
