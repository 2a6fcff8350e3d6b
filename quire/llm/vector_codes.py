"""Vector code compression: codebooks by member-resident Lloyd rounds, and codes of whole tables."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.rdd import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lookup, quoted, shared_dir, staged

_BLOCK = 8192  # parts that are measured at once
_KEY_MEMBERS = 1_000_000  # parts that one (position, entry, salt) should hold at most
_LONG = 1 << 63
Codebooks = list[list[list[int]]]  # by position, entry, and place within the part


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); beyond 2^62 as Python's whole numbers."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < float(1 << 62):
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)


def nearest(parts: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest entry (squared Euclidean distance, ties to the lower index) and that distance, in whole numbers."""
    most = max(int(np.abs(parts).max(initial=0)), max((abs(x) for entry in book for x in entry), default=0))
    if most * most * 4 * max(1, parts.shape[1]) < 1 << 53:  # all sums are whole numbers that a double holds
        x, c = parts.astype(np.float64), np.array(book, dtype=np.float64).reshape(len(book), -1)
        far = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        at = far.argmin(axis=1)
        return at, far[np.arange(len(at)), at].astype(np.int64)
    x = parts.astype(object)
    far = np.stack([((x - np.array(entry, dtype=object)[None, :]) ** 2).sum(axis=1) for entry in book], axis=1)
    at = np.array([min(range(len(book)), key=row.__getitem__) for row in far.tolist()], dtype=np.int64)
    return at, far[np.arange(len(at)), at]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a column of lists, which all have `dims` values."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _split(vectors: np.ndarray, parts: int, width: int, scale: int) -> np.ndarray:
    """Rows cut into `parts` parts of `width` whole numbers; what is missing at the end of a vector is 0."""
    whole = _whole(vectors, scale)
    if whole.shape[1] < parts * width:
        whole = np.concatenate([whole, np.zeros((len(whole), parts * width - whole.shape[1]), whole.dtype)], axis=1)
    return whole.reshape(len(whole), parts, width)


def _distinct(parts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal parts as one, with their number."""
    if parts.dtype == object or len(parts) < 2:
        return parts, counts
    rows = np.ascontiguousarray(parts).view(np.dtype((np.void, parts.itemsize * parts.shape[1]))).ravel()
    _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
    return parts[first], np.bincount(inverse.ravel(), weights=counts).astype(np.int64)


def _spread(parts: np.ndarray) -> np.ndarray:
    """A number of each part, from its components alone."""
    if parts.dtype == object:
        parts = np.array([[x & 0xFFFFFFFF for x in row] for row in parts], dtype=np.int64).reshape(parts.shape)
    mixed = (parts.astype(np.uint64) + np.uint64(1)) * (np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
    return ((mixed ^ (mixed >> np.uint64(29))).sum(axis=1) >> np.uint64(24)).astype(np.int64)


class _Owners:
    """Where members live: a key is (position, entry, salt) as one number, and its owner is a partition."""

    def __init__(self, entries: int, salts: int) -> None:
        self.entries, self.salts = entries, salts

    def key(self, position: int, entry: int, salt: int) -> int:
        return (position * self.entries + entry) * self.salts + salt

    def of(self, key: int) -> tuple[int, int, int]:
        rest, salt = divmod(key, self.salts)
        return *divmod(rest, self.entries), salt

    def blocks(self, position: int, entries: np.ndarray, salts: np.ndarray, parts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, tuple]]:
        """(key, (parts, counts)) of members, one block for each key."""
        keys = entries * self.salts + salts
        order = np.argsort(keys, kind="stable")
        ends = np.flatnonzero(np.diff(keys[order], append=-1))
        start = 0
        for end in ends + 1:
            own = order[start:end]
            yield self.key(position, int(entries[own[0]]), int(salts[own[0]])), (parts[own], counts[own])
            start = end


def _partition(key: int) -> int:
    """Keys are dealt in turn, so the salts of one entry go to different partitions."""
    return key


def _sums(blocks: Iterator[tuple[int, tuple]], owners: _Owners) -> Iterator[tuple[tuple[int, int], tuple[list[int], int]]]:
    """What an owner's resident members add to each of its entries: sums in whole numbers, and counts."""
    found: dict[tuple[int, int], tuple[list[int], int]] = {}
    for key, (_, parts, counts) in blocks:
        position, entry, _ = owners.of(key)
        exact = parts if parts.dtype != object and int(np.abs(parts).max(initial=0)) * int(counts.sum()) < _LONG else parts.astype(object)
        added = [int(x) for x in (exact * counts.astype(exact.dtype)[:, None]).sum(axis=0)]
        known, n = found.get((position, entry), ([0] * len(added), 0))
        found[position, entry] = [x + y for x, y in zip(known, added, strict=True)], n + int(counts.sum())
    yield from found.items()


def _updated(state: RDD, books: Codebooks, owners: _Owners) -> Codebooks:
    """Each entry as the floor of its members' mean; an entry without members stays. One row an entry comes to the driver."""

    def add(a: tuple[list[int], int], b: tuple[list[int], int]) -> tuple[list[int], int]:
        return [x + y for x, y in zip(a[0], b[0], strict=True)], a[1] + b[1]

    sums = state.mapPartitions(lambda blocks: _sums(blocks, owners)).reduceByKey(add, min(8, state.getNumPartitions())).collect()
    new = [[list(entry) for entry in book] for book in books]
    for (position, entry), (total, n) in sums:
        new[position][entry] = [x // n for x in total]
    return new


def _reassigned(blocks: Iterator[tuple[int, tuple]], books: Codebooks, owners: _Owners) -> Iterator[tuple[int, tuple]]:
    """The members of each block under the new codebooks: (key, (moved, parts, counts)), those whose entry is another one as moved."""
    for key, (_, parts, counts) in blocks:
        position, entry, salt = owners.of(key)
        at, _ = nearest(parts, books[position])
        stay = at == entry
        if stay.any():
            yield key, (False, parts[stay], counts[stay])
        if not stay.all():
            go = ~stay
            for new, (p, c) in owners.blocks(position, at[go], np.full(int(go.sum()), salt), parts[go], counts[go]):
                yield new, (True, p, c)


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector isn't null and holds neither nulls nor values that aren't finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.where(quoted(vector_col).isNotNull() & F.forall(quoted(vector_col), finite))


def usual_size(vectors: DataFrame, vector_col: str = "embedding") -> int:
    """The number of components that most usable vectors have, the larger of equals; 0 where there are none."""
    sizes = usable(vectors, vector_col).groupBy(F.size(quoted(vector_col)).alias("n")).agg(F.count(F.lit(1)).alias("rows")).where("n > 0")
    most = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return most.n if most else 0


def fit_codebooks(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, dims: int | None = None, salts: int | None = None
) -> Codebooks:
    """The codebooks of vectors after `rounds` rounds of Lloyd's algorithm over all rows, in whole numbers: [position][entry][place].

    A component x becomes floor(scale * x). Vectors have `dims` components (by default usual_size; other vectors
    take no part), cut into `parts` equal parts; where they can't be cut evenly, zeros are added at the end. Each codebook starts as the
    parts of the `entries` smallest ids, ascending, of fewer where there are fewer, none where there is no row; rows of equal ids by their vectors,
    and rows without an id don't begin a codebook. Unusable vectors take no part. Literal copies count as often as they stand there.

    Members live where they are: rows (position, entry, salt, parts) are partitioned by their first three, on disk. In a round the owners sum
    their resident members (one row an entry comes to the driver, whatever the input), and measure them against the new codebooks; those that
    keep their entry stay in their partition, and only those whose entry changes go through a shuffle into the partitions of their new owners. Equal
    parts of a block go as one with their number. The salt comes from a part's bytes and its task, so one vector in a third of all rows is spread
    as well. Every other round is written to the checkpoint folder; a lost executor costs the recomputation of two rounds at most.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vector_col).select(quoted(id_col).alias("_id"), quoted(vector_col).alias("_v"))
    dims = usual_size(rows, "_v") if dims is None else dims
    rows = rows.where(F.size("_v") == dims)
    first = rows.where("_id is not null").orderBy("_id", "_v").limit(entries).collect() if dims else []
    if not first:
        return [[] for _ in range(parts)]
    width = -(-dims // parts)
    start = _split(np.array([r._v for r in first], dtype=np.float64), parts, width, scale)
    books: Codebooks = [[[int(x) for x in entry] for entry in start[:, p]] for p in range(parts)]
    if not rounds:
        return books
    members = rows.count()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = salts or max(-(-n // len(first)), -(-members // _KEY_MEMBERS))
    owners = _Owners(len(first), salts)

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of the first assignment, as blocks of bytes by key."""
        task = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                cut = _split(_vectors(batch.column(0).slice(at, _BLOCK), dims), parts, width, scale)
                keys, blocks = [], []
                for position in range(parts):
                    own, counts = _distinct(cut[:, position], np.ones(len(cut), np.int64))
                    salt = (_spread(own) + task) % salts
                    for key, block in owners.blocks(position, nearest(own, books[position])[0], salt, own, counts):
                        keys.append(key)
                        blocks.append(pickle.dumps(block, protocol=5))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], ["key", "block"])

    # setting the folder that is set already makes a subfolder that nothing writes to, so it is only done where there is none
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    laid = rows.select("_v").mapInArrow(laid_out, "key bigint, block binary")
    first_blocks = laid.rdd.map(lambda r: (r.key, (True, *pickle.loads(bytes(r.block)))))
    state = first_blocks.partitionBy(n, _partition)
    kept: list[RDD] = []
    for turn in range(rounds):
        books = _updated(state, books, owners)
        if turn + 1 == rounds:
            break
        again = books
        assigned = state.mapPartitions(lambda blocks, again=again: _reassigned(blocks, again, owners), preservesPartitioning=True).persist(StorageLevel.DISK_ONLY)
        if turn % 2:
            assigned.checkpoint()
        stay = assigned.filter(lambda b: not b[1][0])
        moved = assigned.filter(lambda b: b[1][0]).partitionBy(state.getNumPartitions(), _partition)
        state = stay.union(moved)
        kept.append(assigned)
        while len(kept) > 2:  # blocks of the round before are needed until the next ones exist
            kept.pop(0).unpersist()
    for assigned in kept:
        assigned.unpersist()
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096, dims: int | None = None) -> DataFrame:
    """id_col, label_col, code, error for each usable vector of `dims` components (by default as many as the codebooks have).

    code: the index of the nearest entry of each part, two hexadecimal digits each, in the order of parts; error: squared distances in
    whole numbers, summed over parts; null where it doesn't fit a long. One pass over the rows without a shuffle.
    """
    parts, width = len(books), len(books[0][0]) if books and books[0] else 0
    dims = parts * width if dims is None else dims
    rows = usable(vectors, vector_col).select(quoted(id_col).alias("_id"), quoted(label_col).alias("_label"), quoted(vector_col).alias("_v"))
    rows = rows.where((F.size("_v") == dims) & F.lit(width > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                own = batch.slice(at, _BLOCK)
                cut = _split(_vectors(own.column("_v"), dims), parts, width, scale)
                codes, errors = np.zeros((len(cut), parts), np.uint8), np.zeros(len(cut), object)
                for p in range(parts):
                    codes[:, p], far = nearest(cut[:, p], books[p])
                    errors += far.astype(object)
                texts = pa.array([row.tobytes().hex() for row in codes], pa.string())
                yield pa.RecordBatch.from_arrays([own.column("_id"), own.column("_label"), texts, pa.array([int(e) if e < _LONG else None for e in errors], pa.int64())], ["_id", "_label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error bigint")
    return out.select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "code", "error")


def codebooks_sha256(books: Codebooks) -> str:
    """Lowercase hex digest of all entries' decimal components by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row per usable row of vectors: id_col, code, error, label_error, codebooks_sha256.

    Codebooks are fit_codebooks of the same rows, codes encode_vectors with them. label_error is the error summed over rows of equal
    labels, null labels together; null where it doesn't fit a long. Rows may repeat; vectors that are null, empty, not finite, or of
    another size than most are left out; no rows give no rows; other columns are ignored, whatever their names. entries: 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits a part: entries has to be from 1 to 256")
    rows = vectors.select(quoted(id_col).alias("_id"), quoted(vector_col).alias("_v"), quoted(label_col).alias("_label"))
    dims = usual_size(rows, "_v")
    books = fit_codebooks(rows, "_id", "_v", parts, entries, rounds, scale, dims)
    coded = staged(encode_vectors(rows, books, "_id", "_v", "_label", scale, dims), "codes")
    total = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error")
    out = lookup(coded, coded.groupBy("_label").agg(total, F.count(F.lit(1)).alias("_n")), "_label", "_n")
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
