"""Clustering around centroids by exponion search, in whole numbers.

Vectors are kept as integers floor(scale * x) in blocks of some thousand. A round assigns every vector to its nearest
centroid (squared distance; of equal ones the smaller number) and moves centroids to the floored means of their vectors.

Each vector carries its centroid a, an upper bound u of its distance to it and a lower bound l of the distance to any
other. It stays if u < max(l, s/2), s being the distance from a to the nearest other centroid. Else u is made exact, and
if that doesn't settle it, only the centroids within 2u + s around a are looked at: both nearest ones are among them. They
are a prefix of a's list of centroids sorted by distance, taken in lengths of powers of two. The comparison that lets a vector stay is
strict and the radius inclusive, both with a margin above the rounding of square roots, so equal distances are always compared,
as whole numbers. When centroids have moved, u grows and l shrinks by the distances moved.

Vectors are shuffled once, by block, and persisted; a round moves only the bounds (20 bytes a vector, a written table, so
lineage is one round) and adds up sums that tasks wrote. Centroids (their number is a parameter) go to every task; nothing
else passes the driver. A lost executor's blocks are read again from the written blocks.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are left out;
repeated rows are vectors of their own, with equal hashes ordered by their components; with fewer vectors than centroids
there are fewer centroids; an empty table gives no rows. Components of 131,072 or more in size are an error, as
distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import packed, summed, written

MARGIN = 1e-9


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(scale * vectors.astype(np.float64))
    if out.size and np.abs(out).max() >= 1 << 27:
        raise ValueError("a component is too large: squared distances would not fit a long")
    return out.astype(np.int32)


def kept(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column with exactly `size` finite components, and those components."""
    if isinstance(column, pa.FixedSizeListArray):
        column = column.cast(pa.list_(column.type.value_type))
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    good = np.isfinite(values).all(axis=1)
    return rows[good], values[good]


def blocks(df: DataFrame, size: int, scale: int, id_col: str, vector_col: str, rows: int) -> DataFrame:
    """(block, ids, vectors): up to `rows` vectors as 32-bit integers."""
    read = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = read.schema["id"].dataType.simpleString()

    def deal(batches):
        n = TaskContext.get().partitionId() << 33
        ids, held = [], []

        def block():
            return pa.RecordBatch.from_pydict({"block": pa.array([n], pa.int64()), "ids": pa.array([ids[:rows]], pa.list_(id_type)), "vectors": pa.array([np.concatenate(held)[:rows].tobytes()], pa.binary())})

        for b in batches:
            id_type = b.schema.field(0).type
            at, values = kept(b.column(1), size)
            ids += b.column(0).take(pa.array(at)).to_pylist()
            held.append(whole(values, scale))
            while len(ids) >= rows:
                yield block()
                ids, held, n = ids[rows:], [np.concatenate(held)[rows:]], n + 1
        if ids:
            yield block()

    return read.mapInArrow(deal, f"block long, ids array<{kind}>, vectors binary")


def seeds(df: DataFrame, k: int, size: int, scale: int, seed: int, id_col: str, vector_col: str) -> np.ndarray:
    """The k kept vectors with the smallest hashes of `seed:id`, in their order."""
    read = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    first = read.filter(F.col("id").isNotNull() & (F.size("v") == size) & good).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256), "v").limit(k)
    return whole(np.array([r["v"] for r in first.collect()], dtype=np.float64).reshape(-1, size), scale).astype(np.int64)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    far = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0))
    if v.shape[1] * (2 * int(far)) ** 2 < 1 << 53:  # exact in doubles
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((v.astype(np.int64) - one) ** 2).sum(1) for one in c.astype(np.int64)], axis=1)


def own_squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors, each to a centroid of its own."""
    return ((v.astype(np.int64) - c) ** 2).sum(1)


def two_nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column and value of the smallest squared distance of each row (the first of equal ones), and the second smallest's root."""
    at = d.argmin(1)
    least = d[np.arange(len(d)), at]
    if d.shape[1] == 1:
        return at, least, np.full(len(d), np.inf)
    return at, least, np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))


class Lists:
    """For a centroid all centroids by their distance from it, itself first; at most `cells` distances are held."""

    def __init__(self, centroids: np.ndarray, cells: int = 1 << 22):
        self.c, self.most = centroids, max(1, cells // max(1, len(centroids)))
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        if a not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            d = np.sqrt(squares(self.c[a : a + 1], self.c)[0].astype(np.float64))
            order = np.lexsort((np.arange(len(d)), np.arange(len(d)) != a, d))
            self.held[a] = d[order], order
        return self.held[a]

    def gap(self, a: int) -> float:
        """The distance to the nearest other centroid."""
        d, _ = self.of(a)
        return float(d[1]) if len(d) > 1 else np.inf


class Round:
    """One assignment: centroids, how far each has moved since the bounds were made, and sums of what is assigned."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None, chunk: int = 1 << 22):
        self.c, self.moved, self.lists = centroids, moved, Lists(centroids)
        self.chunk = chunk
        self.sums, self.counts = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        self.scanned = self.searched = 0
        if moved is not None:
            first = int(moved.argmax())
            rest = np.delete(moved, first)
            self.others = np.full(len(moved), moved[first])
            self.others[first] = rest.max(initial=0.0)

    def everywhere(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Assignment and bounds of vectors that have none yet."""
        step = max(1, self.chunk // len(self.c))
        found = [two_nearest(squares(v[i : i + step], self.c)) for i in range(0, len(v), step)]
        a, least, second = (np.concatenate(x) for x in zip(*found))
        return a.astype(np.int32), np.sqrt(least.astype(np.float64)) * (1 + MARGIN), second * (1 - MARGIN)

    def again(self, v: np.ndarray, a: np.ndarray, u: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Assignment and bounds from those before the centroids moved."""
        a, u, l = a.copy(), (u + self.moved[a]) * (1 + MARGIN), l - self.others[a]
        l -= np.abs(l) * MARGIN
        known, at = np.unique(a, return_inverse=True)
        gap = np.array([self.lists.gap(int(x)) for x in known])[at]
        bound = np.maximum(l, gap / 2) * (1 - MARGIN)
        rows = np.flatnonzero(~(u < bound))
        u[rows] = np.sqrt(own_squares(v[rows], self.c[a[rows]]).astype(np.float64)) * (1 + MARGIN)
        rows = rows[~(u[rows] < bound[rows])]
        self.searched += len(rows)
        before = a[rows]
        for x in np.unique(before).tolist():
            mine = rows[before == x]
            d, order = self.lists.of(x)
            radius = (2 * u[mine] + (gap[mine] if len(d) > 1 else 0)) * (1 + MARGIN) + MARGIN
            n = np.searchsorted(d, radius, side="right")
            width = np.minimum(len(d), 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
            for w in np.unique(width).tolist():
                some = mine[width == w]
                near = np.sort(order[:w])  # of equal distances the smaller number comes first
                step = max(1, self.chunk // w)
                for i in range(0, len(some), step):
                    part = some[i : i + step]
                    k, least, second = two_nearest(squares(v[part], self.c[near]))
                    self.scanned += len(part) * w
                    a[part], u[part], l[part] = near[k], np.sqrt(least.astype(np.float64)) * (1 + MARGIN), second * (1 - MARGIN)
        return a, u, l

    def add(self, v: np.ndarray, a: np.ndarray) -> None:
        order = np.argsort(a, kind="stable")
        there, begin, n = np.unique(a[order], return_index=True, return_counts=True)
        self.sums[there] += np.add.reduceat(v[order].astype(np.int64), begin, axis=0)
        self.counts[there] += n


STATE = "block long, cluster binary, upper binary, lower binary, place int, task int, counts binary"


def assigned(held: DataFrame, state: DataFrame | None, centroids: np.ndarray, moved: np.ndarray | None, size: int) -> DataFrame:
    """A row for each block with clusters and bounds, and each task's sums as packed counts (see `summed`)."""
    read = held.select("block", "vectors")
    if state is not None:
        read = read.join(state.filter("block is not null").select("block", "cluster", "upper", "lower"), "block")

    def rows(batches):
        now, task = Round(centroids, moved), TaskContext.get().partitionId()
        names = ["block", "cluster", "upper", "lower", "place", "task", "counts"]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types)], names=names)

        for b in batches:
            for i in range(b.num_rows):
                v = np.frombuffer(b.column(1)[i].as_py(), dtype="<i4").reshape(-1, size)
                if moved is None:
                    a, u, l = now.everywhere(v)
                else:
                    a, u, l = now.again(v, *(np.frombuffer(b.column(k)[i].as_py(), dtype=t) for k, t in ((2, "<i4"), (3, "<f8"), (4, "<f8"))))
                now.add(v, a)
                yield row(b.column(0)[i].as_py(), a.astype("<i4").tobytes(), u.tobytes(), l.tobytes(), None, None, None)
        for place, counts in packed([now.sums.ravel(), now.counts]):
            yield row(None, None, None, None, place, task, counts)

    return read.mapInArrow(rows, STATE)


def totals(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of all vectors of each centroid, folded in levels of tasks."""
    sums, counts = summed(state.filter("place is not null").select("place", "task", "counts"), [k * size, k], at_once=True)
    return sums.reshape(k, size), counts


def cluster(df: DataFrame, *, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept vector, after `rounds` rounds
    of moving centroids and one more assignment."""
    spark: SparkSession = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    c = seeds(df, k, size, scale, seed, id_col, vector_col)
    if not len(c):
        return spark.createDataFrame([], schema)
    dealt = written(blocks(df, size, scale, id_col, vector_col, block_rows), "vector-blocks")
    held = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").persist()
    state = moved = None
    for turn in range(rounds + 1):
        state = written(assigned(held, state, c, moved, size), "vector-bounds")
        if turn == rounds:
            break
        sums, counts = totals(state, len(c), size)
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], c)
        if (new == c).all():  # nothing would change any more
            break
        moved, c = np.sqrt(own_squares(new, c).astype(np.float64)) * (1 + MARGIN), new

    final = c

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                v = np.frombuffer(b.column(1)[i].as_py(), dtype="<i4").reshape(-1, size)
                a = np.frombuffer(b.column(2)[i].as_py(), dtype="<i4")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).flatten(), pa.array(a, pa.int32()), pa.array(own_squares(v, final[a]), pa.int64())], names=["vec_id", "cluster", "distance"])

    found = held.join(state.filter("block is not null").select("block", "cluster"), "block").select("ids", "vectors", "cluster")
    found = written(found.mapInArrow(rows, f"vec_id {kind}, cluster int, distance long"), "vector-clusters")
    held.unpersist()
    by = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # as many as centroids
    inertia = reduce(int.__add__, by.values(), 0)
    about = [(x, d, inertia, hashlib.sha256(",".join(map(str, final[x].tolist())).encode()).hexdigest()) for x, d in by.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
