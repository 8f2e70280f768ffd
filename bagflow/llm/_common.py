"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def written(df: DataFrame, label: str, *, codec: str = "lz4") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000, megabytes: int = 32) -> DataFrame:
    """df (a written table) with a broadcast hint if it has at most that many rows and bytes; else joins shuffle."""
    width = F.lit(0)
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("array", "map", "struct"):
            c = F.to_json(F.struct(c))
        width = width + (F.coalesce(F.octet_length(c), F.lit(0)) + 8 if kind in ("array", "map", "struct", "string", "binary") else F.lit(8))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(width.cast("long"))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= megabytes << 20 else df


def held_out(doc_id: str, folds: int):
    """True where crc32(doc_id as text) mod folds is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so extra columns of any name can't clash; null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[_LOWER]


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, dtype=np.uint64)
            up[0] = 1
            down = np.full(size, _BASE_INV, dtype=np.uint64)
            down[0] = 1
            _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of data with A-Z lowered, and their start and end bytes.

    The polynomial hash of a word is a difference of prefix sums shifted to position 0, so all words of a buffer
    are hashed by a handful of array operations; equal words have equal hashes wherever they stand.
    """
    if not data:
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), z, z
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = np.ones(len(raw) + 2, dtype=np.int8)
    gap[1:-1] = WHITE[raw]
    edge = np.diff(gap)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_letters()[raw] * up[: len(raw)], out=sums[1:])
        out = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return out, start, end


def chunks(texts: list[bytes], most: int = 1 << 20):
    """Runs of texts of about `most` bytes together (a longer text stands alone): (first, past)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system. Python workers live on from task to task, and what their allocators keep after a
    large batch would stand beside all that later stages need."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def slices(batches, rows: int = 1000):
    """Arrow batches in parts of at most `rows` rows, so that what a task derives from a batch stays small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)
    give_back()


def words_of(texts: list[bytes]):
    """Hashed words of each text: yields (index, hashes of its words) for runs of texts hashed together."""
    for a, b in chunks(texts):
        hashes, start, _ = word_hashes(b"\n".join(texts[a:b]))
        cuts = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        at = np.searchsorted(start, cuts)
        for i in range(b - a):
            yield a + i, hashes[at[i] : at[i + 1]]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of k words; of the whole sequence if it is shorter; none if empty."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        n = max(1, len(words) - k + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(min(k, len(words))):
            out = out * np.uint64(_BASE) + words[j : j + n]
    return np.unique(mix64(out + np.uint64(min(k, len(words)))))


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


CHUNK = 1 << 16


def packed(arrays: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Chunks of a list of count arrays that aren't all zero, as (place, compressed counts)."""
    at = 0
    for t in arrays:
        for a in range(0, len(t), CHUNK):
            part = t[a : a + CHUNK]
            if part.any():
                yield at + a // CHUNK, zlib.compress(part.astype("<i8").tobytes(), 1)
        at += -(-len(t) // CHUNK)


def tree_sum(df: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], *, fan: int = 32) -> DataFrame:
    """One row for each `place`: the rows that tasks wrote for it (place, task, further columns) folded in levels.

    At every level a group holds the rows of at most `fan` tasks (or groups of the level before), so its size depends on
    neither the number of tasks nor the input. df should be a written table, for it is read twice.
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    tasks = df.agg(F.max("task")).first()[0] or 0

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fold(pdf)
        out["place"], out["task"] = pdf["place"].iloc[0], pdf["task"].iloc[0] // fan
        return out[list(pdf.columns)]

    while True:
        df = df.groupBy("place", F.floor(F.col("task") / fan)).applyInPandas(one, columns)
        tasks //= fan
        if not tasks:
            return df


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = 0
    for c in pdf["counts"]:
        total = total + np.frombuffer(zlib.decompress(c), dtype="<i8")
    return pd.DataFrame({"counts": [zlib.compress(np.asarray(total, dtype="<i8").tobytes(), 1)]})


def summed(df: DataFrame, sizes: list[int], kind: type = np.int64, *, at_once: bool = False) -> list[np.ndarray]:
    """The sums of the count arrays that tasks packed (place int, task int, counts binary); as large as the arrays are.

    at_once fetches them in one job, for arrays of a few MB.
    """
    sums = tree_sum(df, _added).select("place", "counts")
    got = {r["place"]: r["counts"] for r in (sums.collect() if at_once else sums.toLocalIterator())}
    out, at = [], 0
    for n in sizes:
        t = np.zeros(n, dtype=kind)
        for a in range(0, n, CHUNK):
            if at + a // CHUNK in got:
                t[a : a + CHUNK] = np.minimum(np.frombuffer(zlib.decompress(got.pop(at + a // CHUNK)), dtype="<i8"), np.iinfo(kind).max)
        out.append(t)
        at += -(-n // CHUNK)
    return out
