"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius.

Terms are runs of two words (the one word of a shorter text). A term's 128-bit hash votes +1 or -1 on each bit, with
weight 1 + floor(log2(times it occurs)); the signs of the sums are the fingerprint. Two texts that share half their
terms differ in about a third of the bits, unrelated ones in half.

`near` finds all distinct fingerprints within `radius` bits of each queried one. On the given tables (sf0.1), the 48
pairs of different texts with a five-word Jaccard of 0.8 or more differ in 10.5 bits at the median and 18 at most, 2 of
them in 3 or fewer; unrelated texts in 38 or more. Hence the default of 20. The bits are cut into eight blocks, and no
two fingerprints within the radius differ by more than a few bits in all of them: the queries, 16 bytes each, are sent
to the tasks and sorted by every block there (the permuted tables); a fingerprint looks up each of its blocks with up to
that many bits flipped, and what it meets is checked by counting differing bits. Fingerprints stay where they are, pairs
are counted in the tasks, and equal fingerprints are one row there, so copies aren't expanded into pairs.

Defined results: a text without words has fingerprint 0 (32 zero digits); null text is empty; repeated rows have
equal fingerprints; an empty table gives an empty result; every text is read whole. In `with_edits`, rows are in
descending order of doc_id (ties by text; null ids last); the only row of a table is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_and_text, mix64, small, words_of, written

BITS = 128
BLOCKS = 8
RADIUS = 20
_SALT = np.uint64(0x5851F42D4C957F2D)


def fingerprints(texts: list[str]) -> list[bytes]:
    """The 16-byte fingerprint of each text."""
    out = [bytes(BITS // 8)] * len(texts)
    for i, words in words_of([t.encode("utf-8", "replace") for t in texts]):
        if len(words):
            out[i] = _vote(words)
    return out


def _vote(words: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        terms = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words
        terms, times = np.unique(terms, return_counts=True)
        weight = np.frexp(times)[1]  # 1 + floor(log2(times))
        if weight.max() > 1:
            terms = np.repeat(terms, weight)
        up = np.zeros(BITS, dtype=np.int64)
        for a in range(0, len(terms), 1 << 14):
            part = terms[a : a + (1 << 14)]
            both = np.stack([part, mix64(part ^ _SALT)], axis=1).view(np.uint8)
            up += np.unpackbits(both, axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * up > len(terms)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 minus the share of bits that differ."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as 32 hexadecimal digits."""
    df = id_and_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.hex() for f in fingerprints(b.column(1).to_pylist())], pa.string())], names=["doc_id", "fingerprint"])

    return df.mapInArrow(rows, f"doc_id {kind}, fingerprint string")


_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(texts: list[str], following: list[str]) -> list[tuple]:
    """The columns for each text and the text that follows it."""
    edited = []
    for t, other in zip(texts, following):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + other[:half])
    n = len(texts)
    seen = list(dict.fromkeys([*texts, *following, *edited]))
    by = dict(zip(seen, fingerprints(seen)))
    out = []
    for i in range(n):
        own, ed = by[texts[i]], by[edited[i]]
        out.append((len(texts[i]), hashlib.sha256(edited[i].encode("utf-8", "replace")).hexdigest(), own.hex(), ed.hex(), likeness(own, ed), likeness(own, by[following[i]])))
    return out


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Each document's fingerprint and that of its edited text, whose second half is the next document's beginning.

    Texts are shuffled once, into ranges of doc_id. A range's last row has its next document in another range: those
    rows, two a range, are set aside and joined afterwards.
    """
    df = id_and_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    order = F.col("doc_id").desc_nulls_last()
    ranged = df.repartitionByRange(partitions, order) if partitions else df.repartitionByRange(order)
    ranged = ranged.sortWithinPartitions(order, "text").select("doc_id", "text", F.spark_partition_id().alias("range"))

    def rows(batches):
        def batch(ids, cols, edge, text, rng):
            cols = [pa.array(c, k) for c, k in zip(zip(*cols), _KINDS)] if cols else [pa.nulls(len(ids), k) for k in _KINDS]
            return pa.RecordBatch.from_arrays([ids, *cols, pa.array(edge, pa.string()), pa.array(text, pa.string()), pa.array(rng, pa.int32())], names=["doc_id", *_NAMES, "edge", "text", "range"])

        held_id, held_text, rng = None, None, None
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                ids, texts = part.column(0), part.column(1).to_pylist()
                if not texts:
                    continue
                if held_text is None:
                    rng = part.column(2)[0].as_py()
                    yield batch(ids.slice(0, 1), [], ["first"], texts[:1], [rng])
                else:
                    ids, texts = pa.concat_arrays([held_id, ids]), [held_text, *texts]
                held_id, held_text = ids.slice(len(ids) - 1), texts[-1]
                if len(texts) > 1:
                    n = len(texts) - 1
                    yield batch(ids.slice(0, n), _compare(texts[:-1], texts[1:]), [None] * n, [None] * n, [rng] * n)
        if held_text is not None:
            yield batch(held_id, [], ["last"], [held_text], [rng])

    done = written(ranged.mapInArrow(rows, f"doc_id {kind}, {_COLUMNS}, edge string, text string, range int"), "simhash")
    edges = done.filter("edge is not null").select("doc_id", "text", "edge", "range")
    ends = edges.filter("edge = 'last'").select("doc_id", "text", F.col("range").alias("at"))
    starts = edges.filter("edge = 'first'").select(F.col("text").alias("following"), F.col("range"))
    # the next range that has rows, the first one after the last: two rows a range, with neither ids nor texts
    turn = edges.filter("edge = 'first'").select(F.col("range").alias("at"))
    w = Window.partitionBy(F.lit(0)).orderBy("at")
    turn = turn.select("at", F.coalesce(F.lead("at").over(w), F.min("at").over(Window.partitionBy(F.lit(0)))).alias("range"))
    ends = ends.join(turn, "at").join(starts, "range").select("doc_id", "text", "following")

    def last(batches):
        for b in batches:
            if b.num_rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*_compare(b.column(1).to_pylist(), b.column(2).to_pylist())), _KINDS)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *_NAMES])

    return done.filter("edge is null").select("doc_id", *_NAMES).unionByName(ends.mapInArrow(last, f"doc_id {kind}, {_COLUMNS}"))


class _Tables:
    """Queried fingerprints, sorted by each of the blocks; finds those within radius bits of others."""

    def __init__(self, queries: np.ndarray, radius: int):
        self.queries, self.radius = queries, radius
        # a pair that differs by more than reach[t] bits in every block t differs by more than radius in all
        self.reach = np.array([(radius + 1 + t) // BLOCKS - 1 for t in range(BLOCKS)])
        masks = np.arange(1 << 16)
        ones = np.bitwise_count(masks)
        keys = queries.view(np.uint16)
        self.tables = []
        for t, most in enumerate(self.reach):
            if most >= 0:
                starts = np.zeros((1 << 16) + 1, dtype=np.int64)
                np.cumsum(np.bincount(keys[:, t], minlength=1 << 16), out=starts[1:])
                self.tables.append((t, masks[ones <= most], starts, np.argsort(keys[:, t], kind="stable")))

    def pairs(self, prints: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each pair (query, row of prints, distance) of different fingerprints once, in parts of about `most` candidates."""
        keys = prints.view(np.uint16).astype(np.int64)
        for t, flips, starts, order in self.tables:
            step = max(1, most // len(flips))
            for a in range(0, len(prints), step):
                looked = (keys[a : a + step, t, None] ^ flips).ravel()
                times = starts[looked + 1] - starts[looked]
                met = np.flatnonzero(times)
                ends = np.cumsum(times[met])
                i = 0
                while i < len(met):
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
                    n = times[met[i:j]]
                    shift = starts[looked[met[i:j]]] - (np.cumsum(n) - n)
                    query = order[np.arange(n.sum()) + np.repeat(shift, n)]
                    row = np.repeat(a + met[i:j] // len(flips), n)
                    differ = self.queries[query] ^ prints[row]
                    distance = np.bitwise_count(differ).sum(axis=1, dtype=np.int32)
                    near = np.flatnonzero((distance <= self.radius) & (distance > 0))
                    # a pair is reported by the first block that finds it
                    by_block = np.bitwise_count(differ[near].view(np.uint16))
                    near = near[~(by_block[:, :t] <= self.reach[:t]).any(axis=1)]
                    if len(near):
                        yield query[near], row[near], distance[near]
                    i = j


def _binary(hexes: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(hexes)), dtype=np.uint64).reshape(-1, 2)


def _searched(prints: DataFrame, queries: DataFrame, radius: int, rows: Callable, columns: str, most: int) -> DataFrame:
    """What `rows` makes of tables of queries and batches of distinct fingerprints; a pass for every `most` queries."""
    if not 0 <= radius < 5 * BLOCKS:
        raise ValueError(f"radius must be from 0 to {5 * BLOCKS - 1}")
    spark = prints.sparkSession
    asked = written(queries.select("fingerprint").filter("fingerprint is not null").distinct(), "simhash-queries")
    passes = -(-asked.count() // most)
    # the search is what costs, so the few bytes of a fingerprint mustn't decide how many tasks share it
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    distinct = prints.select("fingerprint").filter("fingerprint is not null").distinct().repartition(tasks, "fingerprint")
    if passes > 1:
        distinct = written(distinct, "simhash-prints")
    out = None
    for i in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("fingerprint"), F.lit(passes)) == i)
        held = spark.sparkContext.broadcast(_binary(part.toArrow().column("fingerprint").to_pylist()))
        one = distinct.mapInArrow(lambda batches, held=held: rows(_Tables(held.value, radius), batches), columns)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], columns) if out is None else out


def near(prints: DataFrame, queries: DataFrame, *, radius: int = RADIUS, most: int = 1 << 20) -> DataFrame:
    """Pairs (query, fingerprint, distance) of distinct fingerprints within radius bits; both inputs hold `fingerprint`."""

    def rows(tables: _Tables, batches):
        for b in batches:
            hexes = b.column(0).to_pylist()
            for query, row, distance in tables.pairs(_binary(hexes)):
                cols = [pa.array([tables.queries[q].tobytes().hex() for q in query], pa.string()), pa.array([hexes[r] for r in row], pa.string()), pa.array(distance, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["query", "fingerprint", "distance"])

    return _searched(prints, queries, radius, rows, "query string, fingerprint string, distance int", most)


def count_near(prints: DataFrame, queries: DataFrame, *, radius: int = RADIUS, most: int = 1 << 20) -> DataFrame:
    """(fingerprint, n): how many other distinct fingerprints lie within radius bits of each queried one, if any do.

    Counted in tasks before the shuffle, so a large group of near copies isn't expanded into pairs.
    """

    def rows(tables: _Tables, batches):
        n = np.zeros(len(tables.queries), dtype=np.int64)
        for b in batches:
            for query, _, _ in tables.pairs(_binary(b.column(0).to_pylist())):
                n += np.bincount(query, minlength=len(n))
        found = np.flatnonzero(n)
        for a in range(0, len(found), 10_000):
            part = found[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([tables.queries[q].tobytes().hex() for q in part], pa.string()), pa.array(n[part])], names=["fingerprint", "n"])

    return _searched(prints, queries, radius, rows, "fingerprint string, n long", most).groupBy("fingerprint").agg(F.sum("n").alias("n"))


def with_counts(prints: DataFrame, counts: DataFrame, *, salts: int = 32, name: str = "near_fingerprints") -> DataFrame:
    """prints with the count of their fingerprint (0 if it has none). Counts are broadcast if they are small enough, else
    each meets its rows in `salts` places, so that a fingerprint with very many rows isn't one task."""
    counts = written(counts.select("fingerprint", F.col("n").alias(name)), "simhash-counts")
    hinted = small(counts)
    if hinted is not counts:
        out = prints.join(hinted, "fingerprint", "left")
    else:
        spread = counts.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
        out = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(spread, ["fingerprint", "salt"], "left").drop("salt")
    return out.select(*prints.columns, F.coalesce(name, F.lit(0)).cast("long").alias(name))
