"""Source divergence audit: how far each source's vocabulary is from every other source's, and by which terms.

Terms are runs of letters (A-Z lowered) and of characters beyond ASCII. A language keeps the terms that at least
`least_docs` of its documents have. With V kept terms and N occurrences of them in a group, a term of `count` has
p = 1 + floor(10^9 (count + 1) / (N + V)) there, and two such numbers differ by f(p, q) = floor((p - q)^2 / q).

Most terms are rare, and rare terms share their counts: terms of one language are grouped by their sparse vector of
(source, count), every pair of a distinct vector is evaluated once and multiplied by the number of its terms. A pair in
which a count is 0 depends on the other count alone, so a vector of k sources costs k * k pairs, and what is left is a
sum over the distinct counts of a source: with z for p of count 0,

    f(pa, pb) = f(za, zb) + [f(pa, zb) - f(za, zb)] + [f(za, pb) - f(za, zb)] + [f(pa, pb) - f(pa, zb) - f(za, pb) + f(za, zb)].

A task counts terms of its documents before anything is shuffled, so a hot source or language is some rows a task. Vectors
are dealt by a salt into groups of bounded size, and groups by the first source of the pair into tiles of `tile` sources.
Lists are ranked by vectors first: of a vector only its first `top` terms can be in a list.

All arithmetic is exact (whole numbers; sums stay below 2^63 as p sums to about 10^9 in a group).

Defined results: null text, lang and source are ''; a group without terms has pairs and no terms; a language of one
source has no pairs; without kept terms pairs have 0; repeated rows are documents of their own; an empty table gives no
rows; texts of any length are read whole, in slices; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

ONE = 1_000_000_000

#: Letters lowered, bytes of other characters as they are, all else a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(data: bytes, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in runs of about `most` bytes."""
    data = data.translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def counted(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = 300_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up in tasks. A row with the term '' stands for the group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def rows(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (n, d) in found.items():
                terms = [b"", *n]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(d.__getitem__, n)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                n, d = found.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for part in terms_of(text):
                    n.update(part)
                    own.update(part)
                d.update(own)
            if sum(len(n) for n, _ in found.values()) > held:
                yield from flush()
                found.clear()
        yield from flush()

    out = read.mapInArrow(rows, "lang string, source string, term binary, n long, docs long")
    return out.withColumn("term", F.col("term").cast("string"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) by long division, exact for totals below 9 * 10^15."""
    out, rest = np.zeros(np.broadcast(count, total).shape, dtype=np.int64), count + 1
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Cells:
    """Sums by cell number; what has been added is merged whenever it is many numbers."""

    def __init__(self, most: int = 2_000_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, cells: np.ndarray, values: np.ndarray) -> None:
        self.parts.append((cells.ravel(), values.ravel()))
        self.size += cells.size
        if self.size > self.most:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        cells, at = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
        sums = np.zeros(len(cells), dtype=np.int64)
        np.add.at(sums, at, np.concatenate([v for _, v in self.parts]))
        self.parts, self.size = [(cells, sums)], len(cells)
        return cells, sums


def pair_sums(index: np.ndarray, count: np.ndarray, lengths: np.ndarray, times: np.ndarray, total: np.ndarray, first: int, past: int, cells: Cells, at_once: int = 500_000) -> None:
    """Add to cells (a * sources + b, a from first to past) what distinct vectors differ from vectors of zeros.

    The vectors stand one after the other: sources (index), counts and lengths; `times` is how many terms have each.
    """
    sources = len(total)
    zero = share(np.zeros(sources, dtype=np.int64), total)
    p = share(count, total[index])
    everyone = np.arange(sources)
    # one of both counts is 0: once for each distinct count of a source
    both = np.stack([index, p])
    single, at = np.unique(both, axis=1, return_inverse=True)
    weight = np.zeros(single.shape[1], dtype=np.int64)
    np.add.at(weight, at.ravel(), np.repeat(times, lengths))
    mine = everyone[first:past]
    step = max(1, at_once // max(1, sources))
    for k in range(0, single.shape[1], step):
        a, pa_, w = single[0, k : k + step, None], single[1, k : k + step, None], weight[k : k + step, None]
        inside = ((a >= first) & (a < past)).ravel()
        if inside.any():
            base = apart(zero[a[inside]], zero[None, :])
            cells.add(a[inside] * sources + everyone, w[inside] * (apart(pa_[inside], zero[None, :]) - base))
        if len(mine):
            cells.add(mine * sources + a, w * (apart(zero[None, mine], pa_) - apart(zero[None, mine], zero[a])))
    # neither is 0
    begin = np.cumsum(lengths) - lengths
    for k in np.unique(lengths[lengths > 1]).tolist():
        rows = np.flatnonzero(lengths == k)
        entries = (begin[rows][:, None] + np.arange(k)).ravel()  # each in its turn is the first of the pair
        entries = entries[(index[entries] >= first) & (index[entries] < past)]
        row = np.searchsorted(begin, entries, side="right") - 1
        step = max(1, at_once // k)
        for i in range(0, len(entries), step):
            e, r = entries[i : i + step], row[i : i + step]
            others = begin[r][:, None] + np.arange(k)
            a, b, x, y = index[e][:, None], index[others], p[e][:, None], p[others]
            value = apart(x, y) - apart(x, zero[b]) - apart(zero[a], y) + apart(zero[a], zero[b])
            cells.add(a * sources + b, value * times[r][:, None])


EVALUATED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("vector", pa.int64()), ("value", pa.int64())])


def evaluate(vectors: pa.Table, groups: pa.Table, salt: int, tile: int, tiles: int) -> pa.Table:
    """Part sums of all pairs whose first source is in the tile, and the value of each source's part of each vector.

    vectors: vector, sources, counts, times; groups: lang, source, n, terms of all sources of one language.
    """
    order = pc.sort_indices(groups["source"].cast(pa.binary()))
    groups = groups.take(order)
    names, lang = groups["source"], groups["lang"][0].as_py()
    n, known = groups["n"].to_numpy(), groups["terms"][0].as_py()
    sources = len(n)
    first, past = sources * tile // tiles, sources * (tile + 1) // tiles
    if not known:
        a, b = (x.ravel() for x in np.meshgrid(np.arange(first, past), np.arange(sources), indexing="ij"))
        keep = a != b
        a, b = (a[keep], b[keep]) if salt == 0 else (a[:0], b[:0])
        return pa.table([pa.repeat(pa.scalar(lang), len(a)), names.take(pa.array(a)), names.take(pa.array(b)), pa.nulls(len(a), pa.int64()), pa.array(np.zeros(len(a), dtype=np.int64))], schema=EVALUATED)
    total = n + known
    cells = Cells()
    if salt == 0:
        zero = share(np.zeros(sources, dtype=np.int64), total)
        mine = np.arange(first, past)[:, None]
        cells.add(mine * sources + np.arange(sources), known * apart(zero[mine], zero[None, :]))
    lists = vectors["sources"].combine_chunks() if len(vectors) else pa.array([], pa.list_(pa.string()))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    index = pc.index_in(lists.flatten(), value_set=names.combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
    count = vectors["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(vectors) else np.zeros(0, dtype=np.int64)
    times = vectors["times"].to_numpy().astype(np.int64)
    pair_sums(index, count, lengths, times, total, first, past, cells)
    at, sums = cells.merged()
    a, b = at // sources, at % sources
    keep = a != b
    pairs = [pa.repeat(pa.scalar(lang), int(keep.sum())), names.take(pa.array(a[keep])), names.take(pa.array(b[keep])), pa.nulls(int(keep.sum()), pa.int64()), pa.array(sums[keep])]
    # terms: against the language
    row = np.repeat(np.arange(len(lengths)), lengths)
    whole = np.zeros(len(lengths), dtype=np.int64)
    np.add.at(whole, row, count)
    p, q = share(count, total[index]), share(whole, np.int64(n.sum() + known))[row]
    keep = (p > q) & (index >= first) & (index < past)
    ids = vectors["vector"].to_numpy()[row[keep]]
    terms = [pa.repeat(pa.scalar(lang), len(ids)), names.take(pa.array(index[keep])), pa.nulls(len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(apart(p[keep], q[keep]))]
    plain = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return pa.concat_tables([pa.table([plain(c) for c in part], schema=EVALUATED) for part in (pairs, terms)])


def audit(docs: DataFrame, *, least_docs: int = 3, top: int = 200, entries: int = 100_000, tile: int = 1000, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` for each other source of the language, `term` for the source's
    own `top` terms; see the module. `entries` is about how many counts a group of vectors holds."""
    counts = counted(docs, text_col=text_col, lang_col=lang_col, source_col=source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("v"))
    found = found.filter((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", F.col("v.source").alias("sources"), F.col("v.n").alias("counts"))
    found = written(found, "divergence-terms")
    kept = found.filter(F.col("term") != "")
    here = found.filter(F.col("term") == "").select("lang", F.explode("sources").alias("source"), F.lit(0).cast("long").alias("n"))
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", F.col("e.sources").alias("source"), F.col("e.counts").alias("n"))
    totals = here.unionByName(each).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    known = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = written(totals.join(known, "lang", "left").select("lang", "source", "n", F.coalesce("terms", F.lit(0)).cast("long").alias("terms")), "divergence-groups")
    vectors = kept.groupBy("lang", "sources", "counts").agg(F.count("*").alias("times"))
    vectors = written(vectors.withColumn("vector", F.monotonically_increasing_id()), "divergence-vectors")

    size = vectors.agg(F.sum(F.size("sources"))).first()[0] or 0
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    salts, tiles = max(1, math.ceil(size / entries)), max(1, math.ceil(widest / tile))
    every_tile = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    dealt = vectors.withColumn("salt", F.pmod(F.xxhash64("vector"), F.lit(salts)).cast("int")).withColumn("tile", every_tile)
    known_there = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("tile", every_tile)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return evaluate(left, right, right["salt"][0].as_py(), right["tile"][0].as_py(), tiles)

    by = ("lang", "salt", "tile")
    values = dealt.groupBy(*by).cogroup(known_there.groupBy(*by)).applyInArrow(one, "lang string, source string, other string, vector long, value long")
    values = written(values, "divergence-values")

    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = values.filter(F.col("other").isNotNull()).groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ordered)).withColumn("part", F.lit("pair"))

    # vectors that share a value share a rank, so that none that may give a term of the list is lost
    best = values.filter(F.col("vector").isNotNull()).select("lang", "source", "vector", "value")
    best = best.withColumn("place", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).filter(F.col("place") <= top).drop("place")
    same = ("lang", "sources", "counts")
    heads = kept.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy("term"))).filter(F.col("place") <= top)
    heads = heads.join(vectors.select(*same, "vector"), list(same)).select("vector", F.col("term").alias("item"))
    terms = best.join(heads, "vector").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= top)
    terms = terms.withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
