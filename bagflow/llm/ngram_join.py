"""Exact Jaccard join of documents on word n-grams, in the metric space of sets under d(A, B) = 1 - |A n B| / |A u B|.

With r = 1 - similarity, two documents link when d <= r.

1. Single n-grams are the first pivots. d(A, {s}) is smallest for the n-grams of A itself, and linked sets differ in less
   than (1 - similarity) * |A| of A's n-grams. So it suffices to place A in the regions of its first
   |A| - ceil(similarity * |A|) + 1 n-grams in one order that all documents share: its boundary replicas. The order is
   rarest first by a frequency sketch of fixed size over all documents; any common order is exact, this one keeps
   regions small. Each n-gram's region elects its smallest document as pivot, and regions of one pivot are one.
2. A region of more than `block` members is divided. Several of its documents become pivots; one pass over the members, in
   tasks of bounded size, takes each one's distances to all of them. Members within r of a pivot link to it and need
   not meet each other any more. Each member goes to the Voronoi region of its nearest pivot p, and into the window of
   every other pivot q with d(A, q) <= d(A, p) + 2r: by the triangle inequality, a document within r of A lies nearest
   to no other. Of a pivot's own ball, only documents stay that can be within r of one outside it, again by the triangle
   inequality. The new regions are divided in turn, until they are small.
3. In a small region, sizes and the triangle inequality |d(A, p) - d(B, p)| <= r with the region's pivot p bound the pairs
   left; bitmaps bound overlaps first, then the sets themselves decide. A task returns links that span its components
   and skips pairs that are connected already.

A region whose division makes no progress (documents far from each other that share a first n-gram) is compared in pairs
of blocks by bitmaps, and what they can't exclude by sets: exact, but quadratic in the members of that region.

Equal sets are one class from the start. Connected components are found on the link table in Spark.

Defined results: a document without words (or null text) has 0 n-grams and is its own component; with fewer words than
n, its whole sequence is its one n-gram; repeated rows and equal texts share a component; an empty table gives an
empty result; null doc_ids never name a component unless it has no other id.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import give_back, id_and_text, shingles, slices, small, tree_sum, words_of, written
from .graph import components

SKETCH_CHUNK = 1 << 16


def _sets(texts: list[str], n: int):
    """The n-gram sets of texts, as sorted arrays of 64-bit hashes."""
    out = [np.zeros(0, dtype=np.uint64)] * len(texts)
    for i, words in words_of([t.encode("utf-8", "replace") for t in texts]):
        out[i] = shingles(words, n)
    return out


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def least_overlap(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """ceil(size * num / den): a set of that size shares so many n-grams with any set it links to."""
    return -((-size * num) // den)


def _bitmap(s: np.ndarray) -> bytes:
    """One bit for each n-gram's hash, of 4 to 8 bits an n-gram; a power of two, so that maps fold to smaller ones."""
    bits = max(64, 1 << int(4 * len(s) - 1).bit_length())
    m = np.zeros(bits // 8, dtype=np.uint8)
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(m, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return m.tobytes()


def _fold(maps: np.ndarray, size: int) -> np.ndarray:
    while maps.shape[-1] > size:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] | maps[..., half:]
    return maps


_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class Join:
    """One join with its parameters: links where den * intersection >= num * union of n-word sets."""

    def __init__(self, n: int = 5, num: int = 80, den: int = 100, *, sketch_bits: int = 24, block: int = 1024, pivots: int = 8, broadcast_rows: int = 1_500_000):
        self.n, self.num, self.den, self.bits, self.block, self.pivots, self.broadcast_rows = n, num, den, sketch_bits, block, pivots, broadcast_rows

    def _small(self, df: DataFrame) -> DataFrame:
        return small(df, self.broadcast_rows, 96)

    def survey(self, docs: DataFrame) -> DataFrame:
        """Written rows of documents (doc_id, text_hash, size, key) and of the frequency sketch (place, task, counts)."""
        n, bits, chunk = self.n, self.bits, min(SKETCH_CHUNK, 1 << self.bits)
        kind = docs.schema["doc_id"].dataType.simpleString()
        docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        names = ["doc_id", "text_hash", "size", "key", "place", "task", "counts"]

        def rows(batches):
            total = np.zeros(1 << bits, dtype=np.uint8)
            ids = None
            for b in slices(batches):
                ids = b.column(0)
                sets = _sets(b.column(1).to_pylist(), n)
                if sets:
                    at, n_at = np.unique((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                    total[at] = np.minimum(total[at] + n_at, 255)
                k = len(sets)
                cols = [ids, b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            if ids is not None:
                parts = total.reshape(-1, chunk)
                some = [i for i in range(len(parts)) if parts[i].any()]
                k = len(some)
                task = [TaskContext.get().partitionId()] * k
                counts = [zlib.compress(parts[i].astype("<u2").tobytes(), 1) for i in some]
                cols = [pa.nulls(k, ids.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(some, pa.int32()), pa.array(task, pa.int32()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

        return written(docs.mapInArrow(rows, f"doc_id {kind}, text_hash long, size long, key binary, place int, task int, counts binary"), "ngram-survey")

    def sketch(self, survey: DataFrame) -> np.ndarray:
        """How often n-grams of each hash range occur (a task adds 255 at most). Its size is fixed by sketch_bits."""
        chunk = min(SKETCH_CHUNK, 1 << self.bits)

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(chunk, dtype=np.int64)
            for c in pdf["counts"]:
                total += np.frombuffer(zlib.decompress(c), dtype="<u2")
            return pd.DataFrame({"counts": [zlib.compress(np.minimum(total, 65535).astype("<u2").tobytes(), 1)]})

        out = np.zeros(1 << self.bits, dtype=np.uint16)
        rows = survey.filter("place is not null").select("place", "task", "counts")
        for r in tree_sum(rows, add).select("place", "counts").toLocalIterator():
            out[r["place"] * chunk : (r["place"] + 1) * chunk] = np.frombuffer(zlib.decompress(r["counts"]), dtype="<u2")
        return out

    def classes(self, survey: DataFrame) -> DataFrame:
        """One row per distinct set: cid, key, size and the smallest doc_id that has it."""
        out = survey.filter("place is null and size > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"))
        return written(out.withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")

    def boundaries(self, docs: DataFrame, classes: DataFrame, sketch: np.ndarray) -> DataFrame:
        """Written (cid, size, firsts, bitmap): the n-grams in whose regions a class lies, and its bitmap."""
        n, bits, num, den = self.n, self.bits, self.num, self.den
        held = docs.sparkSession.sparkContext.broadcast(sketch)
        kind = docs.schema["doc_id"].dataType.simpleString()

        def rows(batches):
            counts = held.value
            seen = set()
            for b in slices(batches):
                at, keys, firsts, sizes, maps = [], [], [], [], []
                for i, (own, s) in enumerate(zip(b.column(0).to_pylist(), _sets(b.column(1).to_pylist(), n))):
                    key = _key(s)
                    if not len(s) or (own, key) in seen:
                        continue
                    seen.add((own, key))
                    at.append(i)
                    keys.append(key)
                    sizes.append(len(s))
                    maps.append(_bitmap(s))
                    order = np.argsort(counts[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
                    take = len(s) - int(least_overlap(np.int64(len(s)), num, den)) + 1
                    firsts.append(s[order[:take]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                    names=["doc_id", "key", "size", "firsts", "bitmap"],
                )

        # one document of each class is enough; the others' rows go before anything is exploded
        rows = docs.mapInArrow(rows, f"doc_id {kind}, key binary, size long, firsts array<long>, bitmap binary")
        rows = rows.join(classes.select("key", "least", "cid"), "key").filter("doc_id <=> least")
        found = written(rows.select("cid", "size", "firsts", "bitmap"), "ngram-boundaries")
        held.unpersist()
        return found

    def memberships(self, boundaries: DataFrame) -> DataFrame:
        """Written (region, pivot, cid): each class with the pivots of its boundary n-grams, itself excepted."""
        regions = boundaries.select("cid", "size", F.explode("firsts").alias("s"))
        shared = regions.groupBy("s").agg(F.min("cid").alias("pivot"), F.max("cid").alias("most"), F.min("size").alias("low"), F.max("size").alias("high"), F.count("*").alias("n"))
        # a region of two members whose sizes are too far apart can't hold a link
        shared = shared.filter((F.col("pivot") < F.col("most")) & ((F.col("n") > 2) | (F.col("low") * self.den >= F.col("high") * self.num)))
        shared = written(shared.select("s", "pivot"), "ngram-shared")
        found = regions.join(self._small(shared), "s").filter("cid <> pivot").select("pivot", "cid").distinct()
        return written(found.select(F.col("pivot").alias("region"), "pivot", "cid"), "ngram-members")

    def divide(self, members: DataFrame, sets: DataFrame) -> tuple[list[DataFrame], DataFrame | None, DataFrame | None]:
        """Divide large regions (region, pivot, cid) again and again: links found on the way, small regions, and regions
        that can't be divided (or None)."""
        num, den, block, many = self.num, self.den, self.block, self.pivots
        reach = 1 - num / den + 1e-9
        links: list[DataFrame] = []
        done: DataFrame | None = None
        stuck: DataFrame | None = None
        level = 0
        while not members.isEmpty():
            level += 1
            sizes = written(members.groupBy("region").agg(F.count("*").alias("n")), "ngram-sizes")
            # the pivots: those members with the smallest hashes, taken in tasks before the shuffle
            order = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("cid", F.lit(level)), "cid"))
            pivots = members.select("region", "cid").withColumn("k", order).filter(F.col("k") <= many).select("region", "cid")
            chunks = F.ceil(F.col("n") / block).cast("int")
            known = self._small(sizes)
            rows = members.select("region", "cid").join(known, "region").select("region", "cid", F.pmod(F.xxhash64("cid"), chunks).cast("int").alias("chunk"), F.lit(False).alias("first"))
            firsts = pivots.join(known, "region").select("region", "cid", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(True).alias("first"))
            dealt = rows.unionByName(firsts).join(sets, "cid")

            def one(pdf: pd.DataFrame) -> pd.DataFrame:
                top, rest = pdf[pdf["first"]], pdf[~pdf["first"]]
                top = top.sort_values("cid")
                of = [np.frombuffer(g, dtype=np.uint64) for g in top["grams"]]
                names = top["cid"].to_numpy()
                out = []
                for cid, grams in zip(rest["cid"].to_numpy(), rest["grams"]):
                    own = np.frombuffer(grams, dtype=np.uint64)
                    away = np.empty(len(of))
                    for k, p in enumerate(of):
                        less, more = (own, p) if len(own) < len(p) else (p, own)
                        common = int((more[np.minimum(np.searchsorted(more, less), len(more) - 1)] == less).sum())
                        # the integers decide about links, so that 1 - num / den needn't be exact
                        linked = den * common >= num * (len(own) + len(p) - common)
                        away[k] = 1 - common / (len(own) + len(p) - common)
                        if linked and names[k] != cid:
                            away[k] = min(away[k], reach)
                        elif names[k] != cid:
                            away[k] = max(away[k], np.nextafter(reach, 1))
                    near = away.min()
                    out += [(pdf["region"].iloc[0], cid, names[k], away[k]) for k in np.flatnonzero(away <= near + 2 * reach)]
                return pd.DataFrame(out, columns=["region", "cid", "pivot", "away"]).astype({"region": "int64", "cid": "int64", "pivot": "int64", "away": "float64"})

            found = written(dealt.groupBy("region", "chunk").applyInPandas(one, "region long, cid long, pivot long, away double"), "ngram-divided")
            links.append(found.filter((F.col("away") <= reach) & (F.col("cid") != F.col("pivot"))).select(F.col("cid").alias("a"), F.col("pivot").alias("b")))
            # of a pivot's ball, only what may lie within r of a member outside it stays
            outer = found.filter(F.col("away") > reach).groupBy("region", "pivot").agg(F.min("away").alias("outer"))
            found = found.filter("cid <> pivot").join(self._small(written(outer, "ngram-outer")), ["region", "pivot"])
            found = found.filter(F.col("away") >= F.col("outer") - reach)
            parts = found.select(F.col("region").alias("parent"), F.xxhash64("region", "pivot", F.lit(level)).alias("region"), "pivot", "cid")
            parts = written(parts, "ngram-parts")
            size = parts.groupBy("region").agg(F.count("*").alias("m"), F.min("parent").alias("parent"))
            before = sizes.select(F.col("region").alias("parent"), F.col("n").alias("parent_n"))
            state = F.when(F.col("m") < block, 0).when(F.col("m") * 4 > F.col("parent_n") * 3, 2).otherwise(1)
            size = self._small(written(size.join(before, "parent").select("region", state.alias("state")), "ngram-states"))
            parts = written(parts.join(size, "region").select("region", "pivot", "cid", "state"), "ngram-regions")
            few, bad = parts.filter("state = 0").drop("state"), parts.filter("state = 2").drop("state")
            done = few if done is None else done.unionByName(few)
            stuck = bad if stuck is None else stuck.unionByName(bad)
            members = parts.filter("state = 1").drop("state")
        return links, done, stuck

    def details(self, docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
        """Written (cid, grams) of the classes in `wanted` (cid), from one document of each."""
        n = self.n
        kind = docs.schema["doc_id"].dataType.simpleString()
        wanted = self._small(written(classes.join(wanted, "cid", "left_semi").select("cid", F.col("least").alias("doc_id"), "key"), "ngram-wanted"))
        some = docs.join(wanted.select("doc_id").distinct(), docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")

        def rows(batches):
            for b in slices(batches):
                sets = _sets(b.column(1).to_pylist(), n)
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "grams"])

        found = some.mapInArrow(rows, "key binary, grams binary")
        found = found.join(wanted.select("cid", "key"), "key").drop("key")
        return written(found.dropDuplicates(["cid"]), "ngram-sets")

    def _tasks(self, members: DataFrame, details: DataFrame, *columns: str) -> DataFrame:
        """Members of every region with their details; the pivot is in all tasks. Regions that are too large (those that
        can't be divided) are dealt to pairs of blocks."""
        sizes = members.groupBy("region", "pivot").agg(F.count("*").alias("others"))
        blocks = F.ceil((F.col("others") + 1) / F.lit(self.block)).cast("int")
        own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
        pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own")),
                lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")),
            )
        )
        every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j > i) | (F.col("blocks") == 1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
        others = members.join(sizes, ["region", "pivot"]).withColumn("blocks", blocks).withColumn("own", own).select("region", "pivot", "cid", F.explode(pairs).alias("t"))
        pivots = sizes.withColumn("blocks", blocks).select("region", "pivot", F.col("pivot").alias("cid"), F.explode(every).alias("t"))
        tasks = others.unionByName(pivots).select("region", "pivot", "cid", F.col("t.i").alias("i"), F.col("t.j").alias("j"))
        return tasks.join(details.select("cid", *columns), "cid")

    def bounded(self, members: DataFrame, boundaries: DataFrame) -> DataFrame:
        """The memberships of classes that may link to another of their region, by sizes and bitmaps."""
        num, den = self.num, self.den

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("size", kind="stable")
            size = pdf["size"].to_numpy()
            maps = [np.frombuffer(m, dtype=np.uint8) for m in pdf["bitmap"]]
            keep = np.zeros(len(size), dtype=bool)
            for a in range(len(size)):
                # from a on: partners that are no smaller, nor too large
                to = int(np.searchsorted(size, size[a] * den // num, side="right"))
                if to <= a + 1:
                    continue
                width = len(maps[a])
                rest = np.stack([_fold(m, width) for m in maps[a + 1 : to]])
                missing = _ONES[maps[a] & ~rest].sum(axis=1, dtype=np.int64)
                overlap = size[a] - missing
                ok = overlap * (den + num) >= num * (size[a] + size[a + 1 : to])
                if ok.any():
                    keep[a] = True
                    keep[a + 1 : to] |= ok
            return pdf.loc[keep, ["region", "pivot", "cid"]]

        found = self._tasks(members, boundaries, "size", "bitmap").groupBy("region", "i", "j").applyInPandas(one, "region long, pivot long, cid long")
        return written(found.filter("pivot <> cid").distinct(), "ngram-bounded")

    def links(self, members: DataFrame, details: DataFrame) -> DataFrame:
        """Links (a, b) of classes that span the components of every region."""
        num, den = self.num, self.den
        reach = 1 - num / den + 1e-9

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("cid", kind="stable")
            cid = pdf["cid"].to_numpy()
            sets = [np.frombuffer(g, dtype=np.uint64) for g in pdf["grams"]]
            size = np.array([len(s) for s in sets])
            flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            group = np.arange(len(sets))
            made = []
            away = None
            # the pivot first, then the others: pairs that are connected already are skipped
            first = int(np.flatnonzero(cid == pdf["pivot"].iloc[0])[0])
            for a in [first, *(x for x in range(len(sets)) if x != first)]:
                open_ = group != group[a]
                if a != first:
                    open_ &= (size * den >= num * size[a]) & (size * num <= den * size[a]) & (np.abs(away - away[a]) <= reach)
                    open_[: a + 1] &= False
                if not open_.any():
                    continue
                if open_.all():
                    f, o = flat, own
                else:
                    pick = open_[own]
                    f, o = flat[pick], own[pick]
                at = np.minimum(np.searchsorted(sets[a], f), size[a] - 1)
                common = np.bincount(o[sets[a][at] == f], minlength=len(sets))
                union = size + size[a] - common
                if a == first:
                    away = 1 - common / union
                    away[first] = 0
                for b in np.flatnonzero(open_ & (common * den >= num * union)).tolist():
                    if group[a] != group[b]:
                        made.append((cid[a], cid[b]))
                        group[group == group[b]] = group[a]
            if len(flat) > 1 << 20:
                give_back()
            return pd.DataFrame(made, columns=["a", "b"], dtype="int64")

        return self._tasks(members, details, "grams").groupBy("region", "i", "j").applyInPandas(one, "a long, b long")

    def groups(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, text_hash, size, class_id and root (the group; null for a document without words) for every row of docs."""
        docs = id_and_text(docs, id_col, text_col)
        survey = self.survey(docs)
        classes = self.classes(survey)
        boundaries = self.boundaries(docs, classes, self.sketch(survey))
        members = self.memberships(boundaries)
        many = members.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") >= self.block).select("region")
        many = self._small(written(many, "ngram-large"))
        some = self.bounded(members.join(many, "region", "left_anti"), boundaries)
        large = members.join(many, "region", "left_semi")
        large = written(large.unionByName(large.select("region", "pivot", F.col("pivot").alias("cid")).distinct()), "ngram-to-divide")
        wanted = some.select("cid").union(some.select(F.col("pivot").alias("cid"))).union(large.select("cid")).distinct()
        sets = self.details(docs, classes, wanted)
        links, done, stuck = self.divide(large, sets)
        if done is not None:
            some = some.unionByName(done)
        if stuck is not None and not stuck.isEmpty():
            some = some.unionByName(self.bounded(stuck, boundaries))
        found = self.links(some, sets)
        for more in links:
            found = found.unionByName(more)
        root = components(found)
        named = classes.join(root, classes["cid"] == root["node"], "left").select("key", F.col("least").alias("class_id"), F.coalesce("root", "cid").alias("root"))
        rows = survey.filter("place is null").select("doc_id", "text_hash", "size", "key")
        full = rows.filter("size > 0").join(named, "key").drop("key")
        return full.unionByName(rows.filter("size = 0").select("doc_id", "text_hash", "size", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("root")))

    def run(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_shingles, class_id and component_id for every row of docs.

        class_id is the smallest doc_id with the same set (for a document without words, its own).
        """
        rows = written(self.groups(docs, id_col=id_col, text_col=text_col), "ngram-groups")
        least = self._small(written(rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "ngram-least"))
        full = rows.filter("root is not null").join(least, "root")
        none = rows.filter("root is null").withColumn("component_id", F.col("doc_id"))
        return full.unionByName(none.select(full.columns)).select("doc_id", F.col("size").alias("n_shingles"), "class_id", "component_id")


def jaccard_components(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """See Join.run; documents link when den * |intersection| >= num * |union| of their n-word sets."""
    return Join(n, num, den, **options).run(docs, id_col=id_col, text_col=text_col)


def one_of_each(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of linked ones, with all its columns: the one of the smallest id (ties: by a text hash).

    A document is an id with its text: rows that repeat both are one, an id on several texts is several documents. Rows
    without an id all stay.
    """
    found = Join(n, num, den, **options).groups(docs, id_col=id_col, text_col=text_col).filter("doc_id is not null")
    found = written(found, "ngram-found")
    least = F.min(F.struct("doc_id", "text_hash"))
    first = found.filter("root is not null").groupBy("root").agg(least.alias("k"))
    rows = found.filter("root is not null").select("root", "doc_id", "text_hash").distinct().join(first, "root")
    others = rows.filter((F.col("doc_id") != F.col("k.doc_id")) | (F.col("text_hash") != F.col("k.text_hash"))).select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"))
    others = small(written(others.distinct(), "ngram-others"), 1_500_000, 64)
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = docs.join(others, (docs[id_col] == others["other_id"]) & (own == others["other_hash"]), "left_anti")
    again = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash"))
    again = small(written(again, "ngram-again"), 1_500_000, 64)
    if again.isEmpty():
        return kept
    both = (kept[id_col] == again["again_id"]) & (own == again["again_hash"])
    return kept.join(again, both, "left_anti").unionByName(kept.join(again, both, "left_semi").dropDuplicates([id_col, text_col]))
