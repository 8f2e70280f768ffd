"""State of a stream in a table of buckets that foreachBatch functions keep.

A version of the table is a manifest: which folder holds each bucket. A batch writes new folders for the buckets that it
touches, then its manifest; the others stay where they are, so a batch costs what it touches. A batch that is repeated
reads the version before it again and replaces its own folders, so results are exactly-once. The last `keep` versions
can be read; what none of them uses any more is deleted. A folder or version that should be there but isn't is an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Buckets:
    """The versions of one state table, under a folder that all executors share.

    Rows are dealt into `buckets` by a hash of the columns `by` (null is a value). Entries of a manifest may carry a mark,
    such as the smallest time in a bucket, by which later batches know whether they need it.
    """

    def __init__(self, spark: SparkSession, path: str, by: Iterable[str] = (), buckets: int = 64, *, keep: int = 3):
        self.spark, self.path, self.by, self.buckets, self.keep = spark, path.rstrip("/"), list(by), buckets, keep

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def newest(self, below: int | None = None) -> int:
        """The last version (below a batch); -1 before the first."""
        p, fs = self._file("versions")
        there = [int(n) for s in fs.listStatus(p) if (n := s.getPath().getName()).isdigit()] if fs.exists(p) else []
        return max((n for n in there if below is None or n < below), default=-1)

    def version(self, epoch: int) -> dict:
        """The manifest after a batch: entries by bucket, each with its folder and mark; and notes."""
        if epoch < 0:
            return {"entries": {}, "notes": {}, "schema": None}
        p, fs = self._file(f"versions/{epoch}")
        if not fs.exists(p):
            raise RuntimeError(f"{self.path} has no state of batch {epoch}: it was moved or removed, or belongs to another checkpoint")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, epoch: int, found: dict) -> None:
        # under another name first: a manifest is there whole or not at all
        part, fs = self._file(f"versions/_{epoch}")
        stream = fs.create(part, True)
        stream.write(json.dumps(found).encode())
        stream.close()
        p, _ = self._file(f"versions/{epoch}")
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(part, p):
            raise RuntimeError(f"{self.path}: the manifest of batch {epoch} can't be written")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[str]:
        """The buckets that rows lie in: at most as many as there are."""
        return [str(r[0]) for r in rows.select(self.bucket()).distinct().collect()]

    def read(self, epoch: int, schema: StructType, only: Iterable[str] | None = None) -> DataFrame:
        """The rows after a batch, of some buckets or all."""
        entries = self.version(epoch)["entries"]
        wanted = [e["folder"] for b, e in entries.items() if only is None or b in only]
        for folder in wanted:
            p, fs = self._file(folder)
            if not fs.exists(p):
                raise RuntimeError(f"{self.path} has lost {folder}, which batch {epoch} needs")
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{w}" for w in wanted])

    def write(self, epoch: int, rows: DataFrame, touched: Iterable[str], *, bucket: Column | None = None, mark: Column | None = None, notes: dict | None = None, before: int | None = None) -> dict:
        """Replace the touched buckets by rows (all their rows; a bucket without any goes), and commit the version.

        The version before is that of the batch before, unless `before` names it.
        """
        before = self.version(epoch - 1 if before is None else before)
        entries = {b: e for b, e in before["entries"].items() if b not in set(touched)}
        folder = f"rows/{epoch}"
        dealt = rows.withColumn("__bucket", self.bucket() if bucket is None else bucket)
        dealt.hint("rebalance", "__bucket").write.partitionBy("__bucket").mode("overwrite").parquet(f"{self.path}/{folder}")
        p, fs = self._file(folder)
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        marks = {}
        if mark is not None and names:
            there = self.spark.read.schema(StructType([*rows.schema.fields]).add("__bucket", "string")).parquet(f"{self.path}/{folder}")
            marks = {r[0]: r[1] for r in there.groupBy("__bucket").agg(mark).collect()}  # one row a bucket
        for name in names:
            b = name.partition("=")[2]
            entries[b] = {"folder": f"{folder}/{name}", "mark": marks.get(b)}
        found = {"entries": entries, "notes": before["notes"] | (notes or {}), "schema": rows.schema.jsonValue()}
        self._commit(epoch, found)
        self._forget(epoch - self.keep)
        return found

    def _forget(self, epoch: int) -> None:
        """Delete a version, and the folders that the one after it doesn't use."""
        p, fs = self._file(f"versions/{epoch}")
        if epoch < 0 or not fs.exists(p):
            return
        after = {e["folder"] for v in range(epoch + 1, epoch + self.keep + 1) if fs.exists(self._file(f"versions/{v}")[0]) for e in self.version(v)["entries"].values()}
        for e in self.version(epoch)["entries"].values():
            if e["folder"] not in after:
                old, _ = self._file(e["folder"])
                fs.delete(old, True)
        fs.delete(p, False)

    def snapshot(self, epoch: int | None = None) -> DataFrame:
        """All rows after a batch (the newest by default), as its notes say they are to be filtered."""
        epoch = self.newest() if epoch is None else epoch
        found = self.version(epoch)
        if found["schema"] is None:
            raise RuntimeError(f"{self.path} has no version yet")
        rows = self.read(epoch, StructType.fromJson(found["schema"]))
        return rows.filter(found["notes"]["where"]) if "where" in found["notes"] else rows


Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]]


def stateful(state_path: str, by: Iterable[str], step: Step, state_schema: Callable[[DataFrame], StructType], *, out: str | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps state by the columns `by`.

    For each batch, `step` gets the state of the touched buckets and the batch's rows, and gives those buckets' new state
    and the batch's results, which are written to `out` as a part of their own. All work is Spark's; nothing is collected
    but the numbers of touched buckets.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        table = Buckets(spark, state_path, by, buckets)
        rows = rows.persist()
        try:
            touched = table.touched(rows)
            old = table.read(epoch - 1, state_schema(rows), touched)
            state, results = step(old, rows)
            table.write(epoch, state, touched)
            if results is not None:
                results.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        finally:
            rows.unpersist()

    return batch


def results(spark: SparkSession, out: str, batch: int | None = None) -> DataFrame:
    """What a stateful batch function has written: of all batches, or of one."""
    return spark.read.parquet(out if batch is None else f"{out}/batch={batch}").drop("batch")
