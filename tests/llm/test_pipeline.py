"""The pipeline on the smallest tables against plain versions of its stages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from bagflow.llm._common import written

from .test_operators import PLAIN, brute_components, valid, words


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "stage")
        seen.append(docs.toPandas())
        if name != "best-fit packing":
            assert docs.columns == columns
    start, good, single, clean, private, packed = seen
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = labels.index.isin(good.doc_id)
    assert (kept == (labels == 1)).mean() > 0.9 and set(good.doc_id) <= set(start.doc_id)

    good = good.sort_values("doc_id").reset_index(drop=True)
    comp, _ = brute_components(list(good.text), 5, 80, 100)
    assert sorted(single.doc_id) == sorted(good.doc_id[i] for i in set(comp))

    items = [" ".join(words(t)) for t in spark.read.parquet(f"{sf}/benchmark.parquet").toPandas().text]
    leaks = {i for i, t in zip(single.doc_id, single.text) if any(f" {q} " in f" {' '.join(words(t))} " for q in items)}
    assert set(clean.doc_id) == set(single.doc_id) - leaks

    before = clean.set_index("doc_id").text
    for i, t, n in zip(private.doc_id, private.text, private.n_chars):
        assert n == len(t)
        found = [m for k, p in PLAIN.items() for m in re.finditer(p, before[i]) if valid(k, m.group())]
        if not found and "[TERM]" not in t:
            assert t == before[i]
        assert all(m.group() not in t for m in found)
    assert set(private.doc_id) == set(clean.doc_id) == set(packed.doc_id)


def staged(spark, docs, sf):
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, sf), "stage")
        if name != "best-fit packing":
            assert docs.columns == columns
        yield name, docs


def test_stages_of_odd_rows(spark, sf):
    """Null ids, nulls in any column, empty texts, repeated rows, and columns with names that operators use themselves."""
    real = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["key", "size", "base", "spans", "root", "score", "cid", "held_out", "piece", "text_hash", "pii_text", "row"]
    clashing = {n: F.lit(i).cast("long") for i, n in enumerate(names)}
    some = real.limit(60)
    null = {c: F.lit(None).cast(t) for c, t in real.dtypes}
    odd = some.limit(3).withColumn("doc_id", null["doc_id"]).unionByName(some.limit(2).withColumns({c: null[c] for c in ("lang", "source", "n_chars")})).unionByName(some.limit(1).withColumns(null)).unionByName(some.limit(2).withColumn("text", F.lit("")))
    docs = real.unionByName(odd).unionByName(some.limit(5)).withColumns(clashing)
    seen = {}
    for name, out in staged(spark, docs, sf):
        seen[name] = out.toPandas()
    for out in list(seen.values())[:-1]:
        assert all((out[n] == i).all() for i, n in enumerate(names)) and len(out)
    texts = seen["n-gram Jaccard join"]
    assert not texts[texts.doc_id.notna()].duplicated(["doc_id", "text"]).any()
    kept = seen["PII"]
    assert sorted(kept.doc_id.dropna().unique()) == sorted(seen["best-fit packing"].doc_id.dropna().unique())


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert all(out.count() == 0 for _, out in staged(spark, docs, sf))
