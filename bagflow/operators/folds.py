"""Folds by any commutative and associative Python function, in two phases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def fold(df: DataFrame, key: str, value: str, fn: Callable, *, init: object = None, name: str = "value", flush: int = 200_000, arrays: bool = False) -> DataFrame:
    """The fold of every key's values (null values left out). Each task folds what it has of a key before the shuffle,

    so a key's group holds at most one partial per task and flush, however many values it has. With `arrays`, fn also
    takes two numpy arrays and folds them place by place (as operators and ufuncs do), and is called some twenty times a
    flush instead of once a row.
    """
    if arrays:
        return _fold_arrays(df, key, value, fn, init, name, flush)
    k, v = df.schema[key].dataType.simpleString(), df.schema[value].dataType.simpleString()

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            pdf = pdf[pdf[value].notna()]
            for key_, x in zip(pdf[key].tolist(), pdf[value].tolist()):
                held[key_] = fn(held[key_], x) if key_ in held else x
            if len(held) > flush:
                yield pd.DataFrame({key: list(held), value: list(held.values())})
                held = {}
        if held:
            yield pd.DataFrame({key: list(held), value: list(held.values())})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = reduce(fn, pdf[value].tolist())
        return pd.DataFrame({key: [pdf[key].iloc[0]], name: [out if init is None else fn(init, out)]})

    parts = df.select(key, value).mapInPandas(partial, f"{key} {k}, {value} {v}")
    return parts.groupBy(key).applyInPandas(whole, f"{key} {k}, {name} {v}")


def halved(codes: np.ndarray, values: np.ndarray, fn: Callable) -> tuple[np.ndarray, np.ndarray]:
    """One value for each code, codes ascending: neighbours of one code are folded, all codes at once, until each has one."""
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order]
    while len(codes):
        start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        if len(start) == len(codes):
            break
        place = np.arange(len(codes)) - np.repeat(start, np.diff(np.r_[start, len(codes)]))
        left = np.flatnonzero(place % 2 == 0)
        paired = np.r_[codes[1:] == codes[:-1], False][left]
        out = values[left].copy()
        out[paired] = fn(values[left[paired]], values[left[paired] + 1])
        codes, values = codes[left], out
    return codes, values


def _fold_arrays(df: DataFrame, key: str, value: str, fn: Callable, init: object, name: str, flush: int) -> DataFrame:
    """Both phases on Arrow batches; the second reads partials sorted by key, so it holds a batch and one open key."""
    schema = df.select(key, value).schema
    k, v = (f.dataType.simpleString() for f in schema)

    def folded(t: pa.Table) -> pa.RecordBatch:
        t = t.filter(t.column(1).is_valid())
        keys = t.column(0).combine_chunks().dictionary_encode("encode")
        codes, values = halved(keys.indices.to_numpy(), t.column(1).to_numpy(), fn)
        return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(codes)), pa.array(values, t.schema.field(1).type)], names=[key, value])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= flush:
                held = [folded(pa.Table.from_batches(held))]
                n = held[0].num_rows
                if n >= flush // 2:
                    yield held.pop()
                    n = 0
        if held:
            yield folded(pa.Table.from_batches(held))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(b: pa.RecordBatch) -> pa.RecordBatch:
            values = b.column(1).to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1) if init is None else pa.array(fn(np.full(len(values), init, dtype=values.dtype), values), b.schema.field(1).type)], names=[key, name])

        held: list[pa.RecordBatch] = []
        for b in batches:
            got = folded(pa.Table.from_batches([*held, b]))
            if got.num_rows > 1:
                yield done(got.slice(0, got.num_rows - 1))
            held = [got.slice(max(0, got.num_rows - 1))]  # its key may go on in the next batch
        if held:
            yield done(held[0])

    parts = df.select(key, value).mapInArrow(partial, f"{key} {k}, {value} {v}")
    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(whole, f"{key} {k}, {name} {v}")
