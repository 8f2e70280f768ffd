"""Bag algebra, folds and keyed bags by the scripts of FIXTURES.md, and against Counter on random bags."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bagflow.functions import scalars
from bagflow.operators import bags, folds, keyed
from bagflow.sources import readers, sinks


def one(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value long")


def two(spark, text):
    return spark.createDataFrame([(x[0], int(x[1:])) for x in text.split()], "key string, value long")


def bag(df):
    return Counter(tuple(r) if len(r) > 1 else r[0] for r in df.collect())


def add(a, b):
    return a + b


def test_reduce(spark):
    for values, total in (([1], 1), ([1, 2, 3], 6), ([3, 3], 6), ([1, 2, 3, 3, 3, 10, 10], 32)):
        df = one(spark, values)
        assert bag(bags.bag_reduce(df, "s", F.sum("value"))) == Counter([total])
        assert bag(bags.bag_reduce(df, "s", F.sum("value"), init=-1, combine=add)) == Counter([total - 1])
    empty = one(spark, [])
    assert bags.bag_reduce(empty, "s", F.sum("value")).count() == 0
    assert bag(bags.bag_reduce(empty, "s", F.sum("value"), init=-1, combine=add)) == Counter([-1])


def test_reduce_by_key(spark):
    df = two(spark, "a1 a2 a3 b1 b2")
    assert bag(keyed.reduce_by_key(df, "key", "s", F.sum("value"))) == Counter([("a", 6), ("b", 3)])
    assert bag(keyed.reduce_by_key(df, "key", "s", F.sum("value"), init=-1, combine=add)) == Counter([("a", 5), ("b", 2)])
    assert bag(folds.fold(df, "key", "value", lambda a, b: a * b, init=2, name="p")) == Counter([("a", 12), ("b", 4)])


def test_keyed(spark):
    df = two(spark, "a1 b1 a2 b2 b3")
    assert bag(keyed.filter_key_size(df, "key", 3)) == Counter([("b", 1), ("b", 2), ("b", 3)])
    assert bag(keyed.map_by_key(two(spark, "a1 a1 b1 b2"), "key", value=F.col("value") + 1)) == Counter([("a", 2), ("a", 2), ("b", 2), ("b", 3)])
    assert bag(keyed.filter_by_key(two(spark, "a1 b1 a2"), scalars.is_even(F.col("value")))) == Counter([("a", 2)])
    pairs = keyed.to_pairs(two(spark, "a1 b1 b2 b2"), "key", "value").select("pair.key", "pair.value")
    assert bag(pairs) == Counter([("a", 1), ("b", 1), ("b", 2), ("b", 2)])


def test_multiplicities_and_majority(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",)], "value string")
    assert bag(bags.multiplicities(df)) == Counter([("a", 1), ("b", 2), ("c", 2)])
    assert bag(bags.majority(df, "value")) == Counter([("b", 2)])
    empty = df.filter("value = 'z'")
    assert bags.majority(empty, "value").count() == 0
    assert bag(bags.majority(empty, "value", init=True)) == Counter([(None, -1)])


def test_maps(spark):
    df = one(spark, [1, 1, 2, 3])
    assert bag(bags.bag_map(df, v=F.col("value") + 1)) == Counter([2, 2, 3, 4])
    assert bag(bags.bag_map(df, v=F.lit(42))) == Counter([42] * 4)
    assert bag(bags.bag_map(bags.to_weighted(df), weighted=True, v=F.col("value") % 2)) == Counter([(1, 3), (0, 1)])


def test_set_scripts(spark):
    steps = [(1, 1), (2, 2), (1, 2), (1, 1)]
    union = [[1], [1, 2], [1, 2], [1, 1, 2]]
    subtract = [[1], [1], [], [1]]
    for k in range(1, 5):
        l, r = (one(spark, [v for v, s in steps[:k] if s == side]) for side in (1, 2))
        assert bag(bags.bag_union(l, r)) == Counter(union[k - 1])
        assert bag(bags.bag_subtract(l, r)) == Counter(subtract[k - 1])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_set_operations(spark, left, right):
    l, r = one(spark, left), one(spark, right)
    a, b = Counter(left), Counter(right)
    for weighted in (False, True):
        x, y = (bags.to_weighted(l), bags.to_weighted(r)) if weighted else (l, r)
        for fn, want in ((bags.bag_union, a | b), (bags.bag_subtract, a - b), (bags.bag_intersection, a & b)):
            out = fn(x, y, weighted=weighted)
            assert bag(bags.from_weighted(out) if weighted else out) == want


def test_direction(spark):
    rows = spark.createDataFrame([(0.5, 0.5, 0.1, 0.1), (0.1, 0.9, 0.1, 0.1), (0.1, 0.1, 0.1, 0.9), (0.1, 0.1, 0.9, 0.1)], "a double, b double, c double, d double")
    label = lambda **o: [r[0] for r in rows.select(scalars.direction(*[F.col(c) for c in "abcd"], **o)).collect()]
    assert label() == ["south", "north", "south", "west"]
    assert label(fix_east=True)[0] == "east"


def test_pairwise_latest_takes_the_first_of_equal_times(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "a", 7), (1, "b", 1)], "seq long, key string, t long")
    r = keyed.pairwise_latest(df, "key", "seq", "t").collect()
    assert [(x["newer"]["seq"], x["older"]["seq"]) for x in r] == [(2, 3)]


def test_delimited_lines(spark):
    df = spark.createDataFrame([("u1;0.5;0.25;x",), ("u2;zz;0.25;y",), ("short",), (None,)], "line string")
    good, bad = readers.parse_delimited(df, {"user": "string", "lat": "double", "lon": "double", "tag": "string"})
    assert bag(good) == Counter([("u1", 0.5, 0.25, "x")])
    assert bag(bad) == Counter(["u2;zz;0.25;y", "short", None])


def test_sinks(spark, tmp_path):
    df = two(spark, "a1 a2")
    assert bag(sinks.whole(df)) == Counter(['[{"key":"a","value":1},{"key":"a","value":2}]'])
    assert bag(sinks.flat(df)) == Counter(['{"key":"a","value":1}', '{"key":"a","value":2}'])
    with pytest.raises(Exception, match="more than 1 rows"):
        sinks.whole(df, most_rows=1).collect()
    sinks.write_flat(df, str(tmp_path / "out"))
    assert readers.read_bag(spark, str(tmp_path / "out"), "key string, value long", "json").count() == 2


def test_words(spark):
    df = spark.createDataFrame([("a b\n a #x #yy",)], "t string")
    assert df.select(scalars.words(F.col("t"))).first()[0] == ["a", "b", "a", "#x", "#yy"]
    assert df.select(scalars.hashtags(F.col("t"))).first()[0] == ["x", "yy"]


def test_folds_of_arrays(spark):
    import random

    import numpy as np

    from bagflow.operators import folds

    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None, *"cdefgh"]), rnd.choice([None, *range(100)])) for _ in range(3000)] + [("only nulls", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    for fn, init, one in ((lambda a, b: a ^ b, None, lambda vs: __import__("functools").reduce(lambda a, b: a ^ b, vs)), (np.maximum, 55, lambda vs: max(55, *vs)), (np.add, -1, lambda vs: sum(vs) - 1)):
        for flush in (200_000, 50):
            got = folds.fold(df, "k", "v", fn, init=init, name="x", arrays=True, flush=flush).collect()
            assert {r["k"]: r["x"] for r in got} == {k: one(vs) for k, vs in want.items()} and len(got) == len(want)
    assert folds.fold(df.limit(0), "k", "v", np.add, arrays=True).collect() == []
