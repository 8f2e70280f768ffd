"""Divergence audit, packing in tiers and clustering against brute force, with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from bagflow.llm import divergence, exponion, tiers

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# --- divergence -------------------------------------------------------------------------------------------------------------


def plain_audit(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        have = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in have.items() if n >= least)
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if have[t] >= least) for s in {d[1] for d in mine}}

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        whole = sum(count.values(), Counter())
        for s, c in count.items():
            pairs = [(o, sum((p(c, t) - p(d, t)) ** 2 // p(d, t) for t in kept)) for o, d in count.items() if o != s]
            terms = [(t, (p(c, t) - p(whole, t)) ** 2 // p(whole, t)) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def audit_rows():
    rnd = random.Random(4)
    words = [*string.ascii_lowercase, "The", "the", "Été", "été", "naïve", "日本", "a_b", "x9y", "[z]"]
    rows = []
    for i in range(150):
        source = rnd.choice(["s1", "s1", "s1", "s2", "é", "z", None])
        lang = rnd.choice(["en", "en", "de", None])
        rows.append((lang, source, " ".join(rnd.choices(words[: 20 if source == "s2" else None], k=rnd.choice([0, 3, 40])))))
    rows += [("en", "s1", None), ("fr", "alone", "one one one"), ("it", "a", "no terms kept"), ("it", "b", ""), ("en", "silent", "12 34"), rows[0], rows[0]]
    return rows + [("en", "rare", f"same{i % 7} same{i % 7}") for i in range(30)]


@pytest.mark.parametrize("settings", [{}, {"entries": 5, "tile": 2, "top": 4, "least_docs": 2}])
def test_audit_equals_plain_counting(spark, settings):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, i, "x", 1) for i, r in enumerate(rows)], "lang string, source string, text string, doc_id long, term string, n int").repartition(5)
    got = sorted(map(tuple, divergence.audit(docs, **settings).collect()))
    assert got == plain_audit(rows, settings.get("least_docs", 3), settings.get("top", 200))


def test_audit_of_long_texts_and_empty_tables(spark):
    text = ("Wörter, words; " * 40_000).encode()
    parts = list(divergence.terms_of(text, most=1000))
    assert len(parts) > 500 and Counter(t for p in parts for t in p) == {"wörter".encode(): 40_000, b"words": 40_000}
    assert list(divergence.terms_of(b"")) == []
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).collect() == []
    assert divergence.audit(spark.createDataFrame([(None, None, None)], "lang string, source string, text string")).collect() == []


def test_shares_by_long_division():
    rnd = np.random.default_rng(1)
    total = rnd.integers(1, 9 * 10**15, 1000)
    count = (total * rnd.random(1000)).astype(np.int64)
    assert divergence.share(count, total).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist())]


# --- packing in tiers --------------------------------------------------------------------------------------------------------


def test_sequences_are_full_and_pieces_whole(spark, sf):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    real = pd.read_parquet(f"{sf}/documents.parquet").text.head(120).tolist()
    texts = [None, "", "  ", "a", "a", *real, real[0], " ".join(real), "<|endoftext|> x"]
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, tier string, length int")
    for parts, pool in ((1, 20_000), (4, 20)):
        got = tiers.pack_tiers(docs.repartition(parts), path, pool=pool, step_tokens=4096).toPandas()
        for i, t in enumerate(texts):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
            mine = got[got.doc_id == i].sort_values("start")
            assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
            for r in mine.itertuples():
                assert zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
        steps = {}
        for s, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            size = int(g.length.sum())
            assert size <= 1024 and size & (size - 1) == 0 and (g.tier == size).all() and list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
            assert g.step_group.nunique() == 1
            steps.setdefault(g.step_group.iloc[0], []).append((size, int((g.length**2).sum())))
        for own in steps.values():
            assert len({s for s, _ in own}) == 1 and len(own) <= 4096 // own[0][0]


def test_tiers_cut_few_documents():
    rnd = np.random.default_rng(2)
    for sizes in (rnd.integers(1, 1024, 3000), rnd.integers(1, 200, 3000), np.full(100, 1023), np.full(64, 128), np.array([], dtype=int), np.array([5])):
        found = tiers.fill(sizes.tolist(), (1024, 512, 256, 128))
        held = Counter()
        for sequence in found:
            n = sum(x for _, _, x in sequence)
            assert 0 < n <= 1024 and n & (n - 1) == 0
            for item, start, n in sequence:
                held[item] += n
        assert held == Counter(dict(enumerate(sizes.tolist())))
        pieces = sum(map(len, found))
        assert pieces <= len(sizes) + -(-int(sizes.sum()) // 1024) + 10
    mixed = tiers.fill(np.clip(rnd.normal(400, 200, 5000).astype(int), 1, 1023).tolist(), (1024, 512, 256, 128))
    assert sum(map(len, mixed)) < 5000 * 1.01  # nearly all of them whole
    assert len({sum(n for _, _, n in s) for s in mixed}) >= 4


def test_steps_cost_alike():
    rnd = np.random.default_rng(3)
    sequences = [(1024, int(x)) for x in rnd.integers(1000, 1 << 20, 640)] + [(256, int(x)) for x in rnd.integers(1, 1 << 16, 100)]
    groups, n = tiers.balanced(sequences, 16 * 1024)
    cost = Counter()
    for g, (size, c) in zip(groups, sequences):
        cost[g, size] += c
    assert len(cost) == n == 40 + 2
    large = [c for (_, size), c in cost.items() if size == 1024]
    assert max(large) < 1.1 * min(large)


def test_tiers_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    out = tiers.pack_tiers(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert out.collect() == [] and out.schema["doc_id"].dataType.simpleString() == "string"
    with pytest.raises(ValueError, match="powers of two"):
        tiers.pack_tiers(docs, "", tiers=(1000,))


# --- clustering ---------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, size, scale, seed):
    good = [(i, [math.floor(scale * float(x)) for x in v], [float(x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in good if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[2]))[:k]
    c = [r[1] for r in first]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, o)), j) for j, o in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v, _ in good]
        for j in range(len(c)):
            own = [v for (_, v, _), x in zip(good, at) if x == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *reversed(nearest(v))) for i, v, _ in good]
    each = Counter()
    for _, j, d in found:
        each[j] += d
    return sorted((str(i), j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found)


def vectors(spread, n, size, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.randint(-spread, spread) / 1024 for _ in range(size)]) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    return rows + [(n, None), (n + 1, [0.5] * (size - 1)), (n + 2, [0.5] * (size + 1)), (n + 3, [nan] + [0.0] * (size - 1)), (n + 4, [inf] * size), (n + 5, [None] * size), (None, [0.25] * size), rows[0], rows[0], rows[1], (n + 6, rows[2][1])]


@pytest.mark.parametrize(("spread", "n", "size", "k", "block"), [(2, 300, 2, 9, 40), (1, 60, 3, 8, 7), (5000, 250, 4, 40, 4096), (80_000_000, 60, 3, 6, 16)])
def test_clusters_equal_plain_search(spark, spread, n, size, k, block):
    rows = vectors(spread, n, size, spread)
    df = spark.createDataFrame([(i, v, "a", 3) for i, v in rows], "vec_id long, embedding array<double>, block string, cluster int").repartition(3)
    got = exponion.cluster(df, k=k, rounds=5, size=size, block_rows=block)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_clusters(rows, k, 5, size, 1024, 3)


def test_bounds_spare_most_distances():
    rnd = np.random.default_rng(5)
    middle = rnd.integers(-10_000, 10_000, (64, 8))
    v = (middle[rnd.integers(0, 64, 4000)] + rnd.integers(-300, 300, (4000, 8))).astype(np.int32)
    c = middle + rnd.integers(-200, 200, middle.shape)
    a, u, l = exponion.Round(c, None).everywhere(v)
    new = c + rnd.integers(-20, 20, c.shape)
    moved = np.sqrt(exponion.own_squares(new, c).astype(float)) * (1 + exponion.MARGIN)
    turn = exponion.Round(new, moved)
    a, u, l = turn.again(v, a, u, l)
    d = exponion.squares(v, new)
    assert (a == d.argmin(1)).all() and turn.searched < 400 and turn.scanned < 0.1 * d.size
    assert (u * u >= d.min(1)).all() and (np.partition(d, 1, axis=1)[:, 1] >= np.where(l > 0, l, 0) ** 2).all()


def test_few_vectors_and_none(spark):
    schema = "vec_id string, embedding array<float>"
    assert exponion.cluster(spark.createDataFrame([], schema)).collect() == []
    assert exponion.cluster(spark.createDataFrame([("a", [1.0])], schema)).collect() == []
    rows = [("a", [0.5, 1.0]), ("b", [0.5, 1.0])]
    got = exponion.cluster(spark.createDataFrame(rows, schema), size=2, k=8)
    assert sorted(tuple(r) for r in got.collect()) == plain_clusters(rows, 8, 10, 2, 1024, 3)
    with pytest.raises(Exception, match="too large"):
        exponion.cluster(spark.createDataFrame([("a", [1e9, 0.0])], schema), size=2).collect()
