"""The operators against brute force on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import string
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bagflow.llm import decontaminate, html_text, lm_score, lm_spelling, ngram_join, packing, pii, quality, queries, simhash, token_counts, warc
from bagflow.llm._common import word_hashes
from bagflow.llm.graph import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   ", "one", "a a a a a a a a a", "Ünïcode  text\twith odd spaces \x1c here", "x" * 5000, "<|endoftext|> and <|startoftext|>", "I'll don't 12345 ½²"]


def frame(spark, texts, **more):
    """Documents with clashing extra columns."""
    rows = [(i, t, "s", 1.5, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, key double, size int")


@pytest.fixture(scope="module")
def real(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(real):
    return [*ODD, *real.text.head(60), *real.text.head(5)]


def words(t):
    return WORD.findall((t or "").translate(LOWER))


# --- shared hashing -------------------------------------------------------------------------------------------------------


def test_word_hashes_agree_wherever_a_word_stands():
    data = "The the THE\x0bthe\x00x é É the".encode()
    h, start, end = word_hashes(data)
    assert [data[a:b] for a, b in zip(start, end)] == data.split()
    assert h[0] == h[1] == h[2] == h[-1] and len({int(x) for x in h}) == 4


# --- 1: packing -----------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    long_text = " ".join(t or "" for t in texts) * 2
    texts = [*texts, long_text]
    got = packing.pack(frame(spark, texts), path).toPandas()
    assert sorted(got.doc_id.unique()) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length.iloc[1:] == 2048).all() and (len(mine) == 1 or len(ids) > 2048)
        for r in mine.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and list(g.offset) == [0, *np.cumsum(g.length)[:-1]]


def test_best_two_fit_is_close_to_the_bound():
    rnd = np.random.default_rng(1)
    for sizes in (rnd.integers(1, 2049, 3000), rnd.integers(600, 900, 2000), np.full(100, 1025), np.array([], dtype=int), np.array([2048, 2048])):
        bins, offsets = packing.best_two_fit(sizes, 2048)
        load = np.bincount(bins, weights=sizes) if len(sizes) else np.zeros(0)
        assert (load <= 2048).all()
        bound = max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum()))
        assert len(load) <= bound * 1.25 + 1
    assert packing._tightest_pair([3, 5, 8], {3: [1], 5: [2], 8: [3]}, 12) == (8, 3)
    assert packing._tightest_pair([5], {5: [1]}, 12) is None


# --- 2: decontamination ---------------------------------------------------------------------------------------------------


def test_decontamination(spark, sf, real):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    names = [(r["item_id"], r["text"]) for r in items.collect()]
    rnd = random.Random(2)
    planted = []
    for k, (_, t) in enumerate(names[:12]):
        w = t.split()
        if k % 3 == 1 and len(w) > 45:  # one word in many leaves over 0.8 of the runs
            w[len(w) // 3] = "changed"
        planted.append(" ".join(rnd.sample(real.text[k].split(), 5)) + " " + " ".join(w) + " " + real.text[k + 20])
    texts = [*ODD, *planted, *real.text]
    got = decontaminate.contamination(frame(spark, texts), items, block_items=17).toPandas().set_index("doc_id").sort_index()
    clean = lambda t: " ".join(words(t))
    for i, t in enumerate(texts):
        exact = {n for n, q in names if f" {clean(q)} " in f" {clean(t)} "}
        assert exact <= set(got.item_ids[i])
        if not exact and not len(ODD) <= i < len(ODD) + 12:
            assert not got.contaminated[i]
    assert got.contaminated[len(ODD) : len(ODD) + 12].all()
    kept = decontaminate.clean(frame(spark, texts), items)
    assert kept.columns == ["doc_id", "text", "score", "key", "size"]
    assert {r["doc_id"] for r in kept.collect()} == set(got.index[~got.contaminated])
    assert not decontaminate.contamination(frame(spark, texts[:20]), items.limit(0)).filter("contaminated").count()


def test_blocks_of_items_score_as_all_of_them(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([("none", None), ("one", "word")], "item_id string, text string").select(F.lit(10**6).cast(dict(spark.read.parquet(f"{sf}/benchmark.parquet").dtypes)["item_id"]).alias("item_id"), "text"))

    def weights(block):
        found = {}
        for index, ids in decontaminate._indexes(items, "item_id", "text", None, block):
            for t, ds, xs in zip(index.vocabulary.tolist(), index.docs, index.weights):
                found.update({(ids[d], index.question_words[d], len(index.answer[d]), t): x for d, x in zip(ds, xs)})
        return found

    whole, parts = weights(10**6), weights(23)
    assert whole.keys() == parts.keys() and all(abs(x - parts[k]) < 1e-9 for k, x in whole.items())


def test_wand_finds_what_brute_force_finds():
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    index = decontaminate.Index([(" ".join(rnd.choices(vocab, k=rnd.randint(2, 12))), "") for _ in range(300)])
    for _ in range(200):
        query = sorted(rnd.sample(range(len(index.vocabulary)), rnd.randint(1, 60)))
        scores = np.zeros(300)
        for t in query:
            scores[index.docs[t]] += index.weights[t]
        for threshold in (0.05, 0.2, 0.5):
            assert {d for d, _ in index.above(query, threshold)} == set(np.flatnonzero(scores >= threshold - 1e-9).tolist())


def test_one_word_items_and_one_changed_word(spark):
    rnd = random.Random(8)
    pool = [f"word{k}" for k in range(400)]
    items = [("one", "Paris"), *[(f"q{k}", " ".join(rnd.sample(pool, n)) + ". " + " ".join(rnd.sample(pool, m))) for k, (n, m) in enumerate([(12, 3), (8, 2), (25, 4), (40, 1), (6, 5)])]]
    table = spark.createDataFrame([(*x, 0) for x in items], "item_id string, text string, doc_id int")
    docs, want = ["I like Paris much", "parisian", None, ""], [["one"], [], [], []]
    for name, text in items[1:]:
        q = decontaminate.split_item(text)[0].split()
        for at in range(len(q)):
            other = text.split()
            other[at] = "changed"
            docs.append(" ".join([*rnd.sample(pool, 20), *other, *rnd.sample(pool, 20)]))
            want.append([name] if len(q) >= 8 and 0 < at < len(q) - 1 else None)
        docs.append(" ".join(rnd.sample(pool, 60)))
        want.append([])
    got = decontaminate.contamination(frame(spark, docs), table, threshold=0.6).toPandas().set_index("doc_id").sort_index()
    for k, w in enumerate(want):
        if w is not None:
            assert list(got.item_ids[k]) == w, docs[k]
    several = decontaminate.contamination(frame(spark, docs), table, block_items=2).toPandas().set_index("doc_id").sort_index()
    assert list(several.item_ids[0]) == ["one"] and not several.contaminated[1]
    kept = decontaminate.clean(frame(spark, docs), table, block_items=2)
    assert kept.count() < len(docs) and kept.filter("doc_id = 0").isEmpty()


# --- 3: n-gram join ---------------------------------------------------------------------------------------------------------


def brute_components(texts, n, num, den):
    sets = [({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}) if (w := words(t)) else set() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(rnd, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rnd.randrange(len(w))] = rnd.choice(["alpha", "beta", "gamma"]) + str(rnd.randrange(99))
    return " ".join(w)


@pytest.mark.parametrize("n,num,block", [(4, 85, 1024), (5, 80, 8)])
def test_join_equals_brute_force(spark, texts, n, num, block):
    rnd = random.Random(4)
    near = [edited(rnd, texts[12], rnd.choice([0.005, 0.01, 0.02, 0.04])) for _ in range(40)]
    chain = [texts[15]]
    for _ in range(12):
        chain.append(edited(rnd, chain[-1], 0.01))
    docs = [*texts, *near, *chain, "a b c", "A b C", "a b c d"]
    got = ngram_join.jaccard_components(frame(spark, docs), n=n, num=num, den=100, sketch_bits=12, block=block).toPandas().set_index("doc_id").sort_index()
    comp, sizes = brute_components(docs, n, num, 100)
    assert list(got.n_shingles) == sizes
    assert list(got.component_id) == comp


def test_join_without_broadcast_and_empty(spark, texts):
    docs = [*texts[:30], *texts[:5]]
    got = ngram_join.jaccard_components(frame(spark, docs), n=4, num=85, den=100, sketch_bits=10, broadcast_rows=0).toPandas().set_index("doc_id").sort_index()
    assert list(got.component_id) == brute_components(docs, 4, 85, 100)[0]
    assert ngram_join.jaccard_components(frame(spark, texts).limit(0), sketch_bits=10).count() == 0


def test_one_of_each_keeps_one(spark, texts):
    docs = frame(spark, texts)
    again = docs.unionByName(docs.filter("doc_id % 7 = 0"))
    kept = ngram_join.one_of_each(again, sketch_bits=12)
    assert kept.columns == docs.columns
    comp, _ = brute_components(texts, 5, 80, 100)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp))


@pytest.mark.parametrize("block,pivots", [(16, 3), (8, 2), (40, 8)])
def test_dividing_regions_equals_brute_force(spark, texts, block, pivots):
    """A large group of near copies, with a chain through it and documents just out of reach."""
    rnd = random.Random(9)
    near = [edited(rnd, texts[12], rnd.choice([0.002, 0.01, 0.02, 0.03, 0.05, 0.08])) for _ in range(150)]
    chain = [near[0]]
    for _ in range(20):
        chain.append(edited(rnd, chain[-1], 0.02))
    docs = [*near, *chain, *near[:30], *texts[:20]]
    got = ngram_join.jaccard_components(frame(spark, docs), n=4, num=85, den=100, sketch_bits=12, block=block, pivots=pivots).toPandas().set_index("doc_id").sort_index()
    comp, sizes = brute_components(docs, 4, 85, 100)
    assert list(got.component_id) == comp and list(got.n_shingles) == sizes
    assert 3 < len(set(comp)) < len(docs) - 40


def test_one_id_on_several_texts(spark, texts):
    a, b, c = texts[12], texts[13], texts[14]
    rows = [(1, a), (5, a), (5, b), (7, b), (5, b), (5, c), (2, ""), (2, ""), (2, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int")
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in ngram_join.one_of_each(docs, sketch_bits=12).collect())
    assert kept == sorted([(1, a), (5, b), (5, c), (2, ""), (2, ""), (0, a), (0, a)])


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (200, 203), (203, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 203: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 4: language-model scores -------------------------------------------------------------------------------------------------


def test_lm_scores(spark, texts, real):
    docs = [*texts, *real.text]
    got = lm_score.score_documents(frame(spark, docs)).toPandas().set_index("doc_id").sort_index()
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(docs))]
    split = [[*words(t), None] for t in docs]
    counts = Counter(w for own, ws in zip(out, split) if not own for w in ws)
    n, v = sum(counts.values()), len(counts)
    base = [sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for ws in split]
    assert list(got.held_out) == out and (got.train_tokens == n).all()
    assert list(got.n_tokens) == [len(ws) for ws in split] and list(got.n_known) == [sum(counts[w] > 0 for w in ws) for ws in split]
    assert np.allclose(got.base_score, base)
    assert (got.score < 0).all()
    first = {}
    for t, h, s in zip(docs, got.held_out, got.score):
        assert np.isclose(first.setdefault((t or "", h), s), s, rtol=1e-4)
    held = got[got.held_out]
    assert held.bits_per_byte.dropna().mean() < 4
    shuffled = frame(spark, ["".join(random.Random(i).sample(t, len(t))) for i, t in enumerate(real.text[:40])])
    model = lm_score.fit(frame(spark, docs))
    again = lm_score.score(frame(spark, docs), model, same_docs=True).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(again.score, got.score, rtol=1e-3)
    assert lm_score.score(shuffled, model).agg(F.avg("bits_per_byte")).first()[0] > held.bits_per_byte.mean() + 1


def learned_of(texts):
    """A scorer fitted on texts in this process, with its words."""
    counts = Counter(w for t in texts for w in [*lm_score.tokens(t), b""])
    hot = [w for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if c > 1 or w == b""]
    words = lm_score.Words(hot, np.array([counts[w] for w in hot], dtype=float), sum(c for w, c in counts.items() if c == 1 and w))
    profile = np.zeros((lm_score.PROFILE + 1) * (words.size + 1), dtype=np.int32)
    runs = [t for _, _, t in lm_score._runs(texts, words, 3000)]
    for t in runs:
        np.add.at(profile, t.frequent_before().astype(np.int64) * (words.size + 1) + t.ids, np.int32(1))
    words.shaped(profile.reshape(lm_score.PROFILE + 1, -1))
    learner = lm_score.Learner(words)
    for t in runs:
        learner.learn(lm_score.Rows(t, words, t.contexts(words), np.arange(len(t.ids))))
    alphabet = lm_spelling.Alphabet(np.bincount(np.frombuffer(b" ".join(counts), dtype=np.uint8), minlength=256))
    letters = lm_spelling.Learner(alphabet)
    rare = [w for w, c in counts.items() if c == 1 and w]
    letters.learn(rare, np.ones(len(rare), dtype=np.int32))
    letters.count()
    spelling = lm_spelling.Speller(alphabet, letters.tables, letters.weights.T, letters.refine.astype(float))
    return lm_score.Scorer(words, lm_score.frozen(words, learner.tables), learner.weights.T, learner.refine.astype(float), spelling)


def plain_score(scorer, text):
    """log10 of a text's words and letters, one decision after the other."""
    words, n = scorer.words, lm_score.INPUTS
    names = {int(h): int(s) for h, s in zip(words.hashes, words.order)}
    toks = [*lm_score.tokens(text), b""]
    ids = [words.end if not w else names.get(int(word_hashes(w)[0][0]), words.rare) for w in toks]
    begin = words.size + 1
    change, curve = np.zeros(n), np.full(n, lm_score.PATIENCE)
    grad, bend, total, block = np.zeros(n), np.zeros(n), 0.0, 0
    for i, (w, own) in enumerate(zip(toks, ids)):
        now = int(lm_score._block(np.array([i]))[0])
        if now != block:
            curve += bend
            change += grad / curve
            grad, bend, block = np.zeros(n), np.zeros(n), now
        back = [ids[i - k] if i >= k else begin for k in (1, 2, 3)]
        often = [x for x in ids[:i] if x < lm_score.FREQUENT][::-1] + [lm_score.FREQUENT] * 2
        contexts = [words.before[back[0]], often[0] * 64 + often[1], words.near[back[0]] * 256 + words.near[back[1]] * 16 + words.near[back[2]]]
        node = 1
        for d in range(int(words.length[own])):
            bit = int(words.code[own]) >> (lm_score.DEPTH - 1 - d) & 1
            slots = [int(c) * lm_score.NODES + node for c in contexts]
            share = float(words.share[node])
            x = np.array([np.log(share / (1 - share)), *(scorer.logits[k][s] for k, s in enumerate(slots)), 0.5])
            gate = d
            for k, s in enumerate(slots):
                gate = gate * 4 + int(scorer.logits[k][s : s + 1].view(np.int32)[0] & 3)
            z = float(x @ (scorer.weights[:, gate] + change))
            p = 1 / (1 + np.exp(-np.clip(z, -18, 18)))
            grad[1:-1] += ((bit - p) * x)[1:-1]
            bend[1:-1] += (p * (1 - p) * x * x)[1:-1]
            places = np.arange(lm_score.STEPS)
            p = np.interp(np.clip(z, -12, 12) * 2 + lm_score.STEPS // 2, places, scorer.refined[node * lm_score.STEPS + places])
            p = np.clip(p, 1e-7, 1 - 1e-7)
            total += np.log10(p if bit else 1 - p)
            node = node * 2 + bit
        total += words.tail[own]
        if own == words.rare:
            total += scorer.spelling.log10([w])[0]
    return total


def test_batches_score_as_one_text_after_the_other(real):
    known = [t for t in real.text.head(150) if t]
    scorer = learned_of(known)
    some = ["", "the", "Zyzzyx the of", *known[:3], " ".join(known[4:9]), *known[160:170]]
    for _, _, t in lm_score._runs(some, scorer.words, 1 << 30):
        sums = np.add.reduceat(scorer.tokens(t), t.first)
    assert np.allclose(sums, [plain_score(scorer, t) for t in some], rtol=1e-4)


def test_probabilities_sum_to_one(real):
    scorer = learned_of([t for t in real.text.head(150) if t])
    words = scorer.words
    # the first token of a text: all symbols together
    every = lm_score.Texts([b"x"], words)
    every.ids = np.arange(words.size + 1, dtype=np.int32)
    every.first, every.own, every.sizes = np.arange(words.size + 1), np.arange(words.size + 1), np.ones(words.size + 1, dtype=np.int64)
    scorer.of_rare = lambda words: np.zeros(len(words))
    assert np.sum(10.0 ** scorer.tokens(every)) == pytest.approx(1, abs=1e-4)
    # the first byte of a word
    total = 0.0
    for byte in range(256):
        own = list(scorer.spelling.bits([bytes([byte])]))[: scorer.spelling.alphabet.length[byte]]
        total += np.prod([p[0] if bit[0] else 1 - p[0] for _, bit, p in own])
    assert total == pytest.approx(1, abs=1e-4)


def test_shared_beginnings_are_spelled_once(real):
    spelling = learned_of([t for t in real.text.head(60) if t]).spelling
    some = sorted({w for t in real.text.head(40) for w in lm_score.tokens(t or "")} | {b"a", b"aa", b"aab", b"aabc", b"\xff" * 300})
    first = next(lm_spelling._Bits(some, spelling.alphabet).decisions())
    beginnings = {(w + b" ")[: k + 1] for w in some for k in range(len(w) + 1)}
    assert len(first[2]) == len(beginnings) < sum(len(w) + 1 for w in some)
    alone = [spelling.log10([w])[0] for w in some]
    assert np.allclose(spelling.log10(some), alone, rtol=1e-6)
    assert np.allclose(spelling.log10([*some[::-1], *some]), [*alone[::-1], *alone], rtol=1e-6)
    assert len(spelling.log10([])) == 0
    # learned together, in any order, as each word by itself
    counts = np.arange(1, len(some) + 1, dtype=np.int32)
    seen = []
    for turn in (1, -1):
        learner = lm_spelling.Learner(spelling.alphabet)
        learner.learn(some[::turn], counts[::turn])
        learner.count()
        seen.append(learner)
    assert all((a == b).all() for a, b in zip(seen[0].tables, seen[1].tables)) and (seen[0].refine == seen[1].refine).all()
    assert seen[0].tables[0].sum() == sum(int(c) * int(spelling.alphabet.length[list(w + b" ")].sum()) for w, c in zip(some, counts))


def test_words_are_hashed_together(monkeypatch):
    calls = []
    monkeypatch.setattr(lm_score, "word_hashes", lambda data: calls.append(data) or word_hashes(data))
    some = [b"the", b"", b"\xc3\xa9t\xc3\xa9", b"of"]
    words = lm_score.Words(some, np.array([4.0, 3.0, 2.0, 2.0]), 5.0)
    assert len(calls) == 1
    assert words.symbols(np.array([word_hashes(b"of")[0][0], word_hashes(some[2])[0][0], lm_score._END, word_hashes(b"no")[0][0]])).tolist() == [3, 2, 1, words.rare]


def test_words_are_counted_in_parts(spark, texts):
    counts = Counter()
    for i, t in enumerate(texts):
        own = zlib.crc32(str(i).encode()) % 10 != 0
        for w in [*words(t), ""]:
            counts[w] += own
    for flush in (1, 32 << 20):
        docs = frame(spark, [t or "" for t in texts])
        got = lm_score.count_words(docs, flush=flush).collect()
        assert {bytes(r["word"]).decode(): r["c"] for r in got} == counts and len(got) == len(counts)
    assert lm_score.count_words(frame(spark, ["a"]).limit(0)).count() == 0


def test_phrases_are_cut_alike_in_different_texts():
    words = lm_score.Words([b"", b"the"], np.array([2.0, 2.0]), 5.0)
    rnd = random.Random(3)
    a, b, c = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(200)) for _ in range(3))
    found = []
    for text in (f"{a} {b}", f"{c} {b}", b):
        t = lm_score.Texts([text.encode()], words)
        starts, context, content = t.phrases(8)
        assert starts[0] == 0 and context[0] == 0 and (np.diff(starts) > 0).all() and (context[1:] % 2 != 0).all()
        found.append(set(zip(context.tolist(), content.tolist())))
    shared = found[0] & found[1]
    assert len(shared) > 15 and shared - found[2] == set() or len(shared - found[2]) <= 1


def test_lm_beats_the_base_and_hears_the_order(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = lm_score.score_documents(docs).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > 0.9 * held.base_score.sum() and (held.score > held.base_score).mean() > 0.6
    assert held.n_predicted.sum() > 0
    real = [t for t in docs.toPandas().text.head(300) if t]
    scorer = learned_of(real[:250])
    rnd = random.Random(1)
    mixed = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in real[:40]]

    def of(texts):
        return sum(scorer.tokens(t).sum() for _, _, t in lm_score._runs(texts, scorer.words))

    assert of(real[:40]) > of(mixed)


def test_lm_edges(spark):
    empty = lm_score.score_documents(frame(spark, ["a b"]).limit(0))
    assert empty.count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    one = spark.createDataFrame([(i, t, 1.0) for i, t in [(out, "some words here"), (out, None), (None, "some words"), (None, "some words")]], "doc_id long, text string, n double")
    got = lm_score.score_documents(one).toPandas()
    assert len(got) == 4 and np.isfinite(got.score).all() and got.n_tokens.tolist().count(1) == 1
    same = got[got.doc_id.isna()]
    assert same.score.nunique() == 1 and same.train_tokens.iloc[0] == 6


# --- 5: HTML --------------------------------------------------------------------------------------------------------------------


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<nav><ul><li>Menu</ul></nav><header>Site</header><div class="cookie-notice">We use cookies</div><aside>Side</aside>
<article><header><h1>Title &amp; more</h1></header><p>One  <b>bold</b>
line<p>Two &lt;tag&gt; a < b<br>after<ul><li>x<li>y</ul><form>Sign</form><div class="ad">Buy</div><!-- <p>no</p> -->
<section id="comments"><p>Great post</p></section></article><footer>(c)</footer><p>tail"""
    got = html_text.main_text(html_text.blocks(page), set())
    assert got == "Title & more\n\nOne bold line\n\nTwo <tag> a < b after\n\nx\n\ny"
    assert html_text.main_text(html_text.blocks("plain text"), set()) == "plain text"
    assert html_text.main_text(html_text.blocks("<p>cut <div cl"), set()) == "cut"
    assert html_text.main_text(html_text.blocks(""), set()) == ""


def test_names_and_small_articles_cost_no_main_text():
    def text(body):
        return html_text.main_text(html_text.blocks(f"<body><nav>Menu</nav>{body}<footer>(c)</footer></body>"), set())

    body = "A long main text of the page with many words."
    for start in ("<article class='post overflow-hidden'>", "<div class='has-sidebar'>", "<main id='content-widget'>", "<article class='tag-legal'>", "<div class='comments-open'>", "<article class='comment'>", "<main class='search'>", "<div id='search'>", "<form id='aspnetForm'>"):
        assert text(f"{start}<p>{body}</p></{start[1:].split()[0]}><div class='ad'>Buy</div>") == body, start
    assert text(f"<div class='layout has-sidebar'><p>{body}</p><div class='site-footer'>F</div><ul class='comment-list'><li>C</ul></div>") == body
    assert text(f"<div><p>{body}</p><article>One</article><article>Two</article></div>") == f"{body}\n\nOne\n\nTwo"
    assert text(f"<article><p>{body}</p></article><div>Beside</div>") == body
    assert text(f"<div class='ad'>{body}</div><article>Short</article>") == "Short"
    assert text("<main>Short</main><div>A longer text beside it</div>") == "Short"
    assert text("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then <object data='a.pdf'>see a.pdf</object>.</article>") == "If x=2 then see a.pdf."
    assert html_text.main_text(html_text.blocks("<aside><p>Only this</p></aside>"), set()) == "Only this"


NOISE_NAMES = ["related-posts", "article-comments", "user-comments", "commentList", "entry-footer", "ad-unit", "google-ad", "share-buttons", "newsletter-signup", "blog-sidebar", "cookie-policy-banner"]
PLAIN_NAMES = ["has-sidebar", "content-sidebar-wrap", "overflow-hidden", "comments-open", "post-body", "page-without-nav", "theshare", "headline"]


def test_texts_of_built_pages(spark):
    """Pages of known main blocks, with noise of many kinds between and around them."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 9)))
    phrase = lambda n: " ".join(word() for _ in range(n))
    pages, want = [], []
    for i in range(60):
        body, blocks = [], []
        for _ in range(rnd.randrange(3, 8)):
            text = phrase(rnd.randrange(15, 40))
            blocks.append(text)
            a, b = text.split(" ", 1)
            body.append(rnd.choice([f"<p>{text}</p>", f"<p>{a}\n<b>{b}</b></p>", f"<div class='{rnd.choice(PLAIN_NAMES)}'>{text}</div>", f"<h2>{text}</h2>", f"<p>{a} <button>{b}</button></p>", f"<ul><li>{text}</li></ul>"]))
            body += [f"<{t} class='{n}'>{phrase(3)}</{t}>" for t, n in [(rnd.choice(["div", "section", "ul"]), rnd.choice(NOISE_NAMES))] if rnd.random() < 0.5]
            body += rnd.choices(["", "<script>var x;</script>", "<style>p{}</style>", f"<!-- {word()} -->", f"<form>{phrase(2)}</form>", f"<nav>{phrase(4)}</nav>", f"<aside>{phrase(4)}</aside>"], k=1)
        outer = rnd.choice(["article", "main", "div"])
        comments = "".join(f"<article class='comment'><p>{phrase(4)}</p></article>" for _ in range(rnd.randrange(3))) if outer != "div" else ""
        pages.append(f"<html><head><title>{word()}</title></head><body><header>{phrase(3)}</header><{outer}>{''.join(body)}{comments if outer == 'main' else ''}</{outer}>{comments if outer == 'article' else ''}<footer>{phrase(3)}</footer></body></html>")
        want.append("\n\n".join(blocks))
    df = spark.createDataFrame([(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    for i, t in enumerate(want):
        assert got[i] == t, pages[i]


def test_many_unclosed_hidden_elements_are_read_once():
    begun = time.time()
    found = html_text.blocks("<p>Text " + "<span hidden>" * 20_000 + "end</p>")
    assert [b.text for b in found] == ["Text end"] and time.time() - begun < 1
    assert [b.text for b in html_text.blocks("<p>a <i hidden>x</i> b <i hidden>y</i> c <i hidden>d")] == ["a b c d"]


def test_style_tree_removes_what_repeats(spark):
    rows = []
    for k in range(12):
        rows.append((k, f"http://a.example/{k}", f"<div><div class='x1'>Same words</div><div class='x2'>Text number {k} of many</div></div>", "clash"))
    rows += [(50, "http://b.example/", "<div class='x1'>Same words</div>", ""), (51, None, None, ""), (52, "http://a.example/q", "<div><div class='x1'>Same words</div></div>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {**{k: f"Text number {k} of many" for k in range(12)}, 50: "Same words", 51: "", 52: "Same words"}
    tree = {r["path"]: r["importance"] for r in html_text.style_tree(pages).filter("host = 'a.example'").collect()}
    assert tree["div>div.x1"] == pytest.approx(0) and tree["div>div.x2"] == pytest.approx(1)


def brute_tree(pages):
    """path: (pages, presentation, content) of one host's pages without articles, by plain counting."""
    forms, texts = {}, {}
    for page in set(pages):
        kids = {}
        found = html_text.blocks(page, kids)
        for b in found:
            for k in range(1, len(b.path) + 1):
                forms.setdefault(b.path[:k], {})[page] = tuple(kids.get(b.path[:k], ()))
                texts.setdefault(b.path[:k], set()).add((b.path, b.text, page))
    out = {}
    for path, of in forms.items():
        m = len(of)
        share = [n / m for n in Counter(of.values()).values()]
        times = Counter((p, t) for p, t, _ in texts[path])
        mean = sum(n * np.log2(n) for n in times.values()) / sum(times.values())
        out[">".join(path)] = (m, -sum(p * np.log2(p) for p in share) / np.log2(m), max(0, 1 - mean / np.log2(m))) if m > 1 else (1, 1.0, 1.0)
    return out


def test_style_tree_equals_plain_counting(spark):
    rnd = random.Random(2)
    body = []
    for k in range(40):
        menu = "".join(f"<li>{w}</li>" for w in rnd.sample(["one", "two", "three", "four"], 3))
        parts = "".join(f"<p>{rnd.choice('abc')} {k}</p>" for _ in range(rnd.randrange(1, 4)))
        body.append(f"<div class='m'><ul>{menu}</ul></div><div class='c'>{parts}<h2>About</h2></div><div class='z'>Sale {rnd.randrange(3)}</div>")
    body += body[:10]
    pages = spark.createDataFrame([(k, "http://a.example/", x) for k, x in enumerate(body)], "page_id long, url string, html string")
    got = {r["path"]: r for r in html_text.style_tree(pages).collect()}
    want = brute_tree(body)
    assert set(got) == set(want)
    for path, (m, presentation, content) in want.items():
        r = got[path]
        assert r["pages"] == m and r["presentation"] == pytest.approx(presentation) and r["content"] == pytest.approx(content)
        assert r["importance"] == pytest.approx(1 - (1 - presentation) * (1 - content))
    found = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    # menus and sales go by comparison with their siblings, headings of the kept branch stay
    for k, x in enumerate(body):
        assert found[k]["text"].split("\n\n") == [*re.findall(r"<p>(.*?)</p>", x), "About"]
        assert found[k]["low_blocks"] == 4


def test_odd_and_deep_pages(spark):
    def text(page):
        return html_text.main_text(html_text.blocks(page), set())

    assert text("<p data-x=it's>First.</p><p>Second</p>") == "First.\n\nSecond"
    assert text("<p title='a>b' data-y=\"c>d\">One</p><p title=\"open>Two</p>") == "One\n\nTwo"
    assert text("<article><p class='legal-analysis'>Law</p><div class='search-results'>Found</div></article>") == "Law\n\nFound"
    started = time.time()
    for deep in ("<div>a" * 20_000, "<form>a" * 5_000, "<ul><li>a" * 10_000, "<div>" * 20_000 + "x" + "</p>" * 20_000, "<b>" * 50_000 + "x"):
        assert text(deep).count("a") == deep.count("a") and html_text.node_rows(deep)
    assert time.time() - started < 30
    rows = spark.createDataFrame([(1, "http://a.example/", "<div>a" * 3000), (2, "http://a.example/", ""), (3, "x", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["n_chars"] for r in html_text.extract(rows).collect()} == {1: 3 * 3000 - 2, 2: 0, 3: 0}
    assert html_text.extract(rows.limit(0)).count() == 0


def test_copies_of_a_page_are_no_boilerplate(spark):
    def page(k, own, foot=""):
        return f"<article><p>Text {k} with words of its own</p>{own}<div class='share'>Share this</div><div class='x1'>Read more on our site</div></article><div class='end'>{foot}</div>"

    own = "<ul><li>First point</li><li>Second point</li></ul>"
    rows = [(k, "http://a.example/c", page("of a copy", own)) for k in range(100)]
    rows += [(100 + k, "http://a.example/d", page("of a copy", own, f"Seen {k} times")) for k in range(20)]
    rows += [(200 + k, f"http://a.example/{k}", page(k, "")) for k in range(30)]
    rows += [(300 + k, "http://b.example/", page("alone", own)) for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_text.extract(pages).collect()}
    copy = ["Text of a copy with words of its own", "First point", "Second point"]
    assert all(got[k] == copy for k in range(120))
    assert all(got[200 + k] == [f"Text {k} with words of its own"] for k in range(30))
    assert got[300][:3] == ["Text alone with words of its own", "First point", "Second point"]
    tree = {r["path"]: r for r in html_text.style_tree(pages).filter("host = 'a.example'").collect()}
    assert tree["article>p"]["pages"] == 31 and tree["article>p"]["importance"] == pytest.approx(1)
    assert tree["article>ul"]["pages"] == 1 and tree["article>div.x1"]["importance"] == pytest.approx(0)


# --- 6: personal data -------------------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    return kind == "email" or (13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15)


def test_base_spans(spark, texts):
    rnd = random.Random(5)
    noise = ["".join(rnd.choice("ab1 4.@+-%(_)é😀\n") for _ in range(300)) for _ in range(150)]
    known = ["a@b.c-d.._x@y.zz", "😀 mail é@x.y me@x.y.z! 1.2.3.4.5 999.1.1.1 0010.2.3.255", "4111 1111 1111 1111, 4111-1111-1111-1112", "+49 (0)171 234-5678. +1", "1" * 6000, "a." * 4000 + "@", "x@" + "a." * 3000 + "b", "1 " * 3000]
    docs = [*texts, *noise, *known]
    got = pii.find(frame(spark, docs)).toPandas().set_index("doc_id")
    for i, t in enumerate(docs):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, t or "") if valid(k, m.group())]
        r = got.loc[i]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, t)
        assert r.spans.split(",")[: len(spans)] == spans
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in spans) for k in PLAIN]


def brute_terms(docs, residual=0.75, least_bits=2.0, support=3, smoothing=2.0):
    """(entity, term): (n_both, n_term, n_entity) of exceeding terms, by plain counting."""
    rows = []
    for t in docs:
        t = t or ""
        spans = plain_spans(t)
        entities, rest = set(), t
        for kind, start, end in sorted(spans, key=lambda s: -s[1]):
            value = t[start:end]
            digits = re.sub("[^0-9]", "", value)
            group = {"email": value.rsplit("@", 1)[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
            entities |= {kind, f"{kind} in {group}", f"{kind} is {value}"}
            rest = rest[:start] + " " + rest[end:]
        rows.append((t, entities, {w for w in words(rest) if re.search(r"[^\W_]{3}", w)}))
    n, out = len(docs), {}
    for e in set().union(*(r[1] for r in rows)):
        with_e = [r for r in rows if e in r[1]]
        for w in set().union(*(r[2] for r in with_e)):
            both = [r for r in with_e if w in r[2]]
            n_term = sum(w in set(words(r[0])) for r in rows)
            prior = len(with_e) / n
            after = (len(both) + smoothing * prior) / (n_term + smoothing)
            if len({r[0] for r in both}) >= support and -np.log2(after) <= residual and np.log2(after / prior) >= least_bits:
                out[e, w] = (len(both), n_term, len(with_e), -np.log2(after), np.log2(after / prior))
    return out


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if valid(k, m.group())]


def test_disclosing_terms_and_sanitising(spark):
    rnd = random.Random(6)
    filler = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(300)]
    docs = [" ".join(rnd.choices(filler, k=40)) for _ in range(200)]
    for k in range(6):
        docs[k] = f"the Zanzibarian {docs[k]} writes from zed{k}@secret.example to all, flat 17b7"
    docs[6:9] = [f"{d} reaches 10.0.{k}.7 by gateway" for k, d in enumerate(docs[6:9])]
    docs[9:11] = ["only two: twofold +41 44 123 45 67"] * 2
    docs += [None, "", "Zanzibarian, zanzibarian stays where the address isn't"] + docs[:2]
    df = frame(spark, docs)
    base = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = {(r["entity"], r["term"]): r for r in pii.disclosing_terms(base, pii._survey(base)).collect()}
    want = brute_terms(docs)
    assert set(terms) == set(want) and {("email", "zanzibarian"), ("email in secret.example", "17b7"), ("ip in 10.0", "gateway")} <= set(want)
    for key, values in want.items():
        r = terms[key]
        assert (r["n_both"], r["n_term"], r["n_entity"]) == values[:3] and r["left"] == pytest.approx(values[3]) and r["disclosed"] == pytest.approx(values[4])
    got = pii.find(df).toPandas().set_index("doc_id")
    named = {w for _, w in want}
    for i, t in enumerate(docs):
        spans = [f"term:{m.start()}:{m.end()}" for m in WORD.finditer(t or "") if m.group().translate(LOWER) in named]
        assert [x for x in got.spans[i].split(",") if x.startswith("term")] == spans and got.n_term[i] == len(spans)
    clean = pii.sanitise(df).toPandas().set_index("doc_id")
    assert list(clean.columns) == ["text", "score", "key", "size"]
    for k in range(6):
        assert "[EMAIL]" in clean.text[k] and "[TERM]" in clean.text[k] and "secret" not in clean.text[k] and "Zanzibarian" not in clean.text[k]
    assert clean.text[202].startswith("Zanzibarian, [TERM] stays where") and clean.text[200] is None
    assert list(clean.text[11:200]) == docs[11:200]


def test_pii_of_an_empty_table(spark):
    none = frame(spark, ["x"]).limit(0)
    assert pii.find(none).count() == 0 and pii.sanitise(none).count() == 0


def test_sanitise_leaves_columns_with_internal_names(spark):
    names = ["pii_text", "pii_spans", "pii_base", "pii_id", "pii_pattern", "base", "spans", "pattern", "plain", "row", "dirty_id", "text_hash", "n", "a.b"]
    rows = [(i, t, *range(i, i + len(names))) for i, t in enumerate(["mail a@b.cc", None, "plain words", "mail a@b.cc"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    got = pii.sanitise(df).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["mail [EMAIL]", None, "plain words", "mail [EMAIL]"]
    assert got[0].__fields__ == df.columns and [tuple(r)[2:] for r in got] == [r[2:] for r in rows]


def test_texts_with_very_many_spans(spark):
    text = " ".join(f"u{i}@list.example, 10.0.{i % 200}.7;" for i in range(3000))
    begun = time.time()
    got = pii.with_spans(frame(spark, [text]).select("doc_id", "text")).select(F.size("base"), F.element_at("base", 3000)).first()
    assert got[0] == 6000 and text[got[1]["start"] : got[1]["end"]] == "u2999@list.example" and time.time() - begun < 60


def test_copies_of_a_text_are_paired_once(spark):
    docs = [f"zanzibar w{k} writes to boss@list.example and u{k}@other.example" for k in range(5) for _ in range(4)] + [f"w{k} writes of nothing" for k in range(200)]
    base = frame(spark, docs).select("doc_id", "text")
    got = pii.disclosing_terms(base, pii._survey(base)).collect()
    want = brute_terms(docs)
    assert {(r["entity"], r["term"]): (r["n_both"], r["n_term"], r["n_entity"]) for r in got} == {k: v[:3] for k, v in want.items()}
    assert want["email is boss@list.example", "zanzibar"][:3] == (20, 20, 20)


def test_sanitise_merges_overlaps(spark):
    got = pii.sanitise(frame(spark, ["call +4111111111111111 now, or 1.2.3.4", "é 😀 a@b.cc"])).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["call +[CARD] now, or [IP]", "é 😀 [EMAIL]"]


def test_pii_runs_no_python(spark, sf):
    plan = pii.with_spans(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- 7: token counts ----------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(8)
    odd = ["".join(chr(rnd.choice([rnd.randrange(1, 127), rnd.randrange(160, 1500), rnd.randrange(0x1F300, 0x1F600), 32])) for _ in range(80)) for _ in range(300)]
    docs = [*texts, *odd, "ΣΑΣ ΟΔΟΣ İ ﬁ é", "ab<|endoftext|>cd<|startoftext|>", "word " * 3000]
    got = token_counts.count_tokens(frame(spark, docs), path, cache_size=500).toPandas().set_index("doc_id").sort_index()
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in docs], add_special_tokens=False)]
    assert list(got.n_tokens) == want
    assert list(got.n_bytes) == [len((t or "").encode()) for t in docs]
    assert list(got.over_limit) == [x > 2048 for x in want]


def test_files_with_other_rules_go_to_their_library(texts, tmp_path):
    from tokenizers import Tokenizer

    for name, change in (("byte_bpe_50k.json", {"add_prefix_space": True}), ("word_bpe_49k.json", None)):
        spec = json.loads(Path(public_tokenizers.path(name)).read_text())
        if change:
            spec["pre_tokenizer"] |= change
        else:
            spec["normalizer"]["normalizers"].pop()
        path = str(tmp_path / name)
        Path(path).write_text(json.dumps(spec))
        plain = Tokenizer.from_file(path)
        some = [t or "" for t in texts[:20]]
        want = [plain.encode(t, add_special_tokens=False).ids for t in some]
        encoder, counter = packing.Encoder(path, 1000), token_counts.WordCounter(path, 1000)
        assert not counter.known and counter.count(some) == [len(x) for x in want]
        assert not encoder.known and [np.frombuffer(encoder.encode(t), dtype=np.uint32).tolist() for t in some] == want
    assert packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1000).known
    assert token_counts.WordCounter(public_tokenizers.path("word_bpe_49k.json"), 1000).known


# --- 8: WARC --------------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "same", 0), (5, "http://a/5", "same", 0), (3, None, "same", 0), (2, "http://b/", "other é\r\n\r\nx", 0), (7, "http://n/", None, 0), (9, "http://e/\nx", "", 0), (11, "u", "z" * 300_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int").repartition(3)
    index = warc.write(pages)
    assert index.count() == len(rows)
    got = {r["page_id"]: r for r in warc.read(index).collect()}
    payload = {p: (h or "").encode() for p, _, h, _ in rows}
    for p, data in payload.items():
        first = max(q for q, d in payload.items() if d == data)
        r = got[p]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if p == first else ("revisit", first))
        assert (bytes(r["payload"]) if r["payload"] is not None else None) == (data if p == first else None)
    some = warc.read(index.filter("page_id in (2, 11)")).collect()
    assert {r["page_id"] for r in some} == {2, 11}
    assert {r["record_type"] for r in warc.read(warc.write(pages, least_bytes=100)).collect()} == {"response"}
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    assert warc.read(warc.write(pages, broadcast_rows=0)).filter("record_type = 'revisit'").count() == 3


# --- 9: SimHash -------------------------------------------------------------------------------------------------------------------------


def test_simhash_edits(spark, texts):
    got = simhash.with_edits(frame(spark, texts), partitions=5).toPandas().set_index("doc_id").sort_index()
    plain = [t or "" for t in texts]
    prints = simhash.fingerprints(plain)
    for i, t in enumerate(plain):
        following = plain[i - 1] if i else plain[-1]
        half = len(t) // 2
        edit = t[: len(t) - half] + following[:half]
        r = got.loc[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert r.fingerprint == prints[i].hex() and r.edited_fingerprint == simhash.fingerprints([edit])[0].hex()
        assert r.near_next == simhash.likeness(prints[i], prints[i - 1 if i else -1])
    assert got.near_edited[12:60].mean() > got.near_next[12:60].mean() + 0.1
    alone = simhash.with_edits(frame(spark, ["only one here"])).first()
    assert alone["near_next"] == 1.0
    assert simhash.with_edits(frame(spark, texts).limit(0)).count() == 0


def test_near_equals_brute_force(spark):
    rnd = random.Random(9)
    prints = [rnd.getrandbits(128) for _ in range(60)]
    for p in prints[:30]:
        x = p
        for b in rnd.sample(range(128), rnd.randint(0, 5)):
            x ^= 1 << b
        prints.append(x)
    hexes = [f"{p:032x}" for p in prints]
    df = spark.createDataFrame([(h,) for h in hexes], "fingerprint string")
    for radius in (1, 3):
        got = {(r["query"], r["fingerprint"], r["distance"]) for r in simhash.near(df, df.limit(50), radius=radius).collect()}
        want = {(a, b, d) for a in set(hexes[:50]) for b in set(hexes) if a != b and (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius}
        assert got == want


def test_near_finds_edited_copies(spark, real, tmp_path):
    rnd, docs = random.Random(11), []
    for t in [t for t in real.text if 80 < len(words(t)) < 600][:40]:
        docs.append(t)
        for share in (0.01, 0.02, 0.03):
            w = t.split(" ")
            for i in rnd.sample(range(len(w)), max(1, int(share * len(w)))):
                w[i] = f"edit{rnd.randrange(10**6)}"
            docs.append(" ".join(w))
    docs += docs[:3]
    rnd.shuffle(docs)
    pd.DataFrame({"doc_id": range(len(docs)), "text": docs}).to_parquet(tmp_path / "documents.parquet")
    prints = [int.from_bytes(p) for p in simhash.fingerprints(docs)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, docs)]
    got = {r["doc_id"]: r["near_fingerprints"] for r in queries.op9_simhash(spark, str(tmp_path)).collect()}
    alike = found = 0
    for i, p in enumerate(prints):
        if i % 20:
            assert got[i] is None
            continue
        close = {q for q in prints if 0 < (p ^ q).bit_count() <= 20}
        assert got[i] == len(close)
        copies = {q for q, s in zip(prints, sets) if q != p and len(s & sets[i]) >= 0.8 * len(s | sets[i])}
        alike, found = alike + len(copies), found + len(copies & close)
    assert alike > 5 and found >= 0.95 * alike


def test_near_in_passes_and_small_parts(spark):
    rnd = random.Random(12)
    base = [rnd.getrandbits(128) for _ in range(8)]
    prints = sorted({b ^ sum(1 << k for k in rnd.sample(range(128), rnd.randint(0, 24))) for b in base for _ in range(30)})
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    for radius in (5, 20):
        want = {(f"{a:032x}", f"{b:032x}", d) for a in prints for b in prints if a != b and (d := (a ^ b).bit_count()) <= radius}
        assert {tuple(r) for r in simhash.near(df, df.union(df), radius=radius, most=100).select("query", "fingerprint", "distance").collect()} == want
        counts = {r["fingerprint"]: r["n"] for r in simhash.count_near(df, df, radius=radius).collect()}
        assert counts == Counter(a for a, _, _ in want)
        tables, raw = simhash._Tables(simhash._binary([f"{p:032x}" for p in prints]), radius), simhash._binary([f"{p:032x}" for p in prints])
        assert sum(len(q) for q, _, _ in tables.pairs(raw, most=7)) == len(want)
    assert simhash.near(df, df.limit(0)).count() == 0 == simhash.count_near(df, df.limit(0)).count()


# --- 10: quality ------------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(spark, docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got.predicted[got.quality == 1].mean() > 0.97


def test_quality_edges(spark, texts, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    df = frame(spark, texts)
    got = quality.classify(spark, df, labels.limit(0)).collect()
    assert {r["score"] for r in got} and len(got) == len(texts)
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert scored[0] == scored[1] and all(0 <= s <= 1 for s in scored.values())
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in scored.items() if s >= 0.3}
    assert quality.score(df.limit(0), model).count() == 0


def test_long_texts_are_encoded_in_parts_at_spaces():
    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 40)
    seen, piece = [], enc.piece
    enc.piece = lambda text: seen.append(len(text)) or piece(text)
    text = " ".join(f"word{i * 37 % 11} it's, {i}é" for i in range(200))
    assert list(np.frombuffer(enc.encode(text), np.uint32)) == enc.whole.encode(text, add_special_tokens=False).ids
    assert len(seen) > 50 and max(seen) < 60
