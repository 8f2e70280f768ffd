"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND.

Test items are the indexed side: small enough to hold, in blocks of `block_items` with one pass over the documents
each (what a pass leaves is written for the next); every block is an inverted index of pairs of neighbouring words whose postings carry weights and the largest weight of every 64 postings.
A weight is BM25's term weight over the item's greatest possible score, so a passage scores between 0 and 1: the share
of an item's informative word pairs that it holds. Passages are windows of twice the longest item's words that advance by
one such length, so that any run of an item's words lies in one of them whole.

Retrieval returns all items that score at least `threshold` in a passage. Terms so common that no item gets much of
its score from them can't reach the threshold by themselves, so only passages with enough other terms are evaluated
(the pivot rule of WAND, checked for a whole batch at once); those walk the postings and skip blocks by their
largest weights. A found item is verified on words: at least `question_overlap` of the question's five-word runs and
`answer_overlap` of the answer's words stand in the passage. One changed word is allowed beyond that where these shares
leave no room for it: in a question of four words or more (the others and all runs without it must stand there), or in
an answer of two or more if the question stands there whole. Items of a single word are found wherever it stands.

Items have the columns of `items`: an id, a question, and optionally an answer; without an answer column, the last
sentence of an item that has several is its answer.

Defined results: null or empty documents and items match nothing; items of fewer than five words match as their whole
sequence; repeated rows and items count each; without items nothing is contaminated; texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, mix64, shingles, words_of, written

K1, B = 1.2, 0.75
BLOCK = 64
SHINGLE = 5


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence (or line) is the answer if something stands before it."""
    m = re.match(r"(?s)(.*\S)(?:(?<=[.!?])\s+|\s*\n\s*)(\S.*)$", text.strip())
    return (m[1], m[2]) if m else (text, "")


def _hashed(text: str) -> np.ndarray:
    for _, w in words_of([text.encode("utf-8", "replace")]):
        return w
    return np.zeros(0, dtype=np.uint64)


def pairs(words: np.ndarray) -> np.ndarray:
    """The index terms of a text: a hash of each two neighbouring words (of the word itself if there is one only)."""
    if len(words) < 2:
        return words
    with np.errstate(over="ignore"):
        return mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


class Index:
    """An inverted index of items with normalised BM25 weights and block maxima.

    `known` are statistics of all items, of which these are a part: their number, mean length and the document
    frequencies of these items' terms (ascending terms, frequencies). Without it these are all.
    """

    def __init__(self, items: list[tuple[str, str]], known: tuple[int, float, np.ndarray, np.ndarray] | None = None):
        whole = [_hashed(f"{q}\n{a}") for q, a in items]
        self.question = [shingles(_hashed(q), SHINGLE) for q, _ in items]
        self.question_words = [min(SHINGLE, len(_hashed(q))) for q, _ in items]
        self.words = [np.unique(_hashed(q)) for q, _ in items]
        self.answer = [np.unique(_hashed(a)) for _, a in items]
        self.alone: dict[int, list[int]] = {}
        for i, w in enumerate(whole):
            if len(w) == 1:
                self.alone.setdefault(int(w[0]), []).append(i)
        self.ones = np.array(sorted(self.alone), dtype=np.uint64)
        self.longest = max([len(w) for w in whole], default=0)
        whole = [pairs(w) for w in whole]
        lengths = np.array([len(w) for w in whole], dtype=float)
        mean = max(1.0, float(lengths.mean())) if len(items) else 1.0
        terms = [np.unique(w, return_counts=True) for w in whole]
        self.vocabulary, df = np.unique(np.concatenate([t for t, _ in terms]), return_counts=True) if items else (np.zeros(0, np.uint64), np.zeros(0))
        total = len(items)
        if known is not None:
            total, mean, df = known[0], max(1.0, known[1]), known[3][np.searchsorted(known[2], self.vocabulary)]
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for d, (t, n) in enumerate(terms):
            at = np.searchsorted(self.vocabulary, t)
            w = idf[at] * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[d] / mean))
            for k, x in zip(at.tolist(), (w / max(w.sum(), 1e-9)).tolist() if len(w) else []):
                postings[k].append((d, x))
        self.docs = [[d for d, _ in p] for p in postings]
        self.weights = [[x for _, x in p] for p in postings]
        self.highest = np.array([max(w) for w in self.weights]) if postings else np.zeros(0)
        self.tops = [[max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for w in self.weights]
        self.ends = [[d[min(i + BLOCK, len(d)) - 1] for i in range(0, len(d), BLOCK)] for d in self.docs]
        self.df = df
        # a coarse table of hashes that may be terms
        self.may = np.zeros(1 << 20, dtype=bool)
        self.may[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def common(self, most: float) -> tuple[np.ndarray, float]:
        """The most frequent terms that together give no item more than `most`, as a mask, and what they give at most."""
        mass = np.zeros(len(self.answer))
        mask = np.zeros(len(self.vocabulary), dtype=bool)
        given = 0.0
        for t in np.argsort(-self.df, kind="stable").tolist():
            after = mass.copy()
            after[self.docs[t]] += self.weights[t]
            if after.max(initial=0) > most:
                break
            mass, mask[t], given = after, True, float(after.max(initial=0))
        return mask, given

    def terms(self, words: np.ndarray) -> np.ndarray:
        """The index of each hashed term in the vocabulary, -1 if it isn't there."""
        out = np.full(len(words), -1, dtype=np.int64)
        some = np.flatnonzero(self.may[(words >> np.uint64(44)).astype(np.int64)])
        if len(some) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, words[some]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == words[some]
            out[some[hit]] = at[hit]
        return out

    def above(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score at least threshold for the distinct terms of query, by block-max WAND."""
        eps = 1e-9
        lists = [[self.docs[t][0], t, 0] for t in query if self.docs[t]]  # current item, term, place
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(lists):
                bound += self.highest[t]
                if bound >= threshold - eps:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            ahead = lists[: pivot + 1]
            blocks = [bisect_left(self.ends[t], item) for _, t, _ in ahead]
            top = sum(self.tops[t][b] for (_, t, _), b in zip(ahead, blocks) if b < len(self.tops[t]))
            if top < threshold - eps:
                # no item up to the nearest block end (or the next list's item) can reach the threshold
                stop = min(self.ends[t][b] for (_, t, _), b in zip(ahead, blocks) if b < len(self.ends[t])) + 1
                if pivot + 1 < len(lists):
                    stop = min(stop, lists[pivot + 1][0])
                stop = max(stop, item + 1)
            elif lists[0][0] == item:
                score = sum(self.weights[t][p] for d, t, p in ahead)
                if score >= threshold - eps:
                    found.append((item, score))
                stop = item + 1
            else:
                stop = item
            rest = lists[pivot + 1 :]
            for x in ahead:
                if x[0] < stop:
                    x[2] = bisect_left(self.docs[x[1]], stop, x[2])
                    if x[2] == len(self.docs[x[1]]):
                        continue
                    x[0] = self.docs[x[1]][x[2]]
                rest.append(x)
            lists = rest
        return found


class Matcher:
    def __init__(self, index: Index, threshold: float, question_overlap: float, answer_overlap: float):
        self.index, self.threshold, self.question_overlap, self.answer_overlap = index, threshold, question_overlap, answer_overlap
        mask, given = index.common(threshold / 2)
        self.value = np.where(mask, 0.0, index.highest)
        self.needed = threshold - given - 1e-9

    def passages(self, n: int) -> list[tuple[int, int]]:
        step = max(1, self.index.longest)
        return [(a, min(n, a + 2 * step)) for a in range(0, max(1, n - step), step)]

    def items(self, words: np.ndarray) -> set[int]:
        """The items that the text with these hashed words holds."""
        index, out = self.index, set()
        if not len(words) or not len(index.vocabulary):
            return out
        if len(index.ones):
            for w in np.unique(words[np.isin(words, index.ones)]).tolist():
                out.update(index.alone[w])
        terms = index.terms(pairs(words))
        value = np.where(terms >= 0, self.value[terms], 0.0)
        sums = np.concatenate([[0.0], np.cumsum(value)])
        windows = np.array(self.passages(len(terms)))
        for a, b in windows[sums[windows[:, 1]] - sums[windows[:, 0]] >= self.needed].tolist():
            query = np.unique(terms[a:b])
            query = query[query >= 0]
            if self.value[query].sum() < self.needed:
                continue
            found = [i for i, _ in index.above(query.tolist(), self.threshold) if i not in out]
            if found:
                out.update(i for i in found if self.verified(i, words[a : b + 1]))
        return out

    def texts(self, texts: list[str | None]) -> list[set[int]]:
        """The items in each text."""
        found: list[set[int]] = [set() for _ in texts]
        for i, words in words_of([(t or "").encode("utf-8", "replace") for t in texts]):
            found[i] = self.items(words)
        return found

    def verified(self, item: int, words: np.ndarray) -> bool:
        q, a = self.index.question[item], self.index.answer[item]
        if not len(q):
            return False
        held = np.isin(q, shingles(words, self.index.question_words[item]) if len(words) >= self.index.question_words[item] else words[:0])
        missing = len(q) - int(held.sum())
        if missing > (1 - self.question_overlap) * len(q) + 1e-9:
            # one changed word takes up to five runs with it
            own = self.index.words[item]
            if len(own) < 4 or missing > SHINGLE or len(own) - np.isin(own, words).sum() > 1:
                return False
        lost = len(a) - int(np.isin(a, words).sum())
        return lost <= (1 - self.answer_overlap) * len(a) + 1e-9 or lost == 1 and len(a) > 1 and not missing


def _parts(question: str, answer: str | None) -> tuple[str, str]:
    return split_item(question) if answer is None else (question, answer)


def _statistics(rows: DataFrame) -> tuple[int, float, DataFrame]:
    """Number and mean length of all items, and the written document frequency of each of their terms."""

    def terms(batches):
        for b in batches:
            own = [pairs(_hashed("\n".join(_parts(q, a)))) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in own], pa.int64()), pa.array([np.unique(w).view(np.int64) for w in own], pa.list_(pa.int64()))], names=["length", "terms"])

    found = written(rows.mapInArrow(terms, "length long, terms array<long>"), "item-terms")
    n, mean = found.agg(F.count("*"), F.avg("length")).first()
    counts = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return n, mean or 0.0, written(counts, "item-frequencies")


def _indexes(items: DataFrame, item_id: str, question_col: str, answer_col: str | None, block_items: int):
    """The items in blocks of about block_items (dealt by hash where there are more): (index, ids of its items).

    Scores don't depend on the blocks: frequencies, number and mean length are those of all items.
    """
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = items.select(F.col(item_id).alias("item"), F.coalesce(F.col(question_col), F.lit("")).alias("question"), answer.alias("answer")).filter("item is not null")
    blocks = max(1, -(-rows.count() // block_items))
    known = _statistics(rows) if blocks > 1 else None
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item", "question"), F.lit(blocks)) == k)
        got = [(r["item"], _parts(r["question"], r["answer"])) for r in part.orderBy("item", "question").collect()]
        own = None
        if known:
            some = np.unique(np.concatenate([np.zeros(0, np.uint64), *(pairs(_hashed("\n".join(x))) for _, x in got)]))
            wanted = items.sparkSession.createDataFrame(pd.DataFrame({"term": some.view(np.int64)}), "term long")  # the block's own
            df = {r["term"]: r["df"] for r in known[2].join(F.broadcast(wanted), "term").collect()}
            own = known[0], known[1], some, np.array([df[t] for t in some.view(np.int64).tolist()], dtype=np.int64)
        yield Index([x for _, x in got], own), [i for i, _ in got]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    question_col: str = "text",
    answer_col: str | None = None,
    threshold: float = 0.6,
    question_overlap: float = 0.8,
    answer_overlap: float = 0.8,
    block_items: int = 20_000,
) -> DataFrame:
    """doc_id, contaminated and item_ids (sorted) for every row of docs."""
    out = id_and_text(docs, id_col, text_col)
    kind = items.schema[item_id].dataType.simpleString()
    value = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    names = []
    for index, ids in _indexes(items, item_id, question_col, answer_col, block_items):
        held = docs.sparkSession.sparkContext.broadcast((index, ids))
        name = f"found_{len(names)}"

        def task(batches, held=held, name=name):
            index, ids = held.value
            matcher = Matcher(index, threshold, question_overlap, answer_overlap)
            for b in batches:
                found = [[ids[k] for k in sorted(x)] for x in matcher.texts(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(value))], names=[*b.schema.names, name])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
        if names:
            out = written(out, "decontaminate")  # one index at a time in a worker
        out = out.mapInArrow(task, f"{fields}, {name} array<{kind}>")
        names.append(name)
    ids = F.array_sort(F.array_distinct(F.concat(*names)))
    return out.select("doc_id", (F.size(ids) > 0).alias("contaminated"), ids.alias("item_ids"))


def clean(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    question_col: str = "text",
    answer_col: str | None = None,
    threshold: float = 0.6,
    question_overlap: float = 0.8,
    answer_overlap: float = 0.8,
    block_items: int = 20_000,
) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    at = docs.columns.index(text_col)
    out = docs
    for k, block in enumerate(_indexes(items, item_id, question_col, answer_col, block_items)):
        if k:
            out = written(out, "decontaminate")  # one index at a time in a worker
        held = docs.sparkSession.sparkContext.broadcast(block)

        def task(batches, held=held):
            matcher = Matcher(held.value[0], threshold, question_overlap, answer_overlap)
            for b in batches:
                yield b.filter(pa.array([not x for x in matcher.texts(b.column(at).to_pylist())], pa.bool_()))

        out = out.mapInArrow(task, docs.schema)
    return out
