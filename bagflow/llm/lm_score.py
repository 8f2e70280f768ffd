"""Language-model scores of texts by online logistic context mixing.

A text is a sequence of tokens: words with A-Z lowered, then one end. Everything is coded in binary decisions, each of
which several predictors with hashed contexts estimate from how often 0 and 1 followed their context in the training
texts; gated weights mix their logits, and a last stage refines the mixed probability by what happened at such ones.

1. Phrases. A text is cut behind every three words whose hash is divisible by `every` (and behind the first three), so
   equal stretches of different texts are cut alike. First decision: is the next phrase the one that most often followed
   the same three words in the corpus? Its contexts are how often and how surely that phrase followed, and how the last
   two such predictions of the text came out.
2. Words. Else the phrase's words follow one by one. A word's code are the branches from the root of a binary tree to
   its class: words that stand behind the same frequent words are near each other in the tree, whose halves are equally
   frequent. Contexts, all of which cross words: the word before; the two last frequent words; the classes of the three
   words before. Weights are learned online over the training texts, averaged over tasks, and go on adapting while a
   text is read: each text begins with the averaged ones and corrects them after every few words. A class's words are
   told apart by their frequency.
3. Letters. Words that are too rare for the tree share one leaf and are spelled (see `lm_spelling`).

Products over decisions are probabilities of tokens; their logs sum to the score of a text and give bits per byte.

What grows with the corpus are Spark tables: the counts of all words, and the phrases with their contexts, which texts
meet in a shuffle join (contexts that hold more than 1/100,000 of all phrases, at most 100,000, are broadcast). The
tree's words (`hot_words` at most), the contexts of words (4,096 each, at every node of the tree) and of letters have
sizes of their own at every scale. A text's own phrases are left out of the counts that predict them; counts for words and
letters hold them, so a training text scores higher than a new one would.

Defined results: null or empty text is the end token alone; rows without a doc_id are training rows; equal texts of one
fold score alike; an empty table gives an empty result; without training rows all decisions start from even chances.
"""

from __future__ import annotations

import math
import zlib
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lm_spelling
from ._common import chunks, held_out, id_and_text, mix64, packed, slices, summed, tree_sum, word_hashes, written

FOLDS = 10
#: Branches of the tree down to a class; frequent words whose followers shape it; frequent words of the second context.
DEPTH = 7
NODES = 1 << DEPTH
PROFILE = 32
FREQUENT = 63
CONTEXTS = 4096
INPUTS = 5
LEVELS = np.array([2.5, 20.5, 200.5])
GATES = 4**3 * DEPTH
STEPS, REACH = lm_spelling.STEPS, lm_spelling.REACH
TABLE = 20
#: A text is cut into phrases behind one in so many places.
EVERY = 16
#: Inputs that are computed at once, and how slowly a text changes its weights.
TOKENS = 8_000
PATIENCE = 60.0
_MUL = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xA0761D6478BD642F)
_AT_DEPTH = np.arange(DEPTH, dtype=np.int32)[:, None]


def tokens(text: str) -> list[bytes]:
    """Words of a text with A-Z lowered: bytes.split knows exactly the six white-space bytes."""
    return text.encode("utf-8", "replace").lower().split()


# --- the code of words ------------------------------------------------------------------------------------------------


def _tree(counts: np.ndarray, profile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code (DEPTH bits, left-aligned) and its length for symbols with these counts.

    Every node is halved by mass along the direction in which its symbols' profiles (what stood before them) differ
    most; a symbol with a third of a node's mass stands alone.
    """
    code, length = np.zeros(len(counts), dtype=np.int32), np.zeros(len(counts), dtype=np.int32)
    whole = profile.sum(axis=0, dtype=float) + 1e-3
    smooth = profile.astype(np.float32, order="C")
    smooth += (2 * whole / whole.sum()).astype(np.float32)
    smooth /= profile.sum(axis=1, keepdims=True).astype(np.float32) + 2
    np.sqrt(smooth, out=smooth)
    todo = [(np.arange(len(counts)), 0, 0)]
    while todo:
        own, prefix, depth = todo.pop()
        code[own], length[own] = prefix << (DEPTH - depth), depth
        if len(own) == 1 or depth == DEPTH:
            continue
        mass = counts[own]
        top = int(np.argmax(mass))
        if 3 * mass[top] >= mass.sum():
            left, right = own[[top]], np.delete(own, top)
        else:
            x = smooth[own]
            x -= (mass @ x / mass.sum()).astype(np.float32)
            spread = sum((x[a : a + 20_000] * mass[a : a + 20_000, None]).T @ x[a : a + 20_000].astype(float) for a in range(0, len(own), 20_000))
            direction = np.linalg.eigh(spread)[1][:, -1]
            direction = direction * (1 if direction[np.argmax(np.abs(direction))] > 0 else -1)
            order = np.lexsort((own, np.round(x @ direction, 9)))
            cut = int(np.searchsorted(np.cumsum(mass[order]), mass.sum() / 2))
            cut = min(max(1, cut), len(own) - 1)
            left, right = own[order[:cut]], own[order[cut:]]
        todo += [(np.sort(left), prefix << 1, depth + 1), (np.sort(right), prefix << 1 | 1, depth + 1)]
    return code, length


class Words:
    """The words that the code names. Symbols are their ranks by count, then `rare` for all other words."""

    def __init__(self, words: list[bytes], counts: np.ndarray, rare: float):
        self.size = len(words)
        self.rare = len(words)
        self.counts = np.append(np.maximum(counts, 1.0), max(rare, 1.0))
        hashes = np.full(len(words), _END, dtype=np.uint64)
        hashes[[i for i, w in enumerate(words) if w]] = word_hashes(b"\n".join(words))[0]
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]
        self.end = words.index(b"")
        lead = (self.hashes >> np.uint64(64 - TABLE)).astype(np.int64)
        first = np.flatnonzero(np.diff(lead, prepend=-1))
        self.table = np.zeros(1 << TABLE, dtype=np.int32)
        self.table[lead[first]] = first
        rest = np.setdiff1d(np.arange(len(lead)), first)
        self.others, self.order_of_others = self.hashes[rest], self.order[rest]

    def shaped(self, profile: np.ndarray) -> None:
        """Make the tree from counts of (frequent word before, symbol)."""
        self.code, self.length = _tree(self.counts, profile.T)
        classes = self.code * 16 + self.length
        self.tail = np.log10(self.counts / np.bincount(classes, weights=self.counts)[classes])
        first, second = np.zeros(NODES), np.zeros(NODES)
        for d in range(DEPTH):
            own = np.flatnonzero(self.length > d)
            node = (1 << d) | (self.code[own] >> (DEPTH - d))
            bit = (self.code[own] >> (DEPTH - 1 - d)) & 1
            first += np.bincount(node, weights=self.counts[own] * (1 - bit), minlength=NODES)
            second += np.bincount(node, weights=self.counts[own] * bit, minlength=NODES)
        self.share = ((second + 1e-3) / (first + second + 2e-3)).astype(np.float32)
        # contexts: the begin of a text is one more symbol
        self.before = np.append(np.minimum(np.arange(self.size + 1), CONTEXTS - 3), CONTEXTS - 1).astype(np.int32)
        self.before[self.rare] = CONTEXTS - 2
        self.near = np.append(self.code >> (DEPTH - 4), 0).astype(np.int32)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word: by a table of the hashes' leading bits, then by search for those that it doesn't hold."""
        at = self.table[(hashes >> np.uint64(64 - TABLE)).astype(np.int64)]
        out = np.where(self.hashes[at] == hashes, self.order[at], self.rare).astype(np.int32)
        rest = np.flatnonzero(out == self.rare)
        at = np.minimum(np.searchsorted(self.others, hashes[rest]), max(len(self.others) - 1, 0))
        if len(self.others):
            hit = self.others[at] == hashes[rest]
            out[rest[hit]] = self.order_of_others[at[hit]]
        return out


class Texts:
    """The tokens of a run of texts: symbols, hashes, the first token of each token's text, and the spans of words."""

    def __init__(self, texts: list[bytes], words: Words):
        self.data = b"\n".join(texts)
        self.bytes = np.fromiter(map(len, texts), np.int64, len(texts))
        hashes, self.start, self.stop = word_hashes(self.data)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        at = np.searchsorted(self.start, bounds)
        self.sizes = np.diff(at) + 1
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        self.place = np.arange(len(hashes)) + owner
        n = int(self.sizes.sum())
        self.hashes = np.full(n, _END, dtype=np.uint64)
        self.hashes[self.place] = hashes
        self.ids = np.full(n, words.end, dtype=np.int32)
        self.ids[self.place] = words.symbols(hashes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.own = np.repeat(np.arange(len(texts)), self.sizes)

        #: The tokens of rare words.
        self.unnamed = np.flatnonzero(self.ids[self.place] == words.rare)
        self.rare_at = self.place[self.unnamed]

    @cached_property
    def rare(self) -> list[bytes]:
        """The words at rare_at as bytes; only scoring reads them."""
        data = self.data.lower()
        return [data[a:b] for a, b in zip(self.start[self.unnamed].tolist(), self.stop[self.unnamed].tolist())]

    def contexts(self, words: Words) -> list[np.ndarray]:
        """Three contexts of every token, each a number below CONTEXTS."""
        n, begin = len(self.ids), self.first[self.own]

        def back(of: np.ndarray, k: int, none: int) -> np.ndarray:
            """What stands k tokens before each token of its text."""
            out = np.full(n, none, dtype=np.int32)
            out[k:] = of[:-k]
            for j in range(k):
                out[self.first[self.sizes > j] + j] = none
            return out

        near = words.near[self.ids]
        last = np.maximum.accumulate(np.where(self.ids < FREQUENT, np.arange(n), -1))
        last = np.concatenate([[-1], last[:-1]])
        ahead = np.where(last >= begin, last[np.maximum(last, 0)], -1)
        f1 = np.where(last >= begin, self.ids[np.maximum(last, 0)], FREQUENT)
        f2 = np.where(ahead >= begin, self.ids[np.maximum(ahead, 0)], FREQUENT)
        of_classes = back(near, 1, 0) << 8 | back(near, 2, 0) << 4 | back(near, 3, 0)
        return [back(words.before[self.ids], 1, CONTEXTS - 1), (f1 * 64 + f2).astype(np.int32), of_classes]

    def frequent_before(self) -> np.ndarray:
        """The last of the PROFILE most frequent words before each token, PROFILE if there is none."""
        begin, place = self.first[self.own], np.arange(len(self.ids))
        last = np.maximum.accumulate(np.where(self.ids < PROFILE, place, -1))
        last = np.concatenate([[-1], last[:-1]])
        return np.where(last >= begin, self.ids[np.maximum(last, 0)], PROFILE)

    def phrases(self, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, context (0 for a text's first phrase) and content hash of every phrase."""
        n, begin = len(self.ids), self.first[self.own]
        place = np.arange(n)
        with np.errstate(over="ignore"):
            h = self.hashes
            three = h.copy()
            three[1:] += mix64(h[:-1]) * np.uint64(3)
            three[2:] += mix64(h[:-2] + _MUL) * np.uint64(5)
            three = mix64(three)
            since = place - begin
            cut = ((since >= 2) & (three % np.uint64(every) == 0)) | (since == 2)
            starts = np.flatnonzero(np.concatenate([[False], cut[:-1]]) | (since == 0))
            context = np.where(since[starts] == 0, np.uint64(0), three[np.maximum(starts - 1, 0)] | np.uint64(1))
            # the hash of a phrase: its tokens' hashes, each turned by its place in the phrase
            sizes = np.diff(np.append(starts, n))
            turn = mix64((place - np.repeat(starts, sizes)).astype(np.uint64) + _MUL) | np.uint64(1)
            content = mix64(np.add.reduceat(mix64(h) * turn, starts)) if n else h
        return starts, context.view(np.int64), content.view(np.int64)


def _runs(texts: list[str | None], words: Words, most: int = 1 << 18):
    """Runs of texts with their tokens: (first, past, Texts)."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    for a, b in chunks(data, most):
        yield a, b, Texts(data[a:b], words)


# --- mixing -----------------------------------------------------------------------------------------------------------


def _squash(x: np.ndarray) -> np.ndarray:
    out = np.clip(x, -18, 18)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


class Rows:
    """The decisions of a stretch of tokens: a row for each depth, a column for each token, with node, bit and slots.

    A code that is shorter than a row's depth decides nothing there: it is at node 0, which no decision has and whose
    counts stay 0, so that all inputs but the constant one are 0.
    """

    def __init__(self, texts: Texts, words: Words, contexts: list[np.ndarray], stretch: np.ndarray):
        ids = texts.ids[stretch]
        code = words.code[ids]
        alive = (_AT_DEPTH - words.length[ids]) >> 31  # all bits set, or none
        self.node = (code >> (DEPTH - _AT_DEPTH) | 1 << _AT_DEPTH) & alive
        self.bit = code >> (DEPTH - 1 - _AT_DEPTH) & 1  # codes are left-aligned: 0 where nothing is decided
        self.alive = alive != 0
        self.slots = [(c[stretch] << DEPTH | self.node).astype(np.int64) for c in contexts]

    def count(self, tables: list[np.ndarray]) -> None:
        """Add these decisions to the tables."""
        times = self.alive.astype(np.int32).ravel()
        for table, slot in zip(tables, self.slots):
            np.add.at(table, (2 * slot + self.bit).ravel(), times)


def _empty() -> list[np.ndarray]:
    return [np.zeros(2 * CONTEXTS * NODES, dtype=np.int32) for _ in range(INPUTS - 2)]


def _level(total: np.ndarray) -> np.ndarray:
    """Evidence level of a count: 0 to 3."""
    return sum((total > b).view(np.int8) for b in LEVELS.astype(total.dtype))


def _take(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at] for places that are known to be inside."""
    return np.take(table, at, mode="clip")


def _mixed(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The logit of each decision: its inputs (rows of x) under its gate's weights (a row for each input)."""
    z = _take(weights[0], gate)
    z *= x[0]
    for k in range(1, len(x)):
        part = _take(weights[k], gate)
        part *= x[k]
        z += part
    return z


def _prior(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counts of 0 and 1 start from at nodes with these shares of ones."""
    return np.float32(0.8) * (1 - share), np.float32(0.8) * share


def _read(n0: np.ndarray, n1: np.ndarray, none: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The logit after these counts, which start from the node's own."""
    out = n1 + one
    out /= n0 + none
    return np.log(out, out=out)


def frozen(words: Words, tables: list[np.ndarray]) -> list[np.ndarray]:
    """The logit of every slot, with its evidence level in the last two bits of the number: one lookup reads both."""
    share = words.share[np.arange(CONTEXTS * NODES) & (NODES - 1)]
    out = []
    for t in tables:
        n = t.reshape(-1, 2).astype(np.float32)
        logit = _read(n[:, 0], n[:, 1], *_prior(share)).astype(np.float32)
        out.append(((logit.view(np.int32) & ~3) | _level(n.sum(axis=1))).astype(np.int32).view(np.float32))
    return out


class Learner:
    """Learns context counts and gated weights in one reading: a decision is predicted from what was counted before it."""

    def __init__(self, words: Words):
        self.words = words
        self.logit = np.log(words.share / (1 - words.share)).astype(np.float32)
        self.prior = _prior(words.share)
        self.tables = _empty()
        self.pairs = [t.view(np.uint64) for t in self.tables]
        self.weights = self.start().T.copy()
        self.curve = np.zeros((INPUTS, GATES))
        self.mass = np.zeros(GATES)
        self.refine = np.zeros(2 * NODES * STEPS, dtype=np.int64)
        self.batches = 0

    @staticmethod
    def start() -> np.ndarray:
        w = np.zeros((GATES, INPUTS))
        w[:, :4] = (0.1, 0.3, 0.3, 0.3)
        return w

    def inputs(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        x = np.empty((INPUTS, *rows.node.shape), dtype=np.float32)
        node = rows.node.astype(np.int64)
        x[0], x[-1] = _take(self.logit, node), 0.5
        levels = 0
        none, one = _take(self.prior[0], node), _take(self.prior[1], node)
        for k, slot in enumerate(rows.slots):
            both = _take(self.pairs[k], slot).view(np.int32)
            n0, n1 = both[:, ::2].astype(np.float32), both[:, 1::2].astype(np.float32)
            x[k + 1] = _read(n0, n1, none, one)
            levels = levels * np.int8(4) + _level(n0 + n1)
        return x, levels + _AT_DEPTH.astype(np.int64) * 4**3

    def learn(self, rows: Rows) -> None:
        """One online step of each gate's weights, scaled by a fading sum of curvature; then the decisions are counted."""
        x, gate = self.inputs(rows)
        z = _mixed(x, gate, self.weights.astype(np.float32))
        p = _squash(z)
        np.add.at(self.refine, (2 * _place(z, rows.node) + rows.bit).ravel(), rows.alive.astype(np.int64).ravel())
        alive = rows.alive.astype(np.float32)
        err = (rows.bit.astype(np.float32) - p) * alive
        flat = gate.ravel()
        grad = np.stack([np.bincount(flat, weights=(err * x[k]).ravel(), minlength=GATES) for k in range(INPUTS)])
        if self.batches % 4 == 0:  # the curvature changes slowly
            var = p * (1 - p) * alive
            bend = np.stack([np.bincount(flat, weights=(var * x[k] * x[k]).ravel(), minlength=GATES) for k in range(INPUTS)])
            self.curve = np.where(self.curve == 0, 10 * bend, 0.7 * self.curve + 3 * bend)
        self.batches += 1
        self.weights += np.clip(grad / (self.curve + 1.0), -0.5, 0.5)
        self.mass += np.bincount(flat, minlength=GATES)
        self.mass[:: 4**3] -= np.count_nonzero(~rows.alive, axis=1)  # without decisions
        rows.count(self.tables)


def _place(z: np.ndarray, node: np.ndarray) -> np.ndarray:
    at = np.clip(z, -REACH, REACH)
    at *= 2
    np.rint(at, out=at)
    at += np.float32(STEPS // 2)
    return node * STEPS + at.astype(np.int64)


def _block(since: np.ndarray) -> np.ndarray:
    """The block of a token by its place in its text: 8 of 16 tokens, 8 of 32 and so on; weights change after each."""
    level = np.log2(since / 128 + 1).astype(np.int64)
    return level * 8 + (since - 128 * ((1 << level) - 1)) // (16 << level)


class Scorer:
    """Scores runs of texts, given all that was learned."""

    def __init__(self, words: Words, logits: list[np.ndarray], weights: np.ndarray, refine: np.ndarray, spelling: lm_spelling.Speller):
        self.words, self.logits, self.spelling = words, logits, spelling
        self.own_logit = np.log(words.share / (1 - words.share)).astype(np.float32)
        self.weights = np.ascontiguousarray(weights.T, dtype=np.float32)
        self.refined = lm_spelling.refinement(refine)
        self.refined[:STEPS] = 0  # node 0 has no decisions: a 0 for certain
        # by evidence levels and node: the weight of every context, and what the node's own logit and the constant add
        depth = np.log2(np.maximum(np.arange(NODES), 1)).astype(np.int64)
        gate = depth * 4**3 + np.arange(4**3)[:, None]
        by_node = [self.weights[k][gate].ravel() for k in range(1, INPUTS - 1)]
        self.by_node = [*by_node, (self.own_logit * self.weights[0][gate] + np.float32(0.5) * self.weights[-1][gate]).ravel()]
        self.spelled: dict[bytes, float] = {}

    def inputs(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """The contexts' logits, and the logit that the learned weights mix of them, the node's own and the constant."""
        x = np.empty((INPUTS - 2, *rows.node.shape), dtype=np.float32)
        level = 0
        for k, slot in enumerate(rows.slots):
            np.take(self.logits[k], slot, out=x[k], mode="clip")
            level = level * 4 + (x[k].view(np.int32) & 3)
        gate = (level * NODES + rows.node).astype(np.int64)
        z = _take(self.by_node[-1], gate)
        for k in range(INPUTS - 2):
            z += x[k] * _take(self.by_node[k], gate)
        return x, z

    def of_bits(self, z: np.ndarray, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The refined probability of each decision as it was taken; 1 at node 0."""
        p = lm_spelling.refined(z, node, self.refined)
        p -= 1 - bit
        return np.abs(p, out=p)

    def of_rare(self, words: list[bytes]) -> np.ndarray:
        """log10 of the spellings of rare words; a task spells a word once while its memory of words lasts."""
        new = sorted(set(words).difference(self.spelled))
        if len(self.spelled) + len(new) > 200_000:
            self.spelled.clear()
            new = sorted(set(words))
        for a in range(0, len(new), 4_000):
            part = new[a : a + 4_000]
            self.spelled.update(zip(part, self.spelling.log10(part).tolist()))
        return np.fromiter(map(self.spelled.__getitem__, words), np.float64, len(words))

    def tokens(self, texts: Texts) -> np.ndarray:
        """log10 of the probability of every token by its words and letters alone.

        Blocks of tokens (see _block) are taken of all texts together. Each text's weights are the learned ones plus
        its own correction, which starts at 0 and takes a step by the text's errors after each block.
        """
        out = self.words.tail[texts.ids].copy()
        out[texts.rare_at] += self.of_rare(texts.rare)
        contexts = texts.contexts(self.words)
        since = np.arange(len(texts.ids)) - texts.first[texts.own]
        block = _block(since)
        order = np.argsort(block, kind="stable")
        blocks = block[order]
        # stretches end where a text's block ends, so that a text's score doesn't depend on those beside it
        ends = np.flatnonzero(np.diff(blocks, append=-1) | np.diff(texts.own[order], append=-1)) + 1
        stops = [0]
        while stops[-1] < len(order):
            stops.append(int(ends[max(np.searchsorted(ends, stops[-1] + TOKENS, "right") - 1, np.searchsorted(ends, stops[-1], "right"))]))
        change = np.zeros((INPUTS - 2, len(texts.sizes)), dtype=np.float32)
        curve = np.full((INPUTS - 2, len(texts.sizes)), PATIENCE)
        for a, stop in zip(stops[:-1], stops[1:]):
            stretch = order[a:stop]
            rows = Rows(texts, self.words, contexts, stretch)
            x, z = self.inputs(rows)
            own, ones = texts.own[stretch], rows.bit.astype(np.float32)
            edges = np.append(np.flatnonzero(np.diff(blocks[a:stop], prepend=-1)), len(stretch)).tolist()
            for lo, hi in zip(edges[:-1], edges[1:]):
                xs, who = x[:, :, lo:hi], own[lo:hi]
                low, past = who[0], who[-1] + 1
                if blocks[a + lo]:  # nothing has changed before the first block's end
                    for k in range(INPUTS - 2):
                        z[:, lo:hi] += xs[k] * change[k][who]
                p = _squash(z[:, lo:hi])
                err, var = ones[:, lo:hi] - p, p * (1 - p)
                for k in range(INPUTS - 2):
                    curve[k, low:past] += np.bincount(who - low, weights=(var * xs[k] * xs[k]).sum(axis=0))
                    change[k, low:past] += np.bincount(who - low, weights=(err * xs[k]).sum(axis=0)) / curve[k, low:past]
            p = self.of_bits(z, rows.node, ones)
            # each is more than 1e-6: four of them fit a float
            out[stretch] += np.log10(p[:4].prod(axis=0).astype(np.float64) * p[4:].prod(axis=0))
        return out


# --- fitting ----------------------------------------------------------------------------------------------------------


def count_words(docs: DataFrame, *, folds: int = FOLDS, flush: int = 32 << 20) -> DataFrame:
    """(word, c) for every distinct token of all rows; c counts training rows only. Counted in tasks before the shuffle."""
    df = docs.select("text", (~F.coalesce(held_out("doc_id", folds), F.lit(False))).alias("train"))

    def split(texts: list[pa.Array]) -> pa.ChunkedArray:
        """The words of texts: Arrow knows the same six white-space bytes. An empty one stands for white space at an edge."""
        return pa.chunked_array([pc.ascii_split_whitespace(pc.ascii_lower(t)).flatten().cast(pa.binary()) for t in texts], pa.binary())

    def counted(train: list[pa.Array], other: list[pa.Array]):
        """The words of training texts by count, and those that only other texts have with 0; b"" is the end of a text."""
        known = pc.value_counts(split(train))
        words, counts = known.field("values"), known.field("counts")
        new = pc.unique(split(other))
        new = new.filter(pc.invert(pc.is_in(new, value_set=words)))
        ends = sum(map(len, train))
        for w, c in ((words, counts), (new, pa.array(np.zeros(len(new), dtype=np.int64)))):
            some = pc.not_equal(w, b"")
            yield pa.RecordBatch.from_arrays([w.filter(some), c.filter(some)], names=["word", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"])

    def rows(batches):
        train, other, size = [], [], 0
        for b in slices(batches):
            text, own = b.column(0), b.column(1)
            train.append(text.filter(own))
            other.append(text.filter(pc.invert(own)))
            size += text.nbytes
            if size > flush:
                yield from counted(train, other)
                train, other, size = [], [], 0
        if train:
            yield from counted(train, other)

    return df.mapInArrow(rows, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _threshold(words: DataFrame, most: int) -> int:
    """The least count t so that at most `most` words have t or more; at least 2."""
    t, total = 1 << 62, 0
    for r in words.filter("c > 1").groupBy("c").agg(F.count("*").alias("n")).orderBy(F.col("c").desc()).toLocalIterator():
        total += r["n"]
        if total > most:
            break
        t = r["c"]
    return max(2, t)


class Model:
    """What is fitted: word counts, their sum and number, (the tree's words, all that was learned of decisions), and the
    corpus's phrases with the chances that a predicted one comes (None: `score` takes them from the documents it scores)."""

    def __init__(self, counts: DataFrame, n: int, v: int, learned: tuple, phrases: DataFrame | None = None, chances: np.ndarray | None = None):
        self.counts, self.n, self.v, self.learned, self.phrases, self.chances = counts, n, v, learned, phrases, chances


def _scorer(learned: tuple) -> Scorer:
    words, logits, weights, refine, spelled = learned
    return Scorer(words, logits, weights, refine, lm_spelling.Speller(*spelled))


_COUNTS = "place int, task int, counts binary"
_LEARNED = "place int, task int, counts binary, weights binary, mass binary, refine binary"


def _counts_of(arrays: list[np.ndarray]):
    task = TaskContext.get().partitionId()
    for place, counts in packed(arrays):
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([task], pa.int32()), pa.array([counts], pa.binary())], names=["place", "task", "counts"])


def _learned_of(tables: list[np.ndarray], weights: np.ndarray, mass: np.ndarray, refine: np.ndarray):
    """A task's counts in chunks, and its weights at place -1."""
    none = pa.array([None], pa.binary())
    for b in _counts_of(tables):
        yield pa.RecordBatch.from_arrays([*b.columns, none, none, none], names=["place", "task", "counts", "weights", "mass", "refine"])
    values = (np.ascontiguousarray(weights).tobytes(), mass.tobytes(), zlib.compress(refine.tobytes(), 1))
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), none, *(pa.array([x], pa.binary()) for x in values)], names=["place", "task", "counts", "weights", "mass", "refine"])


def _gathered(df: DataFrame, label: str, sizes: list[int], start: np.ndarray, refiners: int) -> tuple:
    """The sums of all tasks' counts, their weights averaged by evidence, and the sums of their refining counts."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        top, under, refine = np.zeros(start.shape), np.zeros(len(start)), np.zeros(2 * refiners, dtype=np.int64)
        for w, m, r in zip(pdf["weights"], pdf["mass"], pdf["refine"]):
            mass = np.frombuffer(m)
            top += np.frombuffer(w).reshape(start.shape) * mass[:, None]
            under += mass
            refine += np.frombuffer(zlib.decompress(r), dtype=np.int64)
        mean = np.where(under[:, None] > 0, top / np.maximum(under, 1e-9)[:, None], start)
        return pd.DataFrame({"weights": [mean.tobytes()], "mass": [under.tobytes()], "refine": [zlib.compress(refine.tobytes(), 1)]})

    df = written(df, label)
    tables = summed(df.filter("place >= 0").select("place", "task", "counts"), sizes, np.int32)
    got = tree_sum(df.filter("place < 0").select("place", "task", "weights", "mass", "refine"), fold).first()
    if got is None:
        return tables, start, np.zeros(2 * refiners)
    return tables, np.frombuffer(got["weights"]).reshape(start.shape), np.frombuffer(zlib.decompress(got["refine"]), dtype=np.int64).astype(np.float64)


def _spelling(rare: DataFrame, alphabet: lm_spelling.Alphabet) -> tuple:
    """Context counts, weights and refinement learned from the table (word, c) of rare training words."""

    def learn(batches, size: int = 1_000):
        learner = lm_spelling.Learner(alphabet)
        for b in batches:
            for a in range(0, b.num_rows, size):
                part = b.slice(a, size)
                learner.learn(part.column(0).to_pylist(), np.array(part.column(1).to_pylist(), dtype=np.int32))
        learner.count()
        yield from _learned_of(learner.tables, learner.weights.T, learner.mass, learner.refine)

    return alphabet, *_gathered(rare.mapInArrow(learn, _LEARNED), "lm-letters", [2 << s for s in lm_spelling.SLOTS], lm_spelling.start(), lm_spelling.REFINERS)


def fit(docs: DataFrame, *, folds: int = FOLDS, hot_words: int = 1 << 18, phrases: bool = True, every: int = EVERY) -> Model:
    """Fit on the training rows of docs (doc_id, text). Without phrases, `score` must be given the same docs."""
    spark, docs = docs.sparkSession, id_and_text(docs)
    counts = written(count_words(docs, folds=folds), "lm-words")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    often = _threshold(counts, hot_words)
    hot = counts.filter((F.col("c") >= often) | (F.col("word") == b"")).toPandas().sort_values(["c", "word"], ascending=[False, True])
    names, own = hot["word"].map(bytes).tolist(), hot["c"].to_numpy(dtype=float)
    if b"" not in names:
        names, own = [*names, b""], np.append(own, 0.0)
    words = Words(names, own, n - own.sum())
    train = docs.filter(~F.coalesce(held_out("doc_id", folds), F.lit(False))).select("text")
    named = spark.sparkContext.broadcast(words)

    def profile(batches):
        held = named.value
        total, letters = np.zeros((PROFILE + 1) * (held.size + 1), dtype=np.int32), np.zeros(256, dtype=np.int64)
        for b in batches:
            for _, _, t in _runs(b.column(0).to_pylist(), held):
                np.add.at(total, t.frequent_before().astype(np.int64) * (held.size + 1) + t.ids, np.int32(1))
                letters += np.bincount(np.frombuffer(t.data, dtype=np.uint8), minlength=256)
        letters[ord("a") : ord("z") + 1] += letters[ord("A") : ord("Z") + 1]
        yield from _counts_of([total, letters])

    cells = summed(written(train.mapInArrow(profile, _COUNTS), "lm-profile"), [(PROFILE + 1) * (words.size + 1), 256])
    alphabet = lm_spelling.Alphabet(cells[1])
    words.shaped(cells.pop(0).astype(np.float32).reshape(PROFILE + 1, -1))
    del cells
    shaped = spark.sparkContext.broadcast(words)

    def learn(batches):
        learner = Learner(shaped.value)
        for b in batches:
            for _, _, t in _runs(b.column(0).to_pylist(), learner.words):
                found = t.contexts(learner.words)
                for a in range(0, len(t.ids), TOKENS):
                    learner.learn(Rows(t, learner.words, found, np.arange(a, min(a + TOKENS, len(t.ids)))))
        yield from _learned_of(learner.tables, learner.weights.T, learner.mass, learner.refine)

    tables, *learned = _gathered(train.mapInArrow(learn, _LEARNED), "lm-learned", [len(t) for t in _empty()], Learner.start(), NODES * STEPS)
    logits = frozen(words, tables)
    spelled = _spelling(counts.filter((F.col("c") > 0) & (F.col("c") < often) & (F.col("word") != b"")), alphabet)
    model = Model(counts, n, v, (words, logits, *learned, spelled))
    if phrases:
        rows = written(_phrase_rows(train, shaped, every), "lm-train-phrases")
        model.phrases = written(_corpus_phrases(rows), "lm-phrases")
        model.chances = _chances(_with_history(_met(rows, model.phrases)))
    return model


# --- phrases ----------------------------------------------------------------------------------------------------------

#: Bounds of the counts and shares that tell apart how a phrase was predicted.
TIMES = (1, 2, 4, 8)
SHARES = (0.25, 0.5, 0.75, 0.999)


def _kind(times: Column, all_: Column) -> Column:
    """The number of (count, share) of a predicted phrase."""
    size, share = F.lit(0), F.lit(0)
    for t in TIMES:
        size = size + (times > t).cast("int")
    for s in SHARES:
        share = share + (times / all_ >= s).cast("int")
    return size * 5 + share


def _hit_chances(kinds: pd.DataFrame, rounds: int = 30) -> np.ndarray:
    """The probability that a predicted phrase comes, for each (kind, history): three predictors of pairs of features,
    mixed by weights that the history selects, learned in rounds and refined by what happened to each triple."""
    n = np.zeros((5, 5, 9, 2))
    for r in kinds.itertuples():
        n[r.kind // 5, r.kind % 5, r.history] += (r.n - r.hits, r.hits)
    x = np.empty((5, 5, 9, 4))
    for k, axis in enumerate((2, 1, 0)):
        part = n.sum(axis=axis, keepdims=True) + 0.5
        x[..., k] = np.log(part[..., 1] / part[..., 0])
    x[..., 3] = 0.5
    w = np.tile(np.array([0.4, 0.3, 0.3, 0.0]), (9, 1))
    for _ in range(rounds):
        p = _squash(np.einsum("abhk,hk->abh", x, w))
        total = n.sum(axis=-1)
        grad = np.einsum("abh,abhk->hk", n[..., 1] - total * p, x)
        bend = np.einsum("abh,abhk->hk", total * p * (1 - p), x**2)
        w += 0.5 * grad / (bend + 1.0)
    p = _squash(np.einsum("abhk,hk->abh", x, w))
    p = (p + (n[..., 1] + 4 * p) / (n.sum(axis=-1) + 4)) / 2
    return np.clip(p, 1e-6, 1 - 1e-6).reshape(-1)


def _corpus_phrases(phrases: DataFrame) -> DataFrame:
    """(context, n, c, best): how often a context occurs in training texts, and its most frequent phrase (ties: by hash)."""
    known = phrases.filter("train and context <> 0").groupBy("context", "content").agg(F.count("*").alias("c"))
    best = F.max(F.struct("c", "content")).alias("b")
    return known.groupBy("context").agg(F.sum("c").alias("n"), best).select("context", "n", "b.c", F.col("b.content").alias("best"))


def _met(phrases: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every phrase (row, seq, train, own) with whether one was predicted and came, and the kind of the prediction."""
    total = corpus.agg(F.sum("n")).first()[0] or 0
    least = max(2.0, total / 100_000)  # at most 100,000 contexts have so many phrases
    hot = corpus.filter(F.col("n") >= least).select(F.col("context").alias("h_context"), F.col("n").alias("h_n"), F.col("c").alias("h_c"), F.col("best").alias("h_best"))
    rest = corpus.filter(F.col("n") < least).select(F.col("context").alias("r_context"), "n", "c", "best")
    out = phrases.join(F.broadcast(hot), F.col("context") == F.col("h_context"), "left")
    # rows that met a hot context are spread by an even hash of their own; contexts are odd
    key = F.when(F.col("h_n").isNotNull() | (F.col("context") == 0), F.shiftleft(F.xxhash64("row", "seq"), 1)).otherwise(F.col("context"))
    out = out.withColumn("key", key).join(rest, F.col("key") == F.col("r_context"), "left")
    n, c, best = (F.coalesce(f"h_{k}", k) for k in ("n", "c", "best"))
    same = F.col("content") == best
    mine = F.col("train").cast("int")
    n, c = n - mine, c - F.when(same, mine).otherwise(0)
    some = F.coalesce(c > 0, F.lit(False))
    return out.select("row", "seq", "train", "own", F.when(some, _kind(c, n)).alias("kind"), F.when(some, same).alias("hit"))


def _phrase_rows(texts: DataFrame, words, every: int) -> DataFrame:
    """(row, seq, train, context, content, own) of every phrase of training texts, without scores."""

    def rows(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for a, z, t in _runs(b.column(0).to_pylist(), words.value):
                starts, context, content = t.phrases(every)
                own = t.own[starts]
                seq = np.arange(len(starts)) - np.searchsorted(own, own)
                cols = [pa.array(row + own), pa.array(seq.astype(np.int32)), pa.array(np.ones(len(own), dtype=bool)), pa.array(context), pa.array(content), pa.array(np.zeros(len(own), dtype=np.float32))]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "seq", "train", "context", "content", "own"])
                row += z - a

    return texts.mapInArrow(rows, "row long, seq int, train boolean, context long, content long, own float")


def _with_history(met: DataFrame) -> DataFrame:
    """With how the last two phrases of the text came out: not predicted, missed or met."""
    w = Window.partitionBy("row").orderBy("seq")
    outcome = F.coalesce(F.col("hit").cast("int") + 1, F.lit(0))
    history = F.coalesce(F.lag(outcome, 1).over(w), F.lit(0)) * 3 + F.coalesce(F.lag(outcome, 2).over(w), F.lit(0))
    return met.withColumn("history", history).select("row", "train", "own", "hit", "kind", "history")


def _chances(met: DataFrame) -> np.ndarray:
    known = met.filter("train and hit is not null").groupBy("kind", "history").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
    return _hit_chances(known.toPandas())


def score(docs: DataFrame, model: Model, *, folds: int = FOLDS, every: int = EVERY, same_docs: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, and
    n_phrases and n_predicted (the phrases that came as predicted).

    With same_docs, docs are those that were fitted: training rows leave out their own phrases.
    """
    if model.phrases is None and not same_docs:
        raise ValueError("fit with phrases to score other documents")
    spark, docs = docs.sparkSession, id_and_text(docs)
    n, v = model.n, model.v
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = spark.sparkContext.broadcast(model.learned)
    docs = docs.select("doc_id", "text", F.coalesce(held_out("doc_id", folds), F.lit(False)).alias("held_out"))
    base = np.log10((model.learned[0].counts[:-1] + 0.1) / (n + 0.1 * (v + 1)))

    def spelled(texts: list[str], scorer: Scorer, most: int = 1 << 21):
        """Runs of texts whose rare words are known to the scorer: those of several runs share more beginnings."""
        for first, past in chunks(texts, most):
            runs = list(_runs(texts[first:past], scorer.words))
            scorer.of_rare([w for _, _, t in runs for w in t.rare])
            yield from ((first + a, first + z, t) for a, z, t in runs)

    def rows(batches):
        scorer = _scorer(held.value)
        words = scorer.words
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for a, z, t in spelled(b.column(1).to_pylist(), scorer):
                k = z - a
                logs = scorer.tokens(t)
                named = t.ids != words.rare
                starts, context, content = t.phrases(every)
                of_text = np.searchsorted(starts, np.append(t.first, len(t.ids)))
                lists = pa.ListArray.from_arrays(
                    pa.array(of_text, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(context), pa.array(content), pa.array(np.add.reduceat(logs, starts).astype(np.float32))], names=["context", "content", "own"]),
                )
                of_rare = np.searchsorted(t.rare_at, np.append(t.first, len(t.ids)))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(a, k),
                        b.column(2).slice(a, k),
                        pa.array(np.arange(row, row + k)),
                        pa.array(t.sizes.astype(np.int64)),
                        pa.array(t.bytes),
                        pa.array(np.add.reduceat(named.astype(np.int64), t.first)),
                        pa.array(np.add.reduceat(np.where(named, np.append(base, 0.0)[t.ids], 0.0), t.first)),
                        pa.ListArray.from_arrays(pa.array(of_rare, pa.int32()), pa.array(t.rare, pa.binary())),
                        lists,
                    ],
                    names=["doc_id", "held_out", "row", "n_tokens", "n_bytes", "known", "base", "rare", "phrases"],
                )
                row += k

    columns = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_bytes long, known long, base double, rare array<binary>, phrases array<struct<context: long, content: long, own: float>>"
    first = written(docs.mapInArrow(rows, columns), "lm-rows", codec="zstd")
    phrases = first.select("row", (~F.col("held_out")).alias("train"), F.posexplode("phrases").alias("seq", "p")).select("row", "seq", "train", "p.*")
    if not same_docs:
        phrases = phrases.withColumn("train", F.lit(False))
    corpus = written(_corpus_phrases(phrases), "lm-phrases") if model.phrases is None else model.phrases
    met = written(_with_history(_met(phrases, corpus)), "lm-met", codec="zstd")
    chances = _chances(met) if model.chances is None else model.chances
    at = F.col("kind") * 9 + F.col("history")
    yes, no = (F.get(F.array(*[F.lit(float(x)) for x in np.log10(p)]), at) for p in (chances, 1 - chances))
    log = F.when(F.col("hit"), yes).when(~F.col("hit"), no + F.col("own")).otherwise(F.col("own").cast("double"))
    sums = met.groupBy("row").agg(F.sum(log).alias("score"), F.count("*").alias("n_phrases"), F.sum(F.coalesce(F.col("hit").cast("long"), F.lit(0))).alias("n_predicted"))
    rare = first.select("row", F.explode("rare").alias("word")).join(model.counts, "word")
    unit = F.log10((F.col("c") + 0.1) / F.lit(n + 0.1 * (v + 1)))
    missing = math.log10(0.1 / (n + 0.1 * (v + 1)))
    rare = rare.groupBy("row").agg(F.count(F.when(F.col("c") > 0, 1)).alias("k2"), F.count("*").alias("met"), F.sum(unit).alias("b2"))
    out = first.select("doc_id", "held_out", "row", "n_tokens", "n_bytes", "known", "base").join(sums, "row").join(rare, "row", "left")
    unmet = F.col("n_tokens") - F.col("known") - F.coalesce("met", F.lit(0))  # words that no fitted text has
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k2", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", F.lit(0.0)) + unmet * F.lit(missing)).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
        "n_phrases",
        "n_predicted",
    )


def score_documents(docs: DataFrame, *, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fit on the training fold and score every document."""
    docs = id_and_text(docs, id_col, text_col)
    return score(docs, fit(docs, folds=folds, phrases=False, **options), folds=folds, same_docs=True)
