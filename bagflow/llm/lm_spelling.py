"""The spelling of words that the code of `lm_score` doesn't name, by logistic context mixing over their bits.

A word is spelled in bytes and closed by a space. A byte's code are the branches of a Huffman tree of the bytes of the
training texts, so a frequent letter takes three or four binary decisions. Predictors estimate each from hashed contexts
(the last 2 and 4 bytes of the word, and its whole beginning), by how often 0 and 1 followed that context in the training
words. Their logits are mixed with weights that a gate selects by how much evidence the longest contexts have; a last
stage refines the mixed probability by what happened at such probabilities.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from ._common import _power_tables, mix64

#: How many of a word's last bytes the predictors see, besides the whole beginning; log2 of the slots of their tables.
LAST = (2, 4)
SLOTS = (18, 20, 20)
INPUTS = len(SLOTS) + 1
#: Evidence levels of the beginning and of the last 4 bytes, and the place of the bit.
PLACES = 6
GATES = 6 * 4 * PLACES
#: Refinement: places of a mixed logit, half a unit apart.
REACH = 12
STEPS = 4 * REACH + 1
REFINERS = 256 * STEPS


class Alphabet:
    """The Huffman code of bytes: for each byte and place the bit and the node before it."""

    def __init__(self, counts: np.ndarray):
        counts = np.maximum(counts, counts.sum() / 65536 + 1)
        heap = [(float(c), i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, branch = {}, {}
        for node in range(256, 511):
            for bit in (0, 1):
                c, _, own = heapq.heappop(heap)
                parent[own], branch[own] = node, bit
                total = c if bit == 0 else total + c
            heapq.heappush(heap, (total, node, node))
        paths = []
        for byte in range(256):
            path, at = [], byte
            while at in parent:
                path.append((parent[at] - 256, branch[at]))
                at = parent[at]
            paths.append(path[::-1])
        self.length = np.array([len(x) for x in paths], dtype=np.int8)
        self.depth = int(self.length.max())
        self.node, self.bit = (np.zeros((self.depth, 256), dtype=np.int64) for _ in range(2))
        for byte, path in enumerate(paths):
            for d, (node, bit) in enumerate(path):
                self.node[d, byte], self.bit[d, byte] = node, bit


class _Bits:
    """Slots of every predictor and decisions of a list of words.

    A beginning that a word shares with the word before it in the list is decided in the same way, so it is taken once:
    `source` is the place at which a byte's decisions are.
    """

    def __init__(self, words: list[bytes], alphabet: Alphabet):
        self.alphabet = alphabet
        spelled = [w + b" " for w in words]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        raw = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.bytes = raw
        self.own = np.repeat(np.arange(len(words)), sizes)
        starts = np.cumsum(sizes) - sizes
        first = starts[self.own]
        place = np.arange(len(raw)) - first
        wide = raw.astype(np.uint64) + np.uint64(1)
        context = np.zeros(len(raw), dtype=np.uint64)
        self.bases = []
        for k in range(1, max(LAST) + 1):
            prev = np.zeros(len(raw), dtype=np.uint64)
            prev[k:] = wide[:-k] if k < len(raw) else 0
            prev[place < k] = 0
            context = context * np.uint64(257) + prev
            if k in LAST:
                self.bases.append(mix64(context + np.uint64(k << 56)))
        up, down = _power_tables(len(raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum(wide * up[: len(raw)], out=sums[1:])
            whole = mix64((sums[:-1] - sums[first]) * down[first] + place.astype(np.uint64))
        self.bases.append(whole)
        # the byte at the same place of the word before: shared if both beginnings and both bytes are equal
        before = np.append(0, starts[:-1])[self.own] + place if len(words) else place
        same = (before < first) & (whole[before] == whole) & (raw[before] == raw) if len(words) else np.zeros(0, dtype=bool)
        order = np.argsort(place, kind="stable")
        self.source = np.empty(len(raw), dtype=np.int64)
        self.source[order] = order[np.maximum.accumulate(np.where(same[order], 0, np.arange(len(raw))))]
        self.fresh = np.flatnonzero(~same)

    def decisions(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each place in the bytes' codes: place, byte of each row, bit, node and each predictor's slot."""
        alphabet, at, raw = self.alphabet, self.fresh, self.bytes[self.fresh]
        bases = [base[at] for base in self.bases]
        for d in range(alphabet.depth):
            on = np.flatnonzero(alphabet.length[raw] > d)
            if len(on) < len(at):
                at, raw, bases = at[on], raw[on], [base[on] for base in bases]
            node = alphabet.node[d][raw]
            turn = node.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            slots = []
            for base, size in zip(bases, SLOTS):
                slot = base + turn
                slot *= np.uint64(0x9E3779B97F4A7C15)
                slot >>= np.uint64(64 - size)
                slots.append(slot.view(np.int64))
            yield d, at, alphabet.bit[d][raw], node, slots


def _logit(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    out = n1 + np.float32(0.05)
    out /= n0 + np.float32(0.05)
    np.log(out, out=out)
    return np.clip(out, -12, 12, out=out)


def _level(total: np.ndarray, bounds: tuple) -> np.ndarray:
    return sum((total > np.float32(b)).view(np.int8) for b in bounds)


#: Evidence bounds of the tables that gate: the beginning and the last 4 bytes.
BOUNDS = {2: (0.5, 2.5, 8.5, 64.5, 1000.5), 1: (0.5, 4.5, 32.5)}


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -18, 18)))


def _mixed(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x[0] * np.take(weights[0], gate, mode="clip")
    for k in range(1, len(x)):
        z += x[k] * np.take(weights[k], gate, mode="clip")
    return z


def _place(z: np.ndarray, node: np.ndarray) -> np.ndarray:
    return node * STEPS + np.rint(np.clip(z, -REACH, REACH) * 2).astype(np.int64) + STEPS // 2


def refinement(refine: np.ndarray) -> np.ndarray:
    """The refined probability of a 1 at every place of every node: half of it what was mixed, half what happened there."""
    n = refine.reshape(-1, STEPS, 2)
    p = _squash((np.arange(STEPS) - STEPS // 2) / 2)
    return np.clip((p + (n[:, :, 1] + 4 * p) / (n.sum(axis=2) + 4)) / 2, 1e-7, 1 - 1e-7).astype(np.float32).ravel()


def refined(z: np.ndarray, node: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The refined probability of a 1 for a mixed logit: between the two nearest places, so that rounding decides nothing."""
    at = np.clip(z, -REACH, REACH)
    at *= 2
    at += np.float32(STEPS // 2)
    low = np.minimum(at.astype(np.int64), STEPS - 2)
    at -= low.astype(np.float32)
    low += node * STEPS
    out = np.take(table[1:], low, mode="clip")
    none = np.take(table, low, mode="clip")
    out -= none
    out *= at
    out += none
    return out


def _gate(levels: dict, d: int) -> np.ndarray:
    return (levels[2].astype(np.int64) * 4 + levels[1]) * PLACES + min(d, PLACES - 1)


def start() -> np.ndarray:
    """Weights to begin with: the more evidence the beginning of the word has, the more it counts."""
    of_beginning = np.array([0.0, 0.4, 0.6, 0.8, 0.95, 1.0])
    w = np.zeros((6, GATES // 6, INPUTS))
    w[:, :, :2] = (1 - of_beginning)[:, None, None] * np.array([0.4, 0.6])
    w[:, :, 2] = of_beginning[:, None]
    return w.reshape(GATES, INPUTS)


class Learner:
    """Learns counts and weights in one reading: a word is predicted from what was counted before its batch."""

    def __init__(self, alphabet: Alphabet):
        self.alphabet = alphabet
        self.tables = [np.zeros(2 << size, dtype=np.int32) for size in SLOTS]
        self.pairs = [t.view(np.uint64) for t in self.tables]
        self.weights = start().T.copy()
        self.curve = np.zeros((INPUTS, GATES))
        self.mass = np.zeros(GATES)
        self.refine = np.zeros(2 * REFINERS, dtype=np.int64)
        self.batches = 0
        self.waiting: list = []

    def learn(self, words: list[bytes], counts: np.ndarray) -> None:
        """One online step of each gate's weights, scaled by a fading sum of curvature; words are counted a few batches later."""
        order = sorted(range(len(words)), key=words.__getitem__)  # so that neighbours share their beginnings
        bits, counts = _Bits([words[i] for i in order], self.alphabet), counts[order]
        times = np.bincount(bits.source, weights=counts[bits.own], minlength=len(bits.own))
        mass, grad, bend = np.zeros(GATES), np.zeros((INPUTS, GATES)), np.zeros((INPUTS, GATES))
        weights = self.weights.astype(np.float32)
        slow = self.batches % 4 == 0  # the curvature changes slowly
        counted: list[list[np.ndarray]] = [[] for _ in SLOTS]
        each = []
        for d, at, bit, node, slots in bits.decisions():
            whole = times[at].astype(np.int64)
            each.append(whole)
            c = whole.astype(np.float32)
            x, levels = np.empty((INPUTS, len(bit)), dtype=np.float32), {}
            x[-1] = 0.5
            for k, slot in enumerate(slots):
                both = np.take(self.pairs[k], slot, mode="clip").view(np.int32)
                n0, n1 = both[::2].astype(np.float32), both[1::2].astype(np.float32)
                x[k] = _logit(n0, n1)
                if k in BOUNDS:
                    levels[k] = _level(n0 + n1, BOUNDS[k])
                counted[k].append(2 * slot + bit)
            gate = _gate(levels, d)
            z = _mixed(x, gate, weights)
            p = _squash(z)
            np.add.at(self.refine, 2 * _place(z, node) + bit, whole)
            err = (bit.astype(np.float32) - p) * c
            mass += np.bincount(gate, weights=c, minlength=GATES)
            for k in range(INPUTS):
                grad[k] += np.bincount(gate, weights=err * x[k], minlength=GATES)
                if slow:
                    bend[k] += np.bincount(gate, weights=p * (1 - p) * c * x[k] * x[k], minlength=GATES)
        if slow:
            self.curve = np.where(self.curve == 0, 10 * bend, 0.7 * self.curve + 3 * bend)
        self.batches += 1
        self.weights += np.clip(grad / (self.curve + 1.0), -0.5, 0.5)
        self.mass += mass
        self.waiting.append((counted, np.concatenate(each)))
        if len(self.waiting) >= min(16, 1 + self.batches // 4):
            self.count()

    def count(self) -> None:
        """Add the words of the last batches to the tables."""
        if self.waiting:
            for counted, times in self.waiting:
                for table, at in zip(self.tables, counted):
                    np.add.at(table, np.concatenate(at), times.astype(np.int32))
            self.waiting.clear()


class Speller:
    """Scores words by fixed tables of logits and evidence levels, weights and refinement."""

    def __init__(self, alphabet: Alphabet, tables: list[np.ndarray], weights: np.ndarray, refine: np.ndarray):
        self.alphabet = alphabet
        self.logits = []
        for k, t in enumerate(tables):
            n = t.reshape(-1, 2).astype(np.float32)
            logit = _logit(n[:, 0], n[:, 1])
            if k in BOUNDS:  # its evidence level is in the last three bits of the number: one lookup reads both
                logit = ((logit.view(np.int32) & ~7) | _level(n.sum(axis=1), BOUNDS[k])).astype(np.int32).view(np.float32)
            self.logits.append(logit)
        self.weights = np.ascontiguousarray(weights.T, dtype=np.float32)
        self.refined = refinement(refine)

    def bits(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each place in the bytes' codes: the byte of each row, the bit, and the probability that it is 1."""
        yield from self._decided(_Bits(words, self.alphabet))

    def _decided(self, bits: _Bits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for d, at, bit, node, slots in bits.decisions():
            x = np.empty((INPUTS, len(bit)), dtype=np.float32)
            x[-1] = 0.5
            for k, slot in enumerate(slots):
                np.take(self.logits[k], slot, out=x[k], mode="clip")
            z = _mixed(x, _gate({k: x[k].view(np.int32) & 7 for k in BOUNDS}, d), self.weights)
            yield at, bit, refined(z, node, self.refined)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability."""
        bits = _Bits(words, self.alphabet)
        chance = np.ones(len(bits.bytes))
        for at, bit, p in self._decided(bits):
            chance[at] *= np.abs(p - (1 - bit).astype(np.float32))
        return np.bincount(bits.own, weights=np.log10(chance)[bits.source], minlength=len(words))
