"""Hierarchical packing of tokenized documents for several context sizes, without padding.

Every document becomes token ids followed by an end id. Windows of the longest size that a document fills alone are cut
from its beginning; what is left, and every shorter document, is routed to the smallest tier (a power of two) that holds
it. Then, in a task's pool of such pieces:

1. each tier is packed, from the longest: its pieces, longest first, open a window, and the gap is filled from shorter
   pieces, of this tier or shorter ones: with one to three pieces that fill it exactly if such are found, else with the longest
   that fits, and again. Windows that come out exactly full stay; the others' pieces go back to the pool;
2. the pool's rest fills windows of the longest size; where nothing fits a gap, the longest piece is cut there;
3. the last window, if it isn't full, is cut in sequences of powers of two.

So every sequence is as long as a power of two, none is padded, and a document is cut where no whole ones fill a
window. Last, the sequences of each tier are dealt into step groups of about `step_tokens` tokens of equal context, in
turns by their cost (the sum of squared lengths of pieces: attention within documents), so that steps cost alike.

A task packs what it tokenizes, in pools of bounded size, so nothing is shuffled and ids never leave the task. The
number of cuts that the ends of pools add depends on the number of partitions and on `pool`, not on the input.

Defined results: null or empty text is the end id alone; repeated rows are packed each on its own; an empty table gives
an empty result; a text of any length is packed whole; extra columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import id_and_text
from .packing import _encoder

#: item, start within it, length
Piece = tuple[int, int, int]


class Pool:
    """Pieces by length, with the lengths that there are as bits: from the shortest, and from the longest in `back`."""

    def __init__(self, lengths: list[int], size: int):
        self.size = size
        self.left: list[list[Piece]] = [[] for _ in range(size + 1)]
        self.bits = self.back = 0
        for i, n in enumerate(lengths):
            self.put((i, 0, n))

    def put(self, piece: Piece) -> None:
        n = piece[2]
        self.left[n].append(piece)
        self.bits |= 1 << n
        self.back |= 1 << (self.size - n)

    def take(self, n: int) -> Piece:
        own = self.left[n]
        piece = own.pop()
        if not own:
            self.bits ^= 1 << n
            self.back ^= 1 << (self.size - n)
        return piece

    def longest(self, most: int) -> int:
        """The longest length up to `most`; 0 if there is none."""
        return max(0, (self.bits & ((2 << most) - 1)).bit_length() - 1)

    def exact(self, gap: int) -> tuple[int, ...]:
        """The length, or the two, that fill the gap; of pairs the most uneven one."""
        if self.bits >> gap & 1:
            return (gap,)
        both = self.bits & (self.back >> (self.size - gap)) & ((2 << gap) - 1)
        x = both.bit_length() - 1
        if x < 1 or 2 * x == gap and len(self.left[x]) < 2:
            return ()
        return x, gap - x

    def three(self, gap: int, tries: int = 48) -> list[Piece]:
        """Three pieces that fill the gap exactly, if one of the longest `tries` lengths that fit has two to go with."""
        x = self.longest(gap - 2) if gap > 2 else 0
        for _ in range(tries):
            if not x:
                break
            piece = self.take(x)
            full = self.exact(gap - x)
            if full:
                return [piece, *(self.take(y) for y in full)]
            self.put(piece)
            x = self.longest(x - 1)
        return []

    def window(self, first: int, size: int, depth: int = 12) -> tuple[list[Piece], int]:
        """A window opened with a piece of length `first`, filled from the pool, and its gap."""
        held, gap = [self.take(first)], size - first
        while gap:
            full = [self.take(x) for x in self.exact(gap)] or self.three(gap)
            if full:
                return held + full, 0
            x = self.longest(gap)
            if not x or len(held) >= depth:
                break
            held.append(self.take(x))
            gap -= x
        return held, gap


def fill(lengths: list[int], tiers: tuple[int, ...]) -> list[list[Piece]]:
    """Sequences of pieces of items of these lengths (below the longest tier, or equal to it)."""
    size = tiers[0]
    pool, out = Pool(lengths, size), []
    for tier in tiers:
        aside = []
        at = pool.longest(tier)
        shortest = tier // 2 if tier != tiers[-1] else 0
        while at > shortest:
            held, gap = pool.window(at, tier)
            if gap:
                aside.append(held[0])
                for p in held[1:]:
                    pool.put(p)
            else:
                out.append(held)
            at = pool.longest(at)
        for p in aside:
            pool.put(p)
    while at := pool.longest(size):
        held, gap = pool.window(at, size, depth=size)
        if gap and (x := pool.longest(size)):
            item, start, n = pool.take(x)
            held.append((item, start, gap))
            pool.put((item, start + gap, n - gap))
            gap = 0
        if not gap:
            out.append(held)
            continue
        while held:  # the last one
            room = 1 << (sum(p[2] for p in held).bit_length() - 1)
            now = []
            while room:
                item, start, n = held.pop(0)
                now.append((item, start, min(n, room)))
                if n > room:
                    held.insert(0, (item, start + room, n - room))
                room -= now[-1][2]
            out.append(now)
    return out


def balanced(sequences: list[tuple[int, int]], step_tokens: int) -> tuple[list[int], int]:
    """The step group of each sequence (context size, cost), and their number: sequences of one size, in turns by cost."""
    groups, n = [0] * len(sequences), 0
    for tier in {s for s, _ in sequences}:
        own = sorted((i for i, s in enumerate(sequences) if s[0] == tier), key=lambda i: -sequences[i][1])
        steps = -(-len(own) // max(1, step_tokens // tier))
        for j, i in enumerate(own):
            turn, k = divmod(j, steps)
            groups[i] = n + (steps - 1 - k if turn % 2 else k)
        n += steps
    return groups, n


class Task:
    """What a task has tokenized and not yet packed."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, kind: pa.DataType, number: int):
        self.tiers, self.step_tokens, self.kind = tiers, step_tokens, kind
        self.sequence = self.step = number << 32
        self.clear()

    def clear(self) -> None:
        self.docs: list = []  # doc_id, ids of the whole document
        self.full: list[tuple[int, int, int]] = []  # doc, start, checksum
        self.rest: list[tuple[int, int, bytes]] = []  # doc, start, ids
        self.bytes = 0

    def add(self, doc_id, ids: bytes) -> None:
        size, n, d = self.tiers[0], len(ids) // 4, len(self.docs)
        self.docs.append((doc_id, n))
        whole = n // size
        for k in range(whole):
            self.full.append((d, k * size, zlib.crc32(ids[4 * k * size : 4 * (k + 1) * size])))
        if n % size:
            self.rest.append((d, whole * size, ids[4 * whole * size :]))
            self.bytes += 4 * (n % size)

    def packed(self) -> Iterator[pa.RecordBatch]:
        """All pieces with their places; the pool is empty after it."""
        size = self.tiers[0]
        pieces = fill([len(ids) // 4 for _, _, ids in self.rest], self.tiers)
        cost = [(size, size * size)] * len(self.full) + [(sum(n for _, _, n in p), sum(n * n for _, _, n in p)) for p in pieces]
        steps, n_steps = balanced(cost, self.step_tokens)
        rows = [(d, start, size, crc, k, 0) for k, (d, start, crc) in enumerate(self.full)]
        for k, held in enumerate(pieces, len(self.full)):
            at = 0
            for item, start, n in held:
                d, before, ids = self.rest[item]
                rows.append((d, before + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), k, at))
                at += n
        for a in range(0, len(rows), 50_000):
            doc, start, length, crc, k, at = zip(*rows[a : a + 50_000])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.docs[d][0] for d in doc], self.kind),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                    pa.array([self.docs[d][1] for d in doc], pa.int64()),
                    pa.array([self.sequence + x for x in k], pa.int64()),
                    pa.array(at, pa.int64()),
                    pa.array([cost[x][0] for x in k], pa.int32()),
                    pa.array([self.step + steps[x] for x in k], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"],
            )
        self.sequence += len(cost)
        self.step += n_steps
        self.clear()


def pack_tiers(docs: DataFrame, tokenizer: str, *, tiers: tuple[int, ...] = (1024, 512, 256, 128), end_id: int = 0, step_tokens: int = 1 << 16, pool: int = 20_000, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 250_000) -> DataFrame:
    """Every piece of every document with its sequence_id, its offset there, the sequence's tier (its length) and its step group.

    `tiers` are powers of two, longest first; `pool` is the most documents that a task packs together.
    """
    if any(t < 1 or t & (t - 1) for t in tiers) or sorted(tiers, reverse=True) != list(tiers):
        raise ValueError(f"tiers must be powers of two, longest first: {tiers}")
    df = id_and_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    tail = array("I", [end_id]).tobytes()

    def rows(batches):
        enc = _encoder(tokenizer, most_chars)
        task = None
        for b in batches:
            task = task or Task(tiers, step_tokens, b.schema.field(0).type, TaskContext.get().partitionId())
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                task.add(doc_id, enc.encode(t) + tail)
                if len(task.docs) >= pool or task.bytes > 32 << 20 or len(task.full) > 200_000:
                    yield from task.packed()
        if task and task.docs:
            yield from task.packed()

    return df.mapInArrow(rows, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long")
