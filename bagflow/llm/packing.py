"""Best-fit packing of tokenized documents into sequences of a fixed length (best-two-fit).

Every document becomes token ids followed by an end id. Only documents longer than a sequence are cut, into pieces of
the full length (the remainder is the first piece). Pieces are dealt by hash into groups of about `group_pieces`; each
group is packed by itself, which costs at most about one open sequence a group:

1. fill greedily: open a sequence with the longest unpacked piece, then add the longest that fits, again and again;
2. if a gap is left, take out the sequence's smallest piece and put in the two unpacked pieces that fill the widened
   gap most tightly, if they fill it better than that piece did.

Only lengths and ids of pieces are shuffled, never tokens or texts. A group holds a bounded number of narrow rows.

Defined results: null or empty text is one piece holding the end id alone; repeated rows are packed each on its own;
an empty table gives an empty result; a text of any length is packed whole.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_chars, id_and_text, written

PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, for a byte-level BPE tokenizer file.

    Texts without runs of white space go to a faster encoder of the same vocabulary and pre-tokens. A space between two
    characters that aren't white space always begins a pre-token, so long ones are cut there, as tokens are held as Python
    numbers for a moment. Other texts, and those that hold a special token, go to the tokenizer whole, as do all texts if
    the file's rules aren't those that this takes for granted.
    """

    #: The rules of byte-level files, and their pattern of pre-tokens.
    RULES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, most_chars: int):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        model, rules = spec["model"], {k: v for k, v in (spec["pre_tokenizer"] or {}).items() if k != "trim_offsets"}
        self.known = spec["normalizer"] is None and rules == self.RULES and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if self.known:
            byte_of = {c: b for b, c in enumerate(byte_chars())}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
            self.piece = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most_chars

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.known or _RUN(text) or any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + self.most)
            end = len(text) if end < 0 else end
            out.append(array("I", self.piece(text[at:end])).tobytes())
            at = end
        return b"".join(out)


def _run():
    import re

    return re.compile(r"[\s\x1c-\x1f\x85]{2}|^\s|\s$").search


_RUN = _run()


@lru_cache(maxsize=2)
def _encoder(path: str, most_chars: int) -> Encoder:
    return Encoder(path, most_chars)


def tokenized_pieces(docs: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 250_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    df = id_and_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    tail = array("I", [end_id]).tobytes()

    def rows(batches):
        enc = _encoder(tokenizer, most_chars)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = enc.encode(t) + tail
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n, size), n]
                for k in range(len(cuts) - 1):
                    at.append(i)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    crc.append(zlib.crc32(ids[4 * cuts[k] : 4 * cuts[k + 1]]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return df.mapInArrow(rows, PIECES.format(kind=kind))


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each piece."""
    order = np.argsort(lengths, kind="stable")
    left: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        left.setdefault(int(lengths[i]), []).append(i)
    have = sorted(left)  # distinct lengths that are unpacked
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)

    def take(x: int) -> int:
        own = left[x]
        i = own.pop()
        if not own:
            del have[bisect_right(have, x) - 1]
        return i

    def put_back(x: int, i: int) -> None:
        if not left[x]:
            insort(have, x)
        left[x].append(i)

    n = 0
    while have:
        held = []
        gap = size
        while gap and have:
            k = bisect_right(have, gap) - 1
            if k < 0:
                break
            x = have[k]
            held.append((x, take(x)))
            gap -= x
        if gap and have and len(held) > 1:
            small, i = held[-1]  # greedy filling adds ever smaller pieces
            pair = _tightest_pair(have, left, gap + small)
            if pair and sum(pair) > small:
                held.pop()
                held += [(x, take(x)) for x in pair]
                put_back(small, i)
        at = 0
        for x, i in held:
            bins[i], offsets[i] = n, at
            at += x
        n += 1
    return bins, offsets


def _tightest_pair(have: list[int], left: dict[int, list[int]], room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum that is at most room."""
    best, pair = 0, None
    lo, hi = 0, bisect_right(have, room) - 1
    while 0 <= lo <= hi:
        x, y = have[lo], have[hi]
        if x + y > room:
            hi -= 1
            continue
        if lo == hi and len(left[x]) < 2:
            break
        if x + y > best:
            best, pair = x + y, (y, x)
            if best == room:
                break
        lo += 1
    return pair


def pack(docs: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 0, group_pieces: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there."""
    pieces = written(tokenized_pieces(docs, tokenizer, size=size, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    schema = pieces.drop("bin_group").schema
    salted = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable")
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), size)
        group = int(pdf["bin_group"].iloc[0])
        return pdf.drop(columns="bin_group").assign(sequence_id=(group << 32) + bins, offset=offsets)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return salted.groupBy("bin_group").applyInPandas(one, f"{fields}, sequence_id long, offset long")
