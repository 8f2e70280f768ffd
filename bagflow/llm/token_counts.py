"""Token counts by rank-synchronous merging of ragged arrays.

Byte-pair encoding merges, in every pre-token, its adjacent pair of the lowest rank until none has one. Here all
pre-tokens of a batch stand in one flat array of symbol ids; in each round every pre-token applies the merge of its
own lowest rank (all places of that pair, left to right) at once, and the array shrinks. The symbols left are the
tokens.

A text is split at white space first (the tokenizer drops white space and no pre-token crosses it), so each distinct
piece is normalised, split and merged once per task and looked up after that. The cache is cleared when it holds
`cache_size` pieces, so memory is bounded. Special tokens inside a text count as one token each, as the tokenizer's
default has it.

Defined results: null or empty text counts 0 bytes and 0 tokens; repeated rows count alike; an empty table gives an
empty result; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import byte_chars, id_and_text


#: White space as the tokenizers' patterns have it; str.split also splits at U+001C to U+001F.
_WHITE = re.compile(r"[^\S\x1c-\x1f]+")
_ODD = re.compile(r"[\x1c-\x1f]")
#: The pre-token pattern of the word tokenizer (a fixed value of its file).
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall


_CHAR_OF = byte_chars()
_BYTE_OF = {c: b for b, c in enumerate(_CHAR_OF)}


class MergeTable:
    """Merge ranks as sorted arrays: the rank and the result of a pair of symbols."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.size = max(vocab.values()) + 2
        left, right, made = (np.array([vocab[x] for x in xs], dtype=np.int64) for xs in ([p[0] for p in pairs], [p[1] for p in pairs], [p[0] + p[1] for p in pairs]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        keep = np.ones(len(keys), dtype=bool)
        keep[1:] = keys[order][1:] != keys[order][:-1]
        self.keys, self.rank, self.made = keys[order][keep], order[keep], made[order][keep]
        # a hashed table of pairs that may exist: most lookups are of pairs without a rank
        self.may = np.zeros(1 << 22, dtype=bool)
        self.may[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (no rank: a number above all) and the symbol it makes."""
        none = np.iinfo(np.int64).max
        rank, made = np.full(len(left), none), np.full(len(left), -1)
        keys = left * self.size + right
        some = np.flatnonzero(self.may[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        hit = self.keys[at] == keys[some]
        rank[some[hit]], made[some[hit]] = self.rank[at[hit]], self.made[at[hit]]
        return rank, made


def surviving(symbols: np.ndarray, sizes: np.ndarray, table: MergeTable) -> np.ndarray:
    """How many symbols are left of each sequence; `sizes` has their lengths in the flat array `symbols`."""
    none = np.iinfo(np.int64).max
    out = sizes.copy()
    own = np.repeat(np.arange(len(sizes)), sizes)
    syms = symbols.astype(np.int64)
    if len(table.keys) == 0:
        return out
    while len(syms) > 1:
        rank, made = table.ranks(syms[:-1], syms[1:])
        rank[own[:-1] != own[1:]] = none
        # the lowest rank of each sequence
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        low = np.minimum.reduceat(np.r_[rank, none], first)
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(syms)]))
        live = low < none
        if not live.any():
            break
        hit = np.r_[(rank == low[group[:-1]]) & (rank < none), False]
        # of overlapping places (x x x) every second one of a run merges, from the left
        places = np.flatnonzero(hit)
        start = np.r_[True, np.diff(places) != 1]
        run = np.maximum.accumulate(np.where(start, np.arange(len(places)), 0))
        places = places[(np.arange(len(places)) - run) % 2 == 0]
        syms[places] = made[places]
        keep = np.ones(len(syms), dtype=bool)
        keep[places + 1] = False
        # sequences without a pair of any rank are done
        keep &= live[group]
        np.subtract.at(out, own[places], 1)
        syms, own = syms[keep], own[keep]
    return out


@lru_cache(maxsize=4)
def _counter(path: str, cache_size: int) -> "WordCounter":
    return WordCounter(path, cache_size)


class WordCounter:
    """Counts tokens of whole texts for a tokenizer file whose model is BPE and whose pre-tokens hold no white space.

    A file with other rules than these is left to its library.
    """

    #: The rules of word-level files.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLITTER = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }

    def __init__(self, path: str, cache_size: int):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        tok = Tokenizer.from_file(path)
        self.whole, self.normalizer, self.splitter = tok, tok.normalizer, tok.pre_tokenizer
        m = model["model"]
        self.known = model["normalizer"] == self.NORMALIZER and model["pre_tokenizer"] == self.SPLITTER and m["type"] == "BPE" and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not self.known:
            return
        suffix = m.get("end_of_word_suffix") or ""
        self.table = MergeTable(m["vocab"], m["merges"])
        self.inner = np.array([m["vocab"][_CHAR_OF[b]] for b in range(256)])
        self.final = np.array([m["vocab"][_CHAR_OF[b] + suffix] for b in range(256)])
        special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cache: dict[str, int] = {}
        self.cache_size = cache_size

    def _words(self, piece: str) -> list[bytes]:
        """The pre-tokens of a piece as bytes. Pieces of plain Latin letters take the same rules without the library's calls."""
        if piece.isascii() or max(piece) < "\u0250" and "\u0130" not in piece:
            return [w.encode() for w in _SPLIT(piece.lower())]
        return [bytes(map(_BYTE_OF.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece))]

    def _learn(self, pieces: list[str]) -> None:
        """Count the distinct pieces together and keep the counts."""
        words = [self._words(p) for p in pieces]
        flat = [w for ws in words for w in ws]
        counts = np.zeros(len(pieces), dtype=np.int64)
        if flat:
            sizes = np.fromiter(map(len, flat), np.int64, len(flat))
            raw = np.frombuffer(b"".join(flat), dtype=np.uint8)
            symbols = self.inner[raw]
            last = np.cumsum(sizes) - 1
            symbols[last] = self.final[raw[last]]
            own = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, words), np.int64, len(words)))
            counts = np.bincount(own, weights=surviving(symbols, sizes, self.table), minlength=len(pieces)).astype(np.int64)
        self.cache.update(zip(pieces, counts.tolist()))

    def count(self, texts: list[str]) -> list[int]:
        if not self.known:
            return [len(e.ids) for e in self.whole.encode_batch(texts, add_special_tokens=False)]
        split, extra = [], []
        for t in texts:
            n = 0
            if self.special is not None and "<|" in t:
                t, n = self.special.subn(" ", t)
            split.append(_WHITE.split(t) if _ODD.search(t) else t.split())
            extra.append(n)
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        new = list(set().union(*split).difference(self.cache)) if split else []
        for a in range(0, len(new), 50_000):
            self._learn(new[a : a + 50_000])
        get = self.cache.__getitem__
        return [n + sum(map(get, words)) for n, words in zip(extra, split)]


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    cache_size: int = 700_000,
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row; `tokenizer` is a path that every worker can open."""
    df = id_and_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        counter = _counter(tokenizer, cache_size)
        for b in batches:
            texts = b.column(1).to_pylist()
            n_bytes = [len(t.encode("utf-8", "replace")) for t in texts]
            n, a, size = [], 0, 0
            for i, x in enumerate(n_bytes):
                size += x
                if size > batch_bytes:
                    n += counter.count(texts[a : i + 1])
                    a, size = i + 1, 0
            n += counter.count(texts[a:])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return df.mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
