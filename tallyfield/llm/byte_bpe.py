"""Operator 11: byte-level BPE encoding and decoding with contiguous rank arrays.

A text is cut at the strings of special tokens, each of which is its own token, and between them into pre-tokens. A short pre-token is merged over two
contiguous arrays, the ids of its parts and the ranks of adjacent pairs: the least rank is searched, the boundary
there is deleted and the two ranks beside it are refreshed, until no pair has a rank. Pre-tokens over SHORT bytes, for which that would be
quadratic, are merged with a heap of pairs over a linked list: the same merges in the same order. A worker remembers the ids of short
pre-tokens, up to a bound. Decoding joins the bytes of the tokens and reads them as UTF-8.

The library's Unicode tables decide what a letter, a number and white space are; they are read off it on the driver, by cutting one
string of all code points, and only their ranges are sent.

Null and empty texts have no tokens; a null list of ids decodes to the empty text, as does a list of none. Ids outside the vocabulary and null ids
decode to nothing; bytes that are no UTF-8 to U+FFFD, as the library does. Texts are encoded whole, whatever their length. Repeated rows and null ids of
rows each give a row; other columns pass through, but for those named like the results, which these replace.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes of a pre-token that is merged by scanning; longer ones need a heap.
SHORT = 96
#: Pre-tokens that a worker remembers, those met last; it holds up to twice as many.
REMEMBERED = 300_000
NEVER = 1 << 30
#: Ends of English contractions, fixed values of the cutting rule.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
ABOVE = re.compile("[\U00010000-\U0010ffff]")


def tokenizer_path(tokenizer: str) -> str:
    """A file of the public tokenizers by name; a path stays as it is."""
    import public_tokenizers

    return tokenizer if os.path.sep in tokenizer else str(public_tokenizers.path(tokenizer))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if it is printable in Latin-1, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@cache
def classes(path: str) -> dict[str, list[tuple[int, int]]]:
    """The ranges of code points that the library's cutting takes as letters (L), numbers (N) and white space (S).

    One string of all code points in order is cut: each piece is a run of one class, which its first code point tells.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found: dict[str, list[tuple[int, int]]] = {"L": [], "N": [], "S": []}
    for _, (a, b) in cut("".join(map(chr, points))):
        # a space goes with what follows, so it is a piece of its own here
        for first, last in ((points[a], points[a]), (points[a + 1], points[b - 1])) if points[a] == 0x20 and b > a + 1 else ((points[a], points[b - 1]),):
            c = chr(first)
            ends = [end for _, (_, end) in cut(f"a{c}{c}1")]
            kind = "S" if c == " " or ends == [1, 2, 3, 4] else "L" if ends == [3, 4] else "N" if ends == [1, 4] else "O"
            if kind != "O":
                found[kind].append((first, last))
    return found


def pattern(ranges: dict[str, list[tuple[int, int]]], end: int = 0x110000) -> re.Pattern:
    """The rule that cuts texts of code points below `end` into pre-tokens, with explicit ranges."""
    of = {k: "".join(f"\\U{a:08x}-\\U{min(b, end - 1):08x}" for a, b in v if a < end) for k, v in ranges.items()}
    letters, numbers, space = (of[k] for k in "LNS")
    short = "|".join(CONTRACTIONS)
    return re.compile(f"'(?:{short})| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class Encoder(dict):
    """Ids of a pre-token, merged when asked for the first time. Holds the pre-tokens met of late; `older` those met before them."""

    def __init__(self, path: str, ranges: dict[str, list[tuple[int, int]]]):
        super().__init__()
        self.older: dict[str, tuple[int, ...]] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a plain byte-level BPE tokenizer")
        vocabulary, letters = spec["model"]["vocab"], byte_letters()
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocabulary[letter]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocabulary[a] << 32 | vocabulary[b]] = rank
            self.merged.append(vocabulary[a + b])
        self.byte_ranks = [self.ranks.get(a << 32 | b, NEVER) for a in self.first for b in self.first]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take white space or whole words only")
        self.special = special
        # where two begin at one place, the longer one counts
        self.cut_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        # up to U+FFFF a class is one table; ranges above it are searched one by one, so only texts that need them are
        self.any, self.basic = pattern(ranges).findall, pattern(ranges, 0x10000).findall
        self.pieces = np.empty(max([*vocabulary.values(), *special.values()]) + 1, object)
        self.pieces[:] = b""
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.pieces[i] = token.encode()

    def __missing__(self, word: str) -> list[int]:
        if (ids := self.older.pop(word, None)) is None:
            data = word.encode("utf-8")
            if len(data) > SHORT:
                return self.merge_long([self.first[b] for b in data])
            ids = self.merge_short(data)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def merge_short(self, data: bytes) -> tuple[int, ...]:
        """Contiguous arrays: scan for the least rank, delete that boundary, refresh both neighbours."""
        rank_of, merged, table = self.ranks.get, self.merged, self.byte_ranks
        parts = [self.first[b] for b in data]
        ranks = [table[a << 8 | b] for a, b in zip(data, data[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            k = ranks.index(least)
            parts[k] = merged[least]
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank_of(parts[k - 1] << 32 | parts[k], NEVER)
            if k < len(ranks):
                ranks[k] = rank_of(parts[k] << 32 | parts[k + 1], NEVER)
        return tuple(parts)

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for any length: pairs wait in a heap by rank, then place; parts are linked to their neighbours."""
        rank_of, merged, n = self.ranks.get, self.merged, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, k) for k in range(n - 1) if (r := rank_of(parts[k] << 32 | parts[k + 1])) is not None]
        heapify(waiting)
        while waiting:
            rank, k = heappop(waiting)
            j = after[k]
            # a pair that has changed since it was put in has another rank, or none
            if parts[k] < 0 or j >= n or rank_of(parts[k] << 32 | parts[j]) != rank:
                continue
            parts[k], parts[j] = merged[rank], -1
            after[k] = nxt = after[j]
            if nxt < n:
                before[nxt] = k
                if (r := rank_of(parts[k] << 32 | parts[nxt])) is not None:
                    heappush(waiting, (r, k))
            if (p := before[k]) >= 0 and (r := rank_of(parts[p] << 32 | parts[k])) is not None:
                heappush(waiting, (r, p))
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        ids, words = self.__getitem__, self.any if ABOVE.search(text) else self.basic
        if self.cut_special is None or not self.cut_special.search(text):
            return np.fromiter(chain.from_iterable(map(ids, words(text))), np.int32)
        parts = self.cut_special.split(text)
        of = (chain.from_iterable(map(ids, words(p))) if k % 2 == 0 else (self.special[p],) for k, p in enumerate(parts))
        return np.fromiter(chain.from_iterable(of), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        known = ids[(ids >= 0) & (ids < len(self.pieces))]
        return b"".join(self.pieces[known].tolist()).decode("utf-8", "replace")


#: The encoders that a worker has, by path.
_HELD: dict[str, Encoder] = {}


def encoder(path: str, ranges: dict[str, list[tuple[int, int]]]) -> Encoder:
    if path not in _HELD:
        _HELD[path] = Encoder(path, ranges)
    return _HELD[path]


def _mapped(df: DataFrame, column: str, name: str, kind: str, work, keep: bool = True) -> DataFrame:
    """df, without the column unless keep, with another one made from it by work(batches of (row, column)), which gives batches of (row, name)."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c.lower() != name and (keep or c != column)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("row"), F.col(f"`{column}`").alias("value"))
    schema = rows.select("row", F.lit(None).cast(kind).alias(name)).schema
    return rows.mapInArrow(work, schema).select(*[F.col(f"row.`{c}`") for c in kept], name)


def bpe_encode(df: DataFrame, tokenizer: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with `ids`, the token ids of each whole text; without text_col unless keep_text. tokenizer: a file's name in the public tokenizers folder, or a path."""
    ranges = classes(tokenizer_path(tokenizer))  # a few thousand pairs of numbers, sent with the function

    def encode(batches):
        known = encoder(tokenizer_path(tokenizer), ranges)
        for b in batches:
            ids = [known.encode(t.as_py()) for t in b.column(1)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], names=["row", "ids"])

    return _mapped(df, text_col, "ids", "array<int>", encode, keep_text)


def bpe_decode(df: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """df with `decoded`, the text of the token ids in ids_col, an array of int."""
    ranges = classes(tokenizer_path(tokenizer))

    def decode(batches):
        known = encoder(tokenizer_path(tokenizer), ranges)
        for b in batches:
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            flat = lists.flatten().fill_null(-1).to_numpy()
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            texts = [known.decode(flat[a:z]) for a, z in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "decoded"])

    return _mapped(df, ids_col, "decoded", "string", decode)


def ids_text(ids):
    """Decimal ids joined by commas."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
