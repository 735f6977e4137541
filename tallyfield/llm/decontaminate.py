"""Operator 5: benchmark decontamination by an FM-index per training shard.

A shard is a bounded run of documents inside a task. Its words become symbols: a word of the benchmark's vocabulary keeps its
number, any other is a separator, since no test phrase can cross it; runs shorter than the shortest phrase are left out for the same
reason, so the index holds what could match and loses nothing. The index is the Burrows-Wheeler transform in a wavelet
matrix; all distinct phrases are searched backward at once by its ranks, occurrences are located by walking to sampled
suffix positions, and the words that they cover are merged to removal spans.

The benchmark is read in chunks of bounded bytes; each chunk is one pass over the documents, so what is sent to a task is bounded
whatever the benchmark's size. Null and empty texts have no words. Items with the same id count as one; items without
words or with a null id never match. Documents with null ids and repeated rows each give a row; other columns pass through,
but for those named like the results, which these replace.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, text_bytes

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: UTF-8 bytes to the lower-cased byte of a word, or to a space between words.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Text bytes of one shard's documents, and text bytes of one pass's benchmark items.
SHARD_BYTES, CHUNK_BYTES = 12_000_000, 8_000_000
#: Parts of the benchmark, each a pass over the texts, before what was found is stored.
PASSES = 8
SAMPLE = 16


def words(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; a suffix that ends sorts before its extensions."""
    rank, k = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        key = rank * (len(s) + 2)
        key[:-k] += rank[k:]
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)])
        rank = np.empty(len(s), np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == len(s) or k >= len(s):
            return order
        k *= 2


class FMIndex:
    """Over int symbols, where 0 separates; symbols must end with 0. Positions after a 0 and each SAMPLE-th one are sampled."""

    def __init__(self, symbols: np.ndarray):
        n, sa = len(symbols), suffix_array(symbols)
        self.levels = range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1)
        self.bwt = symbols[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.ones, self.zeros, now = [], [], self.bwt
        for level in self.levels:
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        first = np.concatenate([[True], symbols[:-1] == 0])
        self.sampled = (first | (np.arange(n) % SAMPLE == 0))[sa]
        self.position = np.where(self.sampled, sa, -1)
        self.n = n

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands in the first i places of the transform."""
        start = np.zeros_like(i)
        for level, ones, zeros in zip(self.levels, self.ones, self.zeros, strict=True):
            up = ((c >> level) & 1).astype(bool)
            start, i = (np.where(up, zeros + ones[x], x - ones[x]) for x in (start, i))
        return i - start

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases, one a row of phrases, padded at the end."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            k = np.flatnonzero((lengths > back) & (lo < hi))
            c = phrases[k, lengths[k] - 1 - back].astype(np.int64)
            known = c < len(self.before) - 1
            hi[k[~known]] = lo[k[~known]]
            k, c = k[known], c[known]
            lo[k], hi[k] = self.before[c] + self.rank(c, lo[k]), self.before[c] + self.rank(c, hi[k])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk backward to a sampled one and add the steps."""
        at, steps = rows.copy(), np.zeros_like(rows)
        left = np.flatnonzero(~self.sampled[at])
        while len(left):
            c = self.bwt[at[left]]
            at[left] = self.before[c] + self.rank(c, at[left])
            steps[left] += 1
            left = left[~self.sampled[at[left]]]
        return self.position[at] + steps


class Phrases:
    """The windows of some items: distinct phrases as symbol rows, and the items of each."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.symbol: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.items = list(found.values())
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.rows[k, : len(p)] = p

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """Of each text: its number of words, merged word spans that phrases cover, and the items that occur."""
        counts, runs, parts = [], [], []
        least = int(self.lengths.min(initial=1 << 30))
        for doc, text in enumerate(texts):
            found = words(text)
            counts.append(len(found))
            if len(found) < least:
                continue
            ids = np.fromiter(map(self.symbol.get, found, itertools.repeat(0)), np.int64, len(found))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
            for a, b in edge.reshape(-1, 2)[edge[1::2] - edge[::2] >= least].tolist():
                runs.append((doc, a, b - a + 1))
                parts += [ids[a:b], np.zeros(1, np.int64)]
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set] = {}
        if runs:
            doc, start, size = np.array(runs).T
            offset = np.cumsum(size) - size
            index = FMIndex(np.concatenate(parts))
            lo, hi = index.search(self.rows, self.lengths)
            often = hi - lo
            phrase = np.repeat(np.arange(len(lo)), often)
            at = index.locate(np.repeat(lo - (np.cumsum(often) - often), often) + np.arange(len(phrase)))
            run = np.searchsorted(offset, at, side="right") - 1
            word = start[run] + at - offset[run]
            order = np.lexsort((word, doc[run]))
            for d, w, p in zip(doc[run][order].tolist(), word[order].tolist(), phrase[order].tolist(), strict=True):
                own, end = spans.setdefault(d, []), w + int(self.lengths[p])
                if own and w <= own[-1][1]:
                    own[-1] = (own[-1][0], max(own[-1][1], end))
                else:
                    own.append((w, end))
                items.setdefault(d, set()).update(self.items[p])
        return [(n, spans.get(d, []), items.get(d, set())) for d, n in enumerate(counts)]


def chunks(items: DataFrame, item_col: str, text_col: str):
    """The items, a bounded part after another."""
    total = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, -(-total // CHUNK_BYTES))
    for k in range(parts):
        part = items.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).filter(F.pmod(F.xxhash64(item_col, text_col), F.lit(parts)) == k)
        yield [(r[0], bytes(r[1])) for r in part.select(item_col, text_bytes(text_col)).collect()]


def benchmark_hits(df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with n_words, spans (merged, in words, end exclusive) and items that occur; without text_col unless keep_text."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if (keep_text or c != text_col) and c.lower() not in ("n_words", "spans", "items")]
    item_type = benchmark.schema[item_col].dataType.simpleString()
    now = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text_bytes(text_col).alias("data"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast(f"array<{item_type}>").alias("items"))
    for k, items in enumerate(chunks(benchmark, item_col, item_text)):
        if k and k % PASSES == 0:  # so that no task holds more of a large benchmark at once
            now = stored(now, "passes")
        phrases = df.sparkSession.sparkContext.broadcast(Phrases(items, window))
        now = now.mapInArrow(_pass(phrases), now.schema)
    return now.select("row.*", "n_words", "spans", "items")


def _pass(phrases):
    def shard(batches):
        t = pa.Table.from_batches(batches)
        found = phrases.value.hits(t.column("data").to_pylist())
        before = zip(t.column("spans").to_pylist(), t.column("items").to_pylist(), strict=True)
        both = [(merge([(s["start"], s["end"]) for s in a] + spans), sorted({*b} | items)) for (_, spans, items), (a, b) in zip(found, before, strict=True)]
        for name, values in (("n_words", [n for n, _, _ in found]), ("spans", [[{"start": a, "end": b} for a, b in s] for s, _ in both]), ("items", [i for _, i in both])):
            k = t.schema.get_field_index(name)
            t = t.set_column(k, t.schema.field(k), pa.array(values, t.schema.field(k).type))
        yield from t.to_batches(max_chunksize=2048)

    def over(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(1).nbytes
            if size >= SHARD_BYTES:
                yield from shard(held)
                held, size = [], 0
        if held:
            yield from shard(held)

    return over


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """df with the words of each span, and what stands between them, cut out of the text."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: cut_words(t, [(x["start"], x["end"]) for x in s]))

    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, cut(F.col(text_col), F.col(spans_col))).otherwise(F.col(text_col)))


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not text or not spans:
        return text
    at = [m.span() for m in re.finditer(WORD.replace(r"\x60", r"\x40\x5B-\x60"), text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return "".join(out) + text[end:]
