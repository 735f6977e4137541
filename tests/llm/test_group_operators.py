"""SimHash, packing, suffix dedup, LM scores, neighbours and shards: brute force, skew and odd input."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfield.llm import common, lm_scoring, packing, sharding, simhash, suffix_dedup, vector_graph
from tests.llm.odd import LONG, TEXTS, empty, odd, word_text


def find_components(n, links):
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


# --- components and SimHash -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [common.FEW_EDGES, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 400)]
    edges = spark.createDataFrame(links + links[:5] + [(7, 7)], "a long, b long")
    want = find_components(400, links)
    got = {r.node: r.component for r in common.components(edges).collect()}
    touched = {x for e in links for x in e if e[0] != e[1]}
    assert got == {k: want[k] for k in touched}
    assert common.components(edges.filter("false")).count() == 0


def brute_fingerprint(t, width):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprint_random():
    rng = random.Random(2)
    for n in [0, 1, 2, 3, 4, 5, 50, 200]:
        t = word_text(rng, n)
        assert simhash.fingerprint(t.encode(), 3) == brute_fingerprint(t, 3)


def test_shingle_hash_is_the_one_spark_has(spark):
    row = spark.sql("SELECT xxhash64('a b é') AS h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("a b é".encode(), seed=42)


def links_of(fps, distance):
    return [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= distance]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 20])
@pytest.mark.parametrize("distance", [2, 3])
def test_close_pairs(spark, distance, bucket):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    fps = set(seeds)
    for s in seeds[:10]:
        for _ in range(6):
            x = s
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps |= {seeds[11] ^ (1 << a) ^ (1 << b) for a in range(9) for b in range(a)}  # a dense bunch
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    index = {x: k for k, x in enumerate(signed)}
    got = [(index[r.a], index[r.b]) for r in simhash.close_pairs(df, distance, bucket).collect()]
    true = set(links_of(fps, distance)) | {(b, a) for a, b in links_of(fps, distance)}
    assert set(got) <= true
    assert find_components(len(fps), got) == find_components(len(fps), links_of(fps, distance))


def test_simhash_components_odd(spark):
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(odd(spark), 3, 2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1), (4, 4), (None, 4), (5, 4), (6, 6), (7, 7), (8, 8), (9, 9)}
    assert simhash.simhash_components(empty(spark), 3, 2).count() == 0


def shingle_set(t, width=5):
    w = (t or "").encode().lower().split()
    return frozenset(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def similar(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b)


def near_texts():
    rng = random.Random(4)
    texts = [word_text(rng, rng.randrange(30, 200)) for _ in range(30)]
    for t in texts[:15]:
        w = t.split()
        for edits in (0, 1, 2, len(w) // 40, len(w) // 10):
            x = list(w)
            for _ in range(edits):
                x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(x))
    base = word_text(rng, 120).split()
    texts += [" ".join([*base[:k], f"hot{k}", *base[k + 1 :]]) for k in range(110)]  # one large group
    rng.shuffle(texts)
    return texts


def test_near_duplicates(spark):
    texts = near_texts()
    sets = [shingle_set(t) for t in texts]
    want = find_components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if similar(sets[a], sets[b])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == want
    kept = [r.doc_id for r in simhash.first_of_each(df).collect()]
    assert sorted(kept) == sorted(set(want))


def family(n, edits, seed=9):
    """Noisy copies of one text, similar to each other to about 0.8."""
    rng = random.Random(seed)
    base, out = word_text(rng, 150).split(), []
    for k in range(n):
        x = list(base)
        for _ in range(edits[k % len(edits)]):
            at = rng.randrange(len(x))
            x[at] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_near_duplicates_of_large_buckets(spark, monkeypatch, block):
    # most of the members are too far from any leader of a bucket, and close to some others
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = family(400, (2, 3, 4))
    sets = [shingle_set(t) for t in texts]
    want = find_components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if similar(sets[a], sets[b])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert 1 < len(set(want)) < len(texts)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (0, 1, 10, 150, 2000):
        for _ in range(30):
            every = np.unique(rng.integers(0, 2**63, 2 * n + 1, np.uint64))
            a, b = (np.sort(rng.permutation(every)[: rng.integers(0, len(every) + 1)]) for _ in range(2))
            differ = np.bitwise_count(simhash.parities(a) ^ simhash.parities(b)).sum()
            assert differ <= len(np.setxor1d(a, b)) and len(simhash.parities(a)) * 8 == simhash.BITS


def test_near_duplicate_recall_by_group_size(spark):
    """Of all pairs of noisy families that are similar to 0.8 or more, how many are in one component: all of them, whatever the size."""
    texts = [t for n in (10, 100, 1000, 3000) for t in family(n, (1, 2, 3, 4), seed=n)]
    n = len(texts)
    sets = [shingle_set(t) for t in texts]
    number: dict = {}
    for s in sets:
        for x in s:
            number.setdefault(x, len(number))
    often = collections.Counter(x for s in sets for x in s)
    columns = {x: k for k, x in enumerate(x for x, m in often.items() if m > 1)}
    held = np.zeros((n, len(columns)), np.float32)
    for k, s in enumerate(sets):
        held[k, [columns[x] for x in s if x in columns]] = 1
    size = np.array([len(s) for s in sets])
    both = held @ held.T
    a, b = np.nonzero(np.triu(both >= 0.8 * (size[:, None] + size - both) - 1e-3, 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert [got[k] for k in range(n)] == find_components(n, list(zip(a.tolist(), b.tolist(), strict=True)))


def test_first_of_each_odd(spark):
    kept = simhash.first_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8, 9]
    assert simhash.first_of_each(empty(spark)).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------------


def check_packing(rows, sizes, lengths):
    pieces = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for doc, n in sizes.items():
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert sum(r["size"] for r in own) == n and [r.start for r in own] == [k * lengths[-1] for k in range(len(own))]
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        fill = sum(r["size"] for r in own)
        assert [r.offset for r in own] == [sum(x["size"] for x in own[:k]) for k in range(len(own))]
        assert {r.capacity for r in own} == {next(c for c in lengths if c >= fill)}


@pytest.mark.parametrize("group", [packing.GROUP_ROWS, 40])
def test_packing(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_ROWS", group)
    rng = random.Random(5)
    sizes = {k: rng.choice([0, 1, 5, 40, 63, 64, 65, 200, 1000]) for k in range(300)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n long")
    check_packing(packing.best_fit_packing(df, F.col("n"), (16, 64, 128)).collect(), sizes, (16, 64, 128))


def packed_cost(sizes, lengths, cost):
    bins, _, capacity = packing.pack(sizes, lengths, cost)
    return sum(map(cost, {b: capacity[b] for b in bins}.values()))


def least_cost(sizes, lengths, cost):
    """Over all ways to put sizes together."""
    best = math.inf

    def go(k, fills):
        nonlocal best
        if k == len(sizes):
            best = min(best, sum(cost(next(c for c in lengths if c >= f)) for f in fills))
            return
        for i in range(len(fills)):
            if fills[i] + sizes[k] <= lengths[-1]:
                go(k + 1, [*fills[:i], fills[i] + sizes[k], *fills[i + 1 :]])
        go(k + 1, [*fills, sizes[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("cost", [lambda c: 1 + c * (1 + c / 64), lambda c: 3 + c, lambda c: c * c])
def test_packing_against_all_ways(cost):
    rng, lengths, ratios, below = random.Random(1), (4, 8, 16), [], 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 16) for _ in range(7)), reverse=True)
        got = packed_cost(sizes, lengths, cost)
        ratios.append(got / least_cost(sizes, lengths, cost))
        fills = [packing.best_fit(sizes, lengths, cost, floor)[2] for floor in lengths]
        floors = min(sum(cost(next(c for c in lengths if c >= x)) for x in f) for f in fills)
        assert got <= floors + 1e-9
        below += got < floors - 1e-9
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.13 and sum(r < 1 + 1e-9 for r in ratios) >= 50


def test_lengths_mix_by_demand():
    """Nines alone fill a bin of 9 best, fours a bin of 16: no single least length opens both well."""
    sizes, lengths, cost = [9] * 20 + [4] * 40, (9, 16), lambda c: c
    floors = [sum(next(c for c in lengths if c >= x) for x in packing.best_fit(sizes, lengths, cost, floor)[2]) for floor in lengths]
    assert packed_cost(sizes, lengths, cost) == 9 * 20 + 16 * 10 < min(floors)


def test_near_lower_bound():
    rng = random.Random(6)
    sizes = sorted((min(8192, int(rng.lognormvariate(6, 1)) + 1) for _ in range(3000)), reverse=True)
    cost = packing.default_cost
    bound = sum(x * min(cost(c) / c for c in packing.LENGTHS if c >= x) for x in sizes)
    assert bound <= packed_cost(sizes, packing.LENGTHS, cost) < 1.02 * bound


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = packing.best_fit([60, 50, 40, 30, 10], (100,), packing.default_cost)
    assert (bins, offsets, fill) == ([0, 1, 0, 1, 1], [0, 0, 60, 50, 80], [100, 90])


def test_packing_odd(spark):
    rows = packing.best_fit_packing(odd(spark), F.length("text"), (64, 256)).collect()
    assert sum(r.bin_id is None for r in rows) == 3 and sum(r["size"] for r in rows if r.doc_id == 6) == len(LONG)
    assert packing.best_fit_packing(empty(spark), F.length("text")).count() == 0


def test_packing_repeats_and_large_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    big = 2**62 + 1
    rows = [(7, 3)] * 400 + [(None, 5)] * 30 + [(big, 2), (big, 70)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = packing.best_fit_packing(df, F.col("n"), (16, 64)).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == {(7, 3): 400, (None, 5): 30, (big, 2): 1, (big, 64): 1, (big, 6): 1}
    dealt = collections.Counter(r.bin_id >> 32 for r in got)
    assert len(dealt) == 9 and max(dealt.values()) < 100
    again = packing.best_fit_packing(df.repartition(7), F.col("n"), (16, 64)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))


# --- repeated substrings ----------------------------------------------------------------------------------------------


def brute_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                mask[s : s + length] = b"\1" * length
        kept = bytes(x for x, m in zip(d, mask, strict=True) if not m)
        out.append((len(d), sum(mask), sum(1 for k in range(len(d)) if mask[k] and (not k or not mask[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def summary(r):
    return (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256)


def passages():
    rng = random.Random(7)
    shared = [word_text(rng, 90, 5000) for _ in range(4)]
    texts = [word_text(rng, rng.randrange(10, 150), 5000) for _ in range(30)]
    for k in range(40):
        p = shared[k % 4]
        cut = p[rng.randrange(0, 60) : len(p) - rng.randrange(0, 200)]
        texts.append(f"{word_text(rng, rng.randrange(0, 40), 5000)} {cut} {word_text(rng, rng.randrange(0, 40), 5000)}")
    texts += [texts[0], texts[0], texts[35], "é" * 700, "ab" * 500, ("x" * 399), ("x" * 399), "y" * 400, "y" * 400 + "z", "q" * 401]
    return texts


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_repeated_spans(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    texts = passages()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: summary(r) for r in suffix_dedup.repeated_spans(df).collect()}
    want = brute_spans(texts, 400)
    assert [got[k] for k in range(len(texts))] == want and any(0 < w[1] < w[0] for w in want)


def test_large_groups_of_windows(spark):
    rows = [(1, 2, k, 0, 0, 3, bytes([97 + k % 2]) * 3, b"c" * 28 + bytes([97 + k % 3]) * 3) for k in range(7)]
    names = "k1 long, k2 long, rid long, at int, low int, high int, left binary, right binary"
    df = spark.createDataFrame([(a, b, r, 10 * r + 5, lo, hi, x, y) for a, b, r, _, lo, hi, x, y in rows], names)
    wide = {(r.rid, s) for r in suffix_dedup.single_windows(df).collect() for s in range(r.first, r.last + 1)}
    near = {(rid, s) for rid, a, b in zip(*suffix_dedup.repeated_starts(window_rows([(a, b, r, 10 * r + 5, lo, hi, x, y, False) for a, b, r, _, lo, hi, x, y in rows])), strict=True) for s in range(a, b + 1)}
    assert wide == near and wide


def window_rows(rows):
    types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.bool_()]
    names = [c.split()[0] for c in suffix_dedup.DEALT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


@pytest.mark.parametrize("most", [suffix_dedup.GROUP, 6])
def test_digit_passes_in_streams(monkeypatch, most):
    """Runs of equal windows in groups that are cut by batches, against a dictionary of all windows; groups of over GROUP rows come back as they are."""
    monkeypatch.setattr(suffix_dedup, "GROUP", most)
    rng = random.Random(3)
    edge = suffix_dedup.EDGE
    rows = []
    for g in range(40):
        texts = [bytes(rng.choices(b"ab", weights=(20, 1), k=2 * edge)) for _ in range(3)]
        for _ in range(rng.choice([1, 2, 3, 5, 9, 20])):
            t, low = rng.choice(texts), rng.randrange(edge)
            high = rng.randrange(low, edge + 1)
            rows.append((g // 2, g, len(rows), 1000 * len(rows) + 500, low, high, t[edge - high : edge], t[edge : 2 * edge - low], rng.random() < 0.1))
    want = collections.defaultdict(set)
    for a, b, rid, at, low, high, left, right, often in rows:
        for j in range(low, high + 1) if not often else ():
            want[a, b, j, left[len(left) - j :] + right[: edge - j]].add((rid, at - j))
    sizes = collections.Counter(r[:2] for r in rows if not r[8])
    batches, k = [], 0
    while k < len(rows):
        n = rng.randrange(1, 12)
        batches.append(window_rows(rows[k : k + n]))
        k += n
    found, back = collections.Counter(), []
    for b in suffix_dedup.equal_groups(iter(batches)):
        for r in b.to_pylist():
            if r["first"] is None:
                back.append(r["rid"])
            else:
                found.update((r["rid"], s) for s in range(r["first"], r["last"] + 1))
    given = {r[2] for r in rows if r[8] or sizes[r[:2]] > most}
    assert len(back) == len(set(back)) and {r[2] for r in rows if r[8]} <= set(back) <= given
    whole = {key: {x for x in v if x[0] not in set(back)} for key, v in want.items()}
    assert found == collections.Counter(x for v in whole.values() if len(v) > 1 for x in v)


def test_pieces_of_long_texts(monkeypatch):
    data = word_text(random.Random(8), 3000, 10**6).encode()
    whole = suffix_dedup.Grams(400)
    want = {(h, at, s) for h, at, a, b in whole.of([data])[0] for s in range(a, b + 1)}
    monkeypatch.setattr(suffix_dedup, "PIECE", 4096)
    cut = suffix_dedup.Grams(400)
    assert {(h, at, s) for h, at, a, b in cut.of([b"short", data, b""])[1] for s in range(a, b + 1)} == want
    assert {s for _, _, s in want} == set(range(len(data) - 399))


def test_repeated_spans_odd(spark):
    got = sorted(((r.doc_id or -1), *summary(r)) for r in suffix_dedup.repeated_spans(odd(spark)).collect())
    want = brute_spans([t for _, t in TEXTS if t != LONG], 400)
    assert [g for g in got if g[0] != 6] == sorted((i or -1, *w) for i, w in zip([i for i, t in TEXTS if t != LONG], want, strict=True))
    assert suffix_dedup.repeated_spans(empty(spark)).count() == 0


# --- LM scores --------------------------------------------------------------------------------------------------------


def held(c="doc_id"):
    return F.crc32(F.col(c).cast("string").cast("binary")) % 7 == 2


@pytest.mark.parametrize("head", [lm_scoring.HEAD, 10])
def test_lm_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    rng = random.Random(9)
    docs = [(k, word_text(rng, rng.randrange(0, 60), 100)) for k in range(80)] + [(200, "Unknown words HERE")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.lm_scores(df, held()).collect()}
    of = {k: [*t.encode().lower().split(), None] for k, t in docs}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs}
    c = collections.Counter(w for k, t in of.items() if not out[k] for w in t)
    n, v = sum(c.values()), len(c)
    for k, t in of.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[k], len(t), sum(w in c for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs_tol=1e-9)
        assert r.score < 0


def test_lm_learns_order(spark):
    rng = random.Random(10)
    texts = [" ".join(f"{'abcdefghijklmnop'[(s + k) % 16]}{(s + k) % 16}" for k in range(80)) for s in (rng.randrange(16) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lm_scoring.lm_scores(df, held()).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def lm_fixture(spark, parts=3):
    rng = random.Random(12)
    chains = {w: rng.sample(range(60), 5) for w in range(60)}

    def text():
        w, out = rng.randrange(60), []
        for _ in range(rng.randrange(0, 80)):
            out.append(f"w{w}" if rng.random() < 0.95 else f"once{rng.randrange(10**6)}")
            w = rng.choice(chains[w]) if rng.random() < 0.8 else rng.randrange(60)
        return " ".join(out)

    docs = [(k, text()) for k in range(300)] + [(900, "Unknown words HERE")]
    return docs, spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("head", [lm_scoring.HEAD, 40])
def test_lm_dense_reference(spark, monkeypatch, head):
    """score against softmaxes over all words, from the counts and the learnt weights; they sum to 1, and the pair weights are at their optimum."""
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    docs, df = lm_fixture(spark)
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs}
    of_doc = {k: [xxhash.xxh64_intdigest(w) for w in t.encode().lower().split()] + [int(lm_scoring.END)] for k, t in docs}
    c = collections.Counter(w for k, t in of_doc.items() if not out[k] for w in t)
    learn = df.filter(~held()).select(F.col("text").cast("binary").alias("data"))
    counts = spark.createDataFrame([(int(np.uint64(w).view(np.int64)), n) for w, n in c.items()], "hash long, c long")
    m, _, _ = lm_scoring.train(learn, counts)
    number = {int(h): k for k, h in enumerate(m.v.known)}
    assert (len(number) == len(c)) == (head > len(c)) and int(lm_scoring.END) in number
    weight = {int(k): x for k, x in zip(m.keys, m.values, strict=True) if int(k) & ((1 << lm_scoring.LOW) - 1) < lm_scoring.CLASS}
    members = collections.defaultdict(list)
    for h, k in number.items():
        members[int(m.v.class_of[k])].append(h)
    rare = len(number)
    rare_mass = sum(n + 1 for h, n in c.items() if h not in number) + 1

    def place(t, i):
        end = int(lm_scoring.END)
        last = t[i - 1] if i else end
        skip = t[i - 2] if i > 1 else end
        row = (last * 0x9E3779B97F4A7C15 % 2**64) >> (64 - m.v.bits)
        context = number[last] if last in number else rare + 1 + number.get(skip, rare)
        return context, m.classes[row * lm_scoring.CLASSES + int(m.v.class_of[number.get(skip, rare)])]

    def dense(context, logs):
        """Probability of every known word, and of the unknown one."""
        p = {}
        for k, words in members.items():
            s = {h: (c[h] + 1) * math.exp(weight.get(context << lm_scoring.LOW | number[h], 0.0)) for h in words}
            p |= {h: math.exp(logs[k]) * x / sum(s.values()) for h, x in s.items()}
        unknown = math.exp(logs[lm_scoring.RARE]) / rare_mass
        return p | {h: unknown * (n + 1) for h, n in c.items() if h not in number}, unknown

    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(df, held()).collect()}
    expected = collections.Counter()
    seen = collections.Counter()
    for k, t in of_doc.items():
        total = 0.0
        for i, w in enumerate(t):
            context, logs = place(t, i)
            p, unknown = dense(context, logs)
            if i % 7 == 0:
                assert math.isclose(sum(p.values()) + unknown, 1, abs_tol=1e-5)
            total += math.log10(p.get(w, unknown))
            if not out[k] and w in number:
                of = int(m.v.class_of[number[w]])
                seen[context, w] += 1
                for h in members[of]:
                    expected[context, h] += p[h] / math.exp(logs[of])
        assert math.isclose(total, got[k], abs_tol=1e-6 * (1 + len(t)))
    for (context, w), n in seen.items():
        key = context << lm_scoring.LOW | number[w]
        if key in weight and context <= 2 * rare:
            assert math.isclose(expected[context, w], n - lm_scoring.DISCOUNT, abs_tol=1e-6 * n)
    assert any(x > 0 for x in weight.values())


def test_lm_partitions_and_gain(spark, monkeypatch):
    """Scores don't depend on how rows are dealt, nor on pieces and steps; held-out text gains over the base."""
    _, df = lm_fixture(spark, 1)
    one = {r.doc_id: r for r in lm_scoring.lm_scores(df, held()).collect()}
    for name, small in (("STEP", 7), ("HELD", 50), ("PIECE", 20), ("SHARD", 100)):
        monkeypatch.setattr(lm_scoring, name, small)
    other = {r.doc_id: r for r in lm_scoring.lm_scores(df.repartition(5), held()).collect()}
    assert all(math.isclose(one[k].score, other[k].score, abs_tol=1e-6) and one[k].n_tokens == other[k].n_tokens for k in one)
    rows = [r for r in one.values() if r.held_out]
    assert sum(r.score - r.base_score for r in rows) * math.log(10) > 0.3 * sum(r.n_tokens for r in rows)


@pytest.mark.parametrize("pairs", [0, 30, 200])
def test_lm_pairs_beyond_those_sent(spark, monkeypatch, pairs):
    """All pairs count, whatever number of them is sent to the tasks; null texts and shards without an asked pair too."""
    docs, df = lm_fixture(spark)
    df = df.unionAll(spark.createDataFrame([(901, None), (902, "w1"), (902, "w1 w2 w1 w2")], df.schema))
    whole = sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in lm_scoring.lm_scores(df, held()).collect())
    monkeypatch.setattr(lm_scoring, "PAIRS", pairs)
    got = sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in lm_scoring.lm_scores(df, held()).collect())
    assert [r[:2] for r in got] == [r[:2] for r in whole] and len(got) == len(docs) + 3
    for x, y in zip(got, whole, strict=True):
        assert math.isclose(x[2], y[2], abs_tol=1e-9) and math.isclose(x[3], y[3], abs_tol=1e-6)


def test_lm_frequent_bounds(spark):
    df = spark.range(1, 2001).select(F.expr("id % 700 + 1").alias("n"))
    for most in (0, 1, 50, 300, 1999, 2000, 5000):
        least = lm_scoring.cut_off(df, "n", F.lit(1), most)
        assert df.filter(F.col("n") >= least).count() <= most
    assert lm_scoring.cut_off(df, "n", F.lit(1), 2000) <= 1


def test_lm_odd(spark):
    rows = lm_scoring.lm_scores(odd(spark), held()).collect()
    assert len(rows) == len(TEXTS) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    none = lm_scoring.lm_scores(odd(spark), F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in none} == {(0, 0, 0.0)}
    assert lm_scoring.lm_scores(empty(spark), held()).count() == 0


# --- neighbours -------------------------------------------------------------------------------------------------------


def vectors(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return (centres[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, dims))).astype(np.float32)


def brute_nearest(ids, x, q, k=5):
    x = x.astype(float)
    s = (x @ x[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
    order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-s[i], ids[i]))[:k]
    return [(ids[i], s[i]) for i in order]


@pytest.mark.parametrize(("shard", "block"), [(8192, 1 << 16), (300, 7)])
def test_nearest_recall(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vector_graph, "SHARD_BYTES", shard * 16 * 8)
    monkeypatch.setattr(vector_graph, "BLOCK_ROWS", block)
    x = vectors(1500)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = vector_graph.nearest(df, F.col("vec_id") % 50 == 0).collect()
    hit = total = 0
    for q in range(0, 1500, 50):
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        want = brute_nearest(list(range(1500)), x, q)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        scores = [r.score for r in own]
        assert scores == sorted(scores, reverse=True)
        hit += len({r.vec_id for r in own} & {i for i, _ in want})
        total += 5
    assert hit / total >= 0.9


def test_nearest_recall_of_large_shards(spark, monkeypatch):
    """40,000 vectors in three shards."""
    monkeypatch.setattr(vector_graph, "SHARD_BYTES", 14_000 * 16 * 8)
    x = vectors(40_000, seed=3)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    got = collections.defaultdict(set)
    for r in vector_graph.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    assert len(got) == 800
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::50] @ u.T
    s[np.arange(800), np.arange(0, 40_000, 50)] = -2
    want = np.argpartition(-s, 5, axis=1)[:, :5]
    assert np.mean([len(got[50 * k] & set(w.tolist())) / 5 for k, w in enumerate(want)]) >= 0.9


def test_nearest_copies_and_odd(spark):
    x = vectors(40)
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(100 + k, x[0].tolist()) for k in range(200)]
    data += [(50, None), (600, [0.0] * 16), (350, [float("nan")] + [1.0] * 15), (450, [None] + [1.0] * 15), (None, x[1].tolist()), (0, x[0].tolist()), (500, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("v"), F.lit(2).alias("ids"))
    rows = vector_graph.nearest(df, F.col("vec_id") % 50 == 0).collect()
    by = {q: [r.vec_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)] for q in {r.query_id for r in rows}}
    assert set(by) == {0, 100, 150, 200, 250}
    assert by[0] == [100, 101, 102, 103, 104] and by[100] == [0, 101, 102, 103, 104] and by[150] == [0, 100, 101, 102, 103]
    few = spark.createDataFrame(data[:3], "vec_id long, embedding array<float>")
    assert vector_graph.nearest(few, F.col("vec_id") % 50 == 0).count() == 2
    assert vector_graph.nearest(few.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


# --- shards -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 1000, 1024, 1025])
def test_feistel_is_a_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(sharding.feistel(F.col("id"), n, 7).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 100 or got != list(range(n)))


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    df = spark.createDataFrame([(k, f"text é {k % 7}" * (k % 5)) for k in range(1003)], "doc_id long, text string").repartition(5)
    rows = sharding.feistel_shards(df, 16).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert {len(v) for v in by.values()} <= {62, 63} and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(r["size"] == len(f"text é {r.doc_id % 7}".encode()) * (r.doc_id % 5) + 1 for r in rows)
    assert all(r.text_crc32 == zlib.crc32((f"text é {r.doc_id % 7}" * (r.doc_id % 5)).encode()) for r in rows)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.feistel_shards(df.repartition(2), 16).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    # shard and slot follow from the row number alone
    some = spark.createDataFrame([(r.row_number, r.shard, r.slot) for r in rows[:50]], "row_number long, shard int, slot long")
    image = sharding.feistel(F.col("row_number"), 1003, 7)
    assert some.filter((F.pmod(image, F.lit(16)) != F.col("shard")) | (F.floor(image / 16) != F.col("slot"))).count() == 0


def test_shards_odd(spark):
    rows = sharding.feistel_shards(odd(spark), 4).collect()
    assert len(rows) == len(TEXTS) and {(r["size"], r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(1, 0)}
    assert len({(r.shard, r.slot) for r in rows}) == len(TEXTS)
    assert sharding.feistel_shards(empty(spark), 4).count() == 0


def test_shards_of_equal_rows(spark, monkeypatch):
    """A third of all rows are equal: they lie in several buckets, and every row has a slot of its own."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 10)
    df = spark.createDataFrame([(None, None)] * 500 + [(k, "t") for k in range(1000)] + [(3, "t")] * 7, "doc_id long, text string")
    keys = ["doc_id", "text"]
    rows = sharding.numbered(df, keys, 30).collect()
    assert sorted(r.row_number for r in rows) == list(range(1507))
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter(map(tuple, df.collect()))
    places = sorted(r.row_number for r in rows if r.doc_id is None)
    assert max(places) - min(places) > 1000
    out = sharding.feistel_shards(df, 16).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert {len(v) for v in by.values()} <= {94, 95} and all(sorted(v) == list(range(len(v))) for v in by.values())
