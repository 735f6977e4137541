"""Byte-level BPE, importance resampling, source divergence: the library or brute force, and odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import byte_bpe, divergence, queries, resampling
from tests.llm.odd import LONG, TEXTS, empty, odd, word_text

BPE = "byte_bpe_50k.json"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path(BPE)))


@pytest.fixture(scope="module")
def own():
    path = byte_bpe.tokenizer_path(BPE)
    return byte_bpe.Encoder(path, byte_bpe.classes(path))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# ---- byte-level BPE ----


@pytest.mark.parametrize(
    "text",
    ["", " ", "  ", "a  b", "a \n", "\n\n x", "it's I'LL we've 'tis '' 's", "x" * 3000, "ab" * 2000, " " * 2000, "é" * 97, "½²Ⅷ٣ 12", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext", "\x00\x1c\x85　​", "🙂 🙂x\U0002ebf0\U00010d40", "ﬁ Ａ \r\n\tif x:"],
)
def test_encoding_equals_the_library(library, own, text):
    ids = ids_of(library, text)
    assert own.encode(text).tolist() == ids
    assert own.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)


def test_random_texts_and_random_ids(library, own):
    rng = random.Random(1)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    pools = [every, list(" \n\t　ab1'srtve.,!\x1c\x85é漢½²"), every[:0x3000]]
    for _ in range(1500):
        text = "".join(rng.choices(rng.choice(pools), k=rng.randrange(60)))
        assert own.encode(text).tolist() == ids_of(library, text), repr(text)
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False), ids


def test_every_code_point_is_cut_as_the_library_cuts_it(library, own):
    """Each code point between a letter and a number, so its class shows."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 20_000):
        text = "".join(f"a{c}1" for c in points[k : k + 20_000])
        assert own.any(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        if text.isascii() or max(text) < "\U00010000":
            assert own.basic(text) == own.any(text)


def test_scan_and_heap_merge_alike(own):
    rng = random.Random(2)
    for _ in range(300):
        data = "".join(rng.choices("aabeinrst é", k=rng.randrange(1, 90))).encode()
        assert list(own.merge_short(data)) == own.merge_long([own.first[b] for b in data])


def test_remembered_words_are_bounded(own, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    want = {f"w{k}": own.encode(f"w{k}").tolist() for k in range(300)}
    for _ in range(2):
        assert {w: own.encode(w).tolist() for w in want} == want
    assert len(own) <= 51 and len(own.older) <= 51


def test_bpe_odd(spark, library):
    df = odd(spark).withColumn("ids", F.lit("clash")).withColumn("none", F.lit(1))
    got = byte_bpe.bpe_decode(byte_bpe.bpe_encode(df, BPE), BPE).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.ids) for r in got) == sorted((i or -1, t or "", ids_of(library, t)) for i, t in TEXTS)
    assert all(r.decoded == (r.text or "") and r.row == "extra row" for r in got)
    assert byte_bpe.bpe_encode(odd(spark), BPE, keep_text=False).columns == [c for c in odd(spark).columns if c != "text"] + ["ids"]
    assert byte_bpe.bpe_decode(byte_bpe.bpe_encode(empty(spark), BPE), BPE).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 99_999, -4, 64])], "k long, ids array<int>")
    assert [r.decoded for r in byte_bpe.bpe_decode(lists, BPE).orderBy("k").collect()] == ["", "", "aa"]


def test_bpe_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(r.doc_id, len(ids := ids_of(library, r.text)), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))) for r in docs]
    assert sorted(map(tuple, queries.QUERIES["op11_byte_bpe"](spark, SF).collect())) == sorted(want)


# ---- importance resampling ----


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features_of(text, longest):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_buckets_of_features(longest):
    rng = random.Random(3)
    texts = [None, b"", b"...", "Été É x".encode(), b"a", b"a a a a", b"x " * 50, ("q" * 300 + " " + "r" * 127 + " z").encode()] + [word_text(rng, rng.randrange(60), 12).encode() for _ in range(60)]
    found, sizes = resampling.feature_buckets(texts, longest, 997)
    ends = np.cumsum(sizes + 1)
    for t, a, z in zip(texts, ends - sizes - 1, ends, strict=True):
        got = Counter(found[:, a:z][found[:, a:z] >= 0].tolist())
        assert got == Counter(zlib.crc32(f.encode()) % 997 for f in features_of((t or b"").decode(), longest)), t


def brute_resample(docs, target, percent=25, least=20, longest=2, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features_of(text, longest)) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        f = features_of(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def test_resampling_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 3000)
    rng = random.Random(4)
    docs = [(k, word_text(rng, rng.randrange(10, 60), 200)) for k in range(300)] + [(None, word_text(rng, 40)), (300, None), (301, ""), (5, word_text(rng, 30)), (302, LONG)]
    target = [word_text(rng, 30, 20) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), 25, 20)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == brute_resample(docs, target)


def test_resampling_odd(spark):
    target = spark.createDataFrame([("hello there",)], "text string")
    # 40 equal rows tie in all but their place; each is drawn once
    df = odd(spark).unionByName(odd(spark, [(77, "one two three four")] * 40))
    got = resampling.resample(df.withColumn("rank", F.lit("clash")), target, 50, 2)
    assert set(got.columns) == {*odd(spark).columns, "n_features", "weight", "score", "rank"} - {"text"}
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 40
    ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
    fit = sum(len(words_of(t)) >= 2 for _, t in TEXTS) + 40
    assert ranks == list(range(1, fit // 2 + 1))
    assert all((r.n_features, r.weight, r["rank"]) == (0, 0, None) for r in rows if r.doc_id in (1, 2, 3))
    assert resampling.resample(empty(spark), target, 25, 20).count() == 0
    assert resampling.resample(odd(spark), target.filter("false"), 25, 20).count() == len(TEXTS)


# ---- source divergence ----


def brute_divergence(docs, least, top):
    terms_of = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = terms_of(text)
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang, docs_with in held.items():
        kept = [t for t, n in docs_with.items() if n >= least]
        own = {s: c for (a, s), c in counts.items() if a == lang}
        share = lambda count: (lambda n: {t: 1 + 1_000_000_000 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept})(sum(count[t] for t in kept))
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("few", [True, False])
def test_divergence_against_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(divergence, "FEW_GROUPS", 0)
    monkeypatch.setattr(divergence, "HELD", 40)
    rng = random.Random(5)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1y", "zeta-eta", "theta", "\U0001f642", "￮", "rare"]
    docs = []
    for k in range(400):
        source = rng.choice([None, "", "s1", "s2", "s3", "s4"])
        text = " ".join(rng.choices(words[:-1], weights=[1 + len(w) * (k % 3) for w in words[:-1]], k=rng.randrange(12)))
        docs.append((text + (" rare" if k < 20 else ""), rng.choice(["en", "de", None]), source))
    docs += [(None, "en", "silent"), ("alone", "xx", "s1"), ("", "yy", "s1"), ("few", "yy", "s2")] + [("same words again", "en", "hot")] * 150
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    got = divergence.divergence(df, least_docs=30, top=4).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == brute_divergence(docs, 30, 4)


def test_shares_are_exact_for_large_counts(spark):
    n, total, kept = 3_000_000_000_017, 9_000_000_000_000_101, 1_000_003
    df = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_divergence_odd(spark):
    df = odd(spark).withColumn("source", F.lit(None).cast("string"))
    got = divergence.divergence(df, least_docs=2).collect()
    # one source in each language, so no pairs, and no term is over its language's share
    assert got == []
    both = df.unionByName(df.withColumn("source", F.lit("b")))
    rows = divergence.divergence(both, least_docs=2).collect()
    assert {(r.lang, r.source, r.item, r.value) for r in rows if r.part == "pair"} == {(lang, a, b, 0) for lang in ("", "en") for a, b in (("", "b"), ("b", ""))}
    assert divergence.divergence(empty(spark).withColumn("source", F.lit("x"))).count() == 0
