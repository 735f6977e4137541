"""One id for several texts, texts without ids, and rows that come many times."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import language_id, secrets, simhash
from tests.llm.odd import word_text


def shingle_set(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def families(rng, n=30):
    """Texts with near-copies, some under ids that other texts have too."""
    out = []
    for k in range(n):
        words = word_text(rng, 120).split()
        for _ in range(rng.randrange(1, 4)):
            own = list(words)
            own[rng.randrange(120)] = "changed"
            out.append((rng.choice([k, k % 7, None]), " ".join(own)))
    return out


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_one_id_for_several_texts(spark):
    rng = random.Random(1)
    a, b = word_text(rng, 100), word_text(rng, 100)
    near = b.replace(b.split()[50], "changed", 1)
    df = spark.createDataFrame([(5, a), (5, b), (3, near)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.first_of_each(df).collect())) == sorted([(5, a), (3, near)])


@pytest.mark.parametrize("nameless", [False, True])
def test_shared_and_absent_ids_against_brute_force(spark, nameless):
    rows = families(random.Random(2))
    rows = [(None, t) for _, t in rows] if nameless else rows
    rows += rows[:5]
    root = brute_classes(rows)
    best = {}
    for r, (i, t) in zip(root, rows, strict=True):
        best.setdefault(r, set()).add((i is None, i or 0))
    kept = [tuple(r) for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    of = {}
    for r, row in zip(root, rows, strict=True):
        of[row] = r
    assert sorted(of[k] for k in kept) == sorted(best)  # one row of each class
    assert all((i is None, i or 0) == min(best[of[i, t]]) for i, t in kept)  # that of the least id


def test_absent_ids_cost_no_more(spark):
    rng = random.Random(3)
    base = word_text(rng, 80).split()
    texts = []
    for _ in range(600):
        own = list(base)
        own[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(own))
    times = []
    for nameless in (False, True, False, True):
        df = spark.createDataFrame([(None if nameless else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
        began = time.time()
        simhash.first_of_each(df).count()
        times.append(time.time() - began)
    assert times[3] < 2 * times[2] + 3


@pytest.mark.parametrize("text, letter", [("½ ② ³ Ⅷ 12", False), ("_ 1", False), ("ª", True), ("é", True), ("漢", True), ("1" * 600 + "a", True), ("🙂", False), ("", False)])
def test_letters_are_of_category_l(text, letter):
    assert language_id.has_letters(text) is letter
    model = language_id.Hierarchy(language_id.np.zeros((0, 1 << language_id.BITS), "float32"), [])
    assert model.predict(text)[2] is not letter


def test_number_characters_are_undetermined(spark):
    rows = [(k, w, lang) for k in range(40) for w, lang in (("the cat and the dog", "en"), ("der Hund und die Katze", "de"))]
    df = spark.createDataFrame([*rows, (1000, "½ ②", "en"), (1001, "³ 12 ①", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df.drop("lang"), language_id.train(df)).collect() if r.doc_id >= 1000}
    assert got == {1000: ("und", 0.0), 1001: ("und", 0.0)}


def test_equal_rows_are_learnt_once(spark):
    rng = random.Random(4)
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the same words of one text").alias("text"), F.lit("en").alias("lang"))
    others = spark.createDataFrame([(k, word_text(rng, 20), rng.choice(["en", "de", "fr"])) for k in range(900)], "doc_id long, text string, lang string")
    learn = df.unionByName(others).select("lang", "text")
    got = language_id.chosen_texts(learn, rows=120).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"en": 40, "de": 40, "fr": 40}
    assert [tuple(r) for r in language_id.chosen_texts(df.select("lang", "text"), 1200).collect()] == [("en", "the same words of one text")]


def test_a_repeated_blob_has_one_entry(spark, tmp_path):
    equal = [(7, "password=abcdef99")] * 50 + [(8, "password=abcdef99")] * 3 + [(None, "token: qwertyuiop")] * 20 + [(9, "none")]
    for k, parts in enumerate((1, 8)):
        ledger = str(tmp_path / f"ledger{k}")
        df = spark.createDataFrame(equal, "doc_id long, text string").repartition(parts)
        got = secrets.secret_spans(df, ledger)
        assert got.count() == len(equal) and got.filter(F.size("spans") == 1).count() == 73
        assert spark.read.parquet(ledger).count() == 3
        secrets.secret_spans(df, ledger)
        assert spark.read.parquet(ledger).count() == 3


def test_rows_of_a_task_are_scanned_once(monkeypatch):
    import pyarrow as pa

    scanned = []
    monkeypatch.setattr(secrets, "find_secrets", lambda t: scanned.append(t) or [])
    b = pa.RecordBatch.from_pydict({"path": [1] * 50 + [2], "blob": [b"x"] * 50 + [b"y"], "text": ["x"] * 50 + ["y"]})
    assert sum(x.num_rows for x in secrets.scan_blobs([b, b])) == 2 and scanned == ["x", "y"]


def test_no_history_rules_a_class_out(spark):
    """Words that always follow each other: no class costs more than GUARD of its share without a history."""
    import numpy as np
    import xxhash

    from tallyfield.llm import lm_scoring

    docs = ["aa bb cc dd ee ff gg hh " * 60] * 20
    words = [w for t in docs for w in t.encode().split()]
    c = {w: words.count(w) for w in set(words)}
    hashes = [(int(np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64)), n) for w, n in c.items()] + [(int(lm_scoring.END.view(np.int64)), len(docs))]
    learn = spark.createDataFrame([(t.encode(),) for t in docs], "data binary")
    m, total, _ = lm_scoring.train(learn, spark.createDataFrame(hashes, "hash long, c long"))
    share = np.exp(m.classes)
    assert np.allclose(share.sum(axis=1), 1, atol=1e-4)
    assert total == len(words) + len(docs)
    # classes of words that have counts; a share of a class is at least GUARD of its own among all tokens, less one for smoothing
    used = np.setdiff1d(np.unique(m.v.class_of), [lm_scoring.RARE])
    plain = (m.v.mass[used] - 1) / (total + lm_scoring.CLASSES)
    assert (share[:, used] >= 0.9 * lm_scoring.GUARD * plain).all()
