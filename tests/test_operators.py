"""Operators on small hand-made rows: nulls, ties, empty input, and expectations worked out by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import json_fns as J
from tallyfield.functions import numbers as N
from tallyfield.functions import text as X
from tallyfield.functions import urls as U
from tallyfield.functions import vectors as V
from tallyfield.functions.summaries import summary_of
from tallyfield.operators import aggregates as A
from tallyfield.operators import clustering as C
from tallyfield.operators import density, joins, mutations, paging
from tallyfield.operators import sequences as Q
from tallyfield.operators import windows as W
from tallyfield.sources import files
from tallyfield.streaming import jobs


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("1,234", 1234), ("$5", 5), ("12.5", 0), ("abc", 0), ("", None), (" ", None), ("-7", -7)])
def test_parse_int(spark, raw, want):
    assert value(spark, N.parse_int(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("1,234.5", 1234.5), ("x", 0.0), ("", None)])
def test_parse_float(spark, raw, want):
    assert value(spark, N.parse_float(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("Smith, John", "John Smith"), ("John", "John"), ("a, b, c", "b, c a"), (None, None)])
def test_flip_name(spark, raw, want):
    assert value(spark, X.flip_name(F.lit(raw).cast("string"))) == want


OWN = "Zq7-kT_w3Lp"  # an invented id of eleven characters
CHANNEL = "UC" + "x9_Q-tallyfield00testA"


@pytest.mark.parametrize("url,want", [
    (f"https://www.youtube.com/watch?v={OWN}&list=two", OWN), (f"https://youtu.be/{OWN}", OWN), (f"https://youtu.be/{OWN}?si=x", OWN), (f"https://youtube.com/shorts/{OWN}", OWN), (f"https://m.youtube.com/go?from=1&v={OWN}", OWN), (f"/open?v={OWN}", OWN),
    ("https://www.youtube.com/watch?v=brief", None), (f"https://video.test/watch?v={OWN}", None), (OWN, None), ("https://video.test", None), (None, None),
])
def test_video_id(spark, url, want):
    assert value(spark, U.video_id(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize("url,want", [(f"https://www.youtube.com/channel/{CHANNEL}", CHANNEL), ("https://www.youtube.com/@tally.field", "@tally.field"), ("https://www.youtube.com/c/OldStyle", None), ("https://video.test/@tally", None), (None, None)])
def test_channel_id(spark, url, want):
    assert value(spark, U.channel_id(F.lit(url).cast("string"))) == want


def test_replace_once_is_once(spark):
    assert value(spark, X.replace_once(F.lit("a cat, a Cat"), "Cat", "$1 dog")) == "a cat, a $1 dog"
    assert value(spark, X.replace_once(F.lit("a cat, a cat"), "Cat", "dog")) == "a dog, a cat"


def test_replace_list_longest_first(spark):
    assert value(spark, X.replace_list(F.lit("abcdef abcde"), [("abcde", "1"), ("abcdef", "2"), ("ab", "3")])) == "2 1"


@pytest.mark.parametrize("word,code", [("metaphone", "MTFN"), ("phone", "FN"), ("Xylophone", "SLFN"), ("church", "XRX"), ("school", "SKL"), ("nation", "NXN"), ("knee", "N"), ("write", "RT"), ("cat", "KT"), ("Égale", "EKL"), ("", ""), (None, None)])
def test_metaphone(word, code):
    assert X.metaphone_of(word) == code


@pytest.mark.parametrize("a,b,want", [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("", "", 1.0), ("a", "", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(a, b, want):
    assert X.jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-4)


def test_json_changes_keep_nested_values(spark):
    assert value(spark, J.merged(F.lit('{"a": {"x": [1, 2]}, "b": "t"}'), F.lit('{"b": null, "c": true}'))) == '{"a":{"x":[1,2]},"b":null,"c":true}'
    assert value(spark, J.without(F.lit('{"a": 1, "b": {"c": 2}}'), "a")) == '{"b":{"c":2}}'
    assert value(spark, J.same(F.lit('{"a": 1, "b": 2}'), F.lit('{"b": 2, "a": 1}')))
    assert not value(spark, J.has(F.lit('{"a": {"b": 1}}'), "b"))
    assert summary_of('{"a": [1, 2], "b": {"y": 1, "x": 2}, "c": 3}') == '{"a_count": 2, "b_keys": ["x", "y"], "c": 3}' and summary_of("oops") is None


def test_vectors(spark):
    zero, one = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert value(spark, V.cosine(zero, one)) == 0.0 and value(spark, V.cosine(one, one)) == pytest.approx(1)
    assert value(spark, V.l2_normalise(one)) == [0.6, 0.8]
    for bad in (F.array(F.lit(float("nan"))), F.array(F.lit(float("inf"))), F.lit(None).cast("array<double>"), F.array().cast("array<double>"), F.array(F.lit(None).cast("double"))):
        assert value(spark, V.is_finite(bad)) is False


def test_asof_ties_and_misses(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 1.0), (3, "b", 9.0), (4, None, 9.0)], "id long, k string, t double")
    right = spark.createDataFrame([("a", 5.0, 10), ("a", 5.0, 11), ("a", 2.0, 9), ("c", 0.0, 1)], "k string, t double, v int")
    got = {r.id: r.v for r in joins.asof_backward(left, right, ["k"], "t", "t", ["v"], ["v"]).collect()}
    assert got == {1: 11, 2: None, 3: None, 4: None}


def test_interval_closure(spark):
    p = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (3, "a", 20.5)], "id long, k string, at double")
    i = spark.createDataFrame([("a", 0, 0.0, 10.0), ("a", 1, 10.0, 20.0)], "k string, n int, s double, e double")
    closed = {r.id: r.n for r in joins.first_interval(p, i, ["k"], ["id"], "at", "s", "e", 7.0).collect()}
    half = {r.id: r.n for r in joins.first_interval(p, i, ["k"], ["id"], "at", "s", "e", 7.0, closed=False).collect()}
    assert closed == {1: 0, 2: 1} and half == {1: 1}


def test_overlap_touching_and_single(spark):
    a = spark.createDataFrame([("x", 1, 0.0, 100.0), ("x", 2, 100.0, 130.0)], "k string, a int, s double, e double")
    b = spark.createDataFrame([("x", 7, 100.0, 120.0), ("x", 8, 10.0, 95.0)], "k string, b int, bs double, be double")
    pairs = lambda touch: sorted((r.a, r.b) for r in joins.overlap_join(a, b, ["k"], ("s", "e"), ("bs", "be"), 9.0, touch).collect())
    assert pairs(True) == [(1, 7), (1, 8), (2, 7)] and pairs(False) == [(1, 8), (2, 7)]
    assert {r.b: r.a for r in joins.max_overlap(b, a, ["k"], ["b"], ("bs", "be"), ("s", "e"), 9.0).collect()} == {7: 2, 8: 1}


@pytest.mark.parametrize("longest", [None, 4e6])
def test_intervals_of_all_lengths(spark, longest):
    """Lengths from nothing to millions of cells' widths; every pair once, and few cells each."""
    rng = random.Random(8)
    spans = lambda n: [(rng.choice("xy"), k, s, s + rng.choice([0, 1, 10 ** rng.uniform(0, 6.5)])) for k, s in ((k, rng.uniform(-1e5, 1e6)) for k in range(n))]
    a, b, p = spans(60), spans(60), [(rng.choice("xy"), k, rng.uniform(-1e5, 2e6)) for k in range(200)]
    p += [("x", 1000, a[0][2]), ("x", 1001, a[0][3])]
    da, db, dp = spark.createDataFrame(a, "k string, a int, s double, e double"), spark.createDataFrame(b, "k string, b int, bs double, be double"), spark.createDataFrame(p, "k string, p int, at double")
    assert sorted((r.p, r.a) for r in joins.range_join(dp, da, ["k"], "at", "s", "e", 9.0, longest=longest).collect()) == sorted((q, i) for k, q, t in p for m, i, x, y in a if k == m and x <= t <= y)
    for touch in (True, False):
        got = sorted((r.a, r.b) for r in joins.overlap_join(da, db, ["k"], ("s", "e"), ("bs", "be"), 9.0, touch, longest).collect())
        assert got == sorted((i, j) for k, i, x, y in a for m, j, u, v in b if k == m and (x <= v and y >= u if touch else x < v and y > u))
    none = joins.range_join(dp, da.filter("false"), ["k"], "at", "s", "e", 9.0, longest=longest)
    assert none.count() == 0 and set(none.columns) == {"k", "p", "at", "a", "s", "e"}


def test_longer_intervals_than_said(spark):
    a, p = spark.createDataFrame([("x", 0.0, 100.0)], "k string, s double, e double"), spark.createDataFrame([("x", 5.0)], "k string, at double")
    with pytest.raises(Exception, match="longer than"):
        joins.range_join(p, a, ["k"], "at", "s", "e", 9.0, longest=50.0).collect()


def test_asof_in_pieces(spark):
    rng = random.Random(5)
    left = [(k, rng.choice(["a", "b", None]), float(rng.randrange(100))) for k in range(200)]
    right = [(rng.choice(["a", "b", "c", None]), float(rng.randrange(100)), k) for k in range(60)] + [("a", 50.0, 901), ("a", 50.0, 900)]
    dl, dr = spark.createDataFrame(left, "id long, k string, t double"), spark.createDataFrame(right, "k string, t double, v int")
    want = {i: max(((t, v) for m, t, v in right if m == k and t <= at), default=(0, None))[1] for i, k, at in left}
    for piece in (None, F.floor(F.col("__ts") / 7), F.floor(F.col("__ts") / 1000)):
        assert {r.id: r.v for r in joins.asof_backward(dl, dr, ["k"], "t", "t", ["v"], ["v"], piece).collect()} == want


def test_windows(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x"), ("a", 5, None), ("a", 6, None), ("b", 1, None)], "k string, t int, v string")
    assert sorted((r.k, r.t) for r in W.change_rows(rows, ["k"], ["t"], "v").collect()) == [("a", 1), ("a", 3), ("a", 4), ("a", 5), ("a", 6), ("b", 1)]
    spans = spark.createDataFrame([("a", 0, 10), ("a", 2, 9), ("a", 5, 12), ("a", 12, 12), ("a", 13, 20)], "k string, s int, e int")
    assert [r.s for r in W.uncovered(spans, ["k"], "s", "e").orderBy("s").collect()] == [0, 5, 12, 13]
    assert W.latest_per_key(rows, ["k"], "t").count() == 2 and W.latest_per_key(rows.filter("false"), ["k"], "t").count() == 0


def test_pivot_keeps_keys_with_other_categories(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "zzz"), (None, "x")], "k string, c string")
    assert {(r.k, r.n_x, r.n_y) for r in A.pivot_counts(rows, ["k"], "c", ["x", "y"]).collect()} == {("a", 2, 0), ("b", 0, 0), (None, 1, 0)}


def test_mode_share_ties(spark):
    rows = spark.createDataFrame([("a", "p", 2), ("a", "q", 1), ("b", None, 1)], "k string, v string, t int")
    assert [(r.k, r.v, r.share) for r in A.mode_share(rows, ["k"], "v", ("f", F.min("t"))).collect()] == [("a", "q", 0.5)]


def test_scd2_and_rerun(spark):
    now = spark.createDataFrame([(1, "x", "2024-01-01"), (2, "y", "2024-01-01"), (3, None, "2024-01-01")], "k long, team string, effective_from string")
    come = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "w")], "k long, team string")
    out = mutations.scd2(now, come, "k", ["team"], F.lit("2024-02-01"))
    rows = {(r.k, r.team, r.is_current, r.change) for r in out.collect()}
    assert rows == {(1, "x", True, "unchanged"), (2, "y", False, "team_change"), (2, "z", True, "team_change"), (3, None, True, "unchanged"), (4, "w", True, "new")}
    again = mutations.scd2(out.filter("is_current").select("k", "team", "effective_from"), come, "k", ["team"], F.lit("2024-02-01"))
    assert {r.change for r in again.collect()} == {"unchanged"}


def test_snapshots(spark):
    days = spark.createDataFrame([(d,) for d in (1, 2, 5, 9)], "d int")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("b", 5), ("b", 5)], "k string, d int")
    assert {(r.k, r.reported, r.resolved) for r in mutations.snapshot_intervals(rows, days, "k", "d").collect()} == {("a", 1, 5), ("a", 9, None), ("b", 5, 9)}


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int"), spark.createDataFrame([(2, None, 5), (3, "c", None)], "k int, v string, n int")
    rows = lambda df: sorted((r.k, r.v, r.n) for r in df.collect())
    assert rows(mutations.upsert(old, new, ["k"])) == [(1, "a", 1), (2, None, 5), (3, "c", None)]
    assert rows(mutations.upsert_coalesce(old, new, ["k"])) == [(1, "a", 1), (2, "b", 5), (3, "c", None)]
    assert rows(mutations.upsert_coalesce(old, new, ["k"], overwrite=["v"])) == [(1, "a", 1), (2, None, 5), (3, "c", None)]
    assert rows(mutations.insert_missing(old, new.unionAll(new), ["k"])) == [(1, "a", 1), (2, "b", 2), (3, "c", None)]


def test_paging(spark):
    rows = spark.range(10).withColumn("ts", F.timestamp_seconds(F.col("id")))
    assert [r.id for r in paging.before(rows, "ts", "id", "1970-01-01 00:00:05", 3).collect()] == [4, 3, 2]
    assert {r.has_more for r in paging.before(rows, "ts", "id", "1970-01-01 00:00:03", 3).collect()} == {False}
    assert paging.page(rows, ["id"], 3, 9)[1] == 10 and [r.id for r in paging.page(rows, ["id"], 3, 9)[0].collect()] == [9]
    assert paging.seeded_sample(rows, "id", 4, 1).collect() == paging.seeded_sample(rows.repartition(3), "id", 4, 1).collect()


def blobs(sizes, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.eye(8)[: len(sizes)]
    x = np.concatenate([c + 0.05 * rng.normal(size=(n, 8)) for c, n in zip(centres, sizes, strict=True)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_density_clusters():
    x = blobs([40, 25, 15])
    got = density.density_clusters(np.concatenate([x, -np.eye(8)[:2]]), 8)
    assert set(got[:40]) == {0} and set(got[40:65]) == {1} and set(got[65:80]) == {2} and got[80:] == [-1, -1]
    assert density.density_clusters(np.concatenate([x, -np.eye(8)[:2]]), 8) == got
    assert density.density_clusters(x[:10], 8) == [-1] * 10 and density.density_clusters(x[:0], 8) == []


def test_online_and_merge():
    points = np.array([[0, 0], [10, 0], [300, 0], [0, 10], [310, 0]], float)
    clusters = C.Online(120)
    assert [clusters.place(p) for p in points] == [0, 0, 1, 0, 1]
    assert C.merge_close(np.array([[0, 0], [50, 0], [500, 0]], float), np.array([5, 3, 2]), 100, 5) == [0, 0, -1]


def test_smoothing():
    assert Q.smooth_labels(list("AABAAC"), 1) == list("AAAAAC") and Q.smooth_labels([], 1) == []
    assert Q.smooth_labels(list("ABA"), 0) == list("ABA")
    spans = [("A", 0, 10, "x"), ("B", 10, 11, "y"), ("A", 11, 20, "z"), ("C", 20, 21, None)]
    assert Q.smooth_spans(spans, 2, 1) == [("A", 0, 20, "x y z"), ("C", 20, 21, None)]
    assert Q.thin_boundaries([(3, 9.0), (10, 1.0), (14, 2.0), (30, 1.0), (38, 5.0)], 8, 40) == [14, 30]


def plain_smoothing(labels, most):
    labels = list(labels)
    while True:
        runs = []
        for k, x in enumerate(labels):
            if runs and runs[-1][0] == x:
                runs[-1][2] = k + 1
            else:
                runs.append([x, k, k + 1])
        short = next((k for k in range(1, len(runs) - 1) if runs[k][2] - runs[k][1] <= most and runs[k - 1][0] == runs[k + 1][0]), None)
        if short is None:
            return labels
        _, a, b = runs[short]
        labels[a:b] = [runs[short - 1][0]] * (b - a)


def test_smoothing_in_streams(spark):
    rng = random.Random(2)
    for most in (0, 1, 2, 3):
        for _ in range(200):
            labels = rng.choices("ABC", k=rng.randrange(30))
            assert Q.smooth_labels(labels, most) == plain_smoothing(labels, most), (labels, most)
    labels = {k: rng.choices("AABBC", k=n) for k, n in ((1, 0), (2, 1), (3, 3000), (4, 5000), (None, 40))}
    df = spark.createDataFrame([(k, i, x) for k, v in labels.items() for i, x in enumerate(v)], "k long, i long, x string")
    got = {}
    for r in Q.smoothed(df.repartition(5), "k", ["i"], "x", 2).collect():
        got.setdefault(r.k, {})[r.i] = r.x
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: plain_smoothing(v, 2) for k, v in labels.items() if v}


def test_keep_longer(spark):
    df = spark.createDataFrame([(1, 0, "p", "ab"), (1, 0, "p", "cd"), (1, 1, "p", "x"), (1, 1, "q", "y"), (1, 2, "p", "ef")], "c long, g long, k string, text string")
    got = sorted((r.c, r.g, r.k, r.text, r.also_in) for r in Q.keep_longer(df, ["c", "k"], "g", "text").collect())
    assert got == [(1, 0, "p", "ab", [1, 2]), (1, 0, "p", "cd", [1, 2]), (1, 1, "q", "y", [])]


def test_online_clusters_in_streams(spark):
    rng = random.Random(4)
    points = {k: [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(n)] for k, n in ((1, 500), (2, 3), (None, 20))}
    df = spark.createDataFrame([(k, i, *p) for k, v in points.items() for i, p in enumerate(v)], "k long, i long, x double, y double").repartition(4)
    got = {(r.k, r.i): r.cluster for r in C.online_clusters(df, "k", "i", 120.0).collect()}
    for k, v in points.items():
        means, sizes = [], []
        for i, p in enumerate(v):
            d = [((p[0] - m[0]) ** 2 + (p[1] - m[1]) ** 2) ** 0.5 for m in means]
            c = d.index(min(d)) if d and min(d) <= 120 else len(means)
            if c == len(means):
                means.append(list(p))
                sizes.append(1)
            else:
                sizes[c] += 1
                means[c] = [m + (x - m) / sizes[c] for m, x in zip(means[c], p, strict=True)]
            assert got[k, i] == c


def test_cluster_bounded(spark):
    x = np.concatenate([blobs([40, 25, 15]), -np.eye(8)[:2]])
    rows = [("whole", i, v.tolist()) for i, v in enumerate(x)] + [("noise", i, v.tolist()) for i, v in enumerate(x[:5])] + [("large", 100 + i, v.tolist()) for i, v in enumerate(np.concatenate([blobs([300, 200], seed=5), -np.eye(8)[:1]]))]
    df = spark.createDataFrame(rows, "g string, i long, v array<double>")
    got = {(r.g, r.i): r.cluster for r in C.cluster_bounded(df, ["g"], "i", 8, most=100).collect()}
    assert len(got) == len(rows)
    assert [got["whole", i] for i in range(82)] == [0] * 40 + [1] * 25 + [2] * 15 + [None, None]
    assert {got["noise", i] for i in range(5)} == {None}
    a, b = ({got["large", 100 + i] for i in part} for part in (range(300), range(300, 500)))
    assert {len(a), len(b)} == {1} and a != b and got["large", 600] is None
    # a member that is far from the mean of its cluster is noise
    tail = np.array([[np.cos(t), np.sin(t)] for t in np.linspace(0, 2.6, 40)])
    labels = np.array(density.density_clusters(tail, 5))
    near = np.array(C.near_members(tail, 5, 0.5))
    for k in range(labels.max() + 1):
        mean = tail[labels == k].mean(axis=0)
        cosine = tail @ mean / np.linalg.norm(mean)
        assert (near[labels == k] == np.where(cosine[labels == k] < 0.5, -1, k)).all()
    assert (near[labels < 0] == -1).all()


def test_assign_keeps_points_without_centroids(spark):
    points = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [-1.0, 0.0]), ("b", 3, [1.0, 0.0])], "g string, i long, v array<double>")
    means = spark.createDataFrame([("a", 7, [1.0, 0.1]), ("a", 8, [0.0, 1.0])], "g string, cluster long, centroid array<double>")
    assert {r.i: r.cluster for r in C.assign(points, means, ["g"], "i", 0.3).collect()} == {1: 7, 2: None, 3: None}


def test_registry_is_bounded(spark, monkeypatch):
    refs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "ref long, q array<double>")
    rows = spark.createDataFrame([(10, [2.0, 0.1]), (11, [-1.0, -1.0])], "i long, v array<double>")
    assert {r.i: r.m for r in V.nearest_of(rows, refs, "i", "ref", 0.3, "m").collect()} == {10: 1, 11: None}
    assert {r.m for r in V.nearest_of(rows, refs.filter("false"), "i", "ref", 0.3, "m").collect()} == {None}
    monkeypatch.setattr(V, "MOST_REFERENCES", 2)
    with pytest.raises(Exception, match="too large"):
        V.nearest_of(rows, refs, "i", "ref", 0.3, "m").collect()


def test_jaro_bound(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcde", k=rng.randrange(8))) for _ in range(60)] + ["", "é", "abc"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", X.jaro_bound("a", "b").alias("bound")).collect():
        assert r.bound >= X.jaro_similarity(r.a, r.b) - 1e-12, (r.a, r.b)


def test_summaries_and_phonetics(spark, tmp_path):
    assert summary_of('{"a": 1, "b": [1, 2], "c": {"y": 1, "x": 2}}') == '{"a": 1, "b_count": 2, "c_keys": ["x", "y"]}'
    assert summary_of(None) is None and summary_of("{oops") is None and summary_of("[1, 2]") == '{"count": 2}' and summary_of("3") == '{"value": 3}'
    score = lambda a, b: value(spark, F.round(X.phonetic_score(F.lit(a), F.lit(b)), 6))
    assert score("knight", "knight") == 1.0 and score("a", "abc") == 0.0
    assert score("smith", "smyth") == round(0.4 * (X.metaphone_of("smith") == X.metaphone_of("smyth")) + 0.4 * X.jaro_winkler_of("smith", "smyth") + 0.2, 6)
    for name, n in (("small", 10), ("large", 1000)):
        spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = [(r.name, r.bytes) for r in files.table_sizes(spark, str(tmp_path)).collect()]
    sizes = {name: sum(f.stat().st_size for f in (tmp_path / f"{name}.parquet").glob("*.parquet")) for name in ("small", "large")}
    assert got == [("large", sizes["large"]), ("small", sizes["small"])]


def test_sliding_spans(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.2)], "id long, d double")
    got = sorted((r.id, r.start_s, r.end_s) for r in Q.sliding_spans(rows, "d", 2.0, 0.5).collect())
    assert got == [(1, 0.0, 1.0), (2, 0.0, 2.0), (3, 0.0, 2.0), (3, 0.5, 2.5), (3, 1.0, 3.0), (3, 1.5, 3.2)]


def test_seed_dictionary(spark):
    text = "# seeds\nteams:\n  - name: A b\n    value: Ab  # short\n    aliases: [x, y z]\n  - name: C\n    value: Cc\n"
    want = [("A b", "Ab", ["x", "y z"]), ("C", "Cc", [])]
    assert [(r.name, r.value, r.aliases) for r in files.dictionary(spark, text).collect()] == want
    assert files.yaml_entries(text) == [{"name": "A b", "value": "Ab", "aliases": ["x", "y z"]}, {"name": "C", "value": "Cc"}]
    assert files.dictionary(spark, "").count() == 0


def test_bad_json_is_a_row(spark, tmp_path):
    (tmp_path / "season=2024").mkdir()
    (tmp_path / "season=2024" / "a.json").write_text('{"n": 1, "season": 1}\n{"n": oops\n')
    good, bad = files.read_json(spark, str(tmp_path), "n int, season int")
    assert [(r.n, r.season) for r in files.from_key(good, "file", {"season": (r"season=(\d+)", "int")}).collect()] == [(1, 2024)]
    assert bad.count() == 1


def test_streams_match_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "a"), (2, 9, None)], "k long, t long, v string").withColumn("ts", F.timestamp_seconds(F.col("t"))).select("k", "ts", "v")
    got = jobs.run(jobs.changes(jobs.stream(rows, spark), "k", "ts", "v"), str(tmp_path / "changes"))
    assert sorted((r.k, r.v or "") for r in got.collect()) == [(1, "a"), (1, "b"), (2, ""), (2, "a")]
    seen = jobs.run(jobs.first_of_key_within(jobs.stream(rows, spark), "k", "ts", "1 hour"), str(tmp_path / "seen"))
    assert sorted(r.k for r in seen.collect()) == [1, 2]
    again = jobs.first_of_key(jobs.stream(rows, spark), "k")
    assert jobs.run(again, str(tmp_path / "first")).count() == 2


def test_sessions_plan(spark):
    rows = jobs.stream(spark.createDataFrame([(1, "2024-01-01 00:00:00")], "k long, ts string").withColumn("ts", F.col("ts").cast("timestamp")), spark)
    assert jobs.sessions(rows, "ts", "5 seconds", ["k"], "1 minute").columns == ["start", "end", "k", "n"]
