"""Findings of round 3: queries against their SQL on rows that the test tables lack, and interval operators against brute force."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import joins
from tallyfield.plans import catalog


@pytest.fixture
def held(spark, tmp_path):
    """Write tables, and give rows of a query and of its SQL over them."""

    def over(name, **tables):
        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        for t, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
        got = catalog.queries()[name](spark, str(tmp_path))
        want = con.sql(catalog.oracle_sql()[name])
        return sorted(map(tuple, got.select(*want.columns).collect()), key=repr), sorted(want.fetchall(), key=repr)

    return over


def test_slugs_of_letters_without_marks(spark, held):
    texts = ["Größe œuvre Æther", " Ça  va　", "a\x0bb\tc", "ΑΣ ΟΔΟΣ", "İstanbul", "'q\".", "", "한국어 한", "ﬁn № ½ …", None]
    got, want = held("str_slug_fold", documents=spark.createDataFrame([(k, t, ("fr", "es")[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, lang string"))
    assert got == want and len(got) == len(texts)


def test_known_pages_whose_url_others_share(spark, held):
    rows = [(k, f"http://x/{k % 7}") for k in range(80)] + [(None, "http://x/1"), (None, None), (81, None), (84, None), (84, None), (86, "http://x/1"), (86, "http://x/1"), (-1, "u"), (-4, "u")]
    got, want = held("inc_watermark_url", pages=spark.createDataFrame(rows, "page_id long, url string"))
    assert got == want and len(got) > 40


def spans_of(rng, n, longest):
    starts = [rng.randrange(-50, 400) for _ in range(n)]
    return [(rng.choice(["x", "y", None]), k, s, s + rng.choice([0, 1, 3, rng.randrange(longest + 1)])) for k, s in enumerate(starts)]


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_without_pairs(spark, seed):
    """Counts, sums, texts and the greatest overlap against all pairs, with ties, intervals without length and null keys."""
    rng = random.Random(seed)
    a, b = spans_of(rng, 90, 40), spans_of(rng, 90, 40)
    da, db = spark.createDataFrame(a, "k string, a long, s long, e long"), spark.createDataFrame(b, "k string, b long, s2 long, e2 long")
    for touch in (True, False):
        want = {}
        for k, i, s, e in a:
            own = [min(e, y) - max(s, x) for m, _, x, y in b if k is not None and m == k and (x <= e and y >= s if touch else x < e and y > s)]
            if own:
                want[i] = (len(own), sum(own))
        for width in (7, 1000):
            assert {r.a: (r.n, int(r.total)) for r in joins.overlap_sums(da, db, ["k"], ["a"], ("s", "e"), ("s2", "e2"), width, touch).collect()} == want
    near = {i: sorted((x, j) for m, j, x, y in b if k is not None and m == k and x <= e and y >= s) for k, i, s, e in a}
    texts = joins.overlap_texts(da, db.withColumn("w", F.when(F.col("b") % 5 != 0, F.col("b").cast("string"))), ["k"], ("s", "e"), ("s2", "e2"), "w", "b", ",", 40)
    assert {r.a: (r.n, r.text) for r in texts.collect()} == {i: (len(own), ",".join(str(j) for _, j in own if j % 5) or None) for i, own in near.items()}
    most = {}
    for k, i, s, e in a:
        own = sorted((-(min(e, y) - max(s, x)), x, j) for m, j, x, y in b if k is not None and m == k and min(e, y) > max(s, x))
        if own:
            most[i] = (own[0][2], -own[0][0])
    assert {r.a: (r.b, r.overlap) for r in joins.max_overlap(da, db, ["k"], ["a"], ("s", "e"), ("s2", "e2"), 9, 40, "b").collect()} == most


def test_most_overlapping_of_many():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50):
        for _ in range(200):
            s, t0 = rng.integers(0, 60, 30), np.sort(rng.integers(0, 60, n))
            e, t1 = s + rng.integers(0, 30, 30), t0 + rng.integers(0, 30, n)
            best, most = joins.most_overlapping(s, e, t0, t1)
            every = np.maximum(np.minimum(e[:, None], t1) - np.maximum(s[:, None], t0), 0)
            assert (most == every.max(axis=1)).all() and (best == np.where(every.max(axis=1) > 0, every.argmax(axis=1), -1)).all()


@pytest.mark.parametrize("longest", [None, 40.0])
def test_first_interval_of_many(spark, longest):
    rng = random.Random(3)
    i, p = spans_of(rng, 80, 40), [(rng.choice(["x", "y", None]), k, rng.randrange(-60, 450)) for k in range(150)]
    di, dp = spark.createDataFrame(i, "k string, i long, s long, e long"), spark.createDataFrame(p, "k string, p long, at long")
    for closed in (True, False):
        want = {}
        for k, q, t in p:
            own = sorted((s, j) for m, j, s, e in i if k is not None and m == k and s <= t and (t <= e if closed else t < e))
            if own:
                want[q] = own[0][1]
        assert {r.p: r.i for r in joins.first_interval(dp, di, ["k"], ["p"], "at", "s", "e", 3.0, closed, ["i"], longest).collect()} == want


def test_pairs_are_not_shuffled(spark):
    """The plans of queries on overlaps join no intervals with intervals."""
    for name in ("join_interval_overlap", "join_max_overlap", "join_overlap_array", "join_point_interval_half_open", "join_overlap_open"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Join" in line and "__icell" in line], name


def test_few_names_of_many_parts(spark, held):
    """Rows of one name come from several tasks."""
    rows = [(k, [f"n{k % 2}", None, "alone"][k % 101 % 3 if k % 50 < 2 else 0], k % 50 + 1) for k in range(3000)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int")
    got, want = held("join_left_name", part=parts)
    assert got == want and len(got) > 5000


def test_rows_of_one_name_are_dealt(spark):
    left, right = spark.createDataFrame([(k, "x") for k in range(400)], "id long, k string"), spark.createDataFrame([(k, "x") for k in range(50)], "other long, k string")
    made = joins.salted_left(left, right, ["k"], "id").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in made) == 20000 and len(made) > 1


def test_json_of_events_without_a_type(spark, held):
    rows = [(1, "error", '{"k": 5}'), (2, None, '{"k": 6}'), (3, "view", '{"k": 7}'), (4, "view", None)]
    got, want = held("update_json_nested", events=spark.createDataFrame(rows, "event_id long, event_type string, props string"))
    assert got == want


def test_json_is_parsed_once(spark):
    plan = catalog.queries()["update_json_nested"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") <= 4


def test_rows_shuffled_for_overlaps(spark):
    """Intervals of b go to two cells at most, however long they are, and both sides of a query read spans that were shuffled by user once."""
    a = spark.createDataFrame([("x", k, 7 * k, 7 * k + 40) for k in range(100)], "k string, a long, s long, e long")
    b = spark.createDataFrame([("x", k, 5 * k, 5 * k + 40) for k in range(200)], "k string, b long, s2 long, e2 long")
    rows = joins._beside(a, b, ["k"], ("s", "e"), ("s2", "e2"), 40, "b").count().agg(F.sum("count")).first()[0]
    assert 300 < rows <= 500
    got = catalog.queries()["join_interval_overlap"](spark, "/root/testdata/sf0.001")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1
