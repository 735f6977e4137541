"""Operators for large tables against brute force: fuzzy mentions, topic blocks, cell index, density clusters, merges, pairs, keyed tables, pages, streams, queues."""

from __future__ import annotations

import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import text as X
from tallyfield.operators import clustering as C
from tallyfield.operators import density, fuzzy, mutations, paging, queues, segments
from tallyfield.operators.keyed_tables import KeyedTable
from tallyfield.operators.sequences import thin_boundaries
from tallyfield.operators.vector_index import CellIndex
from tallyfield.streaming import jobs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---- fuzzy mentions ----


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def brute_mentions(texts, names, edits, least):
    words = lambda t: [w for w in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in t.lower()).split()]
    entries = {n: words(n) for n in names if n and words(n)}
    out = []
    for i, t in texts:
        own = words(t or "")
        for pos in range(len(own)):
            found = []
            for name, parts in entries.items():
                got = own[pos : pos + len(parts)]
                if len(got) < len(parts):
                    continue
                costs = [levenshtein(x, y) for x, y in zip(got, parts, strict=True)]
                if all(c <= (0 if min(len(x), len(y)) < least else edits) for c, x, y in zip(costs, got, parts, strict=True)) and sum(costs) <= edits:
                    score = round(sum(X.jaro_winkler_of(x, y) for x, y in zip(got, parts, strict=True)) / len(parts), 6)
                    found.append((-len(parts), sum(costs), -score, name, " ".join(got)))
            if found:
                n, cost, score, name, got = min(found)
                out.append((i, pos, got, name, cost, -score))
    return sorted(out)


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_mentions_against_brute_force(spark, edits):
    rng = random.Random(edits)
    base = ["amber", "stone", "river", "north", "old", "mill", "lakes", "bridge"]
    names = [" ".join(rng.sample(base, rng.randrange(1, 4))) for _ in range(25)] + ["North-River", "", None, "old", "amber stone amber"]

    def damaged(w):
        w = list(w)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            rng.choice([lambda k=k: w.insert(k, rng.choice("abxé")), lambda k=k: w and w.pop(min(k, len(w) - 1)), lambda k=k: w and w.__setitem__(min(k, len(w) - 1), "z")])()
        return "".join(w)

    texts = [(k, " ".join(damaged(w) for w in rng.choices([*base, "other", "word"], k=rng.randrange(25)))) for k in range(60)] + [(100, None), (101, ""), (102, "..., !"), (103, "old old OLD mill")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted(tuple(r) for r in fuzzy.mentions(df, known, edits=edits, least=4).collect())
    assert got == brute_mentions(texts, names, edits, 4)
    assert edits == 0 or any(r[4] for r in got)


def test_mentions_of_nothing(spark):
    df = spark.createDataFrame([(1, "amber stone")], "doc_id long, text string")
    none = spark.createDataFrame([], "name string")
    assert fuzzy.mentions(df, none).count() == 0
    assert fuzzy.mentions(df.filter("false"), spark.createDataFrame([("amber",)], "name string")).count() == 0


def test_mentions_join_on_equality(spark):
    df = spark.createDataFrame([(1, "amber stone")], "doc_id long, text string")
    text = plan(fuzzy.mentions(df, spark.createDataFrame([("amber",)], "name string")))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


# ---- topic blocks ----

TOPICS, SCOPES, MOVES = ["gear", "bolt", "anvil", "ring", "Plate"], ["red", "cold", "new", "old"], ["moving on", "next up"]


def topic_texts():
    rng, out = random.Random(3), {}
    for doc in (5, 200, 100_000):
        text = []
        for part in range(7):
            words = ["the", "and", "unit", "shop", rng.choice(TOPICS), rng.choice(TOPICS), rng.choice(SCOPES), rng.choice(SCOPES), "bolting", "removing once"]
            for k in range(rng.randrange(5, 60)):
                lead = {2: "Moving on ", 4: "Next up: "}.get(part, "") if k == 0 else ""
                text.append(lead + " ".join(rng.choices(words, weights=[9, 9, 9, 9, 1, 1, 1, 1, 1, 1], k=rng.randrange(1, 12))))
        out[doc] = "".join(x + rng.choice([". ", ". ", ". ", ".\n"]) for x in text)
    return out


def brute_blocks(text):
    sentences, at = [], 0
    for k in range(1, len(text)):
        if text[k - 1] == "." and text[k] in " \n\t":
            sentences.append(text[at:k])
            at = k
    sentences.append(text[at:])
    low = [x.lower() for x in sentences]
    names = [{n for n in TOPICS if n.lower() in x} for x in low]
    wide = [{n for n in SCOPES if n in x} for x in low]
    score = []
    for k, w in enumerate(names):
        recent = {x for v in names[max(0, k - 20) : k] for x in v}
        moved = any(f" {p} " in f" {low[k].strip().replace(':', ' ')} " for p in MOVES)
        score.append(len(w - recent) + 2 * moved + 1.5 * sentences[k].startswith("\n"))
    top = [(k, x) for k, x in enumerate(score) if x >= 2 and x == max(score[max(0, k - 10) : k + 11])]
    cuts = [0, *thin_boundaries(top, 8, len(score)), len(score)]
    bounds = [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    often = lambda of, a, b, least: [n for n, c in sorted(Counter(x for s in of[a : b + 1] for x in s).items(), key=lambda p: (-p[1], p[0])) if c >= least]

    def kind(a, b):
        named, scopes = often(names, a, b, 2), often(wide, a, b, 3)
        if len(named) > 1:
            return "versus", f"{named[0]} vs {named[1]}" + (f" (+{len(named) - 2} more)" if len(named) > 2 else "")
        if len(scopes) > 3:
            return "general", "general"
        if scopes:
            return "scope", "/".join(sorted(scopes))
        return ("single", named[0]) if named else ("general", "general")

    blocks, before = list(bounds), None
    while blocks != before:
        before, kept = blocks, []
        for a, b in blocks:
            if kept:
                p, q = kept[-1]
                n, m = q - p + 1, b - a + 1
                both = set(often(names, p, q, 1 if n < 50 else 2)) & set(often(names, a, b, 1 if m < 50 else 2))
                about = {kind(p, q)[0], kind(a, b)[0]} & {"versus", "single"}
                if min(n, m) < 80 and (len(both) > 1 or len(both) == 1 and about):
                    kept[-1] = (p, b)
                    continue
            kept.append((a, b))
        blocks = kept
    return bounds, [(*kind(a, b), a, b) for a, b in blocks]


def test_topic_blocks_against_brute_force(spark):
    texts = topic_texts()
    df = spark.createDataFrame([*texts.items(), (1, None), (2, ""), (2, "")], "doc_id long, text string")
    found = lambda merge: segments.topic_blocks(df, TOPICS, SCOPES, MOVES, merge=merge)
    want = {doc: brute_blocks(text) for doc, text in texts.items()}
    cut = sorted((r.doc_id, r.first_pos, r.last_pos) for r in found(False).collect())
    assert cut == sorted([(doc, a, b) for doc, (x, _) in want.items() for a, b in x] + [(2, 0, 0)] * 2)
    blocks = sorted(map(tuple, found(True).collect()))
    assert blocks == sorted([(doc, *x) for doc, (_, y) in want.items() for x in y] + [(2, "general", "general", 0, 0)] * 2)
    assert len(texts) + 2 < len(blocks) < len(cut) and len({b[1] for b in blocks}) > 1
    assert "Exchange" not in plan(found(True)) and "Generate" not in plan(found(True))


def test_phrases_are_whole_words_and_names_are_not():
    known = segments.Mentions(["ring"], ["old"], ["next up"])
    sentences, topics, scopes, moved = known.of("Text up. Stringing cold. Next upper. (Next up) ring.\nri")
    assert len(sentences) == 5 and topics == [set(), {"ring"}, set(), {"ring"}, set()] and scopes == [set(), {"old"}, set(), set(), set()] and moved == {3}
    assert segments.Mentions([], [], []).of("a. b")[1:] == ([set(), set()], [set(), set()], set())


def test_blocks_merge_by_size():
    block = lambda a, z, **t: (a, z, Counter(t), Counter())
    kept = lambda *b: [(x[0], x[1]) for x in segments.merged_blocks(list(b))]
    assert kept(block(0, 79, x=9, y=9), block(80, 159, x=9, y=9)) == [(0, 79), (80, 159)]  # two long ones stay apart
    assert kept(block(0, 49, x=1, y=1), block(50, 99, x=9, y=9)) == [(0, 49), (50, 99)]  # in 50 sentences a topic needs two
    assert kept(block(0, 48, x=1, y=1), block(49, 97, x=9, y=9)) == [(0, 97)]
    assert kept(block(0, 9, x=1), block(10, 19, x=1)) == [(0, 9), (10, 19)] and kept(block(0, 9, x=1), block(10, 19, x=2)) == [(0, 19)]
    assert kept() == []


def test_dictionaries_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(segments, "MOST_NAMES", 2)
    assert segments.names_of(spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "name string"), "name") == ["a", "b"]
    with pytest.raises(ValueError, match="more than 2"):
        segments.names_of(spark.range(3).select(F.col("id").cast("string").alias("name")), "name")


# ---- cells ----


def vectors(n, dim=16, seed=0, groups=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.6 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_cells_reach_recall_and_exactness(spark, tmp_path):
    x = vectors(3000)
    rows = [(k, v.tolist(), k % 5) for k, v in enumerate(x)] + [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, x[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g int")
    index = CellIndex.build(df, "id", "v", 30, str(tmp_path / "index"))
    assert index.rows().count() == 3001
    every = np.concatenate([x, x[7:8]])
    ids = np.array([*range(3000), 9003])
    hits = 0
    for probe in (3, 500, 777, 2999, 7):
        cos = every @ x[probe]
        want = ids[np.lexsort((ids, -np.round(cos, 12)))][:10].tolist()
        near = [r.id for r in index.search(x[probe], "id", 10, cells=4).collect()]
        hits += len(set(near) & set(want))
        exact = index.search(x[probe] * 3.0, "id", 10, cells=1, exact=True).collect()
        assert sorted(r.id for r in exact) == sorted(want)
        some = [r.id for r in index.search(x[probe], "id", 5, cells=2, where="g = 2", exact=True).collect()]
        keep = (ids % 5 == 2) & (ids < 9000)
        assert sorted(some) == sorted(ids[keep][np.argsort(-cos[keep], kind="stable")][:5].tolist())
    assert hits >= 0.95 * 50
    few = index.scored(x[3], index.cell[:2].tolist())
    assert "PartitionFilters: [cell" in plan(few)
    read = {f.rsplit("/", 2)[1] for f in few.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert read == {f"cell={k}" for k in index.cell[:2]}
    empty = CellIndex.build(df.filter("false"), "id", "v", 30, str(tmp_path / "empty"))
    assert empty.cell.tolist() == []


# ---- density ----


def kruskal(x, least):
    """The tree by sorting all pairs."""
    n = len(x)
    d = density.squared(x, x)
    core = np.sort(d, axis=1)[:, min(least, n - 1)]
    pairs = sorted((max(d[a, b], core[a], core[b]), a, b) for a in range(n) for b in range(a + 1, n))
    root, out = list(range(n)), []
    for w, a, b in pairs:
        i, j = a, b
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        if i != j:
            root[i] = j
            out.append((float(np.sqrt(w)), a, b))
    return out


def test_dense_tree_is_the_only_one():
    rng = np.random.default_rng(2)
    x = np.concatenate([vectors(120, 6), vectors(20, 6)])
    x = np.concatenate([x, x[:15], np.round(rng.normal(size=(40, 6)))])  # equal points and equal distances
    assert sorted(density.dense_tree(x, 5)) == sorted(kruskal(x, 5))


def test_clusters_by_rounds_equal_those_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 90)
    monkeypatch.setattr(density, "HELD", 2)
    points = {"a": vectors(700, 8, 1), "b": vectors(260, 8, 2), None: vectors(240, 8, 3), "few": vectors(60, 8, 4)}
    points["a"][600:640] = points["a"][:40]
    rows = [(k, int(i * 3 + 1), v.tolist()) for k, x in points.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, i long, v array<double>").repartition(5)
    got = {(r.g, r.i): r.cluster for r in C.density_clusters_of(df, ["g"], "i", 6, most=200).collect()}
    assert len(got) == len(rows)
    for k, x in points.items():
        want = C.near_members(x / np.linalg.norm(x, axis=1, keepdims=True), 6, 0.25)
        assert [got[k, i * 3 + 1] for i in range(len(x))] == [None if c < 0 else c for c in want], k
    assert len({c for (g, _), c in got.items() if g == "a"}) > 3


def test_null_keys_are_a_source(spark):
    x = vectors(60, 8, 4)
    df = spark.createDataFrame([(None, i, v.tolist()) for i, v in enumerate(x)] + [("a", 1, x[0].tolist())], "g string, i long, v array<double>")
    for found in (C.cluster_bounded(df, ["g"], "i", 5), C.cluster_bounded(df, ["g"], "i", 5, most=40), C.density_clusters_of(df, ["g"], "i", 5)):
        assert found.count() == 61


# ---- merges and pairs ----


def plain_merge(means, sizes, eps, least):
    groups, means, sizes = [[k] for k in range(len(means))], [np.array(m, float) for m in means], list(sizes)
    while len(groups) > 1:
        pairs = [(float(np.sqrt(((means[a] - means[b]) ** 2).sum())), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups))]
        d, a, b = min(pairs)
        if d > eps:
            break
        means[a] = (means[a] * sizes[a] + means[b] * sizes[b]) / (sizes[a] + sizes[b])
        sizes[a] += sizes[b]
        groups[a] += groups[b]
        del means[b], sizes[b], groups[b]
    at = {k: g for g, members in enumerate(groups) for k in members}
    return [at[k] if sizes[at[k]] >= least else -1 for k in range(len(at))]


def test_merges_equal_the_plain_loop():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 30, 70):
        for whole in (False, True):
            means = rng.uniform(0, 300, (n, 2))
            means = np.round(means / 20) * 20 if whole else means  # many equal distances
            sizes = rng.integers(1, 6, n)
            assert C.merge_close(means, sizes, 60.0, 5) == plain_merge(means, sizes, 60.0, 5), (n, whole)
    began = time.time()
    out = C.merge_close(rng.uniform(0, 5000, (5000, 2)), np.ones(5000), 60.0, 2)
    assert time.time() - began < 30 and len(out) == 5000


def test_greedy_pairs_in_rounds(spark):
    rng = random.Random(6)
    pairs = {(g, rng.randrange(12), f"b{rng.randrange(12)}"): rng.choice([1, 2, 3, None]) for g in (1, 2, None) for _ in range(80)}
    chain = {(9, k // 2 if k % 2 else k // 2, f"c{(k + 1) // 2}"): 100 - k for k in range(30)}  # each edge waits for the one before
    rows = [(*k, w) for k, w in (pairs | chain).items()]
    got = C.pair_greedy(spark.createDataFrame(rows, "g long, a long, b string, w long"), ["g"], "a", "b", "w").collect()
    want, used = [], set()
    for g, a, b, w in sorted(rows, key=lambda r: (str(r[0]), r[3] is None, -(r[3] or 0), r[1], r[2])):
        if (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            want.append((g, a, b, w))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert C.pair_greedy(spark.createDataFrame([], "g long, a long, b string, w long"), ["g"], "a", "b", "w").count() == 0


# ---- keyed tables ----


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_changes_touch_only_their_slices(spark, tmp_path):
    old = spark.range(400).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("s"))
    table = KeyedTable.create(old, ["id"], slices=16, path=str(tmp_path / "t"))
    before = files_of(tmp_path / "t")
    new = spark.createDataFrame([(3, 1, "new"), (5, None, "new"), (1000, 7, "new")], "id long, v long, s string")
    slices = table.change(new, lambda a, b: mutations.upsert_coalesce(a, b, ["id"]))
    want = {k: (k * 2, "x") for k in range(400)} | {3: (1, "new"), 5: (10, "new"), 1000: (7, "new")}
    assert {r.id: (r.v, r.s) for r in table.rows().collect()} == want and table.rows().count() == 401
    after = files_of(tmp_path / "t")
    touched = lambda f: any(f"__slice={k}/" in f for k in slices)
    assert 0 < len(slices) <= 3 and {f: m for f, m in before.items() if not touched(f)} == {f: m for f, m in after.items() if not touched(f)}
    assert table.change(new.filter("false"), lambda a, b: mutations.upsert(a, b, ["id"])) == []
    table.change(new, lambda a, b: mutations.upsert(a, b, ["id"]))
    assert {r.id: r.v for r in table.rows().filter("s = 'new'").collect()} == {3: 1, 5: None, 1000: 7}
    table.drop()


def test_the_old_side_is_not_shuffled(spark, tmp_path):
    table = KeyedTable.create(spark.range(2000).select("id", F.lit(1).alias("v")), ["id"], path=str(tmp_path / "t"))
    new = spark.range(0, 3000, 7).select("id", F.lit(2).alias("v"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = mutations.upsert_coalesce(table.part(list(range(16))), new, ["id"])
        text = plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text  # only the new rows
    table.drop()


def test_history_of_days_in_a_keyed_table(spark, tmp_path):
    rows = [(k, f"s{k % 3}", None if k == 4 else k) for k in range(40)]
    opened = spark.createDataFrame(rows, "k long, seg string, nat long").withColumns({"effective_from": F.lit("2024-01-01").cast("date"), "effective_to": F.lit(None).cast("date"), "is_current": F.lit(True), "change": F.lit("new")})
    table = KeyedTable.create(opened, ["k"], slices=8, path=str(tmp_path / "t"))
    for day, incoming in (("2024-01-02", [(3, "moved", 3), (4, "s1", None), (99, "s9", 9)]), ("2024-01-03", [(3, "moved", 30), (99, "s9", 9)])):
        new = spark.createDataFrame(incoming, "k long, seg string, nat long")
        table.change(new, lambda history, came, day=day: mutations.scd2_history(history, came, "k", ["seg", "nat"], F.lit(day)))
    of = lambda k: sorted((str(r.effective_from), str(r.effective_to), r.seg, r.nat, r.is_current) for r in table.rows().filter(F.col("k") == k).collect())
    assert of(3) == [("2024-01-01", "2024-01-02", "s0", 3, False), ("2024-01-02", "2024-01-03", "moved", 3, False), ("2024-01-03", "None", "moved", 30, True)]
    assert of(4) == [("2024-01-01", "None", "s1", None, True)] and of(99) == [("2024-01-02", "None", "s9", 9, True)]
    assert table.rows().count() == 43 and table.rows().filter("is_current").count() == 41
    table.drop()


# ---- pages ----


@pytest.mark.parametrize("order", [["id"], ["-id"], ["g", "-t", "id"], ["-s", "g", "id"]])
def test_pages_equal_slices_of_the_sorted_table(spark, monkeypatch, order):
    monkeypatch.setattr(paging, "SORTED", 40)
    rng = random.Random(7)
    rows = [(k, rng.choice([None, 1, 2, 2, 2, 2]), rng.choice([None, 1.5, 2.5, float(k)]), rng.choice([None, "", "é", "b", f"s{k}"])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, g long, t double, s string").repartition(7)
    want = [r.id for r in df.orderBy(*paging.Order(order).columns()).collect()]
    pages = paging.Pages(df, order, parts=6)
    assert pages.total == 900 == sum(pages.counts)
    for offset, limit in ((0, 10), (5, 1), (131, 57), (440, 300), (890, 50), (899, 1), (900, 5), (5000, 5), (3, 0)):
        assert [r.id for r in pages.page(limit, offset).collect()] == want[offset : offset + limit], (offset, limit)


def test_pages_of_equal_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(paging, "SORTED", 10)
    equal = spark.range(100).select(F.lit(1).alias("k"))
    rows, total = paging.page(equal, ["k"], 7, 90)
    assert total == 100 and rows.count() == 7
    rows, total = paging.page(equal.filter("false"), ["k"], 7, 0)
    assert total == 0 and rows.count() == 0


# ---- streams ----


def test_state_of_idle_keys_goes(spark, tmp_path):
    """Three triggers, one file each: a key that stays away longer than `idle` loses its state, and its next row counts as a change."""
    source, at = str(tmp_path / "source"), str(tmp_path / "out")
    schema = "k long, ts timestamp, v string"

    def arrive(rows):
        spark.createDataFrame(rows, "k long, t string, v string").select("k", F.col("t").cast("timestamp").alias("ts"), "v").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        return jobs.run(jobs.changes(stream, "k", "ts", "v", delay="1 hour", idle="2 days"), at)

    got = lambda: {(r.k, str(r.ts)[:13], r.v) for r in run().collect()}
    held = lambda: spark.read.format("statestore").option("stateVarName", "last").load(f"{at}/state").count()
    arrive([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 01:00:00", "a"), (2, "2024-01-01 00:00:00", "x"), (None, "2024-01-01 00:00:00", "n")])
    first = {(1, "2024-01-01 00", "a"), (2, "2024-01-01 00", "x"), (None, "2024-01-01 00", "n")}
    assert got() == first and held() == 3
    arrive([(2, "2024-01-02 00:00:00", "x"), (2, "2024-01-02 01:00:00", "y"), (2, "2024-01-05 00:00:00", "y"), (3, "2024-01-05 00:00:00", "q")])
    second = first | {(2, "2024-01-02 01", "y"), (2, "2024-01-05 00", "y"), (3, "2024-01-05 00", "q")}
    assert got() == second and held() == 2  # keys 1 and null have been idle for more than two days
    arrive([(1, "2024-01-05 02:00:00", "a"), (3, "2024-01-05 03:00:00", "q"), (3, "2024-01-05 04:00:00", "r")])
    assert got() == second | {(1, "2024-01-05 02", "a"), (3, "2024-01-05 04", "r")} and held() == 3


def test_seen_keys_are_forgotten_after_the_watermark(spark, tmp_path):
    source = str(tmp_path / "source")
    for day, keys in ((1, [1, 1, 2]), (2, [1]), (6, [3]), (7, [1])):
        spark.createDataFrame([(k, f"2024-01-0{day} 00:00:00") for k in keys], "k long, t string").select("k", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        out = jobs.run(jobs.first_of_key_within(spark.readStream.schema("k long, ts timestamp").parquet(source), "k", "ts", "1 day"), str(tmp_path / "out"))
    assert sorted(r.k for r in out.collect()) == [1, 1, 2, 3]


# ---- queues ----


def test_claims(spark):
    waiting = spark.createDataFrame([(k, k % 7) for k in range(200)] + [(None, 0)], "k long, due long")
    got = queues.claims(waiting, "k", ["due"], workers=4, limit=9).collect()
    assert len(got) == 36 and len({r.k for r in got}) == 36
    for worker in range(4):
        own = sorted((r.place, r.due, r.k) for r in got if r.worker == worker)
        assert [p for p, _, _ in own] == list(range(1, 10))
        alone = [r.k for r in queues.claim(waiting, "k", ["due"], 4, worker, 9).collect()]
        assert alone == [k for _, _, k in own]
    all_rows = [r.k for w in range(4) for r in queues.claim(waiting, "k", ["due"], 4, w, 1000).collect()]
    assert len(all_rows) == 201 and set(all_rows) == {None, *range(200)}
    queue = waiting.withColumn("status", F.lit("open"))
    done = queues.finished(queue, queues.claim(waiting, "k", ["due"], 4, 1, 9), "k", "status", "done")
    assert done.filter("status = 'done'").count() == 9 and done.count() == 201
