"""Density clusters (HDBSCAN): in one task for few points, by rounds over blocks of points for many.

Mutual reachability of two points is their Euclidean distance, or the distance of either to its least-th neighbour if that is more. A minimum spanning tree of it is condensed to clusters of `least` points or more, and
those with the most excess of mass are taken. Edges of one length are ordered by the lesser, then the greater id, so there is one tree, whichever way it is found. Squared distances count to 12 decimals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.session import stored

#: Points of a block, and blocks that a task holds while the others pass by.
BLOCK, HELD = 2048, 4


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
    return np.round(np.maximum(d, 0, out=d), 12, out=d)


def dense_tree(x: np.ndarray, least: int) -> list[tuple[float, int, int]]:
    """The spanning tree (length, a, b), a < b, of a few points: needs the distances of all pairs at once."""
    n = len(x)
    d = squared(x, x)
    core = np.partition(d, min(least, n - 1), axis=1)[:, min(least, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    at = np.arange(n)
    pair = lambda k: np.minimum(at, k) * n + np.maximum(at, k)  # noqa: E731 - an edge as one number
    best, by, left = reach[0].copy(), pair(0), np.ones(n, bool)
    left[0] = False
    edges = []
    for _ in range(n - 1):
        low = np.where(left, best, np.inf)
        ties = np.flatnonzero(low == low.min())
        k = int(ties[by[ties].argmin()])
        edges.append((float(np.sqrt(best[k])), int(by[k] // n), int(by[k] % n)))
        left[k] = False
        own = pair(k)
        nearer = left & ((reach[k] < best) | (reach[k] == best) & (own < by))
        best[nearer], by[nearer] = reach[k][nearer], own[nearer]
    return edges


def condensed(n: int, edges: list[tuple[float, int, int]], least: int) -> list[int]:
    """Clusters of n points by their spanning tree: 0 is the largest one, then that with the first point; -1 is noise."""
    if n < 2 * least:
        return [-1] * n
    # single linkage: node ids from n on
    parent, size, kids, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}, {}

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for k, (w, a, b) in enumerate(sorted(edges)):
        a, b, new = root(a), root(b), n + k
        parent[a] = parent[b] = new
        size[new], kids[new], height[new] = size[a] + size[b], (a, b), w

    def leaves(a: int) -> list[int]:
        stack, out = [a], []
        while stack:
            a = stack.pop()
            if a < n:
                out.append(a)
            else:
                stack += kids[a]
        return out

    # condensed tree: clusters with their birth, mass and children
    birth, mass, children, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: list(range(n))}
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            continue
        lam = 1 / max(height[node], 1e-12)
        big = [k for k in kids[node] if size[k] >= least]
        if len(big) == 2:
            mass[c] += (lam - birth[c]) * size[node]
            for k in big:
                new = len(birth)
                birth[new], mass[new], children[new], members[new] = lam, 0.0, [], leaves(k)
                children[c].append(new)
                stack.append((k, new))
        else:
            mass[c] += (lam - birth[c]) * sum(size[k] for k in kids[node] if k not in big)
            stack += [(k, c) for k in big]
    chosen: set[int] = set()
    score = dict(mass)
    for c in sorted(birth, reverse=True):
        below = sum(score[k] for k in children[c])
        if c and (not children[c] or mass[c] >= below):
            drop = list(children[c])
            while drop:
                k = drop.pop()
                chosen.discard(k)
                drop += children[k]
            chosen.add(c)
        else:
            score[c] = below
    out = [-1] * n
    for rank, c in enumerate(sorted(chosen, key=lambda c: (-len(members[c]), min(members[c])))):
        for k in members[c]:
            out[k] = rank
    return out


def density_clusters(x: np.ndarray, least: int) -> list[int]:
    """Clusters of a few points."""
    return condensed(len(x), dense_tree(x, least), least) if len(x) >= 2 * least else [-1] * len(x)


def packed(values, kind) -> bytes:
    return np.asarray(values, kind).tobytes()


def block_of(row: dict) -> tuple:
    """(ids, vectors, squared core distances, components) of a stored block, in the order of ids."""
    ids = np.frombuffer(row["ids"], np.int64)
    of = lambda name, kind: np.frombuffer(row[name], kind) if row.get(name) is not None else None
    return ids, np.frombuffer(row["x"], np.float64).reshape(len(ids), -1), of("core", np.float64), of("comp", np.int64)


def met(blocks: DataFrame, kind: pa.Schema, start, step, finish) -> DataFrame:
    """Each block of a source (g) against all blocks of it: state = start(block), state = step(state, block, other), columns of finish(source, block, state).

    Blocks are dealt to tasks in groups of HELD; a task keeps its group and lets all blocks of the source pass. The vectors of a source are sent once for each group, so what is sent grows with the square of its points, as the work does; a task's memory doesn't.
    """
    columns = blocks.columns
    groups = F.greatest(F.lit(1), F.ceil(F.col("of") / HELD)).cast("int")
    own = blocks.withColumn("group", F.pmod(F.col("b"), groups)).withColumn("passes", F.lit(0))
    others = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), groups - 1))).withColumn("passes", F.lit(1))
    dealt = own.unionByName(others).repartition("g", "group").sortWithinPartitions("g", "group", "passes", "b")

    def run(batches):
        now, held = None, []
        out: list = []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["g"], row["group"]) != now:
                    out += [finish(now[0], b, state) for b, state in held]
                    now, held = (row["g"], row["group"]), []
                block = block_of(row)
                if row["passes"] == 0:
                    held.append((block, start(block)))
                else:
                    held = [(b, step(state, b, block)) for b, state in held]
            yield from sent(out)
            out = []
        if held:
            yield from sent([finish(now[0], b, state) for b, state in held])

    def sent(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    ddl = ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'long'}" for f in kind)
    return dealt.select(*columns, "group", "passes").mapInArrow(run, ddl)


def core_distances(blocks: DataFrame, least: int) -> DataFrame:
    """(g, id, core): the squared distance of each point to its least-th neighbour, or its farthest one if it has fewer."""

    def step(state, own, other):
        d = np.concatenate([state, squared(own[1], other[1])], axis=1)
        return np.partition(d, least, axis=1)[:, : least + 1] if d.shape[1] > least + 1 else d

    finish = lambda g, b, state: (np.full(len(b[0]), g), b[0], state.max(1))
    return met(blocks, pa.schema([("g", pa.int64()), ("id", pa.int64()), ("core", pa.float64())]), lambda b: np.zeros((len(b[0]), 0)), step, finish)


def nearest_outside(blocks: DataFrame) -> DataFrame:
    """(g, comp, w, lo, hi): for each point the first edge to a point of another component."""

    def step(state, own, other):
        ids, x, core, comp = own
        w, to = state
        if len(set(comp.tolist()) | set(other[3].tolist())) == 1:
            return state
        r = squared(x, other[1])
        np.maximum(r, core[:, None], out=r)
        np.maximum(r, other[2], out=r)
        r[comp[:, None] == other[3]] = np.inf
        k = r.argmin(1)  # ids are in order, so the first of equal ones has the least id
        new, by = r[np.arange(len(ids)), k], other[0][k]
        better = (new < w) | (new == w) & (by < to)
        return np.where(better, new, w), np.where(better, by, to)

    def finish(g, b, state):
        w, to = state
        some = np.isfinite(w)
        return np.full(some.sum(), g), b[3][some], w[some], np.minimum(b[0], to)[some], np.maximum(b[0], to)[some]

    never = np.iinfo(np.int64).max
    kind = pa.schema([("g", pa.int64()), ("comp", pa.int64()), ("w", pa.float64()), ("lo", pa.int64()), ("hi", pa.int64())])
    return met(blocks, kind, lambda b: (np.full(len(b[0]), np.inf), np.full(len(b[0]), never)), step, finish)


def joined(frame: pd.DataFrame) -> pd.DataFrame:
    """The components of one source after its chosen edges (comp, other, w, lo, hi): (g, comp, new, w, lo, hi), w null where no edge was added for comp."""
    root = {int(c): int(c) for c in pd.unique(frame[["comp", "other"]].to_numpy().ravel())}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    added = {}
    for w, lo, hi, a, b in sorted(zip(frame["w"], frame["lo"], frame["hi"], frame["comp"], frame["other"], strict=True)):
        x, y = find(int(a)), find(int(b))
        if x != y:
            root[max(x, y)] = min(x, y)
            added[int(a)] = (w, lo, hi)
    rows = [(frame["g"].iloc[0], c, find(c), *added.get(c, (None, None, None))) for c in root]
    out = pd.DataFrame(rows, columns=["g", "comp", "new", "w", "lo", "hi"])
    return out.astype({"w": "Float64", "lo": "Int64", "hi": "Int64"})


def spanning_edges(rows: DataFrame, least: int, rounds: int = 40) -> DataFrame:
    """(g, w, lo, hi) of the spanning tree of each source g of rows (g, id, v): w is the length, ids are whole numbers and v unit vectors.

    Boruvka's rounds: every component takes its first edge to another one, and all are joined; there are at most half as many then. Vectors stay in stored blocks of BLOCK points, components and edges in
    tables between rounds. No task holds more of a source's vectors than HELD blocks and the one that passes; the numbers of a source's components (in the first round, points) are joined in one.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("of"))
    placed = rows.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        return pd.DataFrame([(frame["g"].iloc[0], frame["b"].iloc[0], frame["of"].iloc[0], packed(frame["id"], np.int64), packed(np.stack(frame["v"].to_numpy()), np.float64))], columns=["g", "b", "of", "ids", "x"])

    blocks = stored(placed.select("g", "id", "v", "of", "b").groupBy("g", "b").applyInPandas(pack, "g long, b int, of int, ids binary, x binary"), "blocks")
    cores = stored(core_distances(blocks, least), "cores")
    points = stored(placed.select("g", "id", "b").join(cores, ["g", "id"]).withColumn("comp", F.col("id")), "points")

    def columns(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        return pd.DataFrame([(frame["g"].iloc[0], frame["b"].iloc[0], packed(frame["core"], np.float64), packed(frame["comp"], np.int64))], columns=["g", "b", "core", "comp"])

    tree = []
    for _ in range(rounds):
        now = points.groupBy("g", "b").applyInPandas(columns, "g long, b int, core binary, comp binary")
        first = nearest_outside(blocks.join(now, ["g", "b"])).groupBy("g", "comp").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("g", "comp", "e.*")
        first = stored(first, "first-edges")
        if first.isEmpty():
            return reduce_union(spark, tree)
        # the component at the other end
        ends = points.select("g", "id", F.col("comp").alias("at"))
        both = first.join(ends.withColumnRenamed("id", "lo"), ["g", "lo"]).withColumnRenamed("at", "x").join(ends.withColumnRenamed("id", "hi"), ["g", "hi"]).withColumnRenamed("at", "y")
        both = both.select("g", "comp", F.when(F.col("x") == F.col("comp"), F.col("y")).otherwise(F.col("x")).alias("other"), "w", "lo", "hi")
        known = stored(both.groupBy("g").applyInPandas(joined, "g long, comp long, new long, w double, lo long, hi long"), "joined")
        tree.append(known.filter("w is not null").select("g", F.sqrt("w").alias("w"), "lo", "hi"))
        points = stored(points.join(known.select("g", "comp", "new"), ["g", "comp"], "left").withColumn("comp", F.coalesce("new", "comp")).select("g", "id", "b", "core", "comp"), "points")
    raise RuntimeError(f"components are left after {rounds} rounds")


def reduce_union(spark, tables: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], "g long, w double, lo long, hi long")
    for t in tables:
        out = out.unionByName(t)
    return out


def large_clusters(rows: DataFrame, least: int) -> DataFrame:
    """(g, id, cluster) of each point of rows (g, id, v), -1 for noise: exact, by rounds over blocks. A source's tree, three numbers a point, is condensed in one task."""
    edges = spanning_edges(rows, least)

    def tree(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pd.unique(frame[["lo", "hi"]].to_numpy().ravel()))
        a, b = np.searchsorted(ids, frame["lo"]), np.searchsorted(ids, frame["hi"])
        labels = condensed(len(ids), list(zip(frame["w"].tolist(), a.tolist(), b.tolist(), strict=True)), least)
        return pd.DataFrame({"g": frame["g"].iloc[0], "id": ids, "cluster": labels})

    return edges.groupBy("g").applyInPandas(tree, "g long, id long, cluster long")
