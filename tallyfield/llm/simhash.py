"""Operator 1: near-duplicates by deletion-variant signatures.

Two forms share the index. A signature is cut into few segments, so that of two close signatures one segment differs in at most
one place; each segment is indexed under its variants with one place wildcarded, equal variants are joined, and the
pairs are verified.

simhash_components works on 64-bit SimHash fingerprints: 2 differing bits need 2 segments of 32 bits, hence 64 variants,
and every pair within the distance is found. Equal fingerprints are grouped before. Variants are hash-partitioned and streamed in
order; a bucket of up to BUCKET fingerprints is verified in place and gives a spanning forest, not pairs. The fingerprints of a
larger bucket go to a second index, by all pairs of wildcard bits, whose buckets hold 4 fingerprints at most: exact, without pairs.

near_duplicates works on the Jaccard similarity of word shingles. SimHash bits cannot reach 0.8 there (about 10 of 64 bits differ),
so its signature has min-wise hashes for places: SEGMENTS of PLACES, one place wildcarded. At similarity 0.8 a pair is missed with a
chance of (1 - 0.8**5 - 5*0.2*0.8**4)**6 = 0.0003. Candidates are verified on the texts' whole shingle sets. In each bucket every
member is a candidate with a leader, and with every member in buckets up to SMALL; leaders differ by segment. Members of larger
buckets that are not of their leader's component then are joined exactly, by common shingles in their prefixes, rare ones first.

Texts: ASCII letters lower-cased, words between ASCII white space, fewer words than a shingle make one shingle; null and empty
texts have no words, fingerprint 0, and are copies of one another. Null ids never name a component while another id is there;
repeated rows are copies. Extra columns pass through near_duplicates' users and stay out of the results here.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, stored, tasks, text_bytes

BUCKET = 8192
#: Members of a common shingle that are compared at once, and bits of a set for it.
BLOCK, BITS = 256, 512
SEGMENTS, PLACES, SMALL = 6, 5, 8
#: Shingles hashed at once.
PIECE = 1 << 16
xx = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(data: bytes, width: int) -> int:
    """SimHash: a bit is set if it is in over half of the shingles' XXH64 values, repeats included."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xx(b" ".join(words))
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for k in range(0, n, PIECE):
        part = words[k : k + PIECE + width - 1]
        h = np.fromiter(map(xx, map(b" ".join, zip(*[part[i:] for i in range(width)], strict=False))), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, fp): the fingerprint of each row's text as a signed long."""
    small_batches(df.sparkSession)

    def compute(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["id", "fp"])

    return df.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("data")).mapInArrow(compute, f"id {df.schema[id_col].dataType.simpleString()}, fp long")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each is visited once and compared with those not yet reached."""
    left, edges = fps.copy(), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                edges += [(at, x) for x in left[near]]
                queue += list(left[near])
                left = left[~near]
    return edges


def bucket_links(distance: int, bucket: int):
    """Arrow batches of (key, fp), ordered by both, to links (a, b) within each key; (fp, fp) for members of larger buckets."""

    def links(keys, fps):
        """Of whole buckets."""
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        size = np.diff(at)
        out = []
        small = np.repeat((size > 1) & (size <= 32), size)
        k, f = keys[small], fps[small]
        for d in range(1, 32):
            i = np.flatnonzero(k[:-d] == k[d:])
            if not len(i):
                break
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= distance]
            out.append(np.stack([f[i], f[i + d]], 1))
        for a, b in zip(at[:-1][size > 32], at[1:][size > 32], strict=True):
            out.append(np.array(forest(fps[a:b], distance), np.uint64).reshape(-1, 2))
        return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)

    def batch(pairs):
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].astype(np.uint64).view(np.int64), pa.int64()) for k in (0, 1)], names=["a", "b"])

    def over(batches):
        held_k, held_f, over_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for b in batches:
            k = np.concatenate([held_k, b.column(0).to_numpy()])
            f = np.concatenate([held_f, b.column(1).to_numpy().view(np.uint64)])
            if over_key is not None:  # more of a bucket that was given up
                n = np.searchsorted(k != over_key, True) if (k != over_key).any() else len(k)
                yield batch(np.stack([f[:n], f[:n]], 1))
                k, f = k[n:], f[n:]
            if not len(k):
                held_k, held_f = k, f
                continue
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))[-1]
            if cut:
                yield batch(links(k[:cut], f[:cut]))
            held_k, held_f, over_key = k[cut:], f[cut:], None
            if len(held_k) > bucket:
                yield batch(np.stack([held_f, held_f], 1))
                over_key = held_k[0]
                held_k, held_f = held_k[:0], held_f[:0]
        if len(held_k):
            yield batch(links(held_k, held_f))

    return over


def close_pairs(distinct: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), enough for the components, between distinct fingerprints, column fp, within a distance of 2 to 7 bits."""
    if not 2 <= distance <= 7:
        raise ValueError("distance must be from 2 to 7")
    segments = distance // 2 + 1
    width = 64 // segments
    place = F.explode(F.sequence(F.lit(0), F.lit(64 - 1))).alias("place")
    segment = F.least((F.col("place") / width).cast("int"), F.lit(segments - 1))
    # the last segment takes the bits that are left over
    mask = F.when(segment == segments - 1, F.lit((1 << (64 - width * (segments - 1))) - 1)).otherwise(F.lit((1 << width) - 1))
    part = F.call_function("shiftrightunsigned", F.col("fp"), segment * width).bitwiseAND(mask.cast("long"))
    value = part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") - segment * width)))
    key = F.call_function("shiftleft", F.col("place").cast("long"), F.lit(64 - width * (segments - 1))).bitwiseOR(value)
    variants = distinct.select("fp", place).select(key.alias("key"), "fp")
    streamed = variants.repartition(tasks(distinct), "key").sortWithinPartitions("key", "fp")
    found = stored(streamed.mapInArrow(bucket_links(distance, bucket), "a long, b long").distinct(), "links")
    links, hot = found.filter("a <> b"), found.filter("a = b").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return links
    return links.unionAll(pair_wildcards(hot, distance))


def pair_wildcards(hot: DataFrame, distance: int) -> DataFrame:
    """Links by `distance` wildcard bits at once: equal variants are within the distance, and 2**distance fingerprints share one at most."""
    masks = F.lit(0).cast("long")
    rows = hot.withColumn("mask", masks).withColumn("last", F.lit(-1))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
    for k in range(distance):
        rows = rows.withColumn("bit", F.explode(F.sequence(F.col("last") + 1, F.lit(64 - distance + k)))).select("fp", F.col("mask").bitwiseOR(bit(F.col("bit"))).alias("mask"), F.col("bit").alias("last"))
    shared = rows.groupBy("mask", F.col("fp").bitwiseAND(F.bitwise_not(F.col("mask"))).alias("rest")).agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return shared.select("a", F.explode("all").alias("b")).filter("a <> b").distinct()


def simhash_components(df: DataFrame, width: int, distance: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the least id reachable by links of fingerprints at most `distance` bits apart."""
    rows = stored(fingerprints(df, id_col, text_col, width), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"))
    joined = components(close_pairs(distinct.select("fp"), distance))
    roots = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# --- similarity of shingle sets ---------------------------------------------------------------------------------------

RNG = np.random.default_rng(20240607)
ODD = RNG.integers(1, 1 << 63, SEGMENTS * PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = RNG.integers(1, 1 << 63, SEGMENTS * PLACES, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(data: bytes, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, in order."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xx, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([xx(h.tobytes())], np.uint64)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(total)])
    return np.unique(total)


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xx(s.tobytes())).view(np.int64))


def variant_keys(s: np.ndarray) -> list[int]:
    """One key for each segment of the min-wise signature and each wildcarded place in it; none for an empty set."""
    if not len(s):
        return []
    least = np.full(SEGMENTS * PLACES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        least = np.minimum(least, mixed(s[k : k + 4096, None] * ODD + ADD).min(axis=0))
    out = []
    for seg in range(SEGMENTS):
        own = least[seg * PLACES : (seg + 1) * PLACES]
        for j in range(PLACES):
            out.append(xxhash.xxh64_intdigest(np.delete(own, j).tobytes(), seed=seg * PLACES + j))
    return np.array(out, np.uint64).view(np.int64).tolist()


def signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, digest, node, keys): digest tells texts of one id apart, node is the hash of the shingle set, keys the variants of its signature."""
    small_batches(df.sparkSession)

    def compute(batches):
        for b in batches:
            sets = [shingles(t, width) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([variant_keys(s) for s in sets], pa.list_(pa.int64()))], names=["id", "digest", "node", "keys"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), digest(text_col).alias("digest"), text_bytes(text_col).alias("data"))
    return rows.mapInArrow(compute, f"id {df.schema[id_col].dataType.simpleString()}, digest binary, node long, keys array<long>")


def digest(text_col: str):
    return F.unhex(F.md5(text_bytes(text_col)))


def bucket_candidates(batches):
    """Arrow batches of (key, place, turn, node), ordered by key and turn, to candidates (a, b): each member with its bucket's first, and with all before it in small buckets.

    shared is 1 once for each bucket; hot marks the pairs with the first of a larger bucket, whose other pairs are left open.
    """
    key, first, place = None, [], 0
    for b in batches:
        out_a, out_b, shared, hot = [], [], [], []
        for k, node in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != key:
                key, first, place = k, [], 0
            if place == SMALL:  # only now it is known that the bucket is a larger one
                for other in first[1:]:
                    out_a.append(other)
                    out_b.append(first[0])
                    shared.append(0)
                    hot.append(True)
            for other in first[: 1 if place >= SMALL else SMALL]:
                out_a.append(node)
                out_b.append(other)
                shared.append(1)
                hot.append(place >= SMALL)
            if place < SMALL:
                first.append(node)
            place += 1
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(shared, pa.int64()), pa.array(hot, pa.bool_())], names=["a", "b", "shared", "hot"])


def open_nodes(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the members of larger buckets that are not yet of one component, and of few others: two nodes whose pair was left open are both here."""
    a, b = (roots.select(F.col("node").alias(c), F.col("component").alias(f"root_{c}")) for c in "ab")
    hot = pairs.filter("hot").join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b"))
    hot = stored(hot, "hot")
    apart = hot.filter("root_a <> root_b")
    hubs = apart.select(F.col("a").alias("hub")).unionAll(apart.select(F.col("b").alias("hub"))).distinct()
    both = hot.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("root_b").alias("root")).unionAll(hot.select(F.col("b").alias("hub"), F.col("a").alias("node"), F.col("root_a").alias("root")))
    ends = apart.select(F.col("a").alias("node"), F.col("root_a").alias("root")).unionAll(apart.select(F.col("b").alias("node"), F.col("root_b").alias("root")))
    return both.join(hubs, "hub", "left_semi").select("node", "root").unionAll(ends).distinct()


def parities(s: np.ndarray) -> np.ndarray:
    """BITS bits of a set, each the parity of its shingles there: as many differ between two sets at most as shingles are in one of them only."""
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1 == 1)


def prefix_candidates(similarity: float):
    """Arrow batches of (token, i, j, block, node, root, size, pos, bits), ordered by the first three, to candidates (a, b) of different roots.

    A common token at places pos of two ordered sets, the first one they share, leaves size - pos common ones at most; and half of
    what the bits don't tell apart of both sizes are.
    """

    def found(block, node, root, size, pos, bits, i, j):
        x, y = (np.flatnonzero(block == k) for k in (i, j))
        least = similarity / (1 + similarity) * (size[x][:, None] + size[y]) - 1e-6
        keep = (root[x][:, None] != root[y]) & (np.minimum((size - pos)[x][:, None], (size - pos)[y]) >= least)
        if i == j:
            keep = np.triu(keep, 1)
        p, q = np.nonzero(keep)
        differ = np.bitwise_count(bits[x[p]] ^ bits[y[q]]).sum(axis=1, dtype=np.int64)
        p, q = (z[size[x[p]] + size[y[q]] - differ >= 2 * least[p, q]] for z in (p, q))
        return node[x[p]], node[y[q]]

    def over(batches):
        held = held_bits = None
        for b in batches:
            now = np.stack([c.to_numpy() for c in b.columns[:-1]], 1).astype(np.int64)
            bits = np.frombuffer(b"".join(b.columns[-1].to_pylist()), np.uint64).reshape(len(now), -1)
            held, held_bits = (now, bits) if held is None else (np.concatenate([held, now]), np.concatenate([held_bits, bits]))
            if not len(held):
                held = None
                continue
            at = np.flatnonzero(np.concatenate([[True], (held[1:, :3] != held[:-1, :3]).any(axis=1)]))
            yield from groups(held[: at[-1]], held_bits, at)
            held, held_bits = held[at[-1] :], held_bits[at[-1] :]
        if held is not None and len(held):
            yield from groups(held, held_bits, np.array([0, len(held)]))

    def groups(rows, bits, at):
        for m, n in zip(at[:-1], at[1:], strict=True):
            a, b = found(*rows[m:n, 3:].T, bits[m:n], rows[m, 1], rows[m, 2])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return over


def prefix_pairs(nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Candidates (a, b, shared) among all nodes (node, root) of different roots, every similar pair being one.

    Sets are put in one order, rare shingles first; similar ones share a shingle in their prefixes. Common shingles are dealt out by pairs of blocks.
    """

    def compute(batches):
        for b in batches:
            sets = [shingles(data, width) for data in b.column(2).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends), pa.int64()), tokens, pa.array([parities(s).tobytes() for s in sets], pa.binary())], names=["node", "root", "size", "tokens", "bits"])

    sets = stored(nodes.join(texts, "node").select("node", "root", "data").mapInArrow(compute, "node long, root long, size long, tokens array<long>, bits binary"), "shingles")
    rows = sets.select("node", "root", "size", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("n"))
    ranked = rows.join(counts, "token").groupBy("node", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all"))
    prefix = (F.col("size") - F.ceil(F.col("size") * similarity - 1e-6) + 1).cast("int")
    tokens = ranked.select("node", "root", "size", F.posexplode(F.slice("all", F.lit(1), prefix)).alias("pos", "at")).filter("at.n > 1")
    tokens = tokens.select(F.col("at.token").alias("token"), "node", "root", "size", F.col("pos").cast("long").alias("pos"))
    tokens = stored(tokens.join(sets.select("node", "bits"), "node"), "prefixes")
    buckets = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = tokens.join(buckets.select("token", blocks.alias("blocks")), "token").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["token", "i", "j"]
    dealt = dealt.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "size", "pos", "bits")
    found = dealt.repartition(tasks(nodes), *keys).sortWithinPartitions(*keys).mapInArrow(prefix_candidates(similarity), "a long, b long")
    return found.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.count("*").alias("shared"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' shingle sets are similar enough."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("data").alias(f"data_{c}"))

    def check(batches):
        sets = lru_cache(64)(lambda data: shingles(data, width))
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = sets(x), sets(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "data_a", "data_b")
    return rows.mapInArrow(check, "a long, b long")


def joined_by(pairs: DataFrame, texts: DataFrame, width: int, similarity: float, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) of `known` and enough similar ones of `pairs` (a, b, shared) for the components, and these."""
    # first each node with the partner that it shares most keys with; then what the components so far leave open
    best = pairs.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    first = stored(verified(best, texts, width, similarity), "verified")
    first = first if known is None else first.unionAll(known)
    roots = components(first)
    a, b = (roots.select(F.col("node").alias(c), F.col("component").alias(f"root_{c}")) for c in "ab")
    rest = pairs.join(best, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left").filter("root_a is null or root_b is null or root_a <> root_b").select("a", "b")
    links = first.unionAll(stored(verified(rest, texts, width, similarity), "verified"))
    return links, components(links)


def duplicate_rows(df: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, first) of each row: first is the (id, digest) that stands for the component, that of the least id; null ids come last."""
    rows = stored(signatures(df, id_col, text_col, width), "signatures")
    least = lambda c: F.min(F.struct(F.col(c).isNull().alias("nameless"), F.col(c).alias("id"), "digest"))
    nodes = stored(rows.groupBy("node").agg(least("id").alias("least"), F.first("keys").alias("keys")), "nodes")
    keyed = nodes.select(F.posexplode("keys").alias("place", "key"), "node")
    turn = F.xxhash64("node", (F.col("place") / PLACES).cast("int"))
    ordered = keyed.select("key", turn.alias("turn"), "node").repartition(tasks(df), "key").sortWithinPartitions("key", "turn", "node")
    pairs = ordered.mapInArrow(bucket_candidates, "a long, b long, shared long, hot boolean")
    pairs = stored(pairs.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.sum("shared").alias("shared"), F.bool_or("hot").alias("hot")), "candidates")
    # the texts of nodes in any pair, fetched once by the least id of each and its digest: an id, or none, may stand for many texts
    used = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = used.join(nodes.select("node", "least"), "node").select(F.col("least.id").alias("wanted_id"), F.col("least.digest").alias("wanted_digest"), "node")
    own = df.select(F.col(f"`{id_col}`").alias("id"), digest(text_col).alias("digest"), text_bytes(text_col).alias("data"))
    fetched = own.join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("digest") == F.col("wanted_digest")))
    texts = stored(fetched.select("node", "data"), "texts")
    if not texts.groupBy("node").count().filter("count > 1").isEmpty():  # rows repeated in id and text
        texts = stored(texts.groupBy("node").agg(F.first("data").alias("data")), "texts")
    links, joined = joined_by(pairs, texts, width, similarity)
    # members of larger buckets that their leaders leave apart
    apart = stored(open_nodes(pairs, joined), "open")
    if not apart.isEmpty():
        more = stored(prefix_pairs(apart, texts, width, similarity).join(pairs, ["a", "b"], "left_anti"), "candidates")
        links, joined = joined_by(more, texts, width, similarity, links)
    named = nodes.select("node", "least").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", "first")
    return rows.select("id", "digest", "node").join(named, "node").select("id", "digest", "first")


def near_duplicates(df: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of each row: components of texts whose sets of word shingles have a Jaccard similarity of `similarity` or more."""
    found = duplicate_rows(df, width, similarity, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def first_of_each(df: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row, that of the least id, for each group of near-duplicates. Of several texts under that id one stays for the group, others only for groups of their own."""
    found = stored(duplicate_rows(df, width, similarity, id_col, text_col), "near-duplicates")
    firsts = found.filter(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.digest") == F.col("digest")))
    firsts = stored(firsts.groupBy(F.col("id").alias("__id"), F.col("digest").alias("__digest")).agg((F.count("*") > 1).alias("__repeated")), "firsts")
    kept = df.withColumn("__own", digest(text_col)).join(firsts.hint("shuffle_hash"), F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest")))
    out = [F.col(f"`{c}`") for c in df.columns]
    if firsts.filter("__repeated").isEmpty():
        return kept.select(*out)
    # only rows that are repeated in id and text are dealt again
    return kept.filter("not __repeated").select(*out).unionAll(kept.filter("__repeated").dropDuplicates(["__id", "__digest"]).select(*out))
