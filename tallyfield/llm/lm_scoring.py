"""Operator 8: text scores by a hashed maximum-entropy model, beside an add-one unigram base.

P(word | history) = P(class | history) * P(word | class, context), both of them softmaxes of feature weights.

Classes follow the distribution of words: the `HEAD` most frequent words fall into BINS classes of equal mass of square roots of counts;
all others, and unknown ones, are one class, and the end token is one. Words are told apart by 64-bit hashes.

The class factor has features of the last word's hashed row (n-gram), of the class of the word before it (skip), and of both. The word
factor has a bias for each word, its smoothed relative count in the class, and a feature for each pair of context and word; the context
is the last word (n-gram) or, if that is not among the frequent ones, the word before it (skip). As features of pairs not seen have no
weight, the normaliser of a context and class is 1 + sum of P0(word) * (exp(weight) - 1) over its pairs: a sparse sum.

The class factor is guarded: GUARD of it goes to the distribution of classes without a history, so one that was always followed alike can't cost a
token more than log(GUARD) against that.

Everything is learnt from counts over all training texts, so the model doesn't depend on how rows are dealt, but for the last digits.
Words are counted in tasks and then by hash. Events (pairs, histories with classes) are counted in tasks as sorted numpy arrays and
added up in shards by their hash, as many as the training tokens ask for. All pairs of a context with words of one class are in one
shard, HEAD at most; there their weights are fitted, with an L1 penalty of DISCOUNT. Pairs seen once are no features, all others are.
The class factor is trained by ROUNDS of gradients summed over tasks, then each history's own weights in its task.

Weights stay in their shards. Only those of the most frequent pairs, up to PAIRS, are also sent to the tasks that score, to save shuffling.
Scoring reads the texts once, in numpy batches. A pair of a text that isn't among those sent goes to its shard, and the sums come back to
the text: so all weights count, however many there are. Counts of words beyond HEAD are joined by hash, as (row, word) pairs. Neither the
vocabulary nor the weights nor a text move as a whole.

Null and empty texts have the end token only. Null ids are never held out. Repeated rows each give a row. Without any training text
every count is 0. Texts of any length are scored whole, in pieces; extra columns stay out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, stored, tasks, text_bytes

BINS, HEAD, PAIRS = 16, 1 << 18, 1 << 21
RARE, LAST, CLASSES = BINS, BINS + 1, BINS + 2
#: Rows of the last word's hash are a quarter of the distinct words, within these bounds.
LEAST_BITS, MOST_BITS = 6, 14
ROUNDS, UPDATES, DISCOUNT, RIDGE = 16, 8, 0.75, 2.0
#: The share of the class factor that goes to the distribution of classes without a history.
GUARD = 0.1
#: Tokens scored at once, tokens whose events a task counts before it passes them on, and training tokens for each task that adds events up.
STEP, HELD, SHARD = 1 << 17, 1 << 21, 1 << 22
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
FAN_IN = 4
#: Event keys: a context above the low bits; there a word, or CLASS plus a class.
LOW, CLASS = 20, 1 << 19
EMPTY = np.float32(-1e9)
SPACE = re.compile(rb"[\x20\x09-\x0D]")
xx = xxhash.xxh64_intdigest
END = np.uint64(xx(b"end of text"))  # no word has a space


def tokens(data: bytes):
    """Arrays of the hashes of a text's words, and of the end, piece by piece."""
    at = 0
    while at < len(data):
        cut = SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        to = cut.start() if cut else len(data)
        words = data[at:to].lower().split()
        yield np.fromiter(map(xx, words), np.uint64, len(words))
        at = to
    yield np.array([END])


def pieces(texts: list[bytes]):
    """(tokens, texts): arrays of about STEP tokens, two earlier ones before them, and the number of the text of each."""
    lead, held, own, n = np.array([END, END]), [], [], 0

    def joined():
        t = np.concatenate([lead, *held])
        return t, np.repeat([k for k, _ in own], [m for _, m in own])

    for k, data in enumerate(texts):
        for t in tokens(data):
            held.append(t)
            own.append((k, len(t)))
            n += len(t)
            if n >= STEP:
                out = joined()
                yield out
                lead, held, own, n = out[0][-2:], [], [], 0
    if n:
        yield joined()


class Vocabulary:
    """The frequent words, numbered by the order of their hashes; the number after the last stands for all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rare_mass: float, bits: int):
        order = np.argsort(hashes)
        self.known, c = hashes[order], counts[order].astype(np.float64)
        self.bits, self.rare = bits, len(hashes)
        self.end = int(np.searchsorted(self.known, END))
        down = np.lexsort((self.known, -c))
        down = down[down != self.end]
        mass = np.cumsum(np.sqrt(c[down]))
        self.class_of = np.full(len(c) + 1, RARE, np.uint8)
        self.class_of[down] = np.minimum(BINS * (mass - np.sqrt(c[down])) / max(mass[-1] if len(mass) else 1.0, 1.0), BINS - 1)
        self.class_of[self.end] = LAST
        self.mass = np.bincount(self.class_of[:-1], c + 1, CLASSES)
        self.mass[RARE] = rare_mass + 1
        self.log_p0 = np.append(np.log(c + 1), 0.0) - np.log(np.maximum(self.mass, 1))[self.class_of]  # of a rare word without its own count
        self.log_c = np.append(np.log10(c + 1), 0.0)
        self.seen = np.append(c > 0, False)

    def features(self, t: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the tokens after the first two: number, class, context (the largest one is none), and row of the history."""
        ids = np.minimum(np.searchsorted(self.known, t), self.rare - 1)
        ids = np.where(self.known[ids] == t, ids, self.rare)
        last, skip = ids[1:-1], ids[:-2]
        skip = np.where(last == self.end, self.end, skip)  # a text begins after the end of another
        context = np.where(last != self.rare, last, self.rare + 1 + skip)
        row = (t[1:-1] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        return ids[2:], self.class_of[ids[2:]].astype(np.int64), context, row * CLASSES + self.class_of[skip]

    def has_pairs(self, ids: np.ndarray, of: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Whether a pair of context and word can have a weight."""
        return (of < RARE) & (context < 2 * self.rare + 1)

    def groups(self, pairs: np.ndarray) -> np.ndarray:
        """The keys of contexts with the classes of the words, from keys of pairs."""
        return pairs >> LOW << LOW | CLASS + self.class_of[pairs & ((1 << LOW) - 1)].astype(np.int64)


#: Steps of cut_off for each power of two, as a power of two.
STEPS = 7


def cut_off(df: DataFrame, count: str, rows: Column, most: int) -> int:
    """A value of the column count such that no more than `most` rows have it or more; a histogram of 128 steps for each power of two decides."""
    low = F.greatest(F.lit(0), F.length(F.bin(count)) - (STEPS + 1))
    step = F.call_function("shiftleft", F.call_function("shiftright", F.col(count), low), low)
    bins = df.groupBy(step.alias("from")).agg(F.sum(rows).alias("rows")).collect()
    least, total = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["from"]):
        total += r["rows"]
        if total > most:
            break
        least = r["from"]
    return least


def count_words(batches):
    """Arrow batches of (data) to (hash, n), counted over some tokens at once."""
    held, n = [], 0

    def counted():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(h[k : k + (1 << 16)].view(np.int64)), pa.array(c[k : k + (1 << 16)])], names=["hash", "n"])

    for b in batches:
        for data in b.column(0).to_pylist():
            for t in tokens(data):
                held.append(t)
                n += len(t)
            if n >= HELD:
                yield from counted()
                held, n = [], 0
    if held:
        yield from counted()


def lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32()), pa.array(np.concatenate(parts), kind))


PAIR, TOTAL, HISTORY = 0, 1, 2
EVENTS = "kind int, shard int, keys array<long>, times array<int>"
#: Of pairs the weights, of contexts with classes minus their log normalisers, of histories with classes nothing.
LEARNT = "kind int, shard int, n long, keys array<long>, values array<double>"


def by_shard(keys: np.ndarray, shards: int):
    """(shard, the places of its keys) of each shard that has some."""
    shard = ((keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return zip(shard[order][at].tolist(), np.split(order, at[1:]), strict=True) if len(keys) else ()


def count_events(vocabulary, shards: int):
    """Arrow batches of (data) to EVENTS, one row for each kind and shard, keys in order. A pair is in the shard of its context and class."""

    def counted(held):
        kinds, of_shard, keys, times = [], [], [], []
        for kind, own in zip((PAIR, HISTORY), zip(*held, strict=True), strict=True):
            k, c = np.unique(np.concatenate(own), return_counts=True)
            for s, at in by_shard(vocabulary.value.groups(k) if kind == PAIR else k, shards):
                kinds.append(kind)
                of_shard.append(s)
                keys.append(k[at])
                times.append(c[at])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(of_shard, pa.int32()), lists(keys, pa.int64()), lists(times, pa.int32())], names=["kind", "shard", "keys", "times"])

    def over(batches):
        v, held, n = vocabulary.value, [], 0
        for b in batches:
            for t, _ in pieces(b.column(0).to_pylist()):
                ids, of, context, history = v.features(t)
                known = v.has_pairs(ids, of, context)
                held.append(((context << LOW | ids)[known], history * CLASSES + of))
                n += len(ids)
                if n >= HELD:
                    yield from counted(held)
                    held, n = [], 0
        if held:
            yield from counted(held)

    return over


def learnt_rows(kind: int, shard: int, n: np.ndarray, keys: np.ndarray, values: np.ndarray | None = None):
    """Arrow batches of LEARNT: the keys of a shard by n."""
    order = np.argsort(n, kind="stable")
    at = np.flatnonzero(np.diff(n[order], prepend=0))
    cuts = np.append(at, len(order))
    for m in range(0, len(at), 1024):
        first = at[m : m + 1024]
        own, ends = order[first[0] : cuts[min(m + 1024, len(at))]], cuts[m : m + 1025] - first[0]
        offsets = pa.array(ends, pa.int32())
        held = pa.ListArray.from_arrays(offsets, pa.array(values[own], pa.float64())) if values is not None else pa.nulls(len(first), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(first), pa.int32()), pa.array([shard] * len(first), pa.int32()), pa.array(n[order[first]], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(keys[own], pa.int64())), held], names=["kind", "shard", "n", "keys", "values"])


def learn_events(vocabulary):
    """Arrow batches of EVENTS, whole shards in a task, to LEARNT: n is how often keys stand in all, for a context with a class the most of its pairs."""

    def over(batches):
        held: dict[tuple[int, int], list] = {}
        size: dict[tuple[int, int], int] = {}
        merged: dict[tuple[int, int], int] = {}

        def added(at):
            k, c = (np.concatenate(x) for x in zip(*held[at], strict=True))
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            own = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            held[at] = [(k[own], np.add.reduceat(c, own))]
            size[at] = merged[at] = len(own)

        for b in batches:
            for kind, shard, k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                at = kind, shard
                held.setdefault(at, []).append((k.values.to_numpy(), c.values.to_numpy().astype(np.int64)))
                size[at] = size.get(at, 0) + len(k)
                if size[at] > 2 * merged.get(at, 0) + HELD // 8:
                    added(at)
        for kind, shard in list(held):
            added((kind, shard))
            k, c = held.pop((kind, shard))[0]
            if kind == HISTORY:
                yield from learnt_rows(kind, shard, c, k)
                continue
            pairs, n, weights, groups, most, norms = fit_pairs(vocabulary.value, k, c)
            yield from learnt_rows(PAIR, shard, n, pairs, weights)
            yield from learnt_rows(TOTAL, shard, most, groups, norms)

    return over


def fit_pairs(v: Vocabulary, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs and how often they stand, all of the words of a class in a context: pairs with a weight, n, weights; contexts with classes, their greatest n, minus log normalisers.

    Maximises the likelihood of each context's words less DISCOUNT times the sum of weights, none below 0: at the optimum the expected
    count of a pair with a weight is its count less DISCOUNT. Each update solves that for the pairs that have one, then lets those below 0 go.
    Pairs that stand once have none. n is rounded down to the steps of cut_off.
    """
    groups, g = np.unique(v.groups(pair), return_inverse=True)
    size = len(groups)
    total, often = np.bincount(g, n, size), n > 1
    pair, n, g = pair[often], n[often], g[often]
    p0, target = np.exp(v.log_p0[pair & ((1 << LOW) - 1)]), (n - DISCOUNT) / total[g]
    weight = np.full(len(pair), np.inf)
    for _ in range(UPDATES):
        on = weight > 0
        z = np.maximum(1 - np.bincount(g[on], p0[on], size), 1e-6) / (1 - np.bincount(g[on], target[on], size))
        weight = np.where(on, np.maximum(np.log(target * z[g] / p0), 0), 0)
    z = 1 + np.bincount(g, p0 * np.expm1(weight), size)
    keep, most = weight > 0, np.zeros(size, np.int64)
    low = np.maximum(np.frexp(n.astype(np.float64))[1] - (STEPS + 1), 0)
    n = n >> low << low
    np.maximum.at(most, g[keep], n[keep])
    used = most > 0
    return pair[keep], n[keep], weight[keep], groups[used], most[used], -np.log(z[used])


def softmax_logs(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class ClassWeights:
    """Of the class factor, without those of single histories."""

    def __init__(self, v: Vocabulary, counts: np.ndarray):
        words = np.bincount(v.class_of, minlength=CLASSES)  # the rare class holds the unknown word at least
        self.bias = np.where(words > 0, np.log(counts + 1.0) - np.log(counts.sum() + CLASSES), EMPTY)
        self.rows, self.skips = np.zeros((1 << v.bits, CLASSES)), np.zeros((CLASSES, CLASSES))

    def logits(self, history: np.ndarray) -> np.ndarray:
        return self.bias + self.rows[history // CLASSES] + self.skips[history % CLASSES]

    def sums(self, history: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Counts of each feature and class, from a row of counts by class for each history."""
        out = np.zeros((len(self.rows) + CLASSES, CLASSES))
        np.add.at(out, history // CLASSES, n)
        np.add.at(out, len(self.rows) + history % CLASSES, n)
        return out

    def expected(self, history: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.sums(history, np.exp(softmax_logs(self.logits(history))) * n.sum(axis=1, keepdims=True))

    def step(self, seen: np.ndarray, expected: np.ndarray) -> None:
        """A gradient step, scaled by how often features stand: each history has two."""
        move = (seen - expected) / (2 * np.maximum(seen, expected) + RIDGE)
        self.rows += move[: len(self.rows)]
        self.skips += move[len(self.rows) :]


def by_history(batches):
    """(histories, their counts by class) of Arrow batches of (key, n)."""
    got = [np.stack([c.to_numpy() for c in b.columns], 1) for b in batches]
    key, n = np.concatenate([np.zeros((0, 2), np.int64), *got]).T
    history, at = np.unique(key // CLASSES, return_inverse=True)
    return history, np.bincount(at * CLASSES + key % CLASSES, n, len(history) * CLASSES).reshape(-1, CLASSES)


def added(batches):
    """One row with the sum of a partition's rows of float64 arrays."""
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            x = np.frombuffer(x, np.float64)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])


def train_classes(events: DataFrame, v: Vocabulary) -> np.ndarray:
    """Log probability of each class in each history, from the counts (key, n) of histories with classes."""
    spark = events.sparkSession
    counts = np.zeros(CLASSES)
    for r in events.groupBy(F.pmod("key", F.lit(CLASSES)).alias("k")).agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    model = ClassWeights(v, counts)
    seen = None
    for k in range(ROUNDS + 1):  # first what is observed
        sent = spark.sparkContext.broadcast(model)

        def gradient(batches, sent=sent, k=k):
            history, n = by_history(batches)
            if len(history):
                yield pa.RecordBatch.from_arrays([pa.array([(sent.value.expected if k else sent.value.sums)(history, n).tobytes()])], names=["sums"])

        sums, parts = events.select("key", "n").mapInArrow(gradient, "sums binary"), events.rdd.getNumPartitions()
        while parts > FAN_IN:
            parts = -(-parts // FAN_IN)
            sums = sums.repartition(parts).mapInArrow(added, "sums binary")
        total = list(added(sums.toArrow().to_batches()))
        sent.destroy()
        if not total:
            break
        total = np.frombuffer(total[0].column(0)[0].as_py(), np.float64).reshape(-1, CLASSES)
        if k:
            model.step(seen, total)
        else:
            seen = total
    sent = spark.sparkContext.broadcast(model)

    def own(batches):
        """The weights of single histories, with the others as they are."""
        history, n = by_history(batches)
        for k in range(0, len(history), 1 << 14):
            part, seen = history[k : k + (1 << 14)], n[k : k + (1 << 14)]
            base, w, total = sent.value.logits(part), np.zeros((len(part), CLASSES)), seen.sum(axis=1, keepdims=True)
            for _ in range(ROUNDS):
                expected = np.exp(softmax_logs(base + w)) * total
                w += (seen - expected - RIDGE * w) / (np.maximum(seen, expected) + RIDGE)
            logs = softmax_logs(base + w).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([x.tobytes() for x in logs])], names=["history", "logs"])

    whole = events.repartition(tasks(events), F.expr(f"key div {CLASSES}")).select("key", "n")
    got = whole.mapInArrow(own, "history long, logs binary").toArrow()
    every = np.arange(len(model.rows) * CLASSES)
    plain = np.log(GUARD) + softmax_logs(model.bias[None])
    table = np.concatenate([softmax_logs(model.logits(every[k : k + (1 << 16)])).astype(np.float32) for k in range(0, len(every), 1 << 16)])
    if got.num_rows:
        table[got.column("history").to_numpy()] = np.frombuffer(b"".join(got.column("logs").to_pylist()), np.float32).reshape(-1, CLASSES)
    for k in range(0, len(table), 1 << 16):
        table[k : k + (1 << 16)] = np.logaddexp(np.log1p(-GUARD) + table[k : k + (1 << 16)], plain)
    return table


class Table:
    """Values by event key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], 1 << 62), np.append(values[order], 0.0)

    def value(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of event keys, 0 for those without one, and whether there is one; looked up in order, which the cache likes."""
        order = np.argsort(q)
        q = q[order]
        at = np.searchsorted(self.keys, q)
        out, found = np.empty(len(q)), np.empty(len(q), bool)
        found[order] = has = self.keys[at] == q
        out[order] = np.where(has, self.values[at], 0.0)
        return out, found


class Model(Table):
    """What each scoring task holds: a bounded size, whatever the corpus. If it isn't whole, the weights of other pairs are in shards."""

    def __init__(self, v: Vocabulary, classes: np.ndarray, keys: np.ndarray, values: np.ndarray, whole: bool):
        super().__init__(keys, values)
        self.v, self.classes, self.whole = v, classes, whole

    def logs(self, t: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the tokens after the first two: number, and log probability, for rare words without the log of their count plus 1; then which tokens lack what the shards know of their pairs, and these."""
        ids, of, context, history = self.v.features(t)
        out = self.classes[history, of] + self.v.log_p0[ids]
        known = np.flatnonzero(self.v.has_pairs(ids, of, context))
        pairs = context[known] << LOW | ids[known]
        values, found = self.value(pairs)
        here = found | self.whole
        out[known] += values
        out[known[here]] += self.value(self.v.groups(pairs[here]))[0]
        return ids, out, known[~here], pairs[~here]


def score_texts(sent):
    """Arrow batches of (rid, id, held_out, data) to sums of each text over its frequent words, its other words, and the pairs that shards know."""

    def over(batches):
        m = sent.value
        v = m.v
        for b in batches:
            texts = b.column(3).to_pylist()
            if not texts:
                continue
            sums, rare_of, rare = np.zeros((4, len(texts))), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            far_of, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t, own in pieces(texts):
                ids, logs, at, pairs = m.logs(t)
                far_of.append(own[at])
                far.append(pairs)
                for k, x in enumerate((np.ones(len(own)), v.seen[ids], v.log_c[ids], logs)):
                    sums[k] += np.bincount(own, x, len(texts))
                rare_of.append(own[ids == v.rare])
                rare.append(t[2:][ids == v.rare])
            rare_of, rare = np.concatenate(rare_of), np.concatenate(rare)
            order = np.lexsort((rare, rare_of))
            rare_of, rare = rare_of[order], rare[order]
            at = np.flatnonzero(np.concatenate([[len(rare) > 0], (rare[1:] != rare[:-1]) | (rare_of[1:] != rare_of[:-1])])) if len(rare) else np.zeros(0, np.int64)
            times, cuts = np.diff(np.append(at, len(rare))), pa.array(np.searchsorted(rare_of[at], np.arange(len(texts) + 1)), pa.int32())
            far_cuts = pa.array(np.searchsorted(np.concatenate(far_of), np.arange(len(texts) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3] / np.log(10)),
                 pa.ListArray.from_arrays(cuts, pa.array(rare[at].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
                 pa.ListArray.from_arrays(far_cuts, pa.array(np.concatenate(far)))],
                names=["rid", "id", "held_out", "n_tokens", "n_head", "head_log", "model_log", "words", "times", "pairs"],
            )

    return over


ASKED = "shard int, block long, places array<int>, keys array<long>, values array<double>"
ANSWERS = "block long, places array<int>, logs array<double>"
#: Texts of a block have numbers that differ in the last so many bits only.
BLOCK = 16


def ask_shards(vocabulary, shards: int):
    """Arrow batches of (rid, pairs) to ASKED, without values: a row for each shard and block of texts."""

    def asked(rids, pairs):
        rid, pair = np.concatenate(rids), np.concatenate(pairs)
        of_shard, blocks, places, keys = [], [], [], []
        for s, at in by_shard(vocabulary.value.groups(pair), shards):
            for own in np.split(at, np.flatnonzero(np.diff(rid[at] >> BLOCK)) + 1):
                of_shard.append(s)
                blocks.append(rid[own[0]] >> BLOCK)
                places.append(rid[own] & ((1 << BLOCK) - 1))
                keys.append(pair[own])
        empty = pa.nulls(len(keys), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(of_shard, pa.int32()), pa.array(blocks, pa.int64()), lists(places, pa.int32()), lists(keys, pa.int64()), empty], names=["shard", "block", "places", "keys", "values"])

    def over(batches):
        rids, pairs, n = [], [], 0
        for b in batches:
            own = b.column(1)
            rids.append(np.repeat(b.column(0).to_numpy(), own.value_lengths().to_numpy()))
            pairs.append(own.flatten().to_numpy())
            n += len(pairs[-1])
            if n >= HELD:
                yield from asked(rids, pairs)
                rids, pairs, n = [], [], 0
        if n:
            yield from asked(rids, pairs)

    return over


def answer(vocabulary):
    """Arrow batches of ASKED, whole shards in a task, to ANSWERS: by block and text the sums of natural logs of all that the task's shards know of the pairs asked for."""

    def over(batches):
        keys, values, pairs, rids = ([np.zeros(0, kind)] for kind in (np.int64, np.float64, np.int64, np.int64))
        for b in batches:
            for block, places, k, x in zip(b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4), strict=True):
                if block is None:
                    keys.append(k.values.to_numpy())
                    values.append(x.values.to_numpy())
                else:
                    pairs.append(k.values.to_numpy())
                    rids.append(block << BLOCK | places.values.to_numpy().astype(np.int64))
        pair = np.concatenate(pairs)
        if not len(pair):
            return
        learnt = Table(np.concatenate(keys), np.concatenate(values))
        rid, at = np.unique(np.concatenate(rids), return_inverse=True)
        logs = np.bincount(at, learnt.value(pair)[0] + learnt.value(vocabulary.value.groups(pair))[0])
        cuts = np.flatnonzero(np.diff(rid >> BLOCK)) + 1
        for own, sums in zip(np.split(rid, cuts), np.split(logs, cuts), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([own[0] >> BLOCK]), lists([own & ((1 << BLOCK) - 1)], pa.int32()), lists([sums], pa.float64())], names=["block", "places", "logs"])

    return over


def add_answers(batches):
    """Arrow batches of ANSWERS, whole blocks in a task, to (rid, far_log)."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for block, places, logs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            held.setdefault(block, np.zeros(1 << BLOCK))[places.values.to_numpy()] += logs.values.to_numpy()
    for block, sums in held.items():
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(block << BLOCK | at), pa.array(sums[at])], names=["rid", "far_log"])


def train(learn: DataFrame, counts: DataFrame) -> tuple[Model, int, int]:
    """The model of the texts in the column data of learn, with the most frequent pairs, their tokens and their distinct tokens; counts has (hash, c) of these."""
    with scratch(learn.sparkSession) as kept:
        return fitted_model(learn, counts, kept)[:3]


def fitted_model(learn: DataFrame, counts: DataFrame, kept) -> tuple[Model, int, int, DataFrame, int]:
    """What train gives, then all weights in LEARNT, and the number of their shards."""
    spark = learn.sparkSession
    end, words = int(END.view(np.int64)), counts.filter(F.col("hash") != int(END.view(np.int64)))
    texts = sum(r["c"] for r in counts.filter(F.col("hash") == end).collect())
    least = cut_off(words, "c", F.lit(1), HEAD - 1)
    rest = words.agg(F.sum("c"), F.count("*"), F.coalesce(F.sum(F.when(F.col("c") < least, F.col("c") + 1)), F.lit(0))).first()
    total, distinct = (rest[0] or 0) + texts, rest[1] + (texts > 0)
    top = words.filter(F.col("c") >= least).toArrow()
    hashes = np.append(top.column("hash").to_numpy().view(np.uint64), END)
    bits = min(max(LEAST_BITS, (distinct // 4).bit_length()), MOST_BITS)
    v = Vocabulary(hashes, np.append(top.column("c").to_numpy(), texts), float(rest[2]), bits)
    sent = spark.sparkContext.broadcast(v)
    parts = max(tasks(learn), -(-total // SHARD))
    shards = 8 * parts  # several in a task, as their hashes don't fall evenly
    events = learn.mapInArrow(count_events(sent, shards), EVENTS).repartition(parts, "shard")
    learnt = kept(events.mapInArrow(learn_events(sent), LEARNT), "learnt")
    histories = learnt.filter(F.col("kind") == HISTORY).select(F.explode("keys").alias("key"), "n")
    classes = train_classes(stored(histories.coalesce(FAN_IN), "histories"), v)
    weights = learnt.filter(F.col("kind") != HISTORY)
    often = F.col("n") >= cut_off(weights.filter(F.col("kind") == PAIR), "n", F.size("keys"), PAIRS)
    near = weights.filter(often).select(F.explode(F.arrays_zip("keys", "values")).alias("w")).select("w.keys", "w.values").toArrow()
    # of contexts with classes all, as other pairs need their normalisers too
    far = weights.filter(~often | (F.col("kind") == TOTAL))
    model = Model(v, classes, near.column("keys").to_numpy(), near.column("values").to_numpy(), weights.filter(~often).isEmpty())
    return model, total, distinct, far, shards


def lm_scores(df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), learning from the rows for which the column held_out is false."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_bytes(text_col).alias("data"))
    learn = docs.filter(~F.col("held_out")).select("data")
    counts = stored(learn.mapInArrow(count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("c")), "word-counts")
    with scratch(spark) as kept:
        model, total, distinct, learnt, shards = fitted_model(learn, counts, kept)
    sent = spark.sparkContext.broadcast(model)
    schema = f"rid long, id {df.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_head long, head_log double, model_log double, words array<long>, times array<int>, pairs array<long>"
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "id", "held_out", "data").mapInArrow(score_texts(sent), schema)
    rows = stored(rows, "scored")
    rare = rows.select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", F.col("w.words").alias("hash"), F.col("w.times").alias("times"))
    sums = rare.join(counts, "hash").select("rid", "times", (F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"), F.lit(0.0).alias("far_log"))
    if not model.whole:
        known = spark.sparkContext.broadcast(model.v)
        asked = rows.select("rid", "pairs").mapInArrow(ask_shards(known, shards), ASKED)
        none = lambda kind: F.lit(None).cast(kind)
        asked = asked.unionAll(learnt.select("shard", none("long").alias("block"), none("array<int>").alias("places"), "keys", "values"))
        far = asked.repartition(max(FAN_IN, -(-total // SHARD)), "shard").mapInArrow(answer(known), ANSWERS)
        far = far.repartition(tasks(df), "block").mapInArrow(add_answers, "rid long, far_log double")
        sums = sums.unionAll(far.select("rid", F.lit(0).alias("times"), F.lit(0.0).alias("rare_log"), F.col("far_log") / float(np.log(10))))
    sums = sums.groupBy("rid").agg(F.sum("times").alias("n_rare"), F.sum("rare_log").alias("rare_log"), F.sum("far_log").alias("far_log"))
    rare_log, far_log = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("far_log", F.lit(0.0))
    return rows.drop("words", "times", "pairs").join(sums, "rid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), (F.col("model_log") + rare_log + far_log).alias("score"),
    )
