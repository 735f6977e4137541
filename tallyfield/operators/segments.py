"""Topic blocks of texts by the names of a dictionary, found with one automaton; each text is one row and stays where it is."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.sequences import dominant, thin_boundaries

#: Names and phrases of a dictionary that goes to every task; more are an error, as the automaton would not fit beside the texts.
MOST_NAMES = 1_000_000
#: A sentence begins at white space after a full stop.
SENTENCE = re.compile(r"(?<=\.)(?=[ \t\n\f\r])")
TOPIC, SCOPE, MOVE = 0, 1, 2


class Mentions:
    """An automaton (Aho and Corasick's) over topics, scopes and phrases, lower-case. Topics and scopes count anywhere in a sentence, phrases as whole words."""

    def __init__(self, topics: list[str], scopes: list[str], moves: list[str]):
        import ahocorasick

        held: dict[str, list[tuple[int, str]]] = {}
        for kind, names in ((TOPIC, topics), (SCOPE, scopes), (MOVE, moves)):
            for name in names:
                if name:
                    held.setdefault(name.lower(), []).append((kind, name))
        self.automaton = ahocorasick.Automaton()
        for pattern, what in held.items():
            self.automaton.add_word(pattern, (len(pattern), what))
        self.any = bool(held)
        if self.any:
            self.automaton.make_automaton()

    def of(self, text: str) -> tuple[list[str], list[set[str]], list[set[str]], set[int]]:
        """The sentences of a text, topics and scopes of each, and the sentences with a phrase; what crosses the end of a sentence isn't in it."""
        low = text.lower()
        starts = [0, *(m.start() for m in SENTENCE.finditer(low))]
        ends = [*starts[1:], len(low)]
        topics, scopes, moved = [set() for _ in starts], [set() for _ in starts], set()
        for end, (size, what) in self.automaton.iter(low) if self.any and low else ():
            end += 1
            k = bisect_right(starts, end - size) - 1
            if end > ends[k]:
                continue
            for kind, name in what:
                if kind != MOVE:
                    (topics if kind == TOPIC else scopes)[k].add(name)
                elif whole(low, end - size, end):
                    moved.add(k)
        return [low[a:b] for a, b in zip(starts, ends, strict=True)], topics, scopes, moved


def whole(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] neither begins nor ends inside a word of ASCII letters, digits and underscores."""
    inside = lambda ch: ch.isascii() and (ch.isalnum() or ch == "_")
    return not (a and inside(text[a - 1])) and not (b < len(text) and inside(text[b]))


def boundary_scores(sentences: list[str], topics: list[set[str]], moved: set[int], recent: int = 20) -> list[float]:
    """A phrase scores 2, a gap (here a new line) 1.5, and each topic not among the last `recent` sentences 1."""
    out, last = [], {}
    for k, (s, names) in enumerate(zip(sentences, topics, strict=True)):
        fresh = sum(k - last.get(x, -recent - 1) > recent for x in names)
        last |= dict.fromkeys(names, k)
        out.append(2.0 * (k in moved) + 1.5 * s.startswith("\n") + fresh)
    return out


def peaks(scores: list[float], least: float = 2.0, around: int = 10) -> list[tuple[int, float]]:
    """Places of `least` or more that nothing within `around` exceeds."""
    return [(k, s) for k, s in enumerate(scores) if s >= least and s >= max(scores[max(0, k - around) : k + around + 1])]


def classified(topics: Counter, scopes: Counter) -> tuple[str, str]:
    """Kind and label of a block: two topics in 2 sentences each or more are `versus`; else scopes in 3 or more are `scope`, or `general` if they are four; one topic is `single`."""
    named, wide = dominant(topics, 2), dominant(scopes, 3)
    if len(named) >= 2:
        more = f" (+{len(named) - 2} more)" if len(named) > 2 else ""
        return "versus", f"{named[0]} vs {named[1]}{more}"
    if wide:
        return ("general", "general") if len(wide) >= 4 else ("scope", "/".join(sorted(wide)))
    return ("single", named[0]) if named else ("general", "general")


def merged_blocks(blocks: list[tuple[int, int, Counter, Counter]]) -> list[tuple[int, int, Counter, Counter]]:
    """Blocks (first, last, topics, scopes), adjacent ones joined if one of both has under 80 sentences and they share two topics, or one if either is about topics.

    In blocks under 50 sentences every topic counts, else those in 2 or more. A pass goes through all blocks in order; passes repeat until nothing changes.
    """

    def shared(a, b) -> int:
        own = [set(dominant(x[2], 1 if x[1] - x[0] + 1 < 50 else 2)) for x in (a, b)]
        return len(own[0] & own[1])

    out, before = list(blocks), len(blocks) + 1
    while len(out) < before:
        before, left, out = len(out), out, []
        for b in left:
            a = out[-1] if out else None
            if a and min(a[1] - a[0], b[1] - b[0]) + 1 < 80 and shared(a, b) >= 1 + (not any(classified(x[2], x[3])[0] in ("versus", "single") for x in (a, b))):
                out[-1] = (a[0], b[1], a[2] + b[2], a[3] + b[3])
            else:
                out.append(b)
    return out


def blocks_of(found: tuple, least_block: int) -> list[tuple[int, int, Counter, Counter]]:
    sentences, topics, scopes, moved = found
    cuts = [0, *thin_boundaries(peaks(boundary_scores(sentences, topics, moved)), least_block, len(sentences)), len(sentences)]
    count = lambda of, a, b: Counter(x for s in of[a:b] for x in s)
    return [(a, b - 1, count(topics, a, b), count(scopes, a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def names_of(df: DataFrame, column: str) -> list[str]:
    """The different names of a dictionary table, in order; their number is checked."""
    rows = df.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"a dictionary of more than {MOST_NAMES} names")
    return sorted(r["name"] for r in rows)


def topic_blocks(texts: DataFrame, topics: list[str], scopes: list[str], moves: list[str], id_col: str = "doc_id", text_col: str = "text", least_block: int = 8, merge: bool = True) -> DataFrame:
    """(id, kind, label, first_pos, last_pos): the blocks of each text in order, positions being sentences from 0; without merge as they were cut.

    A text is read in one go by the task that scans it: there is no exchange and no row for a sentence. A null text has no block, an empty one a single block of one empty sentence. Repeated rows each give theirs.
    """
    sent = texts.sparkSession.sparkContext.broadcast((topics, scopes, moves))

    def cut(batches):
        known = Mentions(*sent.value)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                blocks = blocks_of(known.of(text), least_block)
                rows += [(i, *classified(t, s), a, z) for a, z, t, s in (merged_blocks(blocks) if merge else blocks)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (b.schema[0].type, pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "kind", "label", "first_pos", "last_pos"])

    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(cut, f"id {texts.schema[id_col].dataType.simpleString()}, kind string, label string, first_pos long, last_pos long")
    return out.select(F.col("id").alias(id_col), "kind", "label", "first_pos", "last_pos")
