"""Operator 13: an audit of how the sources of a language diverge, by wide term vectors.

A task counts the terms of its texts by language, source and term, with the documents that hold them; Spark sums these. A language keeps the
terms of at least `least_docs` of its documents. Each kept term is pivoted into one row with an array of counts, a place for each source of the
language. Higher-order functions turn it into an array of smoothed shares and emit the absolute differences of all pairs of places, which
partial aggregation sums before they are shuffled: a task sends one sum for each pair of sources of a language, however many terms it has.

Null text, language and source are ''. A language or source is an ordinary value else. A source without terms, or of a language that keeps none,
has its rows all the same, with value 0 where no term is kept. Repeated rows count as often as they come. Texts are read whole. Counts are exact: shares are computed in decimals, so that counts up to 10^18 are.
Extra columns stay out. An empty table gives no rows. The result is one row for each pair of sources of a language, so it grows with the square of their number, as an audit of all pairs does.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, tasks

#: ASCII letters in lower case and all bytes above ASCII belong to terms; others part them.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Different (language, source, term) that a task counts at once; then it sends them on.
HELD = 200_000
#: Groups (language, source) up to which their totals are sent to all tasks; they are counted.
FEW_GROUPS = 4096


def term_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed in a task; each group (lang, source) has a row without a term too."""
    small_batches(df.sparkSession)

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}  # occurrences and documents of each group's terms
        size = 0

        def sent():
            rows = [(lang, source, term, k, docs[term]) for (lang, source), (n, docs) in held.items() for term, k in n.items()]
            rows += [(lang, source, None, 0, 0) for lang, source in held]
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            for k in range(0, len(rows), 1 << 16):
                columns = zip(*rows[k : k + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, words = len(n), text.translate(TERMS).split()
                n.update(words)
                docs.update(set(words))
                size += len(n) - before
                if size > HELD:
                    yield from sent()
                    held.clear()
                    size = 0
        if held:
            yield from sent()

    none = F.lit("")
    rows = df.select(F.coalesce(F.col(f"`{lang_col}`"), none).alias("lang"), F.coalesce(F.col(f"`{source_col}`"), none).alias("source"), F.coalesce(F.col(f"`{text_col}`"), none).cast("binary").alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def share(n, total, kept):
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), exact."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", wide(n + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(total + 5 * kept)) + 1


def wide_vectors(counts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """The vectors (lang, term, counts) of kept terms, counts by source, and the languages (lang, sources, totals, kept), totals in the order of sources."""
    # dealt once, by what both groupings share; tasks have summed before
    dealt = counts.repartition(tasks(counts), "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = dealt.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    every = stored(every.filter(F.col("term").isNull() | (F.col("docs") >= least_docs)).drop("docs"), "vectors")
    kept, groups = every.filter("term is not null"), every.filter("term is null").select("lang", F.explode(F.map_keys("counts")).alias("source"))
    totals = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    known = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("of"))
    langs = known.join(sizes, "lang", "left").select("lang", F.col("of.source").alias("sources"), F.col("of.total").alias("totals"), F.coalesce("kept", F.lit(0)).alias("kept"))
    return kept, stored(langs, "languages")


def divergence(df: DataFrame, least_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): the distance to each other source of the language, and the `top` terms that set a source off from its language."""
    vectors, langs = wide_vectors(term_counts(df, text_col, lang_col, source_col), least_docs)
    few = langs.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0] <= FEW_GROUPS
    joined = vectors.join(F.broadcast(langs) if few else langs, "lang")
    # the pivot: a place for each source, 0 where it lacks the term
    n = F.transform("sources", lambda s: F.coalesce(F.element_at("counts", s), F.lit(0).cast("long")))
    wide = joined.withColumn("n", n).withColumn("p", F.transform(F.arrays_zip("n", "totals"), lambda v: share(v["n"], v["totals"], F.col("kept"))))

    # differences of the places (0, 1), (0, 2) and so on in one array; a pair is known by its place there
    last = F.size("p") - 1
    beside = lambda a, i: F.transform(F.slice("p", i + 2, last - i), lambda b: F.abs(a - b))
    emitted = wide.filter(last > 0).select("lang", F.posexplode(F.flatten(F.transform("p", beside))).alias("pair", "f"))
    sums = emitted.groupBy("lang", "pair").agg(F.sum("f").alias("value"))
    places = langs.select("lang", "sources", F.posexplode("sources").alias("i", "source")).select("*", F.posexplode("sources").alias("j", "item")).filter("i != j")
    i, j = F.least("i", "j"), F.greatest("i", "j")
    places = places.withColumn("pair", (i * (2 * F.size("sources") - i - 1) / 2 + j - i - 1).cast("int"))
    pairs = places.join(sums, ["lang", "pair"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    whole = wide.withColumn("q", share(total(F.col("n")), total(F.col("totals")), F.col("kept")))
    over = F.filter(F.arrays_zip("sources", "n", "p"), lambda v: (v["n"] > 0) & (v["p"] > F.col("q")))
    terms = whole.select("lang", "term", "q", F.explode(over).alias("v")).select("lang", F.col("v.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("v.p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
