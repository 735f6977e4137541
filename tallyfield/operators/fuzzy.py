"""Mentions of a dictionary's names in texts, allowing for edits, by a deletion neighbourhood and equality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import text as X
from tallyfield.session import stored

#: Rows of a table that is sent to all tasks at most; they are counted. Larger ones are dealt out by key with the other side.
FEW = 100_000


def joined(rows: DataFrame, table: DataFrame, on: str | list[str]) -> DataFrame:
    """rows joined with a stored table. Rows made by exploding texts are never sent whole, whatever size Spark expects of them."""
    if table.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(table), on)
    return rows.hint("merge").join(table, on)


def deletions(word: Column, edits: int) -> Column:
    """All strings that a word becomes by deleting up to `edits` characters, itself included. Two words within that many edits share one."""
    out = F.array(word)
    for _ in range(edits):
        shorter = F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.substring(w, 1, k - 1), F.substring(w, k + 1, F.length(w))))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def allowed(a: Column, b: Column, edits: int, least: int) -> Column:
    """The edits that two words may differ by: none if either has fewer than `least` letters."""
    return F.when(F.least(F.length(a), F.length(b)) < least, 0).otherwise(edits)


def near_words(words: DataFrame, known: DataFrame, edits: int, least: int) -> DataFrame:
    """(word, known, edits) of the different words of both tables, one column each, that differ by few enough edits.

    Each word is indexed under what it becomes by deletions; equal entries are candidates and their distance is then computed. Words of other lengths than known ones have are left out first.
    """
    variants = lambda c: F.explode(F.when(F.length(c) < least, F.array(c)).otherwise(deletions(F.col(c), edits))).alias("variant")
    index = stored(known.select("known", variants("known")), "deletions")
    longest = known.agg(F.max(F.length("known"))).first()[0] or 0
    fit = words.filter(F.length("word") <= longest + edits)
    pairs = joined(fit.select("word", variants("word")), index, "variant").select("word", "known").distinct()
    far = F.levenshtein("word", "known", edits)  # -1 beyond the threshold
    return pairs.withColumn("edits", far).filter((F.col("edits") >= 0) & (F.col("edits") <= allowed(F.col("word"), F.col("known"), edits, least)))


def mentions(texts: DataFrame, names: DataFrame, edits: int = 1, least: int = 4, id_col: str = "doc_id", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """(id, pos, found, name, edits, score): the best name that stands at each word of a text; positions count from 0.

    A name of n words stands where n words in a row differ from it by `edits` in all, word by word; words under `least` letters must be equal. The best one has the most words, then the
    fewest edits, then the highest mean Jaro-Winkler similarity of its words, then the least name. Names and texts are cut into words as `tokens` does.

    Only different words meet the dictionary's words. A name is looked for at the word of it that the texts have least often, and its other words are compared there, so a common
    word pulls in no names. Texts are exploded once, and only words near a dictionary's are kept. Null texts and names have no words; repeated rows each count, so ids should be unique.
    """
    entries = names.select(F.col(name_col).alias("name")).distinct().withColumn("parts", X.tokens("name", 1)).filter(F.size("parts") > 0)
    known = stored(entries.select(F.explode("parts").alias("known")).distinct(), "known-words")
    tokens = texts.select(F.col(id_col).alias("id"), X.tokens(text_col, 1).alias("tokens"))
    words = stored(tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("times")), "words")
    near = stored(near_words(words.select("word"), known, edits, least), "near-words")
    # how often the texts have anything near a dictionary's word
    often = joined(words, near, "word").groupBy("known").agg(F.sum("times").alias("times"))
    parts = entries.select("name", "parts", F.posexplode("parts").alias("at", "known"))
    # a name whose words the texts don't all have stands nowhere
    rare = parts.join(often, "known").groupBy("name", "parts").agg(F.min_by(F.struct("at", "known"), F.struct("times", "at")).alias("rare"), F.count("*").alias("had")).filter(F.col("had") == F.size("parts"))
    anchors = stored(near.join(rare.select("name", "parts", F.col("rare.at").alias("at"), F.col("rare.known").alias("known")), "known").select("word", "name", "parts", "at"), "anchors")
    # each word with those around it that a name may need, not with its whole text
    n = entries.agg(F.max(F.size("parts"))).first()[0] or 1
    near_by = lambda w, p: F.struct(w.alias("word"), p.alias("p"), F.slice("tokens", F.greatest(p - (n - 1), F.lit(0)) + 1, 2 * n - 1).alias("around"))
    placed = joined(tokens.select("id", F.explode(F.transform("tokens", near_by)).alias("z")).select("id", "z.*"), anchors, "word")
    start = F.col("p") - F.col("at")
    own = F.slice("around", F.greatest(start - F.greatest(F.col("p") - (n - 1), F.lit(0)), F.lit(0)) + 1, F.size("parts"))
    found = placed.filter(start >= 0).select("id", start.alias("pos"), "name", "parts", own.alias("own")).filter(F.size("own") == F.size("parts"))
    costs = F.zip_with("own", "parts", lambda a, b: F.when(F.levenshtein(a, b) <= allowed(a, b, edits, least), F.levenshtein(a, b)).otherwise(edits + 1))
    found = stored(found.withColumn("edits", F.aggregate(costs, F.lit(0), lambda x, y: x + y)).filter(F.col("edits") <= edits), "mentions")
    # the similarity is computed once for each pair of what was found and a name
    scored = found.select(F.array_join("own", " ").alias("found"), F.array_join("parts", " ").alias("as"), "own", "parts").distinct()
    scored = scored.select("found", "as", F.explode(F.arrays_zip("own", "parts")).alias("z")).groupBy("found", "as").agg(F.round(F.avg(X.jaro_winkler(F.col("z.own"), F.col("z.parts"))), 6).alias("score"))
    rows = found.select("id", "pos", F.array_join("own", " ").alias("found"), F.array_join("parts", " ").alias("as"), "name", "edits", F.size("parts").alias("n"))
    ranked = joined(rows, stored(scored, "scores"), ["found", "as"])
    best = ranked.groupBy("id", "pos").agg(F.min(F.struct((-F.col("n")).alias("n"), "edits", (-F.col("score")).alias("s"), "name", "found")).alias("b"))
    return best.select(F.col("id").alias(id_col), "pos", F.col("b.found").alias("found"), F.col("b.name").alias("name"), F.col("b.edits").alias("edits"), (-F.col("b.s")).alias("score"))
