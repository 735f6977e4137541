"""Operator 6: language identification by hierarchical discrimination.

Hashed byte trigrams of the lower-cased letters of a whole text are the features. One-versus-one linear support vector machines choose
the language family first and then the language within it. They are fitted on the driver to a bounded sample: `rows`
different labelled texts at most, or one of each language if there are more languages, shared evenly by the languages: those with the least hashes of each. The prediction reads
the text only. Everything else runs in tasks over Arrow batches.

A letter is a code point of the Unicode category L, in training and prediction alike. A text that is null or has no letters is `und` with score 0, as is every text if there is no labelled row to learn from. Such
texts without letters are rejected, and texts with `letters` letters or more that are unlike the language predicted for them: the cosine to the
mean of its training rows is below the model's floor, FLOOR times the least such cosine of the training rows of so many letters. Shorter
texts have too few trigrams to tell and are kept, as is every text with letters if there is no labelled row. Null ids
are never held out. Repeated rows each give a row; other columns pass through, but for
those named like the results, which these replace.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Languages by family, fixed values; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "pa", "gu", "ne", "si"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue", "wuu"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
UNDETERMINED = "und"
SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
BITS = 13
#: Bytes of a text that are counted at once.
PIECE = 1 << 20
#: Letters from which on a text can be rejected as unlike its language, and the share of the least training cosine that it must reach.
LETTERS, FLOOR = 200, 0.6


def has_letters(text: str, least: int = 1) -> bool:
    """Whether a text has so many letters or more; no more of it is read than that takes."""
    found = 0
    for k in range(0, len(text), 256):
        found += sum(map(str.isalpha, text[k : k + 256]))
        if found >= least:
            return True
    return False


def features(text: str) -> np.ndarray:
    """Trigram counts of a text, scaled to length 1."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(SPACED) + b" ", np.uint8)
    total = np.zeros(1 << BITS, np.float32)
    for k in range(0, len(data) - 2, PIECE):
        b = data[k : k + PIECE + 2].astype(np.uint32)
        h = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        total += np.bincount(h, minlength=1 << BITS)
    total[(32 << 16 | 32 << 8 | 32) * 2654435761 % 2**32 >> (32 - BITS)] = 0
    return total / np.float32(max(np.sqrt(float(total @ total)), 1e-9))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 120) -> np.ndarray:
    """Weights, the bias last, of a linear support vector machine with squared hinge loss, by accelerated gradient descent; y is 1 or -1, or 0 for rows left out."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), np.where(y < 0, 0.5 / max((y < 0).sum(), 1), 0)).astype(np.float32)
    w, v, rate = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32), 1 / (1 + 4 * cost)
    for k in range(steps):
        pull = share * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * y
        new = v - rate * (v / 10 - 2 * cost * np.append(pull @ x, pull.sum()))
        v, w = new + k / (k + 3) * (new - w), new
    return w


class Hierarchy:
    """Family against family, then language against language within each family."""

    def __init__(self, x: np.ndarray, langs: list[str], long: list[bool] | None = None, letters: int = LETTERS):
        self.letters = letters
        self.langs = sorted(set(langs))
        lang = np.array(langs)
        means = {a: x[lang == a].mean(axis=0) for a in self.langs}
        self.means = {a: m / max(float(np.linalg.norm(m)), 1e-9) for a, m in means.items()}
        alike = [float(row @ self.means[a]) for row, a, k in zip(x, langs, long or [False] * len(langs), strict=True) if k]
        self.floor = FLOOR * min(alike, default=0.0)
        family = np.array([FAMILY.get(a, a) for a in langs])
        self.families = {f: sorted({*lang[family == f]}) for f in sorted(set(family))}
        pairs = [*itertools.combinations(self.families, 2), *(p for own in self.families.values() for p in itertools.combinations(own, 2))]
        self.pairs, weights = [], []
        for k, (a, b) in enumerate(pairs):
            of = family if k < len(self.families) * (len(self.families) - 1) // 2 else lang
            weights.append(svm(x, np.where(of == a, 1, np.where(of == b, -1, 0)).astype(np.float32)))
            self.pairs.append((of is family, a, b))
        self.weights = np.array(weights, np.float32).reshape(len(pairs), x.shape[1] + 1).T

    def vote(self, margins: dict, names: list[str]) -> tuple[str, float]:
        """The name that wins most duels, then by margin; its score is the mean certainty of its duels."""
        won = {a: [0, 0.0] for a in names}
        for (a, b), m in margins.items():
            won[a if m > 0 else b][0] += 1
            won[a][1] += m
            won[b][1] -= m
        best = max(names, key=lambda a: (*won[a], a))
        sure = [1 / (1 + np.exp(-np.clip(3 * (m if a == best else -m), -30, 30))) for (a, b), m in margins.items() if best in (a, b)]
        return best, float(np.mean(sure)) if sure else 1.0

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text is rejected."""
        if not text or not has_letters(text):
            return UNDETERMINED, 0.0, True
        if not self.langs:
            return UNDETERMINED, 0.0, False
        x = features(text)
        m = x @ self.weights[:-1] + self.weights[-1] if self.pairs else []
        duel = lambda top, names: {(a, b): float(m[k]) for k, (is_top, a, b) in enumerate(self.pairs) if is_top == top and a in names and b in names}
        family, sure = self.vote(duel(True, self.families), list(self.families))
        lang, surer = self.vote(duel(False, self.families[family]), self.families[family])
        return lang, sure * surer, float(x @ self.means[lang]) < self.floor and has_letters(text, self.letters)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))).view(np.int64))


def chosen_texts(learn: DataFrame, rows: int) -> DataFrame:
    """(lang, text) of `rows` different texts of learn (lang, text) with letters, evenly by language: those of the least hashes."""

    def hashed(batches):
        for b in batches:
            found = {(lang, text_hash(t)) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if has_letters(t)}
            langs, hashes = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64())], names=["lang", "hash"])

    # equal texts are one, however many there are
    texts = stored(learn.mapInArrow(hashed, "lang string, hash long").distinct(), "labelled")
    langs = texts.select("lang").distinct().count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    least = texts.withColumn("place", place).filter(F.col("place") <= max(1, rows // max(langs, 1))).select("lang", "hash")
    # no more than `rows`, so each task can have them
    wanted = {(r["lang"], r["hash"]) for r in least.collect()}

    def picked(batches):
        for b in batches:
            keep = [(lang, text_hash(t)) in wanted for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return learn.mapInArrow(picked, "lang string, text string").distinct()


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 1200, letters: int = LETTERS) -> Hierarchy:
    """Fit on labelled rows that are not held out; `rows` of their texts at most, evenly by language, go to the driver as features."""
    small_batches(df.sparkSession)
    learn = df.filter(~held_out(F.col(f"`{id_col}`"))).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("lang is not null and text is not null")
    chosen = chosen_texts(learn, rows)

    def extract(batches):
        for b in batches:
            found = [(features(t), has_letters(t, letters), text_hash(t)) for t in b.column(1).to_pylist()]
            at = [np.flatnonzero(x).astype(np.uint16) for x, _, _ in found]
            values = [x[k].tobytes() for (x, _, _), k in zip(found, at, strict=True)]
            columns = [b.column(0), pa.array([k.tobytes() for k in at], pa.binary()), pa.array(values, pa.binary()), pa.array([f[1] for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "at", "x", "long", "hash"])

    # what isn't 0 of each text, in the order of their hashes, so the fit doesn't depend on the order in which tasks end
    got = chosen.mapInArrow(extract, "lang string, at binary, x binary, long boolean, hash long").toArrow().sort_by([("lang", "ascending"), ("hash", "ascending")])
    x = np.zeros((got.num_rows, 1 << BITS), np.float32)
    for row, at, values in zip(x, got.column("at"), got.column("x"), strict=True):
        row[np.frombuffer(at.as_py(), np.uint16)] = np.frombuffer(values.as_py(), np.float32)
    return Hierarchy(x, got.column("lang").to_pylist(), got.column("long").to_pylist(), letters)


def identify(df: DataFrame, model: Hierarchy, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with lang_pred, score and rejected; without text_col unless keep_text."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if (keep_text or c != text_col) and c.lower() not in ("lang_pred", "score", "rejected")]

    def predict(batches):
        for b in batches:
            found = [sent.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).alias("text"))
    schema = rows.select("row").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).schema
    return rows.mapInArrow(predict, schema).select("row.*", "lang_pred", "score", "rejected")
