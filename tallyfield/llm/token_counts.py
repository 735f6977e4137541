"""Operator 2: token counts with a whole-token shortcut.

The pieces of a byte-fallback BPE model prove where its merges can't reach: if no piece has a space mark after another
character, and none a line feed beside any other, then a text can be cut before each run of space marks and around each line
feed, and the counts of the cuts add up. Offline, each vocabulary string that is a possible cut and that the library
encodes alone as one token goes into a table. A text's cuts are looked up there; only the rest is merged by the library.

Null and empty texts have 0 tokens. Strings of special tokens are ordinary text, as the library treats them. Texts of any
length are counted whole. Repeated rows and null ids each give a row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
CUTS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Merged cuts that a worker remembers; then it forgets them all, so memory is bounded.
REMEMBERED = 300_000


class Counts(dict):
    """Tokens of a cut. Holds the proven whole tokens; asks the library for others and remembers them, up to a bound."""

    def __init__(self, path: str, proven: list[str] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__(dict.fromkeys(proven, 1) if proven is not None else whole_tokens(self.model))
        self.proven = len(self)

    def __missing__(self, cut: str) -> int:
        if len(self) > self.proven + REMEMBERED:
            for k in list(self)[self.proven :]:
                del self[k]
        n = merged(self.model, cut)
        if len(cut) < 64:
            self[cut] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, CUTS.findall(MARK + text.replace(" ", MARK))))


def merged(model, cut: str) -> int:
    """Tokens of a cut by the library, which puts a space mark first: one is taken off, or a line feed shields the cut from it."""
    if cut[0] == MARK:
        return len(model.encode(cut[1:].replace(MARK, " "))) if len(cut) > 1 else 1
    return len(model.encode("\n" + cut)) - 2


def whole_tokens(model) -> dict[str, int]:
    """The vocabulary strings that encode alone as one token, after proof that merges never cross a cut."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    for p in pieces:
        if p.lstrip(MARK).count(MARK) or ("\n" in p and p != "\n"):
            raise ValueError(f"piece {p!r} could be merged across a cut; this model needs other cuts")
    return {p: 1 for p in pieces if CUTS.fullmatch(p) and merged(model, p) == 1}


#: The counts that a worker has, by the model's path.
_HELD: dict[str, Counts] = {}


def counts(path: str, proven: list[str] | None = None) -> Counts:
    if path not in _HELD:
        _HELD[path] = Counts(path, proven)
    return _HELD[path]


def model_path(tokenizer: str) -> str:
    import os

    import public_tokenizers

    return tokenizer if os.path.sep in tokenizer else str(public_tokenizers.path(tokenizer))


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row. tokenizer: a file's name in the public tokenizers folder, or a path."""
    import sentencepiece

    small_batches(df.sparkSession)
    # proven once, before any task; no more than the vocabulary is sent
    proven = df.sparkSession.sparkContext.broadcast(list(whole_tokens(sentencepiece.SentencePieceProcessor(model_file=model_path(tokenizer)))))

    def count(batches):
        known = counts(model_path(tokenizer), proven.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([known.of(t) for t in b.column(2).to_pylist()], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(count, f"id {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
