"""The pipeline's stages in order, each on what the one before kept."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfield.llm import common
from tests.llm.odd import LONG, TEXTS, odd, word_text


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    english = lambda n: " ".join(rng.choices("the of and house water never walking light under mountain river story winter people would could thing".split(), k=n))
    french = lambda n: " ".join(rng.choices("le la et maison eau jamais marcher lumière sous montagne rivière histoire hiver gens aurait chose".split(), k=n))
    docs = [(k, english(120) if k % 2 else french(120), "en" if k % 2 else "fr") for k in range(60)]
    bench = word_text(rng, 20, 10**6)
    near = docs[3][1].split()
    near[50] = "changed"
    extra = [(100, None, None), (101, "123 !!!", "en"), (102, docs[2][1], "fr"), (103, " ".join(near), "en"), (104, f"{docs[5][1][:200]} {bench} {english(30)}", "en"), (105, f"{english(80)} password=abc123def456 end", "en")]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in docs + extra]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r[0] for r in rows]
    now = df
    gone = {"language_id": {100, 101}, "simhash_near_dedup": {102, 103}, "benchmark_decontamination": {104}, "secret_scans": set()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == df.columns
        kept = [k for k in kept if k not in gone[name]]
        assert sorted(r.doc_id for r in now.collect()) == kept, name
    text = {r.doc_id: r.text for r in now.collect()}
    assert text[105].endswith("[assign] end") and text[1] == docs[1][1]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}) == kept and all(r.bin_id is not None for r in got)


def test_scratch_is_deleted(spark, tmp_path):
    df = spark.range(10)
    shared = Path(common.shared_dir(spark))
    before = set(shared.iterdir())
    with common.scratch(spark) as kept:
        common.stored(df, "one")
        with common.scratch(spark) as inner:
            two = inner(df, "two")
            common.stored(df, "three")
        out = kept(two, "four")
    assert out.count() == 10 and [p.name.split("-")[0] for p in set(shared.iterdir()) - before] == ["four"]
    with pytest.raises(ValueError), common.scratch(spark):
        common.stored(df, "five")
        raise ValueError
    assert len(set(shared.iterdir()) - before) == 1


def odd_documents(spark, path, rows):
    df = odd(spark, rows).drop("bucket").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "doc": F.lit("d"), "lang_pred": F.lit("l"), "rejected": F.lit(False), "component_id": F.lit(0)})
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "some words of a benchmark that no document holds in full here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


#: Odd rows, with a null id, and the ids that each stage keeps.
KEPT = {"language_id": [None, 4, 5, 5, 6, 8, 9], "simhash_near_dedup": [4, 6, 8, 9], "benchmark_decontamination": [4, 6, 8, 9], "secret_scans": [4, 6, 8, 9]}


@pytest.mark.parametrize("labelled", [True, False])
def test_stages_on_odd_rows(spark, tmp_path, labelled):
    now = odd_documents(spark, tmp_path, TEXTS)
    now = now if labelled else now.withColumn("lang", F.lit(None).cast("string"))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        rows = now.collect()
        assert sorted((r.doc_id for r in rows), key=lambda k: (k is not None, k)) == KEPT[name]
        assert {(r.doc, r.score, r.blob) for r in rows} == {("d", "extra score", "extra blob")}
    assert {r.doc_id: r.text for r in rows} == {4: "Hello there", 6: LONG, 8: "a", 9: "[assign] x"} and all(r.n_chars == len(r.text) for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {4, 6, 8, 9} and all(r.bin_id is not None for r in packed)


def test_empty_table(spark, tmp_path):
    now = odd_documents(spark, tmp_path, TEXTS[:0])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_registers_all():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
