"""The contract queries that SQL can express, against DuckDB; the others run at all on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tallyfield.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import SF, TABLES, rows

COLUMNS = {
    "op1_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
    "op2_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op9_nearest_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op10_feistel_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    got = QUERIES[name](spark, SF)
    assert set(got.columns) >= COLUMNS.get(name, {"doc_id"}) and got.count()
