"""Every registered query and the whole pipeline over the smallest tables: rows and columns as their contracts have them."""

from __future__ import annotations

import duckdb
import pytest
from tests.conftest import DATA

from querncore.llm import queries

SF = str(DATA / "sf0.001")
PER_DOCUMENT = {
    "op1_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op2_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op3_records": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_quality": ["doc_id", "held_out", "score", "predicted"],
    "op5_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op6_unigram": ["doc_id"],
    "op8_lm_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_licenses": ["doc_id"],
    "op10_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op13_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
}


def ids(table, column):
    return sorted(r[0] for r in duckdb.sql(f"select {column} from '{SF}/{table}.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(PER_DOCUMENT))
def test_a_row_for_each_document(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.columns[: len(PER_DOCUMENT[name])] == PER_DOCUMENT[name]
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == ids("documents", "doc_id")


def test_nearest_of_each_query(spark):
    rows = queries.queries()["op7_nearest"](spark, SF).collect()
    asked = [i for i in ids("embeddings", "vec_id") if i % 20 == 0]
    assert sorted((r.query_id, r["rank"]) for r in rows) == [(q, k) for q in asked for k in range(1, 21)] and all(r.vec_id != r.query_id for r in rows)


def test_all_are_tested_here_or_against_sql():
    assert set(queries.queries()) == {*PER_DOCUMENT, "op7_nearest", "pipeline", *queries.oracle_sql()}


def test_pipeline(spark):
    rows = queries.queries()["pipeline"](spark, SF).collect()
    held = set(ids("documents", "doc_id"))
    assert rows and {r.doc_id for r in rows} <= held and all(r.n_tokens > 0 for r in rows)
