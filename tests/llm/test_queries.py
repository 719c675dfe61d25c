"""Registered queries next to their SQL twins, and their columns."""

import duckdb
import pytest
from check_oracle import TABLES, difference

import corpus_pipeline
from weirlog.llm import queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3_language_id": "doc_id held_out lang_pred score",
    "op4_chat_format": "conv_id turn part role text rendered",
    "op5_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_ngram_join": "doc_id n_shingles component_id",
    "op7_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op8_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op9_near_vectors": "vec_id n_links component_id kept",
    "op10_mixing": "doc_id size source_size target taken",
    "op11_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op12_lexical_search": "item_id rank doc_id score",
    "op13_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}
#: Queries that do not return one row for each of their table.
NOT_ROW_BY_ROW = ("op12_lexical_search", "op13_filter_audit")


def test_every_operator_has_a_query():
    assert list(COLUMNS) == list(queries.ALL)
    assert set(queries.SQL) <= set(queries.ALL)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    found = queries.ALL[name](spark, SMALL)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    if name in NOT_ROW_BY_ROW:
        assert found.count() > 0
        return
    source = {"op4": "conversations", "op9": "embeddings"}.get(name.split("_")[0], "documents")
    assert found.count() == spark.read.parquet(f"{SMALL}/{source}.parquet").count()


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_sql(spark, name):
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    assert difference(queries.ALL[name](spark, SMALL).toPandas(), database.sql(queries.SQL[name]).df()) is None


def test_exact_dedup_stays_in_the_engine(spark):
    plan = queries.op8_exact_dedup(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoopJoin"))
