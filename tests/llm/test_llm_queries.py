"""Each numbered query over a small test table; with SQL where there is some."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry
from housemark.llm import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = {"op6_html_extraction": "pages", "op8_embeddings": "embeddings"}
COLUMNS = {
    "op1": "doc_id fingerprint component_id",
    "op2": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5": "doc_id n_words n_tokens",
    "op6": "page_id url text n_chars",
    "op7": "doc_id held_out score predicted",
    "op8": "vec_id n_links component_id kept",
    "op9": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op10": "doc_id size source_size target taken",
    "op11": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns_and_rows(spark, name):
    found = entry.queries()[name](spark, FOLDER)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(found.columns)
    source = spark.read.parquet(f"{FOLDER}/{TABLES.get(name, 'documents')}.parquet")
    if name == "op11_filter_audit":
        assert found.count() == 600 * source.select("source").distinct().count()
    elif name == "op2_packing":
        assert found.select("doc_id").distinct().count() == source.count()
    else:
        assert found.count() == source.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    frame = entry.queries()[name](spark, FOLDER)
    assert not differences(frame, connect(FOLDER), entry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op3_quality_rules", "op10_mixing"])
def test_native_operators_run_no_python(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 14))
