from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from housemark.llm import packing, simhash
from housemark.sources.scratch import stage
from test_mixing import slow as slow_mix

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before each stage, and the last stage's rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for _, function in pipeline.STAGES:
        found.append(stage(function(spark, found[-1], FOLDER)))
    return found


def test_stages_keep_the_columns(steps):
    assert [name for name, _ in pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "secret scans", "mixing sources to target weights",
        "packing",
    ]
    assert all(x.schema == steps[0].schema for x in steps[1:-1])


def test_every_stage_takes_effect(steps):
    raw, ruled, single, masked, mixed, packed = steps
    assert 0 < ruled.count() < raw.count()
    assert ruled.join(raw, ruled.columns, "left_anti").isEmpty()
    kept = simhash.near_duplicates(simhash.with_fingerprints(single))
    assert kept.groupBy("component").count().where("count > 1").isEmpty()
    assert single.count() == simhash.near_duplicates(
        stage(simhash.with_fingerprints(ruled))
    ).select("component").distinct().count()
    assert masked.count() == single.count()
    assert masked.where("text LIKE '%password=%' AND text RLIKE 'password=[0-9a-f]{12}'").isEmpty()
    assert masked.where(F.char_length("text") != F.col("n_chars")).isEmpty()
    copies = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies <= 2 and mixed.join(masked, mixed.columns, "left_anti").isEmpty()
    tokens = Counter(r.doc_id for r in mixed.collect())
    pieces = Counter(r.doc_id for r in packed.where("start = 0").collect())
    assert pieces == tokens


def test_run_gives_the_last_stage(spark, steps):
    found = pipeline.run(spark, FOLDER).drop("sequence_id", "offset")
    wanted = steps[-1].drop("sequence_id", "offset")
    assert found.columns == wanted.columns
    assert found.agg(F.sum("length")).first() == wanted.agg(F.sum("length")).first()
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


def test_odd_documents(spark, odd):
    docs = odd
    for _, function in pipeline.STAGES[:-1]:
        after = stage(function(spark, docs, FOLDER))
        assert after.schema.names == docs.schema.names
        assert after.where("kept <> 'own kept' OR _row <> 'own _row'").isEmpty()
        docs = after
    assert packing.pack(docs).count() >= 0


def test_near_duplicates_of_null_and_repeated_ids(spark, odd):
    left = pipeline.drop_near_duplicates(spark, stage(odd), FOLDER).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "3", "6", "7", "8", "None"]


@pytest.mark.parametrize("function", [pipeline.drop_near_duplicates, pipeline.mix_sources])
def test_files_cut_otherwise_by_a_later_scan(spark, function):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3)
    docs = stage(docs.where("doc_id IS NOT NULL"))
    wanted = Counter(r.doc_id for r in function(spark, docs, FOLDER).collect())
    left = function(spark, docs, FOLDER)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "8k")
    try:
        assert Counter(r.doc_id for r in left.collect()) == wanted
    finally:
        spark.conf.set(name, before)


def test_empty_documents(spark, none):
    docs = none
    for _, function in pipeline.STAGES:
        docs = stage(function(spark, docs, FOLDER))
    assert docs.isEmpty()


def slow_single(rows, fingerprints):
    """Ids that near-dedup leaves: the smallest of each component of fingerprints."""
    ids = sorted(rows)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}


def test_survivors_of_dedup_and_mixing_computed_anew(spark, steps):
    """Both stages from plain Python over the whole table before them."""
    _, ruled, single, masked, mixed, _ = steps
    mask = (1 << 64) - 1
    prints = {r.doc_id: r.fingerprint & mask for r in simhash.with_fingerprints(ruled).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(slow_single(prints, prints))
    rows = [(r.doc_id, r.source, r.text) for r in masked.collect()]
    copies = {str(r[0]): r[-1] for r in slow_mix(rows)}
    found = Counter(str(r.doc_id) for r in mixed.collect())
    assert found == Counter({i: n for i, n in copies.items() if n})


def test_documents_are_not_written_again_to_be_told_apart(spark, monkeypatch):
    docs = stage(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    written = []
    monkeypatch.setattr(pipeline, "stage", lambda frame, name="stage": written.append(frame.columns) or stage(frame, name))
    for function in (pipeline.drop_near_duplicates, pipeline.mix_sources):
        function(spark, docs, FOLDER)
    assert written and not any("text" in c or "_doc" in c for c in written)
