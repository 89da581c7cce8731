"""The pipeline's stages, each on its own input, and the SQL twins of the queries."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from concord.llm import decontam, toxicity
from concord.llm.queries import ORACLES, QUERIES
from tests.llm import cases

TABLES = "documents embeddings pages benchmark labels conversations"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{cases.SF}/{t}.parquet'")
    df = QUERIES[name](spark, cases.SF)
    names = sorted(df.columns)
    found = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    cursor = con.execute(ORACLES[name])
    order = [[d[0] for d in cursor.description].index(c) for c in names]
    assert found and found == sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())


def test_all_queries_and_the_pipeline_are_registered():
    found = entry.queries()
    assert {n for q in found if q.startswith("op") for n in [q[2:].split("_")[0]]} == {str(n) for n in range(1, 14)}
    assert "pipeline" in found and set(ORACLES) <= set(entry.oracle_sql())


def test_stages(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.train(docs, spark.read.parquet(f"{cases.SF}/labels.parquet"))
    rejected = {r.key for r in toxicity.classify(docs, model).where("rejected").collect()}
    clean = stages["toxicity"](spark, docs, cases.SF)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - rejected and rejected
    single = stages["near_duplicates"](spark, docs, cases.SF)
    texts = [r.text for r in single.collect()]
    assert len(texts) == len(set(texts)) < docs.count()
    apart = stages["decontamination"](spark, docs, cases.SF)
    items = [decontam.normalize(r.text) for r in spark.read.parquet(f"{cases.SF}/benchmark.parquet").collect()]
    assert not any(i in decontam.normalize(r.text) for r in apart.collect() for i in items)
    mixed = stages["mixing"](spark, docs, cases.SF)
    assert 0.5 * docs.count() < mixed.count() <= docs.count()
    for kept in (clean, single, apart, mixed):
        assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty()
    sharded = stages["sharding"](spark, docs, cases.SF)
    assert sharded.drop("shard", "slot").exceptAll(docs).isEmpty() and sharded.count() == docs.count()


def test_run_is_the_chain_of_stages(spark):
    found = corpus_pipeline.run(spark, cases.SF)
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, cases.SF).collect(), stage(spark, docs, cases.SF).schema)
    assert cases.rows_of(found) == cases.rows_of(docs)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = cases.docs(spark)
    kept = stage(spark, docs, cases.SF)
    if name != "sharding":
        assert kept.columns == docs.columns
    assert 0 < kept.count() <= len(cases.ROWS)
    assert stage(spark, cases.empty(spark), cases.SF).isEmpty()
