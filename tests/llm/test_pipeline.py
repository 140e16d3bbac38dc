"""Every stage of the pipeline on its own input, and the SQL twins of the queries."""

import os
import uuid

import duckdb
import pytest
from planted import make, prose
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tabscout.functions.lineage import shared_folder
from tabscout.llm.oracles import ORACLES
from tabscout.llm.queries import REGISTRY
from test_minhash import brute as groups
from test_substring import brute as repeats

SF = "/root/testdata/sf0.001"


def test_stages_on_planted_documents(spark, tmp_path):
    passage, body = prose(9, 60), [prose(i, 150) for i in range(6)]
    near = body[0].split()
    near[75] = "changed"
    texts = [*body, " ".join(near), body[1], prose(20, 80) + " " + passage, prose(21, 80) + "\n" + passage + "\n" + prose(22, 20), None, ""]
    docs = make(spark, texts)
    columns = docs.columns
    kept = pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = {i for i, c in groups(rows, 5).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == expected == set(range(len(texts))) - {6, 7}
    cut = pipeline.substring_dedup(spark, kept, SF)
    assert cut.columns == columns
    marks = {i: sum(m) for i, _, m in repeats([(r.doc_id, r.text) for r in kept.collect()], pipeline.PASSAGE)}
    before = {r.doc_id: r for r in kept.collect()}
    for r in cut.collect():
        gone = len((before[r.doc_id].text or "").split()) - len((r.text or "").split())
        assert gone == marks[r.doc_id]
        assert r.text == before[r.doc_id].text or gone and r.n_chars == len(r.text)
    assert marks[9] == 60 and sum(marks.values()) == 60
    mixed = pipeline.mixing(spark, cut, SF)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= expected
    packed = pipeline.packing(spark, mixed, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    """A text is not lost because another row with its id is a copy; of equal rows one stays."""
    a, own = prose(31, 120), prose(32, 120)
    docs = make(spark, [(1, a), (5, a), (5, own), (7, own), (9, prose(33, 90)), (9, prose(33, 90)), (None, prose(34, 80)), (None, a)])
    kept = pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert found == sorted([(1, a), (5, own), (9, prose(33, 90)), (None, prose(34, 80))], key=repr)
    texts = [(3, prose(40 + i, 30 + 60 * i)) for i in range(40)]
    docs = make(spark, texts)
    mixed = pipeline.mixing(spark, docs, SF)
    drawn = {(r.doc_id, r.source, r.lang, r.topic): r.kept for r in pipeline.mix(docs).collect()}
    topics = docs.withColumn("t", pipeline.form_topic(F.col("text"))).collect()
    want = sorted(r.text for r in topics if drawn[r.doc_id, r.source, r.lang, r.t])
    assert sorted(r.text for r in mixed.collect()) == want


def test_quality_stage_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    toxic = [r.doc_id for r in labels if r.toxic == 1]
    assert sum(i in ids for i in good) / len(good) > 0.97
    assert sum(i in ids for i in toxic) / len(toxic) < 0.15


def test_run(spark):
    packed = pipeline.run(spark, SF)
    assert packed.count() > 0
    assert packed.agg(F.max("length")).first()[0] <= 2048


def test_empty_documents(spark, no_docs):
    docs = no_docs
    for name, stage in pipeline.STAGES:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    found = REGISTRY[name](spark, SF)
    names = sorted(found.columns)
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    twin = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, twin))
