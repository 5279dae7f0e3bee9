"""The stages of the pipeline on a small folder, and all registered queries' statements."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempoweave.llm import queries
from tempoweave.llm.quality import quality_rules
from tests.llm import brute
from tests.oracle import rows, want

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    read = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    kept = corpus_pipeline.quality(spark, docs, FOLDER)
    texts = read(kept)
    failed = brute.counts(read(docs))
    assert kept.columns == docs.columns and 0 < len(texts) < docs.count() and not any(failed[i][-1] for i, _ in texts)
    single = corpus_pipeline.near_duplicates(spark, kept, FOLDER)
    assert {i for i, _ in read(single)} == {i for i, (_, c) in brute.components(texts).items() if i == c}
    clean = corpus_pipeline.decontamination(spark, single, FOLDER)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {i for i, _ in read(clean)} == {i for i, x in brute.leaks(read(single), items).items() if not x[-1]}
    bare = corpus_pipeline.secrets(spark, clean, FOLDER)
    assert bare.columns == docs.columns and bare.count() == clean.count() and not any(brute.secrets(t) for _, t in read(bare))
    mixed = corpus_pipeline.mixing(spark, bare, FOLDER)
    assert mixed.columns == [*docs.columns, "taken", "first_slot"] and mixed.filter("taken <= 0").count() == 0
    assert sorted(read(corpus_pipeline.run(spark, FOLDER))) == sorted(read(mixed))


def test_stages_of_repeated_and_missing_ids(spark):
    """Rows without an id go through all stages; of rows that share an id one stays; columns of the mix's names are replaced."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("length(text) > 400").limit(3).withColumn("taken", F.lit("x"))
    first = docs.orderBy("doc_id").limit(1)
    rows = docs.unionByName(first).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality_rules(rows, labels, carry=True).select("row.*")
    assert kept.columns == rows.columns and kept.count() == 7
    single = corpus_pipeline.near_duplicates(spark, rows, FOLDER)
    assert single.filter("doc_id IS NULL").count() == 3 and single.filter("doc_id IS NOT NULL").count() == single.select("doc_id").distinct().count() - 1
    assert corpus_pipeline.decontamination(spark, rows.withColumn("text", F.lit("clean words only")), FOLDER).count() == 7
    assert corpus_pipeline.secrets(spark, rows, FOLDER).count() == 7
    mixed = corpus_pipeline.mixing(spark, rows, FOLDER)
    assert mixed.columns == [*(c for c in docs.columns if c != "taken"), "taken", "first_slot"] and dict(mixed.dtypes)["taken"] == "bigint"
    assert mixed.filter("taken > 3 * size(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''))").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_statement(spark, name):
    assert rows(queries.queries()[name](spark, FOLDER).toPandas()) == rows(want(queries.oracle_sql()[name], FOLDER))
