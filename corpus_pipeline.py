"""From raw documents to a training mix, in five stages.

Each stage gets the session, the documents that its predecessor kept, and the
folder of the other tables; it returns documents with the same columns (the
last one adds `taken` and `first_slot`).  Every stage's rows are written as Parquet and read
again, so a lost executor never costs more than one stage; the tables between
the stages go as soon as their successor is written.

The results rest on hashes and on a trained order of texts that SQL does not
have, so ORACLE_SQL is None; tests compare the stages with brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempoweave.llm._store import drop, shared_folder, written
from tempoweave.llm.decontaminate import drop_contaminated
from tempoweave.llm.jaccard_join import similar_documents
from tempoweave.llm.mixing import mix_sources
from tempoweave.llm.quality import quality_rules
from tempoweave.llm.secrets import redact_secrets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, _table(spark, sf_dir, "labels"), carry=True).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one with the least id.

    Of rows that share an id one stays, the first by their columns; rows without an id are linked with nothing and stay.
    """
    first = similar_documents(docs).filter("component_id = doc_id").select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi")
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*(c for c in docs.columns if c != "doc_id")))
        kept = kept.select(place.alias("_place"), F.struct(*docs.columns).alias("_row")).filter("_place = 1").select("_row.*")
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with the number of these words (repeats counted) and the slot that reads them first.

    Columns `taken` and `first_slot` of the documents are replaced.
    """
    docs = docs.drop("taken", "first_slot")
    return mix_sources(docs, carry=True).filter("taken > 0").select("row.*", "taken", "first_slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    *before, (_, last) = STAGES
    for k, (_, stage) in enumerate(before):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop(spark, f"{folder}/{k - 1}")
    out = written(last(spark, docs, sf_dir), "corpus-mix")
    drop(spark, folder)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
