"""A training-data pipeline: five stages, each written as Parquet and read again as the next one's input.

All stages keep null and empty texts as their operators do: the classifier scores them like any other, lines
and near duplicates leave them alone, packing gives them their end id.  Rows that repeat an id are judged
each by the classifier, lose the same lines, and are one node of the join.  An empty table gives an empty table.
Columns beyond those of documents stay until packing, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigplane.llm import jaccard, lines, packing, pii, quality, storage

_SCOPE = "pipeline"
#: For near duplicates among documents: shingles of five words, similarity in percent.
SHINGLE, PERCENT = 5, 80


def _begin(spark: SparkSession) -> None:
    """The stage before has been written by now, so its tables can go.  One pipeline runs per application."""
    storage.release(spark, _SCOPE)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    _begin(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line covers; ``n_chars`` follows the text."""
    _begin(spark)
    with storage.scope(_SCOPE):
        return _counted(lines.dedup_lines(docs, counts=False))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of the least id."""
    _begin(spark)
    with storage.scope(_SCOPE):
        found = jaccard.join(docs, words_each=SHINGLE, percent=PERCENT)
        others = found.where("component_id <> doc_id").select("doc_id").distinct()
        return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal numbers, dates, mail names and secrets are pseudonyms."""
    _begin(spark)
    spans = f"spans_{uuid.uuid4().hex}"  # so that a column of the documents' own stays
    return _counted(pii.protect(docs, spans_col=spans).drop(spans))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in full sequences, with their ids and the crc32 of these."""
    _begin(spark)
    with storage.scope(_SCOPE):
        pieces = packing.pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality", good),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("pii", with_pseudonyms),
    ("packing", packed),
]

#: A model, a tokenizer and connected components have no twin in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{storage.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}"), True)
    _begin(spark)
    return docs
