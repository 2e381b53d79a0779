"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.llm import decontaminate, language, pieces, private, similar
from palaver.llm.common import fresh, prepare, shared_folder, table
from palaver.llm.queries import MODEL

MIN_LANGUAGE_SCORE = 0.3
# The stage works on shingles of five words and a similarity of 0.8; op3's own 3 and 90 bind that query only.
NEAR_SIZE = 5
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with some confidence; ``lang`` stays as given."""
    prepare(spark)
    found = language.identify(docs, language.train(docs))
    kept = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.filter(kept).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of similar documents, once. Rows without an id stay."""
    prepare(spark)
    groups = similar.similar_components(docs, size=NEAR_SIZE, percent=NEAR_PERCENT)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi")
    # Repeated rows of one id: the join has brought them together already.
    number = fresh(docs.columns, "_number")
    first = W.partitionBy("doc_id").orderBy("doc_id")
    once = chosen.withColumn(number, F.row_number().over(first)).filter(F.col(number) == 1).select(*docs.columns)
    return once.unionByName(docs.filter(F.col("doc_id").isNull()))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of test items; documents that are mostly such passages go."""
    prepare(spark)
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.remove_contamination(found).select(*docs.columns)


def remove_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and what discloses it, replaced."""
    prepare(spark)
    found = private.find_private(docs)
    return found.withColumn("text", private.sanitise(F.col("text"), F.col("spans"))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ``ids`` of their texts."""
    prepare(spark)
    return pieces.encode(docs, pieces.Vocabulary.load(MODEL))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("private", remove_private),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept below the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return result
        result.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
