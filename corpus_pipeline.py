"""A training-data pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, folder) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bpe import encode_documents
from tallyloom.llm.ngram_join import JaccardRule, one_per_component
from tallyloom.llm.quality import keep_good
from tallyloom.llm.queries import VOCABULARY
from tallyloom.llm.secret_scan import redact_secrets
from tallyloom.llm.tables import table
from tallyloom.llm.tiling import without_leaks
from tallyloom.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs.select(*COLUMNS), table(spark, folder, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group linked by five-word shingles (Jaccard 0.8 or more) the smallest doc_id stays."""
    return one_per_component(docs.select(*COLUMNS), JaccardRule(words=5, num=80, den=100))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that contain half of a benchmark item, in whatever order, go."""
    return without_leaks(docs.select(*COLUMNS), table(spark, folder, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets are masked in the text."""
    return redact_secrets(docs.select(*COLUMNS))


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids of each text, their digest and that of the decoded text."""
    coded = encode_documents(docs, VOCABULARY, with_ids=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("ids").alias("token_ids"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

# The classifier is fitted, and its scores are no SQL; tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, folder, "documents", *COLUMNS)
    for number, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, folder)
        if number < len(STAGES):
            docs = cut_lineage(docs)
    return docs
