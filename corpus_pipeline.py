"""A training corpus from raw documents: language, quality, near copies, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import crf, langid, ngram_join, packing, secrets
from cairn.llm.common import checkpoint, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the table's labels teach; null, empty and letterless texts go.

    A row is judged by its own text: null and repeated ids and further columns, whatever their names, stay as they are.
    """
    return langid.keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which content lines are the larger part; null and empty texts go. Null and repeated ids stay."""
    return crf.keep_content(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that n-gram similarity connects, and all without a group.

    Rows with a null id or without words stay. Of a repeated id only the row whose own text is in a group goes.
    """
    return ngram_join.drop_similar(docs)


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret; null and empty texts stay as they are."""
    return secrets.redact(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training windows; null and empty texts have no piece."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("language", language), ("quality", quality), ("near copies", near_copies), ("secrets", secret_values), ("packing", windows)]

#: Models, a metric-space join and packing can't be put in SQL: tests hold run() against the plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is checkpointed, as the next one reads it more than once.

    An empty table gives no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
