"""The corpus pipeline: from documents to tokens, a stage for each of five operators.

Every stage works on all that the one before it kept, and its decisions take effect: rejected documents go, one document
of each group of near duplicates stays, secrets are blotted out, sources are brought to their targets by dropping and
repeating whole documents, and what is left is encoded.

Defined results: nulls in any column, empty and very long texts get the results that each operator states (a null doc_id
is a document of its own and stays); of repeated rows and ties of a group the first by doc_id and text stays; documents
without words are never taken by the mix; columns beyond those of documents are dropped at the first stage, whatever
their names; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import bpe, mixing, quality, secrets, simhash
from talweg.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return model.apply(docs.select(*COLUMNS)).where(F.col("score") >= threshold).select(*COLUMNS)


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their secrets."""
    forest = secrets.fit(secrets.example_findings(spark), secrets.dictionary(docs))
    return secrets.redact(docs.select(*COLUMNS), forest).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it."""
    mixed = mixing.mix(docs.select(*COLUMNS), packet=None).where("taken > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.expr("cast(taken div size AS int)"))).alias("_pass")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids."""
    return bpe.encode(docs.select("doc_id", "source", "text"), carry=["doc_id", "source"]).select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("near_duplicates", dedupe),
    ("secrets", redact),
    ("mixing", mix),
    ("tokens", encode),
]
#: The stages learn, cluster and encode: SQL does not express them. tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
