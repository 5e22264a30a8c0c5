"""Reading the tables that the queries of this subpackage run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text) of documents and the columns named; a null text is empty, other columns don't matter."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
