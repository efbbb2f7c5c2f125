"""A shared folder for what a query writes while it runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leafmill.operators.common import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/leafmill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read from there, for tables that several operators read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
