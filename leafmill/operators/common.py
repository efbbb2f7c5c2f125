"""Building blocks that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def assemble(df: DataFrame, keys: list[str], order: list[str], text: str, sep: str, name: str = "text") -> DataFrame:
    """One row per key: the texts in order, joined by sep. Null texts are dropped."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return df.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["_t"]), sep).alias(name))


def distinct_ordered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per distinct keys, the one that comes first by order, with all columns."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in cols]).select(*df.columns)


def first_n(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """name: 1, 2, ... inside each key by order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where the session names none and runs in one process, a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafmill-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that lineage ends."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read from there, for loops of joins.

    What checkpoint() returns keeps the estimates and constraints of the plan behind it, and those of joins grow with every round.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/leafmill/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
