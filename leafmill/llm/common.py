"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of what separates words: space and the ASCII controls tab to carriage return.
GAP = "[ \\t-\\r]+"
_GAP = re.compile(rb"[ \t-\r]")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """array<string> of the words; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder from spark.checkpoint.dir. Only where the session names none and runs in one process, a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafmill-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there, so that lineage ends and lost executors cost nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, **options) -> DataFrame:
    """df written as Parquet (with the writer's options) to the shared checkpoint folder and read from there: compressed, for wide rows and texts."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, like `name`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blocks_of(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes that end between words, so that very long texts need little memory."""
    at = 0
    while len(data) - at > size:
        gap = _GAP.search(data, at + size)
        if gap is None:
            break
        yield data[at : gap.start()]
        at = gap.end()
    yield data[at:] if at else data


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): (node, component), component being the smallest reachable node.

    Each round takes the smallest label among neighbours, then the label's own label. Both sides of each join are read from the
    checkpoint folder, so adaptive execution can split the rows of a node with very many links; minima combine before the shuffle.
    Nodes without an edge are absent; null ends and self-links are ignored.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    both = cut(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "component")
        low = cut(labels.unionAll(near).groupBy("node").agg(F.min("component").alias("component")))
        up = low.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        new = cut(low.join(up, "component").select("node", F.col("higher").alias("component")))
        moved = new.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        labels = new
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
