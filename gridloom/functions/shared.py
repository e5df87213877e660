"""Tables written to the shared folder, distributed ids and connected components."""

from __future__ import annotations

import contextlib
import itertools
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a fresh local folder where it is unset and Spark itself is local."""
    global _local
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _local = _local or tempfile.mkdtemp(prefix="gridloom-")
    return f"file://{_local}"


@contextlib.contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own below the shared one, deleted with all that is in it when the block ends, however it ends."""
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        store, root = fs.FileSystem.from_uri(path)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def settle(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to spark.sql.shuffle.partitions tasks: files of few bytes are one task, however much is made of their rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dense_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """df with consecutive numbers in the given order, without bringing all rows into one task.

    Rows are dealt out by ranges, numbered inside each range, and shifted by the ranges before; only
    a count for each range reaches the driver.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("gl_part", F.spark_partition_id()), "ranged")
    sizes = sorted(map(tuple, ranged.groupBy("gl_part").count().collect()))
    before = dict(zip((p for p, _ in sizes), itertools.accumulate([start] + [n for _, n in sizes]), strict=False))
    numbered = ranged.withColumn("gl_row", F.row_number().over(Window.partitionBy("gl_part").orderBy(*order)) - 1)
    if not before:
        return numbered.withColumn(name, F.lit(0).cast("long")).drop("gl_part", "gl_row")
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("gl_part"))
    return numbered.withColumn(name, (F.col("gl_row") + offset).cast("long")).drop("gl_part", "gl_row")


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (a, b, of one orderable type): the component's smallest node.

    Each round takes the smallest label around a node and then that label's own label, so the number
    of rounds grows with the logarithm of a component's diameter.
    """
    pairs = edges.filter("a <> b").select("a", "b")
    both = settle(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = settle(labels, "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "m").alias("low"))
        of = labels.select(F.col("node").alias("low"), F.col("label").alias("its"))
        labels = settle(lower.join(of, "low").select("node", F.col("label").alias("was"), F.least("low", "its").alias("label")), "labels")
        if labels.filter("label <> was").isEmpty():
            return labels.select("node", "label")
