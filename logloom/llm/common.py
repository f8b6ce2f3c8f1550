"""Helpers shared by the training-data operators: scratch tables, input shaping, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import by_merge, ensure_checkpoint_dir

#: White space of the word rule ``[^\x20\x09-\x0D]+``; also what ``bytes.split()`` splits at.
SPACES = b" \t\n\x0b\x0c\r"


BATCH_ROWS = 1000


class Scratch:
    """Parquet tables of one job under the folder the cluster names in ``spark.checkpoint.dir``.

    A table written here ends the lineage, is seen by every executor and survives the loss of any of them. The session
    hands texts to Python ``BATCH_ROWS`` rows at a time from then on: documents can be long, and executors small.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        self.root = f"{ensure_checkpoint_dir(spark)}/{job}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def drop(self, name_or_path: str) -> None:
        """Delete one table (its path) of this job through Spark's own file system layer."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(name_or_path)
        p.getFileSystem(conf).delete(p, True)


def with_columns_checked(df: DataFrame, *names: str) -> DataFrame:
    """``df`` if it has the columns, else a clear error."""
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ValueError(f"missing columns {gone}; the table has {df.columns}")
    return df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    name = base
    while name in df.columns:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [b"" if v is None else v for v in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (id, component), component the smallest id.

    Alternating large-star and small-star rounds: every vertex is tied to the smallest vertex it sees, until no edge
    changes. A round is two group-by minima and joins on the vertex; no vertex's neighbours are gathered in one row, and no
    side of a join goes through the driver.
    Only vertices of an edge come out; null ends and loops are ignored; no edges give no rows.
    """
    cur = scratch.write(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.join(by_merge(low), "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: the smaller neighbours of a vertex, and the vertex, go to the smallest of them
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(by_merge(small_min), "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small_min.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        nxt = scratch.write(small, "edges")
        state = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        mark = (state["n"], state["h"])
        cur = nxt
        if mark == before:
            stars = cur.groupBy("u").agg(F.min("v").alias("component"))
            return stars.select(F.col("u").alias("id"), "component").unionByName(
                stars.select(F.col("component").alias("id"), "component").distinct())
        before = mark
    raise RuntimeError("components did not settle")
