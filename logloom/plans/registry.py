"""Registered queries: each is a Spark callable and, where SQL can say it, an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as the reader splits it; text tables are dealt to ``logloom.spread`` tasks where the session sets that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = int(spark.conf.get(SPREAD_CONF, "0"))
    return df.repartition(spread) if spread and name in SPREAD else df


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, parts: int | None = None) -> DataFrame:
    """A given table dealt by ``key`` once, before its texts are taken apart into lines and words.

    What goes by the key from there on lies together, and the texts are what is shuffled, not their words. The parts become more with
    the input, as a text's words take many times its room.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (parts or PARTS) * df.rdd.getNumPartitions())
    return df.repartition(n, key)


#: Parts for each one the reader makes.
PARTS = 8
#: For files of one row group, which one task would read alone. Off unless set.
SPREAD_CONF = "logloom.spread"
# Tables whose rows carry texts that are parsed or matched row by row.
SPREAD = ("events", "documents", "pages")
