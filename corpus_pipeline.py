"""The corpus pipeline: stages over ``documents``, each an operator of ``logloom.llm``, and the operators' queries.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. ``run`` writes each result as Parquet in the shared folder and
reads it again for the next stage. Sampling, isolation trees, block draws and packing cannot be stated in SQL, so
``ORACLE_SQL`` is None and the stages are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import jaccard_join, mixing, packing, pii, quality
from logloom.llm import queries as llm_queries
from logloom.llm.common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the forest reject go."""
    stats = Scratch(spark, "stage3").write(quality.rule_statistics(docs), "stats")
    forest, threshold = quality.train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, forest, threshold)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays: the one with the smallest id."""
    scratch = Scratch(spark, "stage10")
    return jaccard_join.one_per_group(docs, jaccard_join.join(docs, scratch), scratch)


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _measured(pii.redact(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, a row per document and block, shard by shard; a document taken twice comes twice."""
    return mixing.mixture(docs, Scratch(spark, "stage9"))


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.pack(docs, Scratch(spark, "stage8"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixing),
    ("packing", retrieval_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    scratch = Scratch(spark, "pipeline")
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        df = scratch.write(stage(spark, df, sf_dir), name.replace(" ", "-"))
    return df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return llm_queries.queries() | {"pipeline": run}


def oracles() -> dict[str, str]:
    return llm_queries.oracles() | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
