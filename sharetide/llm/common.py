"""What the operators' queries share: registration, tables, tokenizer files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Arrow batches by bytes, not only by rows: long texts would otherwise make batches of any size.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def op_query(name: str, sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tuned(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer(name: str) -> str:
    """Path of an installed public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    Its cleaner acts when the driver's JVM drops the plans that own them, which in a small driver heap
    may take long.  Results never depend on it: finished steps are written tables.
    """
    import gc
    import time

    for _ in range(2):  # the second round meets what the cleaner let go after the first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
