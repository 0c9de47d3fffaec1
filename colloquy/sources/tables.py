"""Stored tables, files and case folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = (
    "usage_id bigint, job_id bigint, provider string, model string, step string, input_tokens bigint, output_tokens bigint, "
    "cost_micro bigint, created_at timestamp_ntz, month string"
)
EVAL_CASES = "name string, transcript string, expected_terms array<string>, expected_speakers array<string>, forbidden_substrings array<string>"


def append_usage(rows: DataFrame, path: str) -> None:
    """Append to the ledger, kept in a folder per month (sink_usage_append)."""
    (
        rows.withColumn("month", F.date_format("created_at", "yyyy-MM")).repartition("month", F.expr("pmod(hash(usage_id), 4)"))
        .write.mode("append").partitionBy("month").parquet(path)
    )


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with a fixed schema; a column an older file lacks reads as NULL (src_library_tables)."""
    return spark.read.schema(USAGE).parquet(path)


def job_costs(jobs: DataFrame, usage: DataFrame) -> DataFrame:
    """Ledger totals written back to the jobs."""
    total = usage.where(F.col("job_id").isNotNull()).groupBy(F.col("job_id").alias("id")).agg(F.sum("cost_micro").alias("cost_micro"))
    return jobs.join(total, "id", "left").withColumn("cost_micro", F.coalesce("cost_micro", F.lit(0).cast("long")))


def read_eval_cases(spark: SparkSession, path: str, one_document_per_file: bool = True) -> DataFrame:
    """Quality cases of a folder (src_eval_cases)."""
    return spark.read.schema(EVAL_CASES).json(path, multiLine=one_document_per_file)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of a folder's files; contents are never read (src_files)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
