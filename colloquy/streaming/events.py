"""Structured Streaming jobs over engine events.

Running figures are native stateful aggregates in update mode. Their changed
rows go to a folder per micro-batch, which a repeated batch overwrites, and
the current table is the last row of each key. No watermark drops a late file:
the state holds one row per job, per month and model, or per billed step, which
is what the tables themselves hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import stage

EVENT = (
    "ts timestamp, job_id bigint, event string, step string, pct double, eta_seconds double, message string, code string, provider string, "
    "model string, input_tokens bigint, output_tokens bigint, cost_micro bigint"
)


#: Folders over which the chunks of jobs are dealt.
BUCKETS = 64


def read_events(spark: SparkSession, path: str, files_per_batch: int = 256) -> DataFrame:
    """Engine events from a folder of JSON lines (src_events_jsonl)."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])


def run_batches(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], mode: str, name: str) -> None:
    """Work through what is there and stop."""
    place = stage.fresh_path(stream.sparkSession, f"stream-{name}")
    query = (
        stream.writeStream.foreachBatch(on_batch).outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def keep_latest(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a stateful aggregate and give its current table."""
    spark = stream.sparkSession
    out = stage.fresh_path(spark, name)
    run_batches(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), "update", name)
    rows = [c for c in stream.columns if c not in keys]
    changes = spark.read.schema(_with_batch(stream.schema)).parquet(out)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rows), "batch").alias("r")).select(*keys, "r.*")


def latest_progress(events: DataFrame) -> DataFrame:
    """Latest step, share and rest time by job; a NULL keeps the old value (st_latest_progress)."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct("ts", "step"))
    return events.where(F.col("event") == "progress").groupBy("job_id").agg(
        *[F.max_by(c, known(c)).alias(c) for c in ("step", "pct", "eta_seconds")])


def usage_totals(events: DataFrame) -> DataFrame:
    """Calls, tokens and cost by month, provider and model (st_usage_totals)."""
    return (
        events.where(F.col("event") == "usage")
        .groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "provider", "model")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_micro").alias("cost_micro"))
    )


def latest_outcome(events: DataFrame) -> DataFrame:
    """Last final state by job, with its warnings counted (st_latest_outcome)."""
    final = F.when(F.col("event").isin("done", "error"), F.struct("ts", "event"))
    warned = F.col("event") == "warning"
    return events.where(F.col("event").isin("done", "error", "warning")).groupBy("job_id").agg(
        F.max_by("event", final).alias("outcome"), F.count_if(warned).alias("warnings"), F.count_if(warned & (F.col("code") == "slow")).alias("slow_warnings"))


def budget_alerts(events: DataFrame, cap_micro: int) -> DataFrame:
    """One row per month when its running spend crosses the cap (st_budget_alert).

    The totals are a stateful aggregate with map-side partials. A batch writes
    the changed months above the cap; a month's alert is its first such row.
    """
    spark = events.sparkSession
    out = stage.fresh_path(spark, "alerts")
    totals = events.where(F.col("event") == "usage").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("cost_micro").alias("spent_micro"))
    over = lambda df: df.where(F.col("spent_micro") > cap_micro)
    run_batches(totals, lambda df, n: over(df).write.mode("overwrite").parquet(f"{out}/batch={n}"), "update", "alerts-query")
    said = spark.read.schema(_with_batch(totals.schema)).parquet(out)
    return said.groupBy("month").agg(F.min_by("spent_micro", "batch").alias("spent_micro"))


def etas(events: DataFrame, totals: DataFrame) -> DataFrame:
    """Rest time on progress rows without one: expected total less elapsed (st_eta).

    ``totals``: job_id, total_seconds. A job starts with its first event, in
    whatever file that comes: a batch writes its progress rows and the first
    event of each of its jobs, and the rest times are reckoned from both tables
    when they are read.
    """
    spark = events.sparkSession
    rows_at, starts_at = stage.fresh_path(spark, "progress"), stage.fresh_path(spark, "starts")
    progress = lambda df: df.where(F.col("event") == "progress").select("job_id", "ts", "pct", "eta_seconds")

    def step(df: DataFrame, n: int) -> None:
        df.groupBy("job_id").agg(F.min("ts").alias("start")).write.mode("overwrite").parquet(f"{starts_at}/batch={n}")
        progress(df).write.mode("overwrite").parquet(f"{rows_at}/batch={n}")

    run_batches(events, step, "append", "eta-query")
    starts = spark.read.schema("job_id bigint, start timestamp, batch int").parquet(starts_at).groupBy("job_id").agg(F.min("start").alias("start"))
    rows = spark.read.schema(_with_batch(progress(events).schema)).parquet(rows_at).drop("batch")
    elapsed = F.greatest((F.unix_micros("ts") - F.unix_micros("start")) / F.lit(1_000_000.0), F.lit(0.0))
    needs = F.col("eta_seconds").isNull() & F.col("total_seconds").isNotNull() & (F.col("pct").isNull() | (F.col("pct") < 100))
    eta = F.when(needs, F.greatest(F.col("total_seconds") - elapsed, F.lit(0.0))).otherwise(F.col("eta_seconds"))
    return rows.join(starts, "job_id").join(totals, "job_id", "left").select("job_id", "ts", "pct", eta.alias("eta_seconds"))


def partial_merges(chunks: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Merged result of the jobs a batch of chunks touched, after every batch (st_partial_chunks).

    ``merge`` takes all chunk rows so far of those jobs. Gives each job's last
    merge; a repeated batch writes the same rows again.
    """
    spark = chunks.sparkSession
    seen, out = stage.fresh_path(spark, "chunks"), stage.fresh_path(spark, "merged")
    schema = chunks.schema
    found = {}

    def step(df: DataFrame, n: int) -> None:
        # a job's chunks lie in the folder of its bucket; only the buckets that the batch touches are read
        dealt = df.withColumn("bucket", F.pmod(F.hash("job_id"), F.lit(BUCKETS)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{seen}/batch={n}")
        rows = spark.read.schema(T.StructType([*_with_batch(schema).fields, T.StructField("bucket", T.IntegerType())])).parquet(seen)
        here = rows.where(F.col("batch") == n)
        buckets = [r[0] for r in here.select("bucket").distinct().collect()]  # at most BUCKETS
        touched = here.select("job_id").distinct()
        so_far = rows.where((F.col("batch") <= n) & F.col("bucket").isin(buckets)).drop("batch", "bucket")
        merged = merge(so_far.join(touched, "job_id", "left_semi"))
        found["schema"] = merged.schema
        merged.write.mode("overwrite").parquet(f"{out}/batch={n}")

    run_batches(chunks, step, "append", "chunk-query")
    merged = spark.read.schema(_with_batch(found["schema"])).parquet(out)
    last = merged.groupBy("job_id").agg(F.max("batch").alias("batch"))
    return merged.join(last, ["job_id", "batch"], "left_semi").drop("batch")


def billed_once(events: DataFrame) -> DataFrame:
    """Usage events without the repeats of a rerun, however late either comes (st_dedup).

    The state is one key per billed step, as the ledger itself.
    """
    return events.where(F.col("event") == "usage").dropDuplicates(["job_id", "step"])


def collect_stream(stream: DataFrame, name: str) -> DataFrame:
    """Append a stream to a table and give the table."""
    spark = stream.sparkSession
    out = stage.fresh_path(spark, name)
    run_batches(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), "append", name)
    return spark.read.schema(_with_batch(stream.schema)).parquet(out).drop("batch")
