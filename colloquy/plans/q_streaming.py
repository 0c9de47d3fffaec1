"""Streaming jobs over the event table written as JSON lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import stage
from colloquy import views as V
from colloquy.operators import aggregates as A
from colloquy.plans.registry import query
from colloquy.streaming import events as E

CAP_MICRO = 1_500_000
#: Rows of one file of events.
FILE_ROWS = 250_000

_EV = """
    ev AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS job_id,
                  CASE event_type WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'usage' WHEN 'view' THEN 'warning' WHEN 'error' THEN 'error' ELSE 'done' END AS event,
                  'step_' || (event_id % 7) AS step, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 101 END AS pct,
                  CASE WHEN event_id % 5 = 0 THEN event_id % 900 END AS eta_seconds, CASE WHEN event_id % 2 = 0 THEN 'slow' ELSE 'noise' END AS code,
                  'p' || (event_id % 2) AS provider, 'm' || (event_id % 3) AS model, event_id % 1000 AS input_tokens, event_id % 500 AS output_tokens, CAST(floor(value * 100) AS BIGINT) AS cost_micro
           FROM events)"""


def event_folder(spark, sf) -> str:
    """The event table as JSON lines in the shared folder, in the table's own partitions."""
    path = stage.fresh_path(spark, "engine-events")
    e = F.col("event_id")
    kind = F.col("event_type")
    V.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.col("user_id").alias("job_id"),
        F.when(kind == "click", "progress").when(kind == "purchase", "usage").when(kind == "view", "warning").when(kind == "error", "error").otherwise("done").alias("event"),
        F.concat(F.lit("step_"), (e % 7).cast("string")).alias("step"), F.when(e % 3 != 0, (e % 101).cast("double")).alias("pct"),
        F.when(e % 5 == 0, (e % 900).cast("double")).alias("eta_seconds"), F.when(e % 2 == 0, "slow").otherwise("noise").alias("code"),
        F.concat(F.lit("p"), (e % 2).cast("string")).alias("provider"), F.concat(F.lit("m"), (e % 3).cast("string")).alias("model"),
        (e % 1000).alias("input_tokens"), (e % 500).alias("output_tokens"), F.floor(F.col("value") * 100).cast("long").alias("cost_micro"),
    ).write.option("maxRecordsPerFile", FILE_ROWS).json(path)
    return path


def _events(spark, sf):
    return E.read_events(spark, event_folder(spark, sf))


@query("src_events_jsonl", f"WITH {_EV} SELECT job_id, event, step, cost_micro, code FROM ev")
def src_events_jsonl(spark, sf):
    return E.collect_stream(_events(spark, sf).select("job_id", "event", "step", "cost_micro", "code"), "events")


@query("st_latest_progress", f"""
    WITH {_EV} SELECT job_id, arg_max(step, ts) AS step, CAST(arg_max(pct, ts) FILTER (pct IS NOT NULL) AS DOUBLE) AS pct, CAST(arg_max(eta_seconds, ts) FILTER (eta_seconds IS NOT NULL) AS DOUBLE) AS eta_seconds
    FROM ev WHERE event = 'progress' GROUP BY 1""")
def st_latest_progress(spark, sf):
    return E.keep_latest(E.latest_progress(_events(spark, sf)), ["job_id"], "progress")


@query("st_usage_totals", f"""
    WITH {_EV} SELECT strftime(ts, '%Y-%m') AS month, provider, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM ev WHERE event = 'usage' GROUP BY 1, 2, 3""")
def st_usage_totals(spark, sf):
    return E.keep_latest(E.usage_totals(_events(spark, sf)), ["month", "provider", "model"], "usage")


@query("st_budget_alert", f"""
    WITH {_EV} SELECT strftime(ts, '%Y-%m') AS month, sum(cost_micro) > {CAP_MICRO} AS crossed FROM ev WHERE event = 'usage' GROUP BY 1 HAVING sum(cost_micro) > {CAP_MICRO}""")
def st_budget_alert(spark, sf):
    return E.budget_alerts(_events(spark, sf), CAP_MICRO).select("month", (F.col("spent_micro") > CAP_MICRO).alias("crossed"))


@query("st_eta", f"""
    WITH {_EV}, f AS (SELECT job_id, min(ts) AS start, count(*) * 10000.0 AS total FROM ev GROUP BY 1)
    SELECT job_id, CAST(pct AS DOUBLE) AS pct, round(CASE WHEN eta_seconds IS NULL AND (pct IS NULL OR pct < 100) THEN greatest(total - epoch(ts - start), 0) ELSE eta_seconds END, 3) AS eta_seconds
    FROM ev JOIN f USING (job_id) WHERE event = 'progress'""")
def st_eta(spark, sf):
    totals = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("job_id")).agg((F.count(F.lit(1)) * F.lit(10000.0)).alias("total_seconds"))
    return E.etas(_events(spark, sf), totals).select("job_id", "pct", F.round("eta_seconds", 3).alias("eta_seconds"))


@query("st_partial_chunks", """
    WITH c AS (SELECT user_id AS job_id, event_id AS chunk, event_type AS label, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'N' || event_id END AS name, value FROM events)
    SELECT job_id, 'speaker' AS kind, label AS item, coalesce(arg_max(name, chunk) FILTER (name <> ''), '') AS value FROM c GROUP BY job_id, label
    UNION ALL SELECT job_id, 'term', lower(label), label FROM c GROUP BY job_id, label
    UNION ALL SELECT job_id, 'meta', 'title', coalesce(arg_min(name, chunk) FILTER (name <> ''), '') FROM c GROUP BY 1
    UNION ALL SELECT job_id, 'meta', 'input_tokens', CAST(count(*) AS VARCHAR) FROM c GROUP BY 1
    UNION ALL SELECT job_id, 'meta', 'output_tokens', CAST(2 * count(*) AS VARCHAR) FROM c GROUP BY 1
    UNION ALL SELECT job_id, 'meta', 'cost_micro', CAST(3 * count(*) AS VARCHAR) FROM c GROUP BY 1""")
def st_partial_chunks(spark, sf):
    path = stage.fresh_path(spark, "chunk-results")
    name = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("N"), F.col("event_id").cast("string")))
    rows = V.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("chunk"), F.col("event_type").alias("label"), name.alias("name"))
    rows.write.option("maxRecordsPerFile", FILE_ROWS).json(path)
    stream = spark.readStream.schema("job_id long, chunk long, label string, name string").option("maxFilesPerTrigger", 256).json(path)

    def merge(df):
        return A.merge_chunks(
            df.select("job_id", "chunk", "label", "name"), df.select("job_id", "chunk", F.lit(0).alias("pos"), F.col("label").alias("term")),
            df.select("job_id", "chunk", F.col("name").alias("title"), F.lit(1).cast("long").alias("input_tokens"), F.lit(2).cast("long").alias("output_tokens"), F.lit(3).cast("long").alias("cost_micro")))

    return E.partial_merges(stream, merge)


@query("st_latest_outcome", f"""
    WITH {_EV} SELECT job_id, arg_max(event, ts) FILTER (event <> 'warning') AS outcome, count(*) FILTER (event = 'warning') AS warnings, count(*) FILTER (event = 'warning' AND code = 'slow') AS slow_warnings
    FROM ev WHERE event IN ('done', 'error', 'warning') GROUP BY 1""")
def st_latest_outcome(spark, sf):
    return E.keep_latest(E.latest_outcome(_events(spark, sf)), ["job_id"], "outcome")


@query("st_dedup", f"WITH {_EV} SELECT DISTINCT job_id, step FROM ev WHERE event = 'usage'")
def st_dedup(spark, sf):
    return E.collect_stream(E.billed_once(_events(spark, sf)).select("job_id", "step"), "billed")
