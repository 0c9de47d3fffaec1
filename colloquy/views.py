"""Input tables of the engine, derived from the driver's tables by expressions.

Media time is BIGINT milliseconds, so running sums are exact. Views that need
an ordered pass are written once to the shared folder (``stage.cut_once``)
and read from there by every query, as a stored segments table would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import stage
from colloquy.functions.cost import catalogue, with_token_cost
from colloquy.operators.ordered import Step, scan


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Library rows, one per order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        key.alias("id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED")
        .when(F.col("o_orderstatus") == "O", "RUNNING")
        .otherwise("FAILED").alias("status"),
        F.col("o_orderpriority").alias("mode"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("duration_total"),
        F.concat(F.lit("/rec/"), cust.cast("string"), F.lit("/"), key.cast("string"), F.lit(".mp4")).alias("source_path"),
        cust.alias("owner_id"),
        F.col("o_totalprice").alias("price"),
    )


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    words = F.size(F.split("text", " ")).cast("long")
    timed = table(spark, sf, "conversations").select(
        conv.cast("long").alias("job_id"),
        turn.cast("long").alias("seq"),
        F.when(F.col("role") == "user", "SPEAKER_00").when(F.col("role") == "assistant", "SPEAKER_01").alias("speaker"),
        "text",
        F.when(F.col("role") == "system", F.lit(500).cast("long"))
        .otherwise(F.greatest(F.floor(words * 1000 / F.lit(3)), F.lit(1000).cast("long"))).alias("dur_ms"),
        ((turn % 4) * 500).alias("gap_ms"),
        (-((conv * 31 + turn * 17) % 150) / F.lit(100.0)).alias("avg_logprob"),
        (((conv * 7 + turn * 13) % 100) / F.lit(100.0)).alias("no_speech_prob"),
        (F.lit(1.0) + ((conv * 11 + turn * 5) % 30) / F.lit(10.0)).alias("compression_ratio"),
    )
    timed = scan(timed, [Step("start_ms", "sum_before", F.col("dur_ms") + F.col("gap_ms"))])
    return timed.withColumn("end_ms", F.col("start_ms") + F.col("dur_ms")).select(
        "job_id", "seq", "start_ms", "end_ms", "speaker", "text",
        "avg_logprob", "no_speech_prob", "compression_ratio",
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Timed segments, one per conversation turn."""
    return stage.cut_once(spark, sf, "segments", lambda: _segments(spark, sf))


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of ``segments`` with equal shares of the segment's duration."""
    parts = F.split("text", " ")
    step = F.floor((F.col("end_ms") - F.col("start_ms")) / F.size(parts))
    return (
        segments(spark, sf)
        .select("job_id", "seq", "start_ms", step.cast("long").alias("step"), F.posexplode(parts).alias("pos", "word"))
        .select(
            "job_id", "seq", F.col("pos").cast("long").alias("pos"), "word",
            (F.col("start_ms") + F.col("pos") * F.col("step")).alias("start_ms"),
            (F.col("start_ms") + (F.col("pos") + 1) * F.col("step")).alias("end_ms"),
        )
    )


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), "event_id", "event_type", "props",
        F.struct("ts", "event_id").alias("at"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("long").alias("hour"),
        (F.lit(100) + (eid * 37) % 3000).alias("dur_ms"),
        ((eid * 53) % 2500).alias("gap_ms"),
    )
    ev = scan(
        ev,
        [
            Step("seq", "sum", F.lit(1).cast("long")),
            Step("start_ms", "sum_before", F.col("dur_ms") + F.col("gap_ms")),
        ],
        order="at",
        block=F.col("hour"),
    )
    return ev.select(
        "job_id", "seq", "event_id", "event_type", "props", "start_ms",
        (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
        F.concat(F.lit("SPEAKER_0"), (F.col("event_id") % 3).cast("string")).alias("speaker"),
    )


def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    return stage.cut_once(spark, sf, "turns", lambda: _turns(spark, sf))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Diarization turns, one per event of a user."""
    return _timeline(spark, sf).select("job_id", "seq", "start_ms", "end_ms", "speaker")


def captions(spark: SparkSession, sf: str) -> DataFrame:
    """The event timeline as decoder output: repeats, noise lines, clean text."""
    eid = F.col("event_id")
    return _timeline(spark, sf).select(
        "job_id", "seq", "start_ms", "end_ms",
        F.when(eid % 37 == 0, "...")
        .when(eid % 41 == 0, "Sous-titrage ST 501")
        .when(eid % 43 == 0, "Ok")
        .when((eid * 7) % 10 < 6, "C’est noté, merci.")
        .otherwise(F.concat_ws(" ", "event_type", "props")).alias("text"),
        F.when(eid % 29 != 0, F.lit(1.0) + (eid % 20) / F.lit(10.0)).alias("compression_ratio"),
        F.when((eid % 11 != 0) & (eid % 5 != 0), F.concat(F.lit("SPEAKER_0"), (eid % 2).cast("string"))).alias("speaker"),
        "event_id",
    )


def turns_conv(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that overlap ``segments``: shifted by 300 ms, speakers rotated."""
    return segments(spark, sf).select(
        "job_id", "seq",
        (F.col("start_ms") + 300).alias("start_ms"),
        (F.col("end_ms") + 300).alias("end_ms"),
        F.concat(F.lit("SPEAKER_0"), ((F.col("seq") + 1) % 3).cast("string")).alias("speaker"),
    )


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    kept = segments(spark, sf).where(F.col("seq") % 2 == 1).withColumn("dur", F.col("end_ms") - F.col("start_ms"))
    kept = scan(kept, [Step("trim_start", "sum_before", F.col("dur"))])
    return kept.select(
        "job_id", "seq", F.col("start_ms").alias("src_start"), F.col("end_ms").alias("src_end"),
        "trim_start", (F.col("trim_start") + F.col("dur")).alias("trim_end"),
    )


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Kept spans of a trimmed recording: source and trimmed timelines."""
    return stage.cut_once(spark, sf, "spans", lambda: _spans(spark, sf))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Voice vectors of unnamed speakers: one row per vector."""
    return vectors(spark, sf).where(F.col("vec_id") % 2 == 1).select(
        (F.col("vec_id") % 20).alias("job_id"),
        F.concat(F.lit("SPEAKER_0"), (F.col("label") % 10).cast("string")).alias("speaker"),
        "vec_id", "embedding",
    )


def profile_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Voice vectors of named people: one row per vector."""
    return vectors(spark, sf).where(F.col("vec_id") % 2 == 0).select(
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("name"), "vec_id", "embedding",
    )


MODEL_BY_PRIORITY = (
    ("1-URGENT", "gemini-3.6-flash"),
    ("2-HIGH", "gemini-3.5-flash"),
    ("3-MEDIUM", "gemini-3.1-pro-preview"),
    ("4-NOT SPECIFIED", "gemini-2.5-flash"),
    ("5-LOW", "gemini-3.1-flash-lite"),
)


def api_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Usage ledger, one row per order; every fiftieth has lost its job."""
    model = F.lit("unlisted-model")
    for prio, mid in MODEL_BY_PRIORITY:
        model = F.when(F.col("o_orderpriority") == prio, mid).otherwise(model)
    rows = table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")).alias("job_id"),
        F.col("o_orderkey").alias("usage_id"),
        model.alias("model"),
        F.concat(F.lit("step_"), (F.col("o_orderkey") % 4).cast("string")).alias("step"),
        F.floor("o_totalprice").cast("long").alias("input_tokens"),
        (F.col("o_custkey") * 7).cast("long").alias("output_tokens"),
    )
    return with_token_cost(rows, catalogue(spark))


def exploded(df: DataFrame, values: Column, name: str, *keep: str) -> DataFrame:
    """A row for each value that is not null; by an outer generator, as Spark works out the values of an inner one once more to filter for them."""
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def pieces(spark: SparkSession, sf: str, keep: Column | None = None) -> DataFrame:
    """Distinct stretches of the documents between blanks, so that dear patterns read each of them once."""
    rows = exploded(table(spark, sf, "documents"), F.split("text", " "), "piece")
    return (rows if keep is None else rows.where(keep)).distinct()


def glossary(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct capitalised words of the documents, taken from each text in place: only they are shuffled."""
    found = F.regexp_extract_all("text", F.lit(r"([A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{4,})"), F.lit(1))
    return exploded(table(spark, sf, "documents"), found, "term").distinct()


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Searchable texts with their titles: documents, and pages as plain text."""
    from colloquy.functions.text import html_text

    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"), F.col("source").alias("title"), "text")
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("source_id"), F.coalesce("url", F.lit("")).alias("title"), html_text("html").alias("text"))
    return docs.unionByName(pages)


def partners(spark: SparkSession, sf: str) -> DataFrame:
    """CRM partners: customers, with their nation as company."""
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("company"))
    return (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("partner_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", ".")), F.lit("@"), F.lower("company"), F.lit(".example")).alias("email"),
            F.when(F.col("c_custkey") % 3 != 0, F.col("company")).alias("company"),
        )
    )


def meetings(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar meetings: events in hourly buckets, attendees in user order.

    A bucket is cut into meetings of at most six people by attendee number,
    so the attendee list is short whatever the bucket holds.
    """
    seats = (
        table(spark, sf, "events")
        .select(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("start_at"), "user_id")
        .distinct()
        .withColumn("room", F.floor(F.col("user_id") / 6))
    )
    return (
        seats.groupBy("start_at", "room")
        .agg(F.array_sort(F.collect_set("user_id")).alias("partner_ids"))
        .select(
            (F.unix_timestamp(F.col("start_at").cast("timestamp")) / F.lit(3600)).cast("long").alias("hour"),
            "room", "start_at",
            (F.col("start_at") + F.expr("INTERVAL 1 HOUR")).alias("stop_at"), "partner_ids",
        )
        .withColumn("meeting_id", F.col("hour") * 1_000_000 + F.col("room"))
        .drop("hour", "room")
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Workspace files of a job, from parts."""
    suffixes = F.array(*[F.lit(s) for s in (".txt", ".json", ".mp4", ".wav", ".md", ".srt", ".log")])
    folder = F.array(*[F.lit(s) for s in ("logs", "work", "out", "cloud_chunks")])
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        (key % 50).alias("job_id"),
        F.concat(
            F.lit("/ws/"), (key % 50).cast("string"), F.lit("/"),
            F.element_at(folder, (key % 4 + 1).cast("int")), F.lit("/"),
            F.regexp_replace("p_name", " ", "_"), F.lit("-"), key.cast("string"),
            F.element_at(suffixes, (key % 7 + 1).cast("int")),
        ).alias("path"),
        (F.col("p_size") * 1000).cast("long").alias("size"),
    )


def runs_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary used by each run: part names of an order's lines."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("term"))
    return (
        table(spark, sf, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("run"), "term")
    )


def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``segments`` as rendered lines ``[speaker] (hh:mm:ss) text``."""
    from colloquy.functions.clock import clock_short

    return segments(spark, sf).select(
        "job_id", "seq",
        F.concat(
            F.lit("["), F.coalesce("speaker", F.lit("?")), F.lit("] ("), clock_short("start_ms"), F.lit(") "),
            F.regexp_replace("text", r"\s+", " "),
        ).alias("line"),
    )
