"""Limits, de-duplication, set operations and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.cost import half_even
from colloquy.operators.aggregates import distinct_run_terms, term_usage

# Upload window, tolerance and smallest window in seconds.
WINDOW_S, TOLERANCE_S, MIN_WINDOW_S = 1_800, 300, 60


def plan_chunks(recordings: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Recordings (job_id, duration_ms) cut into equal upload windows (plan_chunks).

    Whole if within the window and a tolerance, else ceil(length / window)
    equal parts. A recording without length gets the window (0, 0).
    """
    window_ms = max(window_s, MIN_WINDOW_S) * 1000
    ms = F.greatest(F.coalesce("duration_ms", F.lit(0).cast("long")), F.lit(0).cast("long"))
    count = F.when(ms <= window_ms + TOLERANCE_S * 1000, F.lit(1).cast("long")).otherwise(F.ceil(ms / F.lit(window_ms)))
    rows = recordings.select("job_id", ms.alias("_ms"), count.alias("chunk_count"))
    rows = rows.select("job_id", "_ms", "chunk_count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunk_count") - 1)).alias("index"))
    n = F.col("chunk_count")
    at = lambda i: half_even(i * F.col("_ms"), n * 10) / F.lit(100.0)
    return rows.select("job_id", "index", "chunk_count", at(F.col("index")).alias("start"), at(F.col("index") + 1).alias("end"))


def sort_streams(streams: list[DataFrame]) -> DataFrame:
    """Per-speaker segment tables as one, by start (sort_merge_streams)."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.orderBy("job_id", "start_ms", "speaker", "seq")


def squeeze(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def dedup_corrections(corrections: DataFrame) -> DataFrame:
    """First of equal (timestamp, original, replacement) per job (dedup_corrections).

    Keeps the smallest ``seq`` with an aggregate, not a ranking.
    """
    keys = [squeeze(c).alias(f"_{c}") for c in ("timestamp", "original", "replacement")]
    row = F.struct(*[c for c in corrections.columns if c != "job_id"])
    return corrections.groupBy("job_id", *keys).agg(F.min_by(row, "seq").alias("r")).select("job_id", "r.*")


# How many bias terms each provider takes.
BIAS_LIMITS = (("default", 200), ("assemblyai", 100), ("deepgram", 50))


def bias_terms(glossary: DataFrame, names: DataFrame, limit: int = BIAS_LIMITS[0][1]) -> DataFrame:
    """Glossary then names, distinct whatever the case, capped per job (dedup_bias_terms).

    Both: job_id, pos, term.
    """
    both = glossary.withColumn("src", F.lit(0)).unionByName(names.withColumn("src", F.lit(1))).withColumn("term", F.trim("term")).where(F.col("term") != "")
    first = both.groupBy("job_id", F.lower("term").alias("_k")).agg(F.min(F.struct("src", "pos", "term")).alias("f"))
    w = Window.partitionBy("job_id").orderBy("f.src", "f.pos", "f.term")
    return first.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit).select("job_id", "rank", F.col("f.term").alias("term"))


# Wording of an uncertain passage with two readings.
DOUBT = r"""(?is)qui pourrait\s+(?:\s*être)?\s*["«']?([^"»'(),.;]+?)["»']?\s+ou\s+["«']?([^"»'(),.;]+?)["»'.]?\s*(?:\(|$|\))"""
DOUBT_MIN_CHARS = 8


def bare_word(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"""[\s.,;:!?'"«»()]+""", ""))


def useful_doubts(doubts: DataFrame) -> DataFrame:
    """Doubts that say something: no stubs, no "X or X", not both already there (dedup_doubts)."""
    reason = F.trim(F.coalesce("reason", F.lit("")))
    rows = doubts.withColumn("_a", bare_word(F.regexp_extract(reason, DOUBT, 1))).withColumn("_b", bare_word(F.regexp_extract(reason, DOUBT, 2)))
    text = bare_word("text")
    same = (F.col("_a") != "") & (F.col("_b") != "") & (F.col("_a") == F.col("_b"))
    there = (F.col("_a") != "") & text.contains(F.col("_a")) & text.contains(F.col("_b"))
    return rows.where((F.length(reason) >= DOUBT_MIN_CHARS) & ~same & ~there).drop("_a", "_b")


def vocabulary(glossary: DataFrame, runs: DataFrame) -> DataFrame:
    """Glossary and used terms, most used first (rank_vocabulary)."""
    usage = term_usage(runs)
    return set_union(glossary, runs).join(usage, "term", "left").select(
        "term", F.coalesce("runs", F.lit(0).cast("long")).alias("runs")).orderBy(F.col("runs").desc(), F.lower("term"))


def suggestions(glossary: DataFrame, runs: DataFrame, selected: list[str], needle: str = "") -> DataFrame:
    """Terms to offer next to the selected ones (rank_suggestions).

    Scores only need runs with a selected term, so no full pair table is
    built: the run's terms are joined with its number of selected ones.
    """
    chosen = [t.lower() for t in selected]
    terms = distinct_run_terms(runs)
    weight = terms.where(F.lower("term").isin(*chosen)).groupBy("run").agg(F.count(F.lit(1)).alias("_w"))
    score = terms.where(~F.lower("term").isin(*chosen)).join(weight, "run").groupBy(F.lower("term").alias("_k")).agg(F.sum("_w").alias("score"))
    cat = vocabulary(glossary, runs).where(~F.lower("term").isin(*chosen))
    if needle.strip():
        cat = cat.where(F.lower("term").contains(needle.strip().lower()))
    return (
        cat.withColumn("_k", F.lower("term")).join(score, "_k", "left")
        .select("term", "runs", F.coalesce("score", F.lit(0).cast("long")).alias("score"))
        .orderBy(F.col("score").desc(), F.col("runs").desc(), F.lower("term"))
    )


def set_union(glossary: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct glossary terms and terms in use (set_union)."""
    return glossary.select("term").union(runs.select(F.trim("term").alias("term")).where(F.col("term") != "")).distinct()


def fallback_models(models: DataFrame, catalogue: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Other models of the same family to fall back to, in order (topk_fallback_models).

    ``models``: model in use. ``fallbacks``: family, fallback, rank. The
    catalogue and the fall-back list are fixed small tables.
    """
    family = catalogue.select("model", "family")
    known = catalogue.select(F.col("model").alias("fallback"))
    options = fallbacks.join(F.broadcast(known), "fallback", "left_semi")
    rows = models.join(F.broadcast(family), "model").join(F.broadcast(options), "family").where(F.col("fallback") != F.col("model"))
    w = Window.partitionBy("model").orderBy("rank")
    return rows.select("model", "fallback", F.row_number().over(w).cast("long").alias("rank"))
