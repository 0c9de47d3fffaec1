"""Prices and costs. Money is kept in whole micro-dollars, so sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Model id, family, provider, billing, US cents per million
# tokens in and out, US cents per audio hour.
CATALOGUE = (
    ("gemini-3.6-flash", "Gemini", "gemini", "per_token", 150, 750, 0),
    ("gemini-3.5-flash", "Gemini", "gemini", "per_token", 150, 900, 0),
    ("gemini-3.1-pro-preview", "Gemini", "gemini", "per_token", 400, 1800, 0),
    ("gemini-2.5-flash", "Gemini", "gemini", "per_token", 100, 250, 0),
    ("gemini-3.1-flash-lite", "Gemini", "gemini", "per_token", 50, 150, 0),
    ("assemblyai-universal-3", "AssemblyAI", "assemblyai", "per_hour", 0, 0, 21),
    ("gpt-4o-transcribe-diarize", "OpenAI", "openai", "per_hour", 0, 0, 36),
    ("gpt-4o-mini-transcribe", "OpenAI", "openai", "per_hour", 0, 0, 18),
    ("gladia-solaria-3", "Gladia", "gladia", "per_hour", 0, 0, 61),
    ("gladia-solaria-1", "Gladia", "gladia", "per_hour", 0, 0, 61),
    ("deepgram-nova-3", "Deepgram", "deepgram", "per_hour", 0, 0, 26),
)
# Audio tokens in and text tokens out per second, prompt and
# answer overhead in tokens.
TOKENS_IN_PER_SECOND, TOKENS_OUT_PER_SECOND = 32, 10
PROMPT_TOKENS, ANSWER_TOKENS = 400, 300
# Stable model a family falls back to.
FALLBACKS = (("Gemini", "gemini-2.5-flash", 1),)


def catalogue(spark: SparkSession) -> DataFrame:
    """The price table: a fixed handful of rows, safe to broadcast."""
    rows = ", ".join(
        f"('{m}', '{fam}', '{prov}', '{bill}', {i}L, {o}L, {h}L, {n})"
        for n, (m, fam, prov, bill, i, o, h) in enumerate(CATALOGUE)
    )
    return spark.sql(
        "SELECT * FROM VALUES " + rows
        + " AS t(model, family, provider, billing, cents_in, cents_out, cents_hour, position)"
    )


def half_even(numerator: Column, denominator: Column | int) -> Column:
    """Whole-number division of a non-negative number, ties to even."""
    denominator = denominator if isinstance(denominator, Column) else F.lit(denominator)
    r = numerator % denominator
    q = ((numerator - r) / denominator).cast("long")
    up = (r * 2 > denominator) | ((r * 2 == denominator) & (q % 2 == 1))
    return q + F.when(up, 1).otherwise(0).cast("long")


def hourly_units(cents_in: Column, cents_out: Column, cents_hour: Column, billing: Column) -> Column:
    """Price of one audio hour in 1e-8 dollars, to rank models."""
    tokens = cents_in * (3600 * TOKENS_IN_PER_SECOND + PROMPT_TOKENS) + cents_out * (
        3600 * TOKENS_OUT_PER_SECOND + ANSWER_TOKENS
    )
    return F.when(billing == "per_hour", cents_hour * 1_000_000).otherwise(tokens)


def priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Add the price columns; an unlisted model takes the dearest one's."""
    hourly = hourly_units(F.col("cents_in"), F.col("cents_out"), F.col("cents_hour"), F.col("billing"))
    dearest = prices.agg(
        F.max_by(F.struct("family", "provider", "billing", "cents_in", "cents_out", "cents_hour"),
                 F.struct(hourly, -F.col("position"))).alias("dearest")
    ).select(F.lit(1).alias("_one"), "dearest")
    listed = prices.select(
        "model", F.struct("family", "provider", "billing", "cents_in", "cents_out", "cents_hour").alias("listed"))
    return (
        rows.join(F.broadcast(listed), "model", "left")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(dearest), "_one", "left")
        .withColumn("_price", F.coalesce("listed", "dearest"))
        .select(*rows.columns, "_price.*")
    )


def token_micro(tokens_in: Column, tokens_out: Column, cents_in: Column, cents_out: Column) -> Column:
    zero = F.lit(0).cast("long")
    return half_even(F.greatest(tokens_in, zero) * cents_in + F.greatest(tokens_out, zero) * cents_out, 100)


def with_token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of real token counters: ``cost_micro`` and ``cost_usd``."""
    out = priced(usage, prices).withColumn(
        "cost_micro", token_micro(F.col("input_tokens"), F.col("output_tokens"), F.col("cents_in"), F.col("cents_out")))
    return out.withColumn("cost_usd", F.col("cost_micro") / F.lit(1_000_000.0)).select(
        *usage.columns, "provider", "cost_micro", "cost_usd")


def with_estimate(recordings: DataFrame, prices: DataFrame, duration_ms: str = "duration_ms") -> DataFrame:
    """Cost projected from a recording's length, by the model's billing."""
    ms = F.greatest(F.col(duration_ms), F.lit(0).cast("long"))
    t_in = F.floor(ms * TOKENS_IN_PER_SECOND / F.lit(1000)).cast("long") + PROMPT_TOKENS
    t_out = F.floor(ms * TOKENS_OUT_PER_SECOND / F.lit(1000)).cast("long") + ANSWER_TOKENS
    per_hour = F.col("billing") == "per_hour"
    out = priced(recordings, prices)
    return out.select(
        *recordings.columns, "billing",
        F.when(per_hour, F.lit(0).cast("long")).otherwise(t_in).alias("input_tokens"),
        F.when(per_hour, F.lit(0).cast("long")).otherwise(t_out).alias("output_tokens"),
        F.when(per_hour, half_even(ms * F.col("cents_hour"), 360))
        .otherwise(token_micro(t_in, t_out, F.col("cents_in"), F.col("cents_out"))).alias("cost_micro"),
    )

# Local models, their family and role.
LOCAL_MODELS = (
    ("mlx-community/whisper-large-v3-turbo", "Whisper", "transcription"),
    ("mlx-community/whisper-large-v3-mlx", "Whisper", "transcription"),
    ("mlx-community/distil-whisper-large-v3", "Whisper", "transcription"),
    ("mlx-community/whisper-medium-mlx", "Whisper", "transcription"),
    ("mlx-community/whisper-small-mlx", "Whisper", "transcription"),
    ("mlx-community/whisper-base-mlx", "Whisper", "transcription"),
    ("mlx-community/whisper-tiny-mlx", "Whisper", "transcription"),
    ("bofenghuang/whisper-large-v3-french-distil-dec16", "Whisper", "transcription"),
    ("mlx-community/whisper-large-v3-mlx", "Whisper", "multipass"),
    ("bofenghuang/whisper-large-v3-french-distil-dec16", "Whisper", "multipass"),
    ("mlx-community/whisper-large-v3-turbo", "Whisper", "multipass"),
    ("mlx-community/Mistral-7B-Instruct-v0.3-4bit", "Mistral", "text_llm"),
    ("mlx-community/Llama-3.2-3B-Instruct-4bit", "Llama", "text_llm"),
    ("mlx-community/Qwen2.5-7B-Instruct-4bit", "Qwen", "text_llm"),
    ("mlx-community/Qwen2.5-14B-Instruct-4bit", "Qwen", "text_llm"),
    ("mlx-community/gemma-4-12B-it-4bit", "Gemma", "audio_llm"),
    ("pyannote/speaker-diarization-community-1", "Pyannote", "diarisation"),
    ("pyannote/speaker-diarization-3.1", "Pyannote", "diarisation"),
)


def local_models(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{m}', '{fam}', '{role}')" for m, fam, role in LOCAL_MODELS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(model, family, role)")
