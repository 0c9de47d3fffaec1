"""Decoder confidence of a segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, bounds and defaults of the score.
WEIGHT_LOGPROB, WEIGHT_SPEECH, WEIGHT_COMPRESSION = 0.75, 0.15, 0.10
LOGPROB_FLOOR, LOGPROB_SPAN = 1.5, 1.3
COMPRESSION_GOOD, COMPRESSION_BAD = 2.0, 3.5
DEFAULT_LOGPROB, DEFAULT_NO_SPEECH, DEFAULT_COMPRESSION = -0.3, 0.0, 1.5
WEAK_SCORE, WEAK_MIN_MS = 0.55, 400
WEAK_LOGPROB, WEAK_NO_SPEECH, WEAK_COMPRESSION = -0.85, 0.65, 2.2


def _or(col: str, default: float) -> Column:
    """NULL and 0 both count as missing."""
    return F.coalesce(F.nullif(F.col(col), F.lit(0.0)), F.lit(default))


def quality_score() -> Column:
    lp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_or("avg_logprob", DEFAULT_LOGPROB) + F.lit(LOGPROB_FLOOR)) / F.lit(LOGPROB_SPAN)))
    sp = F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(0.0), _or("no_speech_prob", DEFAULT_NO_SPEECH)))
    c = _or("compression_ratio", DEFAULT_COMPRESSION)
    cr = (
        F.when(c <= COMPRESSION_GOOD, F.lit(1.0)).when(c >= COMPRESSION_BAD, F.lit(0.0))
        .otherwise((F.lit(COMPRESSION_BAD) - c) / F.lit(COMPRESSION_BAD - COMPRESSION_GOOD))
    )
    return F.lit(WEIGHT_LOGPROB) * lp + F.lit(WEIGHT_SPEECH) * sp + F.lit(WEIGHT_COMPRESSION) * cr


def is_weak() -> Column:
    return ((F.col("end_ms") - F.col("start_ms")) >= WEAK_MIN_MS) & (quality_score() < WEAK_SCORE)


def weak_reasons() -> Column:
    named = F.concat_ws(
        ", ",
        F.when(_or("avg_logprob", DEFAULT_LOGPROB) < WEAK_LOGPROB, "logprob bas"),
        F.when(_or("no_speech_prob", DEFAULT_NO_SPEECH) > WEAK_NO_SPEECH, "no_speech élevé"),
        F.when(_or("compression_ratio", DEFAULT_COMPRESSION) > WEAK_COMPRESSION, "compression élevée"),
    )
    return F.when(named == "", "qualité globale faible").otherwise(named)
