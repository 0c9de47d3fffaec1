"""The review report: what was changed by machine, as ordered lines per job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many entries a section shows.
TERM_CAP, LOOP_CAP, GLOSSARY_CAP, CORRECTION_CAP, DOUBT_CAP, LOOP_CHARS = 30, 10, 40, 40, 25, 70
REASONS = (
    ("not_found", "quote absente du texte"), ("too_distant", "écart trop large (réécriture)"),
    ("low_confidence", "confiance trop basse"), ("empty", "champ vide"),
)


def _mmss(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def _section(rows: DataFrame, no: int, title: Column | str, order: list, line: Column, cap: int | None = None) -> DataFrame:
    """A section's title, entries (the first ``cap`` by ``order``) and closing blank line."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy(*order)))
    ranked = ranked.where(F.col("_r") <= cap) if cap else ranked
    entry = lambda rank, text: F.struct(F.lit(rank).cast("long").alias("rank"), text.alias("line"))
    body = entry(F.col("_r"), line)
    # The frame comes with a job's first entry, so that the rows are read once.
    frame = [entry(r, t) for r, t in ((-1, F.lit(title) if isinstance(title, str) else title), (0, F.lit("")), (1_000_000_000, F.lit("")))]
    lines = F.when(F.col("_r") == 1, F.array(*frame, body)).otherwise(F.array(body))
    return ranked.select("job_id", F.lit(no).alias("section"), F.inline_outer(lines))


def review(
    titles: DataFrame, speakers: DataFrame, terms: DataFrame, coverage: DataFrame, loops: DataFrame,
    replaced: DataFrame, substitutions: DataFrame, corrections: DataFrame, doubts: DataFrame,
) -> DataFrame:
    """Report lines (job_id, section, rank, line) in reading order (sink_review).

    Ranks within a section are cut by the ranking's own group limit before
    the shuffle, so a job with very many entries stays cheap.
    """
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    parts = [
        _section(titles.where(F.col("title") != ""), 1, "## Titre proposé", ["title"], F.concat(F.lit("> "), "title")),
        _section(speakers.where(F.col("name") != ""), 2, "## Interlocuteurs identifiés", ["speaker"], F.concat(
            F.lit("- "), tick(F.col("speaker")), F.lit(" → **"), "name", F.lit("** _("), F.when(F.col("recognized"), "voix mémorisée / réglage").otherwise("déduit du texte"), F.lit(")_"))),
        _section(terms, 3, "## Termes techniques détectés", ["pos"], F.concat(F.lit("- "), "term"), TERM_CAP),
    ]
    s = lambda c: F.format_string("%.0f", F.col(c) / F.lit(1000.0))
    whole = F.concat(F.lit("✓ Tout l'audio de la réunion est dans la transcription ("), s("audio_ms"), F.lit(" s)."))
    lost = F.concat(F.lit("**"), s("lost_ms"), F.lit(" s d'audio perdues sur "), s("audio_ms"), F.lit(" s** ("),
                    F.format_string("%.0f", F.lit(100.0) - F.col("coverage_pct")), F.lit("% du fichier)."))
    state = coverage.withColumn("t", F.when(F.col("dropped") == 0, "## Couverture audio").when(F.col("alert"), "## ⚠️ Zones perdues — relecture impossible").otherwise("## Zones perdues"))
    # The block's title depends on the job, so it goes in as the first entry.
    block = F.array(*[F.struct(F.lit(r).cast("long").alias("rank"), t.alias("line")) for r, t in (
        (-1, F.col("t")), (0, F.lit("")), (1, F.when(F.col("dropped") == 0, whole).otherwise(lost)), (2, F.lit("")))])
    parts.append(state.select("job_id", F.lit(4).alias("section"), F.inline(block)))
    length = F.col("end_ms") - F.col("start_ms")
    text = F.when(F.length("text") > LOOP_CHARS, F.concat(F.substring("text", 1, LOOP_CHARS), F.lit("…"))).otherwise(F.col("text"))
    parts.append(_section(loops, 5, F.lit("Plages :"), [length.desc(), "run"], F.concat(
        F.lit("- "), tick(_mmss(F.col("start_ms"))), F.lit(" → "), tick(_mmss(F.col("end_ms"))),
        F.format_string(" (%.0fs, %d segments) : « ", length / F.lit(1000.0), F.col("dropped")), text, F.lit(" »")), LOOP_CAP))
    more = loops.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOOP_CAP)
    parts.append(more.select("job_id", F.lit(5).alias("section"), F.lit(LOOP_CAP + 1).cast("long").alias("rank"), F.format_string("- … et %d autre(s).", F.col("n") - LOOP_CAP).alias("line")))
    parts.append(_section(replaced.where(F.col("replaced") > 0), 6, "## Repasse qualité maximale", ["replaced"], F.format_string(
        "%d segment(s) re-transcrit(s) avec `whisper-large-v3` après détection de faible confiance.", F.col("replaced"))))
    arrow = lambda: F.concat(tick(F.col("original")), F.lit(" → "), tick(F.col("replacement")))
    parts.append(_section(substitutions, 7, "## Vocabulaire métier (corrigé automatiquement)", ["start_ms", "pos"], F.concat(
        F.lit("- "), tick(_mmss(F.col("start_ms"))), F.lit(" "), arrow(), F.lit(" ("), "method", F.format_string(", confiance %.2f)", F.col("confidence"))), GLOSSARY_CAP))
    stamp = tick(F.coalesce(F.nullif("timestamp", F.lit("")), F.lit("—")))
    done = corrections.where(F.col("outcome") == "applied")
    parts.append(_section(done, 8, "## Corrections LLM appliquées", ["seq"], F.concat(
        F.lit("- "), stamp, F.lit(" "), arrow(), F.when(F.col("occurrences") > 1, F.format_string(" ×%d", F.col("occurrences"))).otherwise(""),
        F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" — "), "reason")).otherwise("")), CORRECTION_CAP))
    why = F.col("outcome")
    for code, label in REASONS:
        why = F.when(F.col("outcome") == code, label).otherwise(why)
    parts.append(_section(corrections.where(F.col("outcome") != "applied"), 9, "## Corrections LLM refusées", ["seq"], F.concat(
        F.lit("- "), stamp, F.lit(" "), arrow(), F.lit(" ("), why, F.lit(")")), CORRECTION_CAP))
    parts.append(_section(doubts, 10, "## Passages douteux", ["seq"], F.concat(
        F.lit("- "), stamp, F.lit(" "), "text", F.lit(" _(raison : "), F.coalesce("reason", F.lit("—")), F.lit(")_")), DOUBT_CAP))
    return reduce(DataFrame.unionByName, parts).orderBy("job_id", "section", "rank")
