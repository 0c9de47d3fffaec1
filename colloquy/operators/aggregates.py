"""Grouped figures. Every group is added up with map-side partials first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.vectors import centroid_from_sums, sums_by, unit
from colloquy.operators.library import list_jobs
from colloquy.operators.ordered import Step, scan


def month_of(ts: Column | str) -> Column:
    """``yyyy-MM`` bucket of a timestamp (fn_month)."""
    return F.date_format(ts, "yyyy-MM")


def month_spend(usage: DataFrame, month: str) -> DataFrame:
    """Spend of one month; 0 if nothing was used (agg_month_spend).

    A range predicate, so the scan can skip other months.
    """
    start = F.to_timestamp_ntz(F.lit(f"{month}-01 00:00:00"))
    inside = (F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL 1 MONTH"))
    return usage.where(inside).agg(F.coalesce(F.sum("cost_micro"), F.lit(0).cast("long")).alias("cost_micro"))


def usage_summary(usage: DataFrame, months: int = 12) -> DataFrame:
    """Calls, tokens and cost by month, newest first (agg_usage_summary)."""
    return (
        usage.groupBy(month_of("created_at").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            (F.sum("cost_micro") / F.lit(1_000_000.0)).alias("cost_usd"),
        )
        .orderBy(F.col("month").desc())
        .limit(max(months, 1))
    )


def budget_guard(estimates: DataFrame, usage: DataFrame, budget_micro: int) -> DataFrame:
    """Would a job's estimate cross its month's cap (agg_budget_guard).

    ``estimates``: id, created_at, cost_micro. A budget of 0 or less is no cap.
    """
    spent = usage.groupBy(month_of("created_at").alias("month")).agg(F.sum("cost_micro").alias("spent_micro"))
    rows = estimates.withColumn("month", month_of("created_at")).join(spent, "month", "left")
    used = F.coalesce("spent_micro", F.lit(0).cast("long"))
    cap = F.lit(budget_micro).cast("long")
    capped = F.lit(budget_micro > 0)
    return rows.select(
        "id", "month", used.alias("spent_micro"), F.col("cost_micro").alias("estimate_micro"),
        (capped & (used + F.col("cost_micro") > cap)).alias("refused"),
        (capped & (used * 100 >= cap * 80)).alias("near_cap"),
    )


def speaker_stats(segments: DataFrame) -> DataFrame:
    """Utterances and spoken time by speaker of a job (agg_speaker_stats)."""
    speaker = F.trim(F.coalesce("speaker", F.lit("")))
    return (
        segments.select("job_id", speaker.alias("speaker"), F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0).cast("long")).alias("d"))
        .where(F.col("speaker") != "")
        .groupBy("job_id", "speaker")
        .agg(F.count(F.lit(1)).alias("utterances"), F.sum("d").alias("spoken_ms"))
    )


OPENING_MS, OPENING_MIN_MS = 60_000, 1_000


def opening_speaker(segments: DataFrame, recognized: DataFrame, users: DataFrame) -> DataFrame:
    """The unnamed cluster that talks most in the first minute is the user (agg_opening_speaker).

    ``recognized``: job_id, speaker, name. ``users``: job_id, name. No row
    where the user is recognised already or nobody speaks for a second.
    """
    label = F.trim(F.coalesce("speaker", F.lit("")))
    opening = (
        segments.where((F.col("start_ms") < OPENING_MS) & (F.col("end_ms") > 0) & (F.col("end_ms") > F.col("start_ms")))
        .select(
            "job_id", label.alias("speaker"),
            F.greatest("start_ms", F.lit(0).cast("long")).alias("a"), F.least("end_ms", F.lit(OPENING_MS).cast("long")).alias("b"))
        .where(F.upper("speaker").startswith("SPEAKER_") & (F.col("b") > F.col("a")))
    )
    named = recognized.select("job_id", "speaker").distinct()
    by_label = (
        opening.groupBy("job_id", "speaker").agg(F.sum(F.col("b") - F.col("a")).alias("ms"), F.min("a").alias("first"))
        .join(named, ["job_id", "speaker"], "left_anti")
    )
    best = by_label.groupBy("job_id").agg(
        F.max_by(F.struct("speaker", "ms"), F.struct(F.col("ms"), -F.col("first"), F.col("speaker"))).alias("b"))
    taken = recognized.select("job_id", F.lower(F.trim("name")).alias("_k")).distinct()
    free = (
        users.withColumn("name", F.trim("name")).where(F.col("name") != "")
        .withColumn("_k", F.lower("name")).join(taken, ["job_id", "_k"], "left_anti").drop("_k")
    )
    return best.where(F.col("b.ms") >= OPENING_MIN_MS).join(free, "job_id").select(
        "job_id", "b.speaker", "name", F.col("b.ms").alias("spoken_ms"))


def step_durations(steps: DataFrame) -> DataFrame:
    """Step times folded into three columns and a total (agg_step_durations).

    Only the spelling ``diarization`` counts as such; a step named
    ``diarisation`` lands in ``whisper``, as it does in stored libraries.
    """
    of = lambda cond: F.sum(F.when(cond, F.col("seconds")).otherwise(F.lit(0.0)))
    step = F.col("step")
    return steps.groupBy("job_id").agg(
        of(step == "compression").alias("ffmpeg"),
        of(step == "diarization").alias("diarization"),
        of(~step.isin("compression", "diarization")).alias("whisper"),
        F.sum("seconds").alias("total"),
    )


ETA_JOBS, ETA_MIN_SECONDS, ETA_SHARE = 30, 10.0, 0.65


def eta_history(jobs: DataFrame, modes: DataFrame) -> DataFrame:
    """Expected total run time for each of ``modes(mode)`` (agg_eta_history).

    Looks at the 30 newest completed jobs before any other filter, so the
    joined side has 30 rows at most and is broadcast. Index rounding is
    half-even.
    """
    head = list_jobs(jobs, ETA_JOBS, "COMPLETED").where(F.col("duration_total") >= ETA_MIN_SECONDS)
    head = head.select(F.col("mode").alias("_m"), "duration_total")
    times = modes.join(F.broadcast(head), F.col("_m").isNull() | (F.col("_m") == "") | (F.col("_m") == F.col("mode")), "left")
    sorted_times = F.array_sort(F.collect_list("duration_total"))
    index = F.bround((F.size("t") - 1) * F.lit(ETA_SHARE), 0).cast("int")
    return times.groupBy("mode").agg(sorted_times.alias("t")).select(
        "mode", F.when(F.size("t") >= 2, F.get("t", F.least(index, F.size("t") - 1))).alias("eta_seconds"))


SPEAKER_MIN_MS, SPEAKER_TURN_MS = 6_000, 400


def eligible_speakers(segments: DataFrame) -> DataFrame:
    """Speakers with six seconds of speech in turns of 0.4 s or more (agg_speaker_eligible)."""
    d = F.col("end_ms") - F.col("start_ms")
    label = F.trim(F.coalesce("speaker", F.lit("")))
    return (
        segments.where(d >= SPEAKER_TURN_MS).select("job_id", label.alias("speaker"), d.alias("d")).where(F.col("speaker") != "")
        .groupBy("job_id", "speaker").agg(F.sum("d").alias("spoken_ms"), F.count(F.lit(1)).alias("turns"))
        .where(F.col("spoken_ms") >= SPEAKER_MIN_MS)
    )


SLICE_PAD_MS, SLICE_MIN_MS = 400, 5_000


def speaker_slices(turns: DataFrame) -> DataFrame:
    """Each speaker's padded turns laid end to end (agg_speaker_slices)."""
    kept = turns.where(F.col("end_ms") - F.col("start_ms") >= SPEAKER_TURN_MS).select(
        "job_id", "speaker", "seq",
        F.greatest(F.col("start_ms") - SLICE_PAD_MS, F.lit(0).cast("long")).alias("src_start"),
        (F.col("end_ms") + SLICE_PAD_MS).alias("src_end"),
    )
    length = F.col("src_end") - F.col("src_start")
    enough = kept.groupBy("job_id", "speaker").agg(F.sum(length).alias("_t")).where(F.col("_t") >= SLICE_MIN_MS)
    laid = scan(kept, [Step("trim_start", "sum_before", length)], keys=("job_id", "speaker"))
    return laid.join(enough, ["job_id", "speaker"], "left_semi").withColumn("trim_end", F.col("trim_start") + length)


def speaker_map(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Labels in first-seen order with their friendly names (agg_speaker_map).

    ``names``: job_id, label, name.
    """
    label = F.trim(F.coalesce("speaker", F.lit("")))
    seen = (
        segments.select("job_id", "seq", label.alias("label")).where(F.col("label") != "")
        .groupBy("job_id", "label").agg(F.min("seq").alias("first_seq"))
    )
    own = F.when(F.upper("label").startswith("SPEAKER_"), "").otherwise(F.col("label"))
    given = names.groupBy("job_id", "label").agg(F.max(F.trim("name")).alias("_n"))
    return seen.join(given, ["job_id", "label"], "left").select(
        "job_id", "label", "first_seq", F.coalesce(F.nullif("_n", F.lit("")), own).alias("name"))


def declared_merge(detected: DataFrame, declared: DataFrame) -> DataFrame:
    """Add declared names nobody carries yet; fill a blank own value (agg_declared_merge).

    ``detected``: job_id, label, name. ``declared``: job_id, seq, name.
    """
    said = declared.withColumn("name", F.trim("name")).where(F.col("name") != "")
    own = said.select("job_id", F.col("name").alias("label"), F.col("name").alias("_own")).distinct()
    filled = detected.join(own, ["job_id", "label"], "left").select(
        "job_id", "label",
        F.when((F.trim(F.coalesce("name", F.lit(""))) == "") & F.col("_own").isNotNull(), F.col("_own")).otherwise(F.col("name")).alias("name"))
    present = detected.select("job_id", F.explode(F.array(F.lower(F.trim("label")), F.lower(F.trim("name")))).alias("_k")).distinct()
    new = (
        said.groupBy("job_id", F.lower("name").alias("_k")).agg(F.min_by("name", "seq").alias("label"))
        .join(present, ["job_id", "_k"], "left_anti").select("job_id", "label", F.col("label").alias("name"))
    )
    return filled.unionByName(new)


LINE_LABEL = r"^\s*\[([^\]\n]{1,60})\]"


def discover_speakers(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """Bracket labels of rendered lines, merged with the stored map (agg_discover_speakers)."""
    found = (
        lines.select("job_id", "seq", F.trim(F.regexp_extract("line", LINE_LABEL, 1)).alias("label"))
        .where((F.col("label") != "") & ~F.lower("label").isin("speaker", "intervenant"))
        .groupBy("job_id", "label").agg(F.min("seq").alias("first_seq"))
    )
    new = found.join(stored.select("job_id", "label"), ["job_id", "label"], "left_anti").select(
        "job_id", "label", F.when(F.upper("label").startswith("SPEAKER_"), "").otherwise(F.col("label")).alias("name"))
    return stored.select("job_id", "label", "name").unionByName(new)


def merge_chunks(speakers: DataFrame, terms: DataFrame, meta: DataFrame) -> DataFrame:
    """Chunk results of a job as one, in rows (job_id, kind, item, value, rank) (agg_chunk_merge).

    ``speakers``: job_id, chunk, label, name. ``terms``: job_id, chunk, pos,
    term. ``meta``: job_id, chunk, title, input_tokens, output_tokens,
    cost_micro. A later non-empty name wins, the first spelling of a term and
    the first non-empty title stay, usage adds up.
    """
    none = F.lit(None).cast("string")
    named = F.when(F.col("name") != "", F.col("chunk"))
    who = speakers.groupBy("job_id", "label").agg(F.max_by("name", named).alias("n")).select(
        "job_id", F.lit("speaker").alias("kind"), F.col("label").alias("item"), F.coalesce("n", F.lit("")).alias("value"))
    word = terms.groupBy("job_id", F.lower("term").alias("item")).agg(F.min_by("term", F.struct("chunk", "pos")).alias("value")).select(
        "job_id", F.lit("term").alias("kind"), "item", "value")
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.col("chunk"))
    head = meta.groupBy("job_id").agg(
        F.min_by("title", titled).alias("title"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("cost_micro").alias("c"))
    entries = F.array(
        *[F.struct(F.lit(k).alias("item"), v.alias("value")) for k, v in (
            ("title", F.coalesce("title", F.lit(""))), ("input_tokens", F.col("i").cast("string")),
            ("output_tokens", F.col("o").cast("string")), ("cost_micro", F.col("c").cast("string")))])
    head = head.select("job_id", F.lit("meta").alias("kind"), F.inline(entries))
    return who.unionByName(word).unionByName(head)


def enrich_merge(merged: DataFrame, extra: DataFrame) -> DataFrame:
    """Fold enrichment into a merged result (agg_enrich_merge).

    Both: job_id, title, speakers (map), terms (array), uncertain (array);
    ``extra`` also corrections, which replace the old ones.
    """
    e = extra.select("job_id", *[F.col(c).alias(f"e_{c}") for c in ("title", "speakers", "terms", "uncertain", "corrections")])
    rows = merged.join(e, "job_id", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = F.create_map().cast("map<string,string>")
    names = F.map_zip_with(
        F.coalesce("speakers", empty), F.coalesce("e_speakers", empty),
        lambda k, old, new: F.when(blank(old) & ~(F.coalesce(new, F.lit("")) == ""), new).otherwise(old))
    # A label that is in neither side's non-empty names stays out of the map.
    names = F.map_filter(names, lambda k, v: v.isNotNull())
    strings = F.array().cast("array<string>")
    return rows.select(
        "job_id",
        F.when(F.coalesce("title", F.lit("")) == "", F.trim(F.coalesce("e_title", F.lit("")))).otherwise(F.col("title")).alias("title"),
        names.alias("speakers"),
        F.concat(F.coalesce("terms", strings), F.array_except(F.coalesce("e_terms", strings), F.coalesce("terms", strings))).alias("terms"),
        F.when(F.size(F.coalesce("uncertain", strings)) == 0, F.coalesce("e_uncertain", strings)).otherwise(F.col("uncertain")).alias("uncertain"),
        F.when(F.col("e_corrections").isNotNull(), F.col("e_corrections")).otherwise(strings).alias("corrections"),
    )


def number_labels(utterances: DataFrame) -> DataFrame:
    """Raw labels to "Intervenant N" by first appearance within a window (agg_label_numbers).

    Only one row per label of a window is ranked, never the utterances.
    """
    from pyspark.sql import Window

    keys = ["job_id", "chunk"]
    label = F.trim(F.coalesce("label", F.lit("")))
    rows = utterances.withColumn("label", label)
    first = rows.where(F.col("label") != "").groupBy(*keys, "label").agg(F.min("seq").alias("_f"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_f"))
    numbered = first.select(*keys, "label", F.concat(F.lit("Intervenant "), rank.cast("string")).alias("speaker"))
    return rows.join(numbered, [*keys, "label"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("")))


def centroids(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Normalised mean vector and count by key (agg_centroid)."""
    return sums_by(vectors, keys).select(*keys, centroid_from_sums("total", "n").alias("embedding"), F.col("n").alias("sample_count"))


def update_centroids(profiles: DataFrame, fresh: DataFrame, key: str = "name") -> DataFrame:
    """Running mean of stored centroids with new vectors (agg_centroid_update).

    An empty or differently sized stored centroid is replaced.
    """
    new = sums_by(fresh, [key])
    old = profiles.select(key, F.col("embedding").alias("_c"), F.coalesce("sample_count", F.lit(0).cast("long")).alias("_n"))
    rows = new.join(old, key, "left")
    usable = F.col("_c").isNotNull() & (F.size("_c") > 0) & (F.size("_c") == F.size("total"))
    mixed = unit(F.zip_with("_c", "total", lambda c, t: (c * F.col("_n") + t) / (F.col("_n") + F.col("n"))))
    updated = rows.select(
        key,
        F.when(usable, mixed).otherwise(centroid_from_sums("total", "n")).alias("embedding"),
        F.when(usable, F.col("_n") + F.col("n")).otherwise(F.col("n")).alias("sample_count"),
    )
    kept = profiles.join(new, key, "left_anti").select(*updated.columns)
    return updated.unionByName(kept)


def distinct_run_terms(runs: DataFrame) -> DataFrame:
    """One row per run and term, whatever its case; the smallest spelling stays."""
    term = F.trim("term")
    return (
        runs.select("run", term.alias("term")).where(F.col("term") != "")
        .groupBy("run", F.lower("term").alias("_k")).agg(F.min("term").alias("term")).drop("_k")
    )


def term_usage(runs: DataFrame) -> DataFrame:
    """In how many runs each term was used (agg_term_usage)."""
    return distinct_run_terms(runs).groupBy("term").agg(F.count(F.lit(1)).alias("runs"))


#: Terms of a run up to which they meet in one place, and the shares a run's terms are dealt to.
PAIR_TERMS, RUN_SHARES = 512, 16


def _term_blocks(terms: DataFrame) -> DataFrame:
    """``terms`` (run, term) with ``parts``, the blocks of the run, and ``blk``, the term's own."""
    share = F.pmod(F.xxhash64("term"), F.lit(RUN_SHARES)).cast("int")
    crowded = terms.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIR_TERMS)
    crowded = crowded.select("run", F.ceil(F.col("n") / PAIR_TERMS).cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(RUN_SHARES - 1))).alias("_share"))
    told = terms.withColumn("_share", share).join(crowded, ["run", "_share"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return told.select("run", "term", "parts", F.pmod(F.xxhash64("term", F.lit("block")), F.col("parts")).cast("int").alias("blk"))


def cooccurrence(runs: DataFrame) -> DataFrame:
    """Symmetric counts of terms used in the same run (agg_cooccurrence).

    Terms are made distinct per run before the pairing, only one order of a
    pair is built, pairs are added up map-side, and the mirror is made from
    the counts. The terms of a crowded run are dealt in blocks, and every two of its
    blocks meet under a key of their own, so that one run fills all tasks.
    Rows without a run count for nothing.
    """
    terms = _term_blocks(distinct_run_terms(runs).where(F.col("run").isNotNull()))
    a = terms.select("run", F.col("term").alias("a"), F.col("blk").alias("x"), F.explode(F.sequence("blk", F.col("parts") - 1)).alias("y"))
    b = terms.select("run", F.col("term").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("x"), F.col("blk").alias("y"))
    pairs = a.join(b, ["run", "x", "y"]).where((F.col("x") < F.col("y")) | (F.col("a") < F.col("b")))
    half = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("runs"))
    both = F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("other")), F.struct(F.col("b").alias("term"), F.col("a").alias("other")))
    return half.select(F.inline(both), "runs")


def workspace_usage(files: DataFrame) -> DataFrame:
    """Files of each job by size with the job's total (agg_workspace_usage)."""
    total = files.groupBy("job_id").agg(F.sum("size").alias("total_bytes"))
    return files.join(total, "job_id").orderBy("job_id", F.col("size").desc(), "path")


NO_COMPANY = "Sans société Odoo"


def profiles_by_company(profiles: DataFrame) -> DataFrame:
    """Profiles under their company; the unlinked ones last (agg_profiles_by_company)."""
    label = F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.lit(NO_COMPANY))
    rows = profiles.withColumn("company", label)
    sizes = rows.groupBy("company").agg(F.count(F.lit(1)).alias("profiles"))
    return rows.join(sizes, "company").orderBy(F.col("company") == NO_COMPANY, F.lower("company"), F.lower("name"))
