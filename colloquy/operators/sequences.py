"""Ordered clean-up of segments and turns.

Everything that looks at neighbours goes through ``ordered.scan``, so a
recording is spread over many tasks. Runs are labelled by the row that opens
them and added up with partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import stage
from colloquy.functions.quality import is_weak, quality_score
from colloquy.functions.text import collapse_loops, is_hallucination, norm_text
from colloquy.operators.ordered import Step, islands, ordered_text, scan


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def blank(c: Column | str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


MERGE_GAP_MS = 1_500


def merge_same_speaker(segments: DataFrame, max_gap_ms: int = MERGE_GAP_MS) -> DataFrame:
    """Join neighbours of one known speaker over short gaps (win_merge_same_speaker).

    The merged row ends where its last segment ends, so each gap is against
    the previous row. Metrics keep the worst value. Texts are joined per block
    first and then per run.
    """
    near = scan(segments, [Step("_p", "lag", F.struct("speaker", "end_ms"))])
    starts = (
        F.col("_p").isNull() | F.col("speaker").isNull() | F.col("_p.speaker").isNull()
        | (F.col("_p.speaker") != F.col("speaker")) | (F.col("start_ms") - F.col("_p.end_ms") > max_gap_ms)
    )
    runs = islands(near, starts, keep_block=True)
    said = F.nullif(F.trim(F.col("text")), F.lit(""))
    pieces = runs.groupBy("job_id", "_blk", "island").agg(
        F.min_by("speaker", "seq").alias("speaker"),
        F.min_by("start_ms", "seq").alias("start_ms"),
        F.max_by("end_ms", "seq").alias("end_ms"),
        ordered_text(said, F.col("seq")).alias("text"),
        F.count(F.lit(1)).alias("merged"),
        F.min("avg_logprob").alias("avg_logprob"), F.max("no_speech_prob").alias("no_speech_prob"),
        F.max("compression_ratio").alias("compression_ratio"),
    )
    return pieces.groupBy("job_id", F.col("island").alias("seq")).agg(
        F.min_by("speaker", "_blk").alias("speaker"),
        F.min_by("start_ms", "_blk").alias("start_ms"),
        F.max_by("end_ms", "_blk").alias("end_ms"),
        ordered_text(F.nullif(F.col("text"), F.lit("")), F.col("_blk")).alias("text"),
        F.sum("merged").alias("merged"),
        F.min("avg_logprob").alias("avg_logprob"), F.max("no_speech_prob").alias("no_speech_prob"),
        F.max("compression_ratio").alias("compression_ratio"),
    )


def _repeats(segments: DataFrame) -> DataFrame:
    """Cleaned rows with their run of equal texts and whether they are dropped.

    The first two of a run stay, so a row goes exactly when both rows before
    it say the same.
    """
    cleaned = segments.where(~is_hallucination()).withColumn("text", collapse_loops(F.trim("text")))
    # Written once: two scans read it four times, and its text rules are dear.
    cleaned = stage.cut(cleaned.withColumn("norm", norm_text("text")), "cleaned")
    one = scan(cleaned, [Step("_p1", "lag", F.col("norm"))])
    same = (F.col("norm") != "") & F.coalesce(F.col("norm") == F.col("_p1"), F.lit(False))
    two = scan(one, [
        Step("_p2", "lag", F.col("_p1")),
        Step("run", "last", F.when(~same, F.col("seq"))),
    ])
    return two.withColumn("dropped", same & F.coalesce(F.col("norm") == F.col("_p2"), F.lit(False))).drop("_p1", "_p2")


def drop_loops(segments: DataFrame) -> DataFrame:
    """Segments without noise lines and without the third and later repeats (win_drop_loops)."""
    return _repeats(segments).where(~F.col("dropped")).drop("norm", "run", "dropped")


LOOP_MIN_DROPS, LOOP_TEXT_CHARS = 5, 120


def loop_records(segments: DataFrame) -> DataFrame:
    """Runs that lost five rows or more: range, text, count (win_loop_records)."""
    return (
        _repeats(segments).where("dropped").groupBy("job_id", "run")
        .agg(
            F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"),
            F.substring(F.min_by("norm", "seq"), 1, LOOP_TEXT_CHARS).alias("text"), F.count(F.lit(1)).alias("dropped"))
        .where(F.col("dropped") >= LOOP_MIN_DROPS)
    )


RECOVER_RANGES, RECOVER_MIN_MS, RECOVER_PAD_MS = 8, 2_000, 1_000


def loop_targets(records: DataFrame, top: int = RECOVER_RANGES) -> DataFrame:
    """Which loops are decoded again, longest first, and their clips (win_loop_targets).

    Ranked before the length test, so a short loop uses up a place.
    """
    length = F.col("end_ms") - F.col("start_ms")
    w = Window.partitionBy("job_id").orderBy(length.desc(), "run")
    return (
        records.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        .select(
            "job_id", "run", F.col("rank").cast("long").alias("rank"), (length >= RECOVER_MIN_MS).alias("recover"),
            F.when(length >= RECOVER_MIN_MS, F.greatest(F.col("start_ms") - RECOVER_PAD_MS, F.lit(0).cast("long"))).alias("clip_start"),
            F.when(length >= RECOVER_MIN_MS, F.col("end_ms") + RECOVER_PAD_MS).alias("clip_end"))
    )


def loop_loss(segments: DataFrame, records: DataFrame) -> DataFrame:
    """Audio lost to loops by job, worst range, coverage and alert (agg_loop_loss)."""
    audio = segments.groupBy("job_id").agg(F.max("end_ms").alias("_a"))
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0).cast("long"))
    lost = records.groupBy("job_id").agg(
        F.sum(length).alias("_l"), F.sum("dropped").alias("_d"), F.max("end_ms").alias("_e"),
        F.max_by(F.struct("start_ms", "end_ms"), F.struct(length, -F.col("run"))).alias("_w"))
    zero = F.lit(0).cast("long")
    rows = audio.join(lost, "job_id", "left").select(
        "job_id", F.coalesce("_l", zero).alias("lost_ms"), F.coalesce("_d", zero).alias("dropped"),
        F.greatest("_a", F.coalesce("_e", zero)).alias("audio_ms"),
        F.col("_w.start_ms").alias("worst_start"), F.col("_w.end_ms").alias("worst_end"))
    kept = F.greatest(F.col("audio_ms") - F.col("lost_ms"), zero)
    pct = F.when(F.col("audio_ms") > 0, kept * F.lit(100.0) / F.col("audio_ms")).otherwise(F.lit(0.0))
    return rows.select("*", kept.alias("kept_ms"), F.round(pct, 4).alias("coverage_pct"), ((F.col("dropped") > 0) & (pct < 80.0)).alias("alert"))


def weak_segments(segments: DataFrame) -> DataFrame:
    from colloquy.functions.quality import weak_reasons

    return segments.where(is_weak()).withColumn("score", quality_score()).withColumn("reason", weak_reasons())


CLIP_PAD_MS, CLIP_GAP_MS, CLIP_MAX = 1_000, 4_000, 12


def clip_ranges(weak: DataFrame, max_per_clip: int = CLIP_MAX) -> DataFrame:
    """Padded clips around near weak segments, at most twelve each (win_clip_ranges).

    Gap islands first, then every island cut by position. The weak rows are a
    small share and are written once, as three passes go over them.
    """
    weak = stage.cut(weak.select("job_id", "seq", "start_ms", "end_ms"), "weak")
    near = scan(weak, [Step("_e", "lag", F.col("end_ms")), Step("_n", "sum", F.lit(1).cast("long"))])
    starts = F.col("_e").isNull() | (F.col("start_ms") - F.col("_e") > CLIP_GAP_MS)
    runs = scan(near, [Step("_first", "last", F.when(starts, F.struct("seq", "_n")))])
    part = F.floor((F.col("_n") - F.col("_first._n")) / max_per_clip)
    return (
        runs.groupBy("job_id", F.col("_first.seq").alias("_i"), part.alias("_part"))
        .agg(F.min("seq").alias("seq"), F.min_by("start_ms", "seq").alias("_s"), F.max_by("end_ms", "seq").alias("_e"), F.count(F.lit(1)).alias("segments"))
        .select("job_id", "seq", F.greatest(F.col("_s") - CLIP_PAD_MS, F.lit(0).cast("long")).alias("clip_start"),
                (F.col("_e") + CLIP_PAD_MS).alias("clip_end"), "segments")
    )


BOUNDARY_MIN_MS, BOUNDARY_MAX_MS = 400, 2_000


def boundary_segments(segments: DataFrame) -> DataFrame:
    """Short segments next to another known speaker (win_boundary)."""
    label = F.nullif(F.trim(F.coalesce("speaker", F.lit(""))), F.lit(""))
    near = scan(segments, [Step("_prev", "lag", label), Step("_next", "lead", label)])
    d = F.col("end_ms") - F.col("start_ms")
    other = lambda c: F.coalesce(F.col(c) != label, F.lit(False))
    return near.where((d >= BOUNDARY_MIN_MS) & (d <= BOUNDARY_MAX_MS) & (other("_prev") | other("_next"))).drop("_prev", "_next")


WEAK_SHARE, BOUNDARY_RANGES = 0.3, 8


def repass_gates(segments: DataFrame, clips: DataFrame, boundary: DataFrame) -> DataFrame:
    """Share of weak audio and number of boundary clips by job, and what they skip (agg_weak_ratio)."""
    audio = segments.groupBy("job_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("audio_ms"))
    weak = clips.groupBy("job_id").agg(F.sum(F.col("clip_end") - F.col("clip_start")).alias("weak_ms"))
    edges = boundary.groupBy("job_id").agg(F.count(F.lit(1)).alias("boundary_ranges"))
    zero = F.lit(0).cast("long")
    rows = audio.join(weak, "job_id", "left").join(edges, "job_id", "left").select(
        "job_id", "audio_ms", F.coalesce("weak_ms", zero).alias("weak_ms"), F.coalesce("boundary_ranges", zero).alias("boundary_ranges"))
    return rows.select(
        "*",
        ((F.col("audio_ms") > 0) & (F.col("weak_ms") > F.col("audio_ms") * F.lit(WEAK_SHARE))).alias("skip_repass"),
        (F.col("boundary_ranges") > BOUNDARY_RANGES).alias("skip_boundary"))


ORPHAN_MS, ORPHAN_GAP_MS = 600, 2_000


def absorb_orphans(segments: DataFrame) -> DataFrame:
    """Short rows without a speaker take a neighbour's (fold_orphans).

    The row before may itself have been filled. Inside a run of orphans only
    the left side can be known, and it carries over gaps of up to 2 s; so the
    label that reaches a row is the last one set by a row that is no orphan
    or cut off by a wider gap. Only the last orphan of a run also sees a
    right neighbour.
    """
    near = scan(segments, [
        Step("_pe", "lag", F.col("end_ms")),
        Step("_nx", "lead", F.struct("speaker", "start_ms")),
    ])
    orphan = F.col("speaker").isNull() & (F.col("end_ms") - F.col("start_ms") <= ORPHAN_MS)
    gap_prev = F.col("start_ms") - F.col("_pe")
    source = F.when(~orphan, F.struct(F.nullif("speaker", F.lit("")).alias("s"))).when(
        gap_prev > ORPHAN_GAP_MS, F.struct(F.lit(None).cast("string").alias("s")))
    rows = scan(near, [Step("_src", "last_before", source)])
    prev, nxt = F.col("_src.s"), F.nullif(F.col("_nx.speaker"), F.lit(""))
    gap_next = F.col("_nx.start_ms") - F.col("end_ms")
    label = (
        F.when(prev.isNotNull() & nxt.isNotNull(), F.when(prev == nxt, prev).when(gap_next <= gap_prev, nxt).otherwise(prev))
        .when(nxt.isNotNull() & (gap_next <= ORPHAN_GAP_MS), nxt)
        .when(prev.isNotNull() & (gap_prev <= ORPHAN_GAP_MS), prev)
    )
    return rows.withColumn("speaker", F.when(orphan, label).otherwise(F.col("speaker"))).drop("_pe", "_nx", "_src")


MICRO_MS, MICRO_GAP_MS = 400, 1_000


#: Rows that are folded as one array.
FOLD_ROWS = 256

_ITEM = "struct<seq:bigint,speaker:string,start_ms:bigint,end_ms:bigint,kind:string>"
_NO_GAP = 1 << 62


def _item(x: Column, start: Column, end: Column, kind: Column | None = None) -> Column:
    return F.struct(x["seq"].alias("seq"), x["speaker"].alias("speaker"), start.alias("start_ms"), end.alias("end_ms"), (x["kind"] if kind is None else kind).alias("kind")).cast(_ITEM)


def _settled(items: Column, min_ms: int, decide) -> Column:
    """One pass over the items of a block: short turns go to the item before or after.

    ``decide(turn, before, after)`` gives 'before', 'after' or 'stay'. What goes
    to the item after is carried as the start it will take.
    """
    state = f"struct<kept:array<{_ITEM}>,carried:bigint>"
    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("kept"), F.lit(None).cast("long").alias("carried")).cast(state)
    pairs = F.transform(items, lambda x, i: F.struct(x.alias("x"), F.get(items, i + 1).alias("after")))

    def step(acc: Column, p: Column) -> Column:
        x = _item(p["x"], F.least(p["x"]["start_ms"], acc["carried"]), p["x"]["end_ms"])
        before = F.get(acc["kept"], F.size(acc["kept"]) - 1)
        short = (x["kind"] == "turn") & (x["end_ms"] - x["start_ms"] < min_ms)
        goes = F.when(short, decide(x, before, p["after"])).otherwise("stay")
        longer = _item(before, before["start_ms"], F.greatest(before["end_ms"], x["end_ms"]))
        kept = F.when(goes == "before", F.concat(F.slice(acc["kept"], 1, F.size(acc["kept"]) - 1), F.array(longer))).when(goes == "after", acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x)))
        return F.struct(kept.alias("kept"), F.when(goes == "after", x["start_ms"]).alias("carried")).cast(state)

    return F.aggregate(pairs, start, step, lambda acc: acc["kept"])


def _to_same_voice(gap_ms: int):
    def decide(x: Column, before: Column, after: Column) -> Column:
        mine = lambda o, gap: o.isNotNull() & o["speaker"].eqNullSafe(x["speaker"]) & (gap <= gap_ms)
        return F.when(mine(before, x["start_ms"] - before["end_ms"]), "before").when(mine(after, after["start_ms"] - x["end_ms"]), "after").otherwise("stay")

    return decide


def _to_nearer(x: Column, before: Column, after: Column) -> Column:
    left, right = F.coalesce(x["start_ms"] - before["end_ms"], F.lit(_NO_GAP)), F.coalesce(after["start_ms"] - x["end_ms"], F.lit(_NO_GAP))
    return F.when(before.isNull() & after.isNull(), "stay").when(left <= right, "before").otherwise("after")


def _settle(turns: DataFrame, min_ms: int, decide, name: str, *, voices: bool) -> DataFrame:
    """One pass of ``decide`` over recordings of any length, in blocks of ``FOLD_ROWS``.

    What a block needs of all rows before it is its entering state: voice and
    end of the turn kept last, and the start its first row takes over. Every
    block is folded from a guess (the last row before it, the largest end so
    far); those whose guess differs from the state in which the block before
    leaves are folded again, until all agree, which is exact because the first
    block of a recording guesses nothing. A turn that stays makes the state
    forget what came before, so the rounds are few; which turn a block lengthens is
    told only at the end. ``voices``: whether ``decide`` looks at the voice
    of the turn before.
    """
    keys, at = ["job_id", "blk"], F.floor(F.col("seq") / FOLD_ROWS).alias("blk")
    up = F.floor(F.col("blk") / FOLD_ROWS)
    voice = (lambda c: c) if voices else (lambda c: F.lit(None).cast("string"))
    row = F.struct("seq", "speaker", "start_ms", "end_ms", F.lit("turn").alias("kind")).cast(_ITEM)
    held = turns.groupBy("job_id", at).agg(F.sort_array(F.collect_list(row)).alias("turns"), F.max("end_ms").alias("reach"))
    first, last = F.col("turns")[0], F.element_at("turns", -1)
    around = scan(held, [
        Step("next", "lead", F.struct(first["speaker"].alias("speaker"), first["start_ms"].alias("start_ms"))),
        Step("voice", "lag", F.struct(last["speaker"].alias("speaker"))), Step("far", "max_before", F.col("reach")),
    ], order="blk", block=up)
    guess = F.struct(F.when(F.col("voice").isNotNull(), F.struct(voice(F.col("voice.speaker")).alias("speaker"), F.col("far").alias("end_ms"))).alias("before"), first["start_ms"].alias("start_ms"))
    blocks = stage.cut(around.select(*keys, "turns", "next", guess.alias("enter")), f"{name}-blocks")

    none, nobody = F.lit(None).cast("long"), F.array().cast(f"array<{_ITEM}>")
    edge = lambda x, start, end, kind: F.when(x.isNull(), nobody).otherwise(F.array(F.struct(none.alias("seq"), x["speaker"].alias("speaker"), start.alias("start_ms"), end.alias("end_ms"), F.lit(kind).alias("kind")).cast(_ITEM)))
    before, entry = F.col("enter.before"), F.col("enter.start_ms")
    opened = F.transform("turns", lambda x, i: F.when(i == 0, _item(x, F.least(x["start_ms"], entry), x["end_ms"])).otherwise(x))
    items = F.concat(edge(before, none, before["end_ms"], "before"), opened, edge(F.col("next"), F.col("next.start_ms"), none, "next"))
    folded = lambda df: df.withColumn("kept", F.flatten(F.transform(F.array(items), lambda x: _settled(x, min_ms, decide))))

    mine = F.filter("kept", lambda x: x["kind"] != "next")
    end = F.get(mine, F.size(mine) - 1)
    leave = F.struct(F.when(F.size(mine) > 0, F.struct(voice(end["speaker"]).alias("speaker"), end["end_ms"].alias("end_ms"))).alias("before"), F.element_at("kept", -1)["start_ms"].alias("start_ms"))
    told = lambda df: folded(df).select(*keys, "enter", "kept", leave.alias("leave"))
    done = stage.cut(told(blocks), f"{name}-folded")
    while True:
        met = scan(done.select(*keys, "enter", "leave"), [Step("given", "lag", F.col("leave"))], order="blk", block=up)
        wrong = stage.cut(met.where(F.col("given").isNotNull() & ~F.col("given").eqNullSafe(F.col("enter"))).select(*keys, F.col("given").alias("enter")), f"{name}-wrong")
        if wrong.isEmpty():
            break
        again = told(blocks.drop("enter").join(wrong, keys))
        done = stage.cut(done.join(wrong, keys, "left_anti").unionByName(again), f"{name}-folded")

    own = F.filter("kept", lambda x: x["kind"] == "turn")
    heads = scan(done.select(*keys, F.get(own, F.size(own) - 1)["seq"].alias("last"), F.get(F.filter("kept", lambda x: x["kind"] == "before"), 0)["end_ms"].alias("_e")),
                 [Step("seq", "last_before", F.col("last"))], order="blk", block=up)
    grown = heads.where("_e is not null").groupBy("job_id", "seq").agg(F.max("_e").alias("_e"))
    kept = done.select("job_id", F.inline(own)).drop("kind")
    return kept.join(grown, ["job_id", "seq"], "left").withColumn("end_ms", F.greatest("end_ms", "_e")).drop("_e")


def fuse_micro_turns(turns: DataFrame, min_ms: int = MICRO_MS, gap_ms: int = MICRO_GAP_MS) -> DataFrame:
    """Turns without flickers: short ones merged or absorbed, neighbours joined (fold_micro_turns).

    ``seq`` follows the start of the turns. Short turns first go to a neighbour of the same
    voice, then to the nearer one; no row holds more than a block of turns. The last pass joins
    same-speaker turns against the running largest end, as an island over scans.
    """
    rows = turns.select("job_id", "seq", "speaker", "start_ms", "end_ms")
    merged = _settle(rows, min_ms, _to_same_voice(gap_ms), "voice", voices=True)
    return join_turns(stage.cut(_settle(merged, min_ms, _to_nearer, "nearer", voices=False), "grown"), gap_ms)


def join_turns(turns: DataFrame, gap_ms: int = MICRO_GAP_MS) -> DataFrame:
    """Neighbouring turns of one speaker as one, gaps against the largest end so far."""
    one = scan(turns, [Step("_ps", "lag", F.struct("speaker"))])
    change = F.col("_ps").isNull() | ~F.col("_ps.speaker").eqNullSafe(F.col("speaker"))
    runs = islands(one, change, name="_voice")
    # The largest end before a row within the same-speaker stretch.
    ends = scan(
        runs, [Step("_m", "max_before", F.col("end_ms"))],
        keys=("job_id", "_voice"), block=F.floor(F.col("seq") / 1024))
    starts = change | (F.col("start_ms") - F.col("_m") > gap_ms)
    groups = islands(stage.cut(ends, "voices"), starts)
    return groups.groupBy("job_id", F.col("island").alias("seq")).agg(
        F.min_by("speaker", "seq").alias("speaker"), F.min_by("start_ms", "seq").alias("start_ms"), F.max("end_ms").alias("end_ms"))


PAUSE_MS, PARAGRAPH_MS = 1_200, 25_000


#: Rows up to which an unbroken stretch of one speaker is folded as one array; longer ones go by pointers.
STRETCH_ROWS = 1024


def paragraphs(segments: DataFrame) -> DataFrame:
    """Same-speaker paragraphs: cut at pauses and after 25 s (fold_paragraphs).

    A change of speaker or a pause restarts the rule, so stretches of unbroken
    speech stand alone. A short one is folded as an array of its rows; of a long
    one each row that can open a paragraph points to the next opener, and the
    pointers are followed by doubling, so that no row holds a long stretch.
    """
    label = F.coalesce(F.nullif("speaker", F.lit("")), F.lit("?"))
    rows = segments.select("job_id", "seq", "start_ms", "end_ms", label.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    near = scan(rows, [Step("_p", "lag", F.struct("speaker", "end_ms"))])
    starts = F.col("_p").isNull() | (F.col("_p.speaker") != F.col("speaker")) | (F.col("start_ms") - F.col("_p.end_ms") >= PAUSE_MS)
    runs = stage.cut(islands(near.withColumn("_starts", starts).drop("_p"), F.col("_starts")).drop("_starts"), "stretches")
    long = stage.cut(runs.groupBy("job_id", "island").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > STRETCH_ROWS).drop("n"), "long-stretches")
    tidy = lambda df: df.withColumn("text", lstrip(rstrip(F.col("text"))))
    if long.isEmpty():
        return tidy(_folded_stretches(runs))
    short = _folded_stretches(runs.join(long, ["job_id", "island"], "left_anti"))
    return tidy(short.unionByName(_long_stretches(runs.join(long, ["job_id", "island"], "left_semi"))))


def _folded_stretches(runs: DataFrame) -> DataFrame:
    """Paragraphs of stretches that are one array each: the places of the openers first, then the slices between them."""
    stretch = runs.groupBy("job_id", "island").agg(
        F.min_by("speaker", "seq").alias("speaker"), F.array_sort(F.collect_list(F.struct("seq", "start_ms", "end_ms", "text"))).alias("rows"))
    start = F.struct(F.lit(None).cast("long").alias("opened"), F.array().cast("array<int>").alias("at"))
    opens = lambda acc, r: acc["opened"].isNull() | (r["start_ms"] - acc["opened"] >= PARAGRAPH_MS)
    step = lambda acc, r: F.when(opens(acc, r), F.struct(r["start_ms"].alias("opened"), F.concat(acc["at"], F.array(r["i"])).alias("at"))).otherwise(acc)
    placed = F.transform("rows", lambda r, i: F.struct(i.cast("int").alias("i"), r["start_ms"].alias("start_ms")))
    told = stretch.withColumn("at", F.aggregate(placed, start, step, lambda acc: acc["at"]))
    ends = lambda k: F.coalesce(F.get("at", k + 1), F.size("rows"))
    parts = F.transform("at", lambda i, k: F.slice("rows", i + 1, ends(k) - i))
    one = lambda p: F.struct(
        p[0]["seq"].alias("seq"), p[0]["start_ms"].alias("start_ms"), F.element_at(p, -1)["end_ms"].alias("end_ms"), F.size(p).cast("long").alias("n"),
        F.array_join(F.transform(p, lambda r: r["text"]), " ").alias("text"))
    return told.select("job_id", "speaker", F.inline(F.transform(parts, one)))


def _long_stretches(runs: DataFrame) -> DataFrame:
    """As ``_folded_stretches``, for stretches of any length.

    Only a row that starts later than all rows before it can open a paragraph,
    and from one opener to the next 25 s pass at least. So the next opener lies
    in the next 25-second bucket at a time that is given, or is the first row of
    a later bucket.
    """
    keys = ["job_id", "island"]
    seen = scan(runs.select(*keys, "seq", "start_ms"), [Step("_m", "max_before", F.col("start_ms"))], keys=tuple(keys), block=F.floor(F.col("seq") / STRETCH_ROWS))
    records = seen.where(F.col("_m").isNull() | (F.col("start_ms") > F.col("_m"))).select(*keys, "seq", F.col("start_ms").alias("at"))
    records = stage.cut(records.withColumn("bucket", F.floor(F.col("at") / PARAGRAPH_MS)), "records")
    # what each record asks for meets the records of the bucket after its own
    asked = records.select(*keys, (F.col("bucket") + 1).alias("bucket"), (F.col("at") + PARAGRAPH_MS).alias("t"), F.col("at").alias("node"), F.lit(None).cast("long").alias("here"))
    both = asked.unionByName(records.select(*keys, "bucket", F.col("at").alias("t"), F.lit(None).cast("long").alias("node"), F.col("at").alias("here")))
    onward = Window.partitionBy(*keys, "bucket").orderBy("t", F.col("here").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = both.withColumn("next", F.first("here", True).over(onward)).where("node is not null")
    heads = both.groupBy(*keys, "bucket").agg(F.min("here").alias("first"))
    later = scan(heads, [Step("later", "next", F.col("first"))], keys=tuple(keys), order="bucket", block=F.floor(F.col("bucket") / STRETCH_ROWS))
    to = met.join(later.select(*keys, "bucket", "later"), [*keys, "bucket"]).select(*keys, "node", F.coalesce("next", "later").alias("next"))
    to = stage.cut(to.where("next is not null"), "pointers")
    open_ = stage.cut(records.groupBy(*keys).agg(F.min("at").alias("node")), "openers")
    while not to.isEmpty():
        # twice as far in every round: openers within 2 ** k steps of the head, pointers of 2 ** k steps
        open_ = stage.cut(open_.unionByName(open_.join(to, [*keys, "node"]).select(*keys, F.col("next").alias("node"))), "openers")
        beyond = to.select(*keys, F.col("node").alias("next"), F.col("next").alias("beyond"))
        to = stage.cut(to.join(beyond, [*keys, "next"]).select(*keys, "node", F.col("beyond").alias("next")), "pointers")
    openers = records.join(open_.withColumnRenamed("node", "at"), [*keys, "at"]).select("job_id", "seq", F.lit(True).alias("_opens"))
    marked = runs.join(openers, ["job_id", "seq"], "left")
    told = islands(marked, F.col("_opens").isNotNull(), name="_paragraph")
    return told.groupBy("job_id", F.col("_paragraph").alias("seq")).agg(
        F.min_by("speaker", "seq").alias("speaker"), F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"), F.count(F.lit(1)).alias("n"), ordered_text("text", "seq").alias("text"))


SAMPLE_GAP_MS, SAMPLE_TEXT_CHARS, SAMPLE_MIN_MS, SAMPLE_CLIP_MS = 3_000, 120.0, 1_000, 8_000
TIME_BUCKET_MS = 60_000


def isolation_scores(segments: DataFrame) -> DataFrame:
    """Length, distance to other voices and text, less overlaps (win_isolation_score).

    A gap counts up to 3 s, so only segments within 3 s are looked at: an
    equi-join on (job, minute) instead of all pairs of a job.
    """
    cols = segments.select("job_id", "seq", "start_ms", "end_ms", F.coalesce("speaker", F.lit("")).alias("speaker"), "text")
    mine = cols.withColumn("b", F.explode(F.sequence(
        F.floor((F.col("start_ms") - SAMPLE_GAP_MS) / TIME_BUCKET_MS), F.floor((F.col("end_ms") + SAMPLE_GAP_MS) / TIME_BUCKET_MS))))
    theirs = cols.select(
        "job_id", F.col("start_ms").alias("os"), F.col("end_ms").alias("oe"), F.col("speaker").alias("ov"),
        F.explode(F.sequence(F.floor(F.col("start_ms") / TIME_BUCKET_MS), F.floor(F.col("end_ms") / TIME_BUCKET_MS))).alias("b"))
    touch = (
        (F.col("ov") != F.col("speaker")) & (F.col("os") < F.col("end_ms") + SAMPLE_GAP_MS) & (F.col("oe") > F.col("start_ms") - SAMPLE_GAP_MS)
        & (F.col("b") == F.greatest(F.floor(F.col("os") / TIME_BUCKET_MS), F.floor((F.col("start_ms") - SAMPLE_GAP_MS) / TIME_BUCKET_MS)))
    )
    over = (F.col("os") < F.col("end_ms")) & (F.col("oe") > F.col("start_ms"))
    gap = F.when(over, F.lit(0).cast("long")).when(F.col("oe") <= F.col("start_ms"), F.col("start_ms") - F.col("oe")).otherwise(F.col("os") - F.col("end_ms"))
    seen = mine.select("job_id", "seq", "start_ms", "end_ms", "speaker", "b").join(theirs, ["job_id", "b"]).where(touch).groupBy("job_id", "seq").agg(
        F.min(gap).alias("_g"), F.count_if(over).alias("_o"))
    rows = cols.join(seen, ["job_id", "seq"], "left")
    near = F.least(F.coalesce("_g", F.lit(SAMPLE_GAP_MS).cast("long")), F.lit(SAMPLE_GAP_MS).cast("long"))
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0).cast("long"))
    text = F.least(F.length(F.coalesce("text", F.lit(""))) / F.lit(SAMPLE_TEXT_CHARS), F.lit(1.0))
    overlaps = F.coalesce("_o", F.lit(0).cast("long"))
    score = (length + near) / F.lit(1000.0) + text - overlaps * F.lit(10.0)
    return rows.select("job_id", "seq", "speaker", "start_ms", "end_ms", near.alias("gap_ms"), overlaps.alias("overlaps"), F.round(score, 6).alias("score"))


def sample_picks(segments: DataFrame, per_speaker: int = 3, clip_ms: int = SAMPLE_CLIP_MS) -> DataFrame:
    """Best sample clips of each speaker (win_sample_pick)."""
    d = F.col("end_ms") - F.col("start_ms")
    scored = isolation_scores(segments).where(F.trim("speaker") != "").withColumn("speaker", F.trim("speaker"))
    fit = d >= SAMPLE_MIN_MS
    w = Window.partitionBy("job_id", "speaker").orderBy(fit.desc(), F.when(fit, F.col("score")).otherwise(d.cast("double")).desc(), "seq")
    top = scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= per_speaker)
    any_fit = F.max(fit).over(Window.partitionBy("job_id", "speaker"))
    top = top.withColumn("_any", any_fit).where(fit | ~F.col("_any")).where(d > 0)
    trim = F.when(d > 1_200, F.lit(50).cast("long")).otherwise(F.lit(0).cast("long"))
    whole = d <= clip_ms + 2 * trim
    return top.select(
        "job_id", "speaker", "rank", "seq",
        F.when(whole, F.col("start_ms") + trim).otherwise(F.greatest(F.lit(0).cast("long"), F.floor((F.col("start_ms") + F.col("end_ms") - clip_ms) / F.lit(2)))).alias("clip_start"),
        F.when(whole, F.greatest(F.least(F.lit(clip_ms).cast("long"), d - trim * 2), F.least(d, F.lit(1_000).cast("long")))).otherwise(F.lit(clip_ms).cast("long")).alias("clip_ms"))


ENROL_TURNS, ENROL_TARGET_MS, ENROL_MIN_MS, RECOG_TURNS = 5, 30_000, 2_000, 3


def enrol_turns(candidates: DataFrame) -> DataFrame:
    """Longest turns of a voice: five at most, enough once 30 s are reached with two (win_enrol_turns)."""
    d = F.col("end_ms") - F.col("start_ms")
    w = Window.partitionBy("job_id", "speaker").orderBy(d.desc(), "seq")
    top = candidates.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= ENROL_TURNS)
    before = F.coalesce(F.sum(d).over(Window.partitionBy("job_id", "speaker").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return top.withColumn("_b", before).where((F.col("rank") <= 2) | (F.col("_b") < ENROL_TARGET_MS)).drop("_b")


def recog_turns(turns: DataFrame, top: int = RECOG_TURNS) -> DataFrame:
    """Longest turns of each unnamed cluster (win_recog_turns)."""
    d = F.col("end_ms") - F.col("start_ms")
    w = Window.partitionBy("job_id", "speaker").orderBy(d.desc(), "seq")
    kept = turns.where(F.upper("speaker").startswith("SPEAKER_") & (d >= ENROL_MIN_MS))
    return kept.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


SENTENCE_END = r"(?<=[.!?…])\s+"


def split_plain_text(texts: DataFrame) -> DataFrame:
    """Flat text (id, text, duration_ms) to timed sentences (win_plain_text_split).

    Each sentence gets its share of the words, half a second at least. The
    window is over the sentences of one text.
    """
    words = lambda c: F.regexp_count(c, F.lit(r"\S+"))
    pieces = F.filter(F.transform(F.split(F.trim("text"), SENTENCE_END), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = texts.withColumn("_p", pieces).withColumn(
        "_total", F.greatest(F.aggregate("_p", F.lit(0), lambda a, p: a + words(p)), F.lit(1))
    ).withColumn("_span", F.greatest(F.greatest(F.coalesce("duration_ms", F.lit(0).cast("long")), F.lit(0).cast("long")) / F.lit(1000.0), F.size("_p").cast("double")))
    rows = rows.select("id", "_total", "_span", F.posexplode("_p").alias("pos", "text"))
    length = F.greatest(F.col("_span") * (words(F.col("text")) / F.col("_total")), F.lit(0.5))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_len", length).withColumn("_s", F.coalesce(F.sum("_len").over(w), F.lit(0.0)))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), F.bround("_s", 2).alias("start"), F.bround(F.col("_s") + F.col("_len"), 2).alias("end"), "text")


TAIL_ROWS = 3


def history_tails(segments: DataFrame) -> DataFrame:
    """Last three rows of the chunk before, as continuity text of each chunk (win_history_tail).

    ``segments``: job_id, chunk, seq, speaker, text.
    """
    w = Window.partitionBy("job_id", "chunk").orderBy(F.col("seq").desc())
    line = F.concat(F.lit("["), F.coalesce(F.nullif("speaker", F.lit("")), F.lit("—")), F.lit("] "), F.coalesce("text", F.lit("")))
    tail = (
        segments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= TAIL_ROWS)
        .groupBy("job_id", "chunk").agg(ordered_text(line, F.col("seq"), "\n").alias("tail"))
    )
    before = scan(tail, [Step("history", "lag", F.col("tail"))], order="chunk")
    return before.select("job_id", "chunk", F.coalesce("history", F.lit("")).alias("history"))


def vad_manifest(kept: DataFrame) -> DataFrame:
    """Kept spans laid end to end on the trimmed timeline (win_vad_manifest)."""
    d = F.col("src_end") - F.col("src_start")
    return scan(kept.where(d > 0), [Step("trim_start", "sum_before", d)]).withColumn("trim_end", F.col("trim_start") + d)


INTRO_MS = 240_000


def intro_snippets(segments: DataFrame) -> DataFrame:
    """Opening text of a recording, up to the first start after four minutes (win_intro_snippet)."""
    stop = segments.where(F.col("start_ms") > INTRO_MS).groupBy("job_id").agg(F.min("seq").alias("_stop"))
    said = F.nullif(F.trim("text"), F.lit(""))
    return (
        segments.where(F.col("start_ms") <= INTRO_MS).join(stop, "job_id", "left")
        .where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop")))
        .groupBy("job_id").agg(ordered_text(said, F.col("seq")).alias("snippet"), F.count(F.lit(1)).alias("segments"))
    )
