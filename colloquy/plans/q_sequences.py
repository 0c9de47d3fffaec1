"""Ordered clean-up over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import views as V
from colloquy.operators import joins as J
from colloquy.operators import sequences as S
from colloquy.plans.registry import query

# SQL pieces shared by several statements.
NORM = "trim(regexp_replace(replace(replace(lower(trim({c})), '’', ''''), '…', '...'), '[^a-z0-9à-öø-ÿ'']+', ' ', 'g'))"
_N = NORM.format(c="text")
NOISE = f"""(trim(text) = '' OR NOT regexp_matches(text, '[A-Za-zÀ-ÖØ-öø-ÿ0-9]')
    OR {_N} IN ('sous titrage st 501', 'sous titres realises par la communaute d''amara org', 'merci d''avoir regarde cette video')
    OR starts_with({_N}, 'sous titrage') OR (coalesce(compression_ratio, 0) >= 2.4 AND length({_N}) <= 4))"""
LP = "coalesce(nullif(avg_logprob, 0), -0.3)"
NS = "coalesce(nullif(no_speech_prob, 0), 0)"
CR = "coalesce(nullif(compression_ratio, 0), 1.5)"
SCORE = f"""(0.75::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({LP} + 1.5::DOUBLE) / 1.3::DOUBLE))
    + 0.15::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, greatest(0.0::DOUBLE, {NS})))
    + 0.1::DOUBLE * CASE WHEN {CR} <= 2.0 THEN 1.0 WHEN {CR} >= 3.5 THEN 0.0 ELSE (3.5::DOUBLE - {CR}) / 1.5::DOUBLE END)"""
WEAK = f"(end_ms - start_ms >= 400 AND {SCORE} < 0.55)"

REPEATS = f"""
    cleaned AS (SELECT *, {_N} AS norm FROM @captions WHERE NOT {NOISE}),
    lagged AS (SELECT *, lag(norm) OVER (PARTITION BY job_id ORDER BY seq) AS p FROM cleaned),
    runs AS (SELECT *, sum(CASE WHEN norm <> '' AND norm = p THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY seq) AS r FROM lagged),
    placed AS (SELECT *, row_number() OVER (PARTITION BY job_id, r ORDER BY seq) AS k, min(seq) OVER (PARTITION BY job_id, r) AS run FROM runs)"""
RECORDS = REPEATS + """,
    records AS (SELECT job_id, run, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, left(any_value(norm), 120) AS text, count(*) AS dropped
                FROM placed WHERE k > 2 GROUP BY 1, 2 HAVING count(*) >= 5)"""


@query("fn_quality_score", f"SELECT job_id, seq, round({SCORE}, 6) AS score FROM @segments")
def fn_quality_score(spark, sf):
    return V.segments(spark, sf).select("job_id", "seq", F.round(S.quality_score(), 6).alias("score"))


@query("fn_weak_flag", f"""
    SELECT job_id, seq, round({SCORE}, 6) AS score,
           coalesce(nullif(concat_ws(', ', CASE WHEN {LP} < -0.85 THEN 'logprob bas' END, CASE WHEN {NS} > 0.65 THEN 'no_speech élevé' END,
                                     CASE WHEN {CR} > 2.2 THEN 'compression élevée' END), ''), 'qualité globale faible') AS reason
    FROM @segments WHERE {WEAK}""")
def fn_weak_flag(spark, sf):
    return S.weak_segments(V.segments(spark, sf)).select("job_id", "seq", F.round("score", 6).alias("score"), "reason")


@query("fn_hallucination", f"SELECT job_id, seq, text FROM @captions WHERE {NOISE}")
def fn_hallucination(spark, sf):
    return V.captions(spark, sf).where(S.is_hallucination()).select("job_id", "seq", "text")


@query("fn_norm_text", f"SELECT doc_id, {_N} AS norm FROM documents")
def fn_norm_text(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.norm_text("text").alias("norm"))


@query("fn_collapse_ngrams")
def fn_collapse_ngrams(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.collapse_loops("text").alias("text"))


@query("win_merge_same_speaker", r"""
    WITH l AS (SELECT *, lag(speaker) OVER w AS ps, lag(end_ms) OVER w AS pe FROM @captions WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
    i AS (SELECT *, sum(CASE WHEN speaker IS NULL OR ps IS NULL OR ps <> speaker OR start_ms - pe > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq) AS g FROM l)
    SELECT job_id, min(seq) AS seq, any_value(speaker) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, seq) AS end_ms,
           string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS merged, max(compression_ratio) AS compression_ratio FROM i GROUP BY job_id, g""")
def win_merge_same_speaker(spark, sf):
    cap = V.captions(spark, sf).withColumn("avg_logprob", F.lit(0.0)).withColumn("no_speech_prob", F.lit(0.0))
    return S.merge_same_speaker(cap).select("job_id", "seq", "speaker", "start_ms", "end_ms", "text", "merged", "compression_ratio")


@query("win_drop_loops", f"WITH {REPEATS} SELECT job_id, seq, start_ms, end_ms, text FROM placed WHERE k <= 2")
def win_drop_loops(spark, sf):
    return S.drop_loops(V.captions(spark, sf)).select("job_id", "seq", "start_ms", "end_ms", "text")


@query("win_loop_records", f"WITH {RECORDS} SELECT * FROM records")
def win_loop_records(spark, sf):
    return S.loop_records(V.captions(spark, sf))


@query("win_loop_targets", f"""
    WITH {RECORDS},
    r AS (SELECT *, end_ms - start_ms AS d, row_number() OVER (PARTITION BY job_id ORDER BY end_ms - start_ms DESC, run) AS rank FROM records)
    SELECT job_id, run, rank, d >= 2000 AS recover, CASE WHEN d >= 2000 THEN greatest(start_ms - 1000, 0) END AS clip_start,
           CASE WHEN d >= 2000 THEN end_ms + 1000 END AS clip_end FROM r WHERE rank <= 8""")
def win_loop_targets(spark, sf):
    return S.loop_targets(S.loop_records(V.captions(spark, sf)))


@query("agg_loop_loss", f"""
    WITH {RECORDS},
    a AS (SELECT job_id, max(end_ms) AS a FROM @captions GROUP BY 1),
    l AS (SELECT job_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS l, CAST(sum(dropped) AS BIGINT) AS d, max(end_ms) AS e FROM records GROUP BY 1),
    w AS (SELECT * FROM (SELECT job_id, start_ms, end_ms, row_number() OVER (PARTITION BY job_id ORDER BY end_ms - start_ms DESC, run) AS k FROM records) WHERE k = 1),
    r AS (SELECT a.job_id, coalesce(l, 0) AS lost_ms, coalesce(d, 0) AS dropped, greatest(a, coalesce(e, 0)) AS audio_ms, w.start_ms AS worst_start, w.end_ms AS worst_end
          FROM a LEFT JOIN l USING (job_id) LEFT JOIN w USING (job_id))
    SELECT *, greatest(audio_ms - lost_ms, 0) AS kept_ms, round(greatest(audio_ms - lost_ms, 0) * 100.0::DOUBLE / audio_ms, 4) AS coverage_pct,
           dropped > 0 AND greatest(audio_ms - lost_ms, 0) * 100.0::DOUBLE / audio_ms < 80 AS alert FROM r""")
def agg_loop_loss(spark, sf):
    cap = V.captions(spark, sf)
    return S.loop_loss(cap, S.loop_records(cap))


_CLIPS = f"""
    weak AS (SELECT * FROM @segments WHERE {WEAK}),
    g AS (SELECT *, lag(end_ms) OVER (PARTITION BY job_id ORDER BY seq) AS pe FROM weak),
    i AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms - pe > 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq) AS isl FROM g),
    p AS (SELECT *, (row_number() OVER (PARTITION BY job_id, isl ORDER BY seq) - 1) // 12 AS part FROM i),
    clips AS (SELECT job_id, min(seq) AS seq, greatest(arg_min(start_ms, seq) - 1000, 0) AS clip_start, arg_max(end_ms, seq) + 1000 AS clip_end, count(*) AS segments
              FROM p GROUP BY job_id, isl, part)"""


@query("win_clip_ranges", f"WITH {_CLIPS} SELECT * FROM clips")
def win_clip_ranges(spark, sf):
    return S.clip_ranges(S.weak_segments(V.segments(spark, sf)))


_BOUNDARY = """
    nb AS (SELECT *, lag(speaker) OVER w AS ps, lead(speaker) OVER w AS ns FROM @captions WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
    boundary AS (SELECT job_id, seq, speaker FROM nb WHERE end_ms - start_ms BETWEEN 400 AND 2000 AND (coalesce(ps <> speaker, false) OR coalesce(ns <> speaker, false)))"""


@query("win_boundary", f"WITH {_BOUNDARY} SELECT * FROM boundary")
def win_boundary(spark, sf):
    return S.boundary_segments(V.captions(spark, sf)).select("job_id", "seq", "speaker")


@query("agg_weak_ratio", f"""
    WITH {_CLIPS}, {_BOUNDARY},
    a AS (SELECT job_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS audio_ms FROM @segments GROUP BY 1),
    w AS (SELECT job_id, CAST(sum(clip_end - clip_start) AS BIGINT) AS weak_ms FROM clips GROUP BY 1),
    b AS (SELECT job_id, count(*) AS n FROM boundary GROUP BY 1)
    SELECT job_id, audio_ms, coalesce(weak_ms, 0) AS weak_ms, coalesce(n, 0) AS boundary_ranges,
           coalesce(weak_ms, 0) > audio_ms * 0.3::DOUBLE AS skip_repass, coalesce(n, 0) > 8 AS skip_boundary
    FROM a LEFT JOIN w USING (job_id) LEFT JOIN b USING (job_id)""")
def agg_weak_ratio(spark, sf):
    seg = V.segments(spark, sf)
    return S.repass_gates(seg, S.clip_ranges(S.weak_segments(seg)), S.boundary_segments(V.captions(spark, sf)))


@query("fold_orphans", """
    WITH n AS (SELECT *, speaker IS NULL AND end_ms - start_ms <= 600 AS orphan, start_ms - lag(end_ms) OVER w AS before,
                      lead(start_ms) OVER w - end_ms AS after, nullif(lead(speaker) OVER w, '') AS nxt FROM @captions WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
    s AS (SELECT *, CASE WHEN NOT orphan THEN coalesce(speaker, '') WHEN before > 2000 THEN '' END AS told FROM n),
    p AS (SELECT *, nullif(last_value(told IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev FROM s)
    SELECT job_id, seq, CASE WHEN NOT orphan THEN speaker WHEN prev IS NOT NULL AND nxt IS NOT NULL THEN CASE WHEN prev = nxt THEN prev WHEN after <= before THEN nxt ELSE prev END
                             WHEN nxt IS NOT NULL AND after <= 2000 THEN nxt WHEN prev IS NOT NULL AND before <= 2000 THEN prev END AS speaker FROM p""")
def fold_orphans(spark, sf):
    return S.absorb_orphans(V.captions(spark, sf)).select("job_id", "seq", "speaker")


@query("fold_micro_turns")
def fold_micro_turns(spark, sf):
    return S.fuse_micro_turns(V.turns(spark, sf))


@query("fold_paragraphs", """
    SELECT job_id, speaker, seq, start_ms, end_ms, n, text FROM (
        WITH RECURSIVE c AS (SELECT job_id, seq, start_ms, end_ms, coalesce(nullif(speaker, ''), '?') AS speaker, coalesce(text, '') AS text, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM @captions),
        p AS (SELECT job_id, rn, start_ms AS opened, seq AS head, end_ms, speaker FROM c WHERE rn = 1
              UNION ALL SELECT c.job_id, c.rn, CASE WHEN c.speaker <> p.speaker OR c.start_ms - p.end_ms >= 1200 OR c.start_ms - opened >= 25000 THEN c.start_ms ELSE opened END,
                               CASE WHEN c.speaker <> p.speaker OR c.start_ms - p.end_ms >= 1200 OR c.start_ms - opened >= 25000 THEN c.seq ELSE head END, c.end_ms, c.speaker
              FROM p JOIN c ON c.job_id = p.job_id AND c.rn = p.rn + 1)
        SELECT job_id, min(c.speaker) AS speaker, head AS seq, min(c.start_ms) AS start_ms, arg_max(c.end_ms, c.seq) AS end_ms, count(*) AS n, trim(string_agg(c.text, ' ' ORDER BY c.seq)) AS text
        FROM p JOIN c USING (job_id, rn) GROUP BY job_id, head)""")
def fold_paragraphs(spark, sf):
    return S.paragraphs(V.captions(spark, sf))


_ISO = """
    c AS (SELECT job_id, seq, start_ms, end_ms, coalesce(speaker, '') AS speaker, text FROM @captions),
    o AS (SELECT a.job_id, a.seq, min(CASE WHEN b.start_ms < a.end_ms AND b.end_ms > a.start_ms THEN 0 WHEN b.end_ms <= a.start_ms THEN a.start_ms - b.end_ms ELSE b.start_ms - a.end_ms END) AS g,
                 count(*) FILTER (b.start_ms < a.end_ms AND b.end_ms > a.start_ms) AS o
          FROM c a JOIN c b ON a.job_id = b.job_id AND a.speaker <> b.speaker AND b.start_ms < a.end_ms + 3000 AND b.end_ms > a.start_ms - 3000 GROUP BY 1, 2),
    iso AS (SELECT c.job_id, c.seq, c.speaker, c.start_ms, c.end_ms, least(coalesce(g, 3000), 3000) AS gap_ms, coalesce(o, 0) AS overlaps,
                   round((end_ms - start_ms + least(coalesce(g, 3000), 3000)) / 1000.0 + least(length(text) / 120.0, 1.0) - coalesce(o, 0) * 10.0, 6) AS score
            FROM c LEFT JOIN o ON o.job_id = c.job_id AND o.seq = c.seq)"""


@query("win_isolation_score", f"WITH {_ISO} SELECT * FROM iso")
def win_isolation_score(spark, sf):
    return S.isolation_scores(V.captions(spark, sf))


@query("win_sample_pick", f"""
    WITH {_ISO},
    r AS (SELECT *, end_ms - start_ms AS d, max(CASE WHEN end_ms - start_ms >= 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, speaker) AS fit FROM iso WHERE speaker <> ''),
    k AS (SELECT *, row_number() OVER (PARTITION BY job_id, speaker ORDER BY CASE WHEN fit = 1 THEN score ELSE d END DESC, seq) AS rank FROM r WHERE fit = 0 OR d >= 1000),
    t AS (SELECT *, CASE WHEN d > 1200 THEN 50 ELSE 0 END AS trim FROM k WHERE rank <= 3)
    SELECT job_id, speaker, rank, seq, CASE WHEN d <= 8000 + 2 * trim THEN start_ms + trim ELSE greatest(0, (start_ms + end_ms - 8000) // 2) END AS clip_start,
           CASE WHEN d <= 8000 + 2 * trim THEN greatest(least(8000, d - 2 * trim), least(d, 1000)) ELSE 8000 END AS clip_ms FROM t""")
def win_sample_pick(spark, sf):
    return S.sample_picks(V.captions(spark, sf))


_CLEAN = """
    l AS (SELECT job_id, seq, coalesce(speaker, '') AS speaker, start_ms, end_ms FROM @turns_conv),
    d AS (SELECT * FROM l WHERE end_ms - start_ms >= 2000),
    x AS (SELECT *, NOT EXISTS (SELECT 1 FROM both_sides o WHERE o.job_id = d.job_id AND o.speaker <> d.speaker
                                AND least(o.end_ms, d.end_ms) - greatest(o.start_ms, d.start_ms) > 100) AS clean FROM d),
    clean AS (SELECT job_id, speaker, seq, start_ms, end_ms, clean FROM (SELECT *, max(CASE WHEN clean THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, speaker) AS anyclean FROM x) WHERE clean OR anyclean = 0)"""
_BOTH = """
    both_sides AS (SELECT job_id, seq, speaker, start_ms, end_ms FROM @turns_conv
                   UNION ALL SELECT job_id, seq + 100000, 'SPEAKER_08', start_ms + 450, start_ms + 700 FROM @segments WHERE speaker = 'SPEAKER_01')"""


def _talked_over(spark, sf):
    turns = V.turns_conv(spark, sf)
    noise = V.segments(spark, sf).where(F.col("speaker") == "SPEAKER_01").select(
        "job_id", (F.col("seq") + 100_000).alias("seq"), (F.col("start_ms") + 450).alias("start_ms"), (F.col("start_ms") + 700).alias("end_ms"), F.lit("SPEAKER_08").alias("speaker"))
    return turns.unionByName(noise), turns.select("job_id", "speaker").distinct()


@query("join_clean_turns", f"WITH {_BOTH}, {_CLEAN} SELECT * FROM clean")
def join_clean_turns(spark, sf):
    return J.clean_turns(*_talked_over(spark, sf))


@query("win_enrol_turns", f"""
    WITH {_BOTH}, {_CLEAN},
    r AS (SELECT *, row_number() OVER (PARTITION BY job_id, speaker ORDER BY end_ms - start_ms DESC, seq) AS rank,
                 coalesce(sum(end_ms - start_ms) OVER (PARTITION BY job_id, speaker ORDER BY end_ms - start_ms DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM clean)
    SELECT job_id, speaker, seq, rank FROM r WHERE rank <= 5 AND (rank <= 2 OR b < 30000)""")
def win_enrol_turns(spark, sf):
    return S.enrol_turns(J.clean_turns(*_talked_over(spark, sf))).select("job_id", "speaker", "seq", "rank")


@query("win_recog_turns", """
    SELECT job_id, speaker, seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id, speaker ORDER BY end_ms - start_ms DESC, seq) AS rank
                                            FROM @turns WHERE end_ms - start_ms >= 2000) WHERE rank <= 3""")
def win_recog_turns(spark, sf):
    return S.recog_turns(V.turns(spark, sf)).select("job_id", "speaker", "seq", "rank")


@query("win_plain_text_split")
def win_plain_text_split(spark, sf):
    texts = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("n_chars") * 60).cast("long").alias("duration_ms"))
    return S.split_plain_text(texts)


@query("win_history_tail", """
    WITH c AS (SELECT job_id, start_ms // 300000 AS chunk, seq, speaker, text FROM @captions),
    k AS (SELECT *, row_number() OVER (PARTITION BY job_id, chunk ORDER BY seq DESC) AS r FROM c),
    t AS (SELECT job_id, chunk, string_agg('[' || coalesce(speaker, '—') || '] ' || text, chr(10) ORDER BY seq) AS tail FROM k WHERE r <= 3 GROUP BY 1, 2)
    SELECT job_id, chunk, coalesce(lag(tail) OVER (PARTITION BY job_id ORDER BY chunk), '') AS history FROM t""")
def win_history_tail(spark, sf):
    cap = V.captions(spark, sf).select("job_id", F.floor(F.col("start_ms") / 300_000).alias("chunk"), "seq", "speaker", "text")
    return S.history_tails(cap)


@query("win_vad_manifest", "SELECT job_id, seq, src_start, src_end, trim_start, trim_end FROM @spans")
def win_vad_manifest(spark, sf):
    kept = V.segments(spark, sf).where(F.col("seq") % 2 == 1).select("job_id", "seq", F.col("start_ms").alias("src_start"), F.col("end_ms").alias("src_end"))
    return S.vad_manifest(kept)


@query("win_intro_snippet", """
    WITH st AS (SELECT job_id, min(seq) AS stop FROM @captions WHERE start_ms > 240000 GROUP BY 1)
    SELECT c.job_id, string_agg(text, ' ' ORDER BY seq) AS snippet, count(*) AS segments FROM @captions c LEFT JOIN st USING (job_id)
    WHERE stop IS NULL OR seq < stop GROUP BY 1""")
def win_intro_snippet(spark, sf):
    return S.intro_snippets(V.captions(spark, sf))
