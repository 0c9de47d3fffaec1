"""Interval, lookup and ranked joins over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import views as V
from colloquy.operators import joins as J
from colloquy.operators.aggregates import speaker_slices
from colloquy.operators.ranking import plan_chunks
from colloquy.plans.q_aggregates import _SLICES
from colloquy.plans.registry import query


def argmax_sql(left: str, right: str) -> str:
    return f"""
    ov AS (SELECT s.job_id, s.seq, t.speaker, CAST(sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS BIGINT) AS o, min(t.seq) AS f
           FROM {left} s JOIN {right} t ON t.job_id = s.job_id AND s.start_ms < t.end_ms AND s.end_ms > t.start_ms GROUP BY 1, 2, 3),
    best AS (SELECT job_id, seq, speaker, o FROM (SELECT *, row_number() OVER (PARTITION BY job_id, seq ORDER BY o DESC, f) AS rn FROM ov) WHERE rn = 1)"""


@query("join_overlap_argmax", f"""
    WITH {argmax_sql('@segments', '@turns_conv')}
    SELECT s.job_id, s.seq, b.speaker, b.o AS overlap_ms FROM @segments s LEFT JOIN best b ON b.job_id = s.job_id AND b.seq = s.seq""")
def join_overlap_argmax(spark, sf):
    return J.overlap_speakers(V.segments(spark, sf), V.turns_conv(spark, sf)).select("job_id", "seq", "speaker", "overlap_ms")


def _short_turns(spark, sf):
    """Alternating short turns over the conversations, with holes between them."""
    t = V.turns_conv(spark, sf)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end_ms") - F.col("start_ms")) / 1_500)))
    t = t.select("job_id", "seq", "start_ms", "end_ms", piece.alias("k"))
    return t.select(
        "job_id", (F.col("seq") * 10_000 + F.col("k")).alias("seq"), (F.col("start_ms") + F.col("k") * 1_500).alias("start_ms"),
        F.least(F.col("start_ms") + F.col("k") * 1_500 + 1_100, F.col("end_ms")).alias("end_ms"),
        F.concat(F.lit("SPEAKER_0"), ((F.col("k") * F.col("k") + F.col("seq")) % 3).cast("string")).alias("speaker"))


_SHORT = """
    st AS (SELECT job_id, seq * 10000 + k AS seq, start_ms + k * 1500 AS start_ms, least(start_ms + k * 1500 + 1100, end_ms) AS end_ms,
                  'SPEAKER_0' || ((k * k + seq) % 3) AS speaker
           FROM (SELECT *, unnest(range((end_ms - start_ms) // 1500 + 1)) AS k FROM @turns_conv))"""
_WORD_SPEAKERS = _SHORT + """,
    cand AS (SELECT w.job_id, w.seq, w.pos, t.speaker, t.seq AS ts, w.start_ms + w.end_ms BETWEEN 2 * t.start_ms AND 2 * t.end_ms AS cov,
                    least(abs(2 * t.start_ms - w.start_ms - w.end_ms), abs(2 * t.end_ms - w.start_ms - w.end_ms)) AS gap
             FROM @words w JOIN st t ON t.job_id = w.job_id AND w.start_ms + w.end_ms BETWEEN 2 * t.start_ms - 1000 AND 2 * t.end_ms + 1000),
    pick AS (SELECT job_id, seq, pos, speaker FROM (SELECT *, row_number() OVER (PARTITION BY job_id, seq, pos ORDER BY NOT cov, CASE WHEN cov THEN 0 ELSE gap END, ts) AS rn FROM cand) WHERE rn = 1),
    ws AS (SELECT w.job_id, w.seq, w.pos, w.word, w.start_ms, w.end_ms, p.speaker FROM @words w LEFT JOIN pick p ON p.job_id = w.job_id AND p.seq = w.seq AND p.pos = w.pos)"""


@query("join_word_speaker", f"WITH {_WORD_SPEAKERS} SELECT job_id, seq, pos, speaker FROM ws")
def join_word_speaker(spark, sf):
    return J.word_speakers(V.words(spark, sf), _short_turns(spark, sf)).select("job_id", "seq", "pos", "speaker")


def _runs_sql(src: str, out: str) -> str:
    return f"""
    {out}_c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS c FROM {src} WINDOW w AS (PARTITION BY job_id, seq ORDER BY pos)),
    {out} AS (SELECT *, sum(c) OVER (PARTITION BY job_id, seq ORDER BY pos) AS run FROM {out}_c)"""


_SMOOTH = f"""{_WORD_SPEAKERS}, {_runs_sql('ws', 'wr')},
    rr AS (SELECT job_id, seq, run, any_value(speaker) AS sp, count(*) AS n, min(start_ms) AS s, max(end_ms) AS e FROM wr GROUP BY 1, 2, 3),
    nb AS (SELECT *, lag(run) OVER w AS hp, lead(run) OVER w AS hn, lag(sp) OVER w AS psp, lead(sp) OVER w AS nsp, lag(e) OVER w AS pe, lead(s) OVER w AS nx
           FROM rr WINDOW w AS (PARTITION BY job_id, seq ORDER BY run)),
    tg AS (SELECT job_id, seq, run, CASE WHEN hp IS NULL OR hn IS NULL OR n >= 2 OR e - s >= 400 THEN sp WHEN psp IS NULL AND nsp IS NULL THEN sp WHEN psp IS NULL THEN nsp WHEN nsp IS NULL THEN psp
                  WHEN psp = nsp THEN psp WHEN abs(2 * nx - s - e) <= abs(s + e - 2 * pe) THEN nsp ELSE psp END AS target FROM nb),
    sm AS (SELECT wr.job_id, wr.seq, wr.pos, wr.word, wr.start_ms, wr.end_ms, tg.target AS speaker FROM wr JOIN tg ON tg.job_id = wr.job_id AND tg.seq = wr.seq AND tg.run = wr.run)"""


@query("win_smooth_words", f"WITH {_SMOOTH} SELECT job_id, seq, pos, speaker FROM sm")
def win_smooth_words(spark, sf):
    return J.smooth_words(J.word_speakers(V.words(spark, sf), _short_turns(spark, sf))).select("job_id", "seq", "pos", "speaker")


@query("win_split_segment", f"""
    WITH {_SMOOTH}, {_runs_sql('sm', 'sr')},
    p AS (SELECT job_id, seq, run AS part, any_value(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, trim(string_agg(word, ' ' ORDER BY pos)) AS text FROM sr GROUP BY 1, 2, 3)
    SELECT p.job_id, p.seq, CAST(part AS BIGINT) AS part, p.speaker, p.start_ms, p.end_ms, p.text, s.avg_logprob FROM p JOIN @segments s ON s.job_id = p.job_id AND s.seq = p.seq WHERE p.text <> ''""")
def win_split_segment(spark, sf):
    out = J.split_on_speakers(V.segments(spark, sf), V.words(spark, sf), _short_turns(spark, sf))
    return out.select("job_id", "seq", "part", "speaker", "start_ms", "end_ms", "text", "avg_logprob")


@query("join_fill_speakers", f"""
    WITH orig AS (SELECT job_id, seq, start_ms, end_ms, speaker FROM @captions WHERE speaker IS NOT NULL),
    bl AS (SELECT job_id, seq, start_ms - 700 AS start_ms, end_ms + 700 AS end_ms, speaker FROM @captions),
    blank AS (SELECT * FROM bl WHERE speaker IS NULL), {argmax_sql('blank', 'orig')}
    SELECT bl.job_id, bl.seq, coalesce(bl.speaker, b.speaker) AS speaker FROM bl LEFT JOIN best b ON b.job_id = bl.job_id AND b.seq = bl.seq AND bl.speaker IS NULL""")
def join_fill_speakers(spark, sf):
    cap = V.captions(spark, sf).select("job_id", "seq", "start_ms", "end_ms", "speaker")
    wide = cap.withColumn("start_ms", F.col("start_ms") - 700).withColumn("end_ms", F.col("end_ms") + 700)
    return J.fill_speakers(wide, cap).select("job_id", "seq", "speaker")


_RANGES = "SELECT job_id, seq, greatest(start_ms - 1000, 0) AS start_ms, end_ms + 1000 AS end_ms FROM @segments WHERE avg_logprob < -1.2"
_NEW = "SELECT job_id, seq, start_ms + 100 AS start_ms, end_ms AS end_ms, 'redone' AS text FROM @segments WHERE avg_logprob < -1.2 AND no_speech_prob < 0.9"
_SPLICED = f"""
    rg AS ({_RANGES}), nw AS ({_NEW}), rdy AS (SELECT DISTINCT job_id FROM rg WHERE job_id IN (SELECT job_id FROM nw)),
    kept AS (SELECT job_id, seq, start_ms, end_ms, text FROM @segments s WHERE NOT EXISTS (
        SELECT 1 FROM rg JOIN rdy USING (job_id) WHERE rg.job_id = s.job_id AND s.start_ms < rg.end_ms AND s.end_ms > rg.start_ms)),
    spl AS (SELECT *, false AS is_new FROM kept UNION ALL SELECT *, true FROM nw WHERE job_id IN (SELECT job_id FROM rdy))"""


def _splice(spark, sf):
    seg = V.segments(spark, sf).select("job_id", "seq", "start_ms", "end_ms", "text", "avg_logprob", "no_speech_prob")
    weak = seg.where(F.col("avg_logprob") < -1.2)
    ranges = weak.select("job_id", F.greatest(F.col("start_ms") - 1000, F.lit(0).cast("long")).alias("start_ms"), (F.col("end_ms") + 1000).alias("end_ms"))
    new = weak.where(F.col("no_speech_prob") < 0.9).select("job_id", "seq", (F.col("start_ms") + 100).alias("start_ms"), "end_ms", F.lit("redone").alias("text"))
    base = seg.select("job_id", "seq", "start_ms", "end_ms", "text")
    return base, J.repass_splice(base, new, ranges)


@query("join_repass_splice", f"""
    WITH {_SPLICED}, n AS (SELECT job_id, count(*) AS n FROM @segments GROUP BY 1), k AS (SELECT job_id, count(*) AS k FROM kept GROUP BY 1)
    SELECT spl.*, n.n - coalesce(k.k, 0) AS replaced FROM spl JOIN n USING (job_id) LEFT JOIN k USING (job_id)""")
def join_repass_splice(spark, sf):
    base, out = _splice(spark, sf)
    return out.join(J.splice_counts(base, out), "job_id")


def _remap_sql(points: str, spans: str, ids: str, keys: str) -> str:
    on = " AND ".join(f"s.{k} = p.{k}" for k in keys.split(", "))
    return f"""
    h AS (SELECT {', '.join('p.' + i.strip() for i in ids.split(','))}, p.side, any_value(p.t) AS t, arg_min(s.src_start + p.t - s.trim_start, s.seq) AS src
          FROM {points} p LEFT JOIN {spans} s ON {on} AND p.t BETWEEN s.trim_start AND s.trim_end + 1 GROUP BY ALL),
    la AS (SELECT {keys}, arg_max(src_end, seq) AS last FROM {spans} GROUP BY ALL),
    m AS (SELECT h.*, coalesce(src, last, t) AS ms FROM h LEFT JOIN la USING ({keys}))"""


@query("join_remap_timeline", f"""
    WITH sp AS (SELECT * FROM @spans),
    pts AS (SELECT job_id, seq, pos, 0 AS side, start_ms // 2 AS t FROM @words UNION ALL SELECT job_id, seq, pos, 1, end_ms // 2 FROM @words
            UNION ALL SELECT job_id, seq, -1, 0, start_ms // 2 FROM @segments UNION ALL SELECT job_id, seq, -1, 1, end_ms // 2 FROM @segments),
    {_remap_sql('pts', 'sp', 'job_id, seq, pos', 'job_id')}
    SELECT job_id, seq, pos, max(ms) FILTER (side = 0) AS start_ms, max(ms) FILTER (side = 1) AS end_ms FROM m GROUP BY 1, 2, 3""")
def join_remap_timeline(spark, sf):
    """Segments (pos -1) and their words in one pass."""
    half = lambda df, pos: df.select("job_id", "seq", pos.cast("long").alias("pos"), F.floor(F.col("start_ms") / 2).alias("start_ms"), F.floor(F.col("end_ms") / 2).alias("end_ms"))
    rows = half(V.words(spark, sf), F.col("pos")).unionByName(half(V.segments(spark, sf), F.lit(-1)))
    return J.remap_segments(rows, V.spans(spark, sf), ["job_id", "seq", "pos"])


@query("join_remap_speaker", f"""
    WITH sl AS ({_SLICES}),
    pts AS (SELECT job_id, speaker, seq, 0 AS side, start_ms // 3 AS t FROM @turns UNION ALL SELECT job_id, speaker, seq, 1, end_ms // 3 FROM @turns),
    {_remap_sql('pts', 'sl', 'job_id, speaker, seq', 'job_id, speaker')}
    SELECT job_id, speaker, seq, max(ms) FILTER (side = 0) AS start_ms, max(ms) FILTER (side = 1) AS end_ms FROM m GROUP BY 1, 2, 3""")
def join_remap_speaker(spark, sf):
    t = V.turns(spark, sf)
    rows = t.select("job_id", "speaker", "seq", F.floor(F.col("start_ms") / 3).alias("start_ms"), F.floor(F.col("end_ms") / 3).alias("end_ms"))
    return J.remap_segments(rows, speaker_slices(t), ["job_id", "speaker", "seq"], ("job_id", "speaker"))


def _calls(spark, sf):
    parts = V.table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    t = V._timeline(spark, sf).withColumn("p_partkey", F.col("event_id") % 200).join(parts, "p_partkey")
    lines = t.select(
        "job_id", "seq", "speaker", F.floor(F.col("start_ms") / 1000).alias("seconds"),
        F.when((F.col("event_type") == "signup") & (F.col("end_ms") - F.col("start_ms") > 2700), F.concat(F.lit("Bonjour Monsieur le "), F.get("w", F.lit(1))))
        .when((F.col("event_type") == "view") & (F.col("end_ms") - F.col("start_ms") > 2700), F.concat(F.lit("merci, m. "), F.get("w", F.lit(1)), F.lit("-Dupont"))).otherwise("oui").alias("text"))
    names = t.groupBy("job_id", "speaker").agg(F.max(F.concat(F.initcap(F.get("w", F.lit(0))), F.lit(" Martin"))).alias("name"))
    terms = V.table(spark, sf, "part").select(F.initcap("p_name").alias("term")).distinct()
    return lines, names, terms


@query("join_name_context", """
    WITH t AS (SELECT e.job_id, e.seq, e.speaker, e.start_ms // 1000 AS sec, string_split(p_name, ' ') AS w,
                      CASE WHEN event_type IN ('signup', 'view') AND end_ms - start_ms > 2700 THEN string_split(p_name, ' ')[2] END AS called
               FROM @timeline e JOIN part ON p_partkey = event_id % 200),
    n AS (SELECT job_id, speaker, max(w[1]) AS own FROM t GROUP BY 1, 2),
    ppl AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[2] AS alias FROM part),
    bad AS (SELECT DISTINCT a.job_id, a.speaker FROM t a JOIN n ON n.job_id = a.job_id AND n.speaker = a.speaker
            JOIN t o ON o.job_id = a.job_id AND abs(o.seq - a.seq) BETWEEN 1 AND 2 AND o.speaker <> a.speaker AND abs(o.sec - a.sec) <= 10
            JOIN ppl ON ppl.alias = o.called AND length(ppl.alias) >= 3 AND ppl.first <> n.own)
    SELECT n.job_id, n.speaker, upper(left(own, 1)) || substr(own, 2) || ' Martin' AS name FROM n
    WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.job_id = n.job_id AND bad.speaker = n.speaker)""")
def join_name_context(spark, sf):
    return J.context_checked_names(*_calls(spark, sf))


@query("join_rename", """
    SELECT s.job_id, s.seq, CASE WHEN j.status = 'COMPLETED' AND s.speaker = 'SPEAKER_00' THEN 'Owner ' || j.owner_id ELSE s.speaker END AS speaker,
           coalesce(j.status = 'COMPLETED' AND s.speaker = 'SPEAKER_00', false) AS renamed FROM @segments s LEFT JOIN @jobs j ON j.id = s.job_id""")
def join_rename(spark, sf):
    mapping = V.jobs(spark, sf).where(F.col("status") == "COMPLETED").select(
        F.col("id").alias("job_id"), F.lit("SPEAKER_00").alias("label"), F.concat(F.lit("Owner "), F.col("owner_id").cast("string")).alias("name"))
    return J.rename(V.segments(spark, sf), mapping).select("job_id", "seq", "speaker", "renamed")


@query("join_meeting_window", """
    WITH r AS (SELECT event_id AS rec_id, CAST(ts AS TIMESTAMP) AS near FROM events WHERE event_type = 'purchase'),
    k AS (SELECT r.rec_id, m.meeting_id, m.partner_ids, row_number() OVER (PARTITION BY r.rec_id ORDER BY m.start_at, m.meeting_id) AS rank
          FROM r JOIN @meetings m ON m.start_at <= r.near + INTERVAL 30 MINUTE AND m.stop_at >= r.near - INTERVAL 30 MINUTE),
    a AS (SELECT rec_id, meeting_id, rank, unnest(partner_ids) AS pid FROM k WHERE rank <= 10 AND len(partner_ids) >= 2)
    SELECT rec_id, meeting_id, rank, string_agg(p.name, ' | ' ORDER BY pid) AS attendees FROM a LEFT JOIN @partners p ON p.partner_id = a.pid GROUP BY 1, 2, 3""")
def join_meeting_window(spark, sf):
    rec = V.table(spark, sf, "events").where(F.col("event_type") == "purchase").select(F.col("event_id").alias("rec_id"), F.col("ts").alias("near"))
    out = J.meetings_near(rec, V.meetings(spark, sf), V.partners(spark, sf), 0.5)
    return out.select("rec_id", "meeting_id", "rank", F.array_join(F.transform("attendees", lambda a: a["name"]), " | ").alias("attendees"))


def crm(spark, sf):
    """Leads, quotes, tasks, projects and messages from suppliers, orders, lines and parts."""
    orders, items, part = (V.table(spark, sf, t) for t in ("orders", "lineitem", "part"))
    none = F.lit(None).cast("long")
    n_leads = 10
    quotes = orders.select(
        (F.col("o_orderkey") % n_leads).alias("lead_id"), F.col("o_orderkey").alias("quote_id"),
        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderdate").alias("date"))
    leads = V.table(spark, sf, "supplier").select(F.lit("lead").alias("root_kind"), F.col("s_suppkey").alias("root_id"), F.col("s_suppkey").alias("lead_id"), none.alias("project_id"))
    tasks = items.select(
        F.lit("task").alias("root_kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("root_id"), none.alias("lead_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("project_id")).distinct()
    events = V.meetings(spark, sf).select(F.lit("event").alias("root_kind"), F.col("meeting_id").alias("root_id"), (F.col("meeting_id") % 13).alias("lead_id"), none.alias("project_id"))
    projects = part.select(F.col("p_partkey").alias("project_id"), F.col("p_name").alias("name"))
    chatter = items.select(
        F.lit("quote").alias("record_kind"), F.col("l_orderkey").alias("record_id"), F.col("l_shipdate").alias("date"),
        F.concat(F.lit("line "), F.format_string("%02d", "l_linenumber"), F.lit(" part "), F.col("l_partkey").cast("string")).alias("body")).distinct()
    return leads.unionByName(tasks).unionByName(events), quotes, projects, chatter


@query("join_context_pack", """
    WITH q AS (SELECT * FROM (SELECT o_orderkey % 10 AS lead_id, o_orderkey AS quote_id, 'S' || o_orderkey AS name,
                                     row_number() OVER (PARTITION BY o_orderkey % 10 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 5),
    ev AS (SELECT 'event' AS root_kind, meeting_id AS root_id, meeting_id % 13 AS lead_id FROM @meetings),
    rel AS (SELECT 'lead' AS root_kind, s_suppkey AS root_id, 'quote' AS kind, quote_id AS record_id, name, rank FROM supplier JOIN q ON q.lead_id = s_suppkey
            UNION ALL SELECT root_kind, root_id, 'quote', quote_id, name, rank FROM ev JOIN q USING (lead_id)
            UNION ALL SELECT root_kind, root_id, 'lead', lead_id, 'lead ' || lead_id, 0 FROM ev
            UNION ALL SELECT DISTINCT 'task', l_orderkey * 10 + l_linenumber, 'project', p_partkey, p_name, 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'N'),
    ch AS (SELECT record_id, string_agg(body, ' | ' ORDER BY r) AS chatter FROM (
        SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY date DESC, body) AS r FROM (
            SELECT DISTINCT l_orderkey AS record_id, l_shipdate AS date, 'line ' || printf('%02d', l_linenumber) || ' part ' || l_partkey AS body FROM lineitem)) WHERE r <= 8 GROUP BY 1)
    SELECT rel.*, CASE WHEN kind = 'quote' THEN chatter END AS chatter FROM rel LEFT JOIN ch ON ch.record_id = rel.record_id AND rel.kind = 'quote'""")
def join_context_pack(spark, sf):
    return J.context_pack(*crm(spark, sf))


@query("join_partner_search", """
    SELECT partner_id, name, email, company FROM @partners WHERE name ILIKE '%nation_7.%' OR email ILIKE '%nation_7.%' ORDER BY name, partner_id LIMIT 25""")
def join_partner_search(spark, sf):
    return J.search_partners(V.partners(spark, sf), "Nation_7.")


def _cs(x: str) -> str:
    """Hundredths of a second of ``x`` parts of a recording, half-even, as seconds."""
    a, b = f"({x}) * ms", "(cnt * 10)"
    return f"({a} // {b} + CASE WHEN 2 * ({a} % {b}) > {b} OR (2 * ({a} % {b}) = {b} AND ({a} // {b}) % 2 = 1) THEN 1 ELSE 0 END) / 100.0"


_PLAN = f"""
    d AS (SELECT id AS job_id, CAST(floor(price) AS BIGINT) * 30 AS ms FROM @jobs),
    n AS (SELECT *, CASE WHEN ms <= 2100000 THEN 1 ELSE (ms + 1799999) // 1800000 END AS cnt FROM d),
    plan AS (SELECT job_id, i AS index, cnt AS chunk_count, {_cs('i')} AS start, {_cs('i + 1')} AS "end"
             FROM (SELECT *, unnest(range(cnt)) AS i FROM n))"""


def chunk_plan(spark, sf):
    rec = V.jobs(spark, sf).select(F.col("id").alias("job_id"), (F.floor("price").cast("long") * 30).alias("duration_ms"))
    return plan_chunks(rec)


@query("plan_chunks", f"""WITH {_PLAN} SELECT * FROM plan""")
def q_plan_chunks(spark, sf):
    return chunk_plan(spark, sf)


@query("join_chunk_resume", f"""
    WITH {_PLAN},
    st AS (SELECT p.*, status, mode FROM plan p JOIN @jobs j ON j.id = p.job_id)
    SELECT job_id, index, chunk_count, start, "end",
           status = 'COMPLETED' AND mode IN ('1-URGENT', '2-HIGH', '5-LOW') AND NOT (mode = '5-LOW' AND index = 0) AND NOT (mode = '2-HIGH' AND index % 2 = 1) AS reused FROM st""")
def join_chunk_resume(spark, sf):
    plan = chunk_plan(spark, sf)
    jobs = V.jobs(spark, sf).select(F.col("id").alias("job_id"), "status", "mode")
    done = plan.join(jobs.where(F.col("status") == "COMPLETED"), "job_id")
    shift = F.when(F.col("mode") == "1-URGENT", 0.4).when(F.col("mode") == "3-MEDIUM", 0.7).otherwise(0.0)
    cached = done.select(
        "job_id", "index", F.when(F.col("mode") == "4-NOT SPECIFIED", F.col("chunk_count") + 1).otherwise(F.col("chunk_count")).alias("chunk_count"),
        (F.col("start") + shift).alias("start"), (F.col("end") - shift).alias("end"),
        F.when((F.col("mode") == "5-LOW") & (F.col("index") == 0), 0).otherwise(3).alias("segments"))
    redo = done.where((F.col("mode") == "2-HIGH") & (F.col("index") % 2 == 1)).select("job_id", "index")
    return J.resumable_chunks(plan, cached, redo)


@query("join_terms_new", """
    WITH k AS (SELECT DISTINCT run, term FROM (SELECT l_orderkey AS run, p_name AS term, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE l_returnflag = 'N'),
    f AS (SELECT l_orderkey AS run, l_linenumber AS seq, CASE WHEN l_linestatus = 'O' THEN upper(p_name) ELSE p_name END AS term, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT run AS job_id, arg_min(term, (seq * 1000000 + l_partkey) * 2 + CASE WHEN term = lower(term) THEN 0 ELSE 1 END) AS term FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.run = f.run AND k.term = lower(f.term)) GROUP BY run, lower(term)""")
def join_terms_new(spark, sf):
    part = V.table(spark, sf, "part").select("p_partkey", "p_name")
    items = V.table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    known = items.where(F.col("l_returnflag") == "N").select(F.col("l_orderkey").alias("job_id"), F.upper("p_name").alias("term"))
    found = items.select(
        F.col("l_orderkey").alias("job_id"),
        ((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("seq"),
        F.concat(F.lit(" "), F.when(F.col("l_linestatus") == "O", F.upper("p_name")).otherwise(F.col("p_name"))).alias("term"))
    return J.new_terms(known, found)


CAPS = "(?:[A-ZÀ-Ý][a-zà-ÿ'’-]+|[A-Z][A-Z0-9'-]+)"


CAPS_SQL = CAPS.replace("'", "''")


@query("join_entity_confirm", f"""
    WITH c0 AS (SELECT conv_id AS id, turn, regexp_extract_all(text, '({CAPS_SQL})', 1) AS names FROM conversations),
    c1 AS (SELECT id, turn * 1000 + i AS rank, names[i] AS term FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM c0)),
    c2 AS (SELECT id, min(rank) AS rank, arg_min(term, rank) AS term, lower(strip_accents(term)) AS f FROM c1 WHERE length(term) >= 4 GROUP BY id, lower(strip_accents(term))),
    kn AS (SELECT DISTINCT lower(strip_accents(term)) AS f FROM @glossary),
    q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS n FROM c2 WHERE f NOT IN (SELECT f FROM kn)) WHERE n <= 12),
    d AS (SELECT source_id, source AS title, text, lower(strip_accents(source || ' ' || text)) AS hay
          FROM (SELECT doc_id, source, text, 'doc-' || doc_id AS source_id FROM documents UNION ALL SELECT page_id, coalesce(url, ''), text, 'page-' || page_id FROM @page_text JOIN pages USING (page_id))),
    h AS (SELECT f, min(source_id) AS source_id FROM (SELECT DISTINCT f FROM q) JOIN d ON contains(hay, f) GROUP BY 1)
    SELECT id, rank, term, h.source_id, left(d.title, 120) AS citation, left(d.text, 240) AS snippet FROM q JOIN h USING (f) JOIN d USING (source_id)""")
def join_entity_confirm(spark, sf):
    found = V.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), "turn", F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"({CAPS})"), F.lit(1))).alias("i", "term"))
    found = found.where(F.length("term") >= 4).select("id", (F.col("turn") * 1000 + F.col("i") + 1).alias("rank"), "term", J.fold("term").alias("f"))
    cand = found.groupBy("id", "f").agg(F.min("rank").alias("rank"), F.min_by("term", "rank").alias("term")).drop("f")
    return J.confirm_entities(cand, V.glossary(spark, sf), V.corpus(spark, sf))


def _people(spark, sf):
    return V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("profile_id"), F.initcap(F.concat_ws(" ", "p_name", "p_type")).alias("name"),
        F.when(F.col("p_size") > 25, F.concat_ws(" ", F.lower("p_brand"), "p_name")).alias("alias"), F.format_string("%03d", "p_size").alias("updated_at"))


_PEOPLE = """
    ppl AS (SELECT p_partkey AS profile_id, array_to_string(list_transform(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS name,
                   CASE WHEN p_size > 25 THEN lower(p_brand) || ' ' || p_name END AS alias, printf('%03d', p_size) AS updated_at FROM part),
    nm AS (SELECT profile_id, lower(name) AS n FROM ppl UNION SELECT profile_id, lower(alias) FROM ppl WHERE alias IS NOT NULL)"""
_STRENGTH = """CASE WHEN q.q = nm.n THEN 4 WHEN starts_with(nm.n, q.q) THEN 3 WHEN contains(' ' || nm.n, ' ' || q.q) THEN 2 WHEN contains(nm.n, q.q) THEN 1 ELSE 0 END"""


@query("join_name_fuzzy", f"""
    WITH {_PEOPLE},
    q AS (SELECT DISTINCT w AS query_id, lower(w) AS q FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT substr(p_name, 2, 4) FROM part UNION ALL SELECT p_brand FROM part)),
    x AS (SELECT query_id, profile_id, max({_STRENGTH}) AS strength FROM q JOIN nm ON contains(nm.n, q.q) GROUP BY 1, 2),
    r AS (SELECT x.*, ppl.name, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, updated_at DESC, lower(ppl.name), x.profile_id) AS rank FROM x JOIN ppl USING (profile_id) WHERE strength < 4)
    SELECT query_id, profile_id, name, strength, rank FROM r WHERE rank <= 8""")
def join_name_fuzzy(spark, sf):
    part = V.table(spark, sf, "part")
    q = part.select(F.explode(F.split("p_name", " ")).alias("w")).union(part.select(F.substring("p_name", 2, 4))).union(part.select("p_brand")).distinct()
    return J.name_menu(q.select(F.col("w").alias("query_id"), F.col("w").alias("query")), _people(spark, sf)).select("query_id", "profile_id", "name", "strength", "rank")


@query("join_name_nearest", """
    WITH n AS (SELECT p_partkey AS id, lower(p_name) || CASE WHEN p_size > 40 THEN ' ' || lower(p_brand) ELSE ' ' || p_partkey END AS n FROM part),
    x AS (SELECT a.id AS query_id, b.id AS profile_id, b.n AS name, CASE WHEN a.n = b.n THEN 4 WHEN starts_with(b.n, a.n) THEN 3 WHEN contains(' ' || b.n, ' ' || a.n) THEN 2 ELSE 1 END AS strength
          FROM n a JOIN n b ON a.id <> b.id AND contains(b.n, a.n)),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, name, profile_id) AS rn FROM x WHERE query_id NOT IN (SELECT query_id FROM x WHERE strength = 4))
    SELECT query_id, profile_id, name, strength FROM k WHERE rn = 1""")
def join_name_nearest(spark, sf):
    part = V.table(spark, sf, "part")
    tail = F.when(F.col("p_size") > 40, F.lower("p_brand")).otherwise(F.col("p_partkey").cast("string"))
    people = part.select(F.col("p_partkey").alias("profile_id"), F.concat_ws(" ", F.lower("p_name"), tail).alias("name"), F.lit(None).cast("string").alias("alias"), F.lit("").alias("updated_at"))
    return J.nearest_names(people)


@query("join_company_name", """
    WITH g AS (SELECT l_orderkey AS job_id, arg_min(s_name, l_linenumber * 1000000 + l_suppkey) AS guest FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 10 <> 0 GROUP BY 1)
    SELECT id AS job_id, CASE WHEN status = 'COMPLETED' AND mode = '1-URGENT' THEN 'Co' || (owner_id % 40) WHEN status = 'COMPLETED' AND mode = '2-HIGH' THEN 'Soc ' || owner_id
                              WHEN status = 'COMPLETED' THEN 'Plain' WHEN mode = '5-LOW' THEN 'Deal ' || id ELSE coalesce(g.guest, CASE WHEN mode = '2-HIGH' THEN 'Typed' ELSE '' END) END AS company
    FROM @jobs LEFT JOIN g ON g.job_id = id""")
def join_company_name(spark, sf):
    jobs = V.jobs(spark, sf).withColumn("k", F.col("owner_id").cast("string"))
    done, mode = F.col("status") == "COMPLETED", F.col("mode")
    packs = jobs.select(
        F.col("id").alias("job_id"),
        F.when(done & (mode == "1-URGENT"), F.concat(F.lit("Jean Dupont, Co"), (F.col("owner_id") % 40).cast("string")))
        .when(done & (mode == "2-HIGH"), F.concat(F.lit("Jean Dupont (Soc "), "k", F.lit(")"))).when(done, "Plain").alias("partner_name"),
        F.when(mode == "5-LOW", F.concat(F.lit(" Deal "), F.col("id").cast("string"))).alias("display_name"))
    sup = V.table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("OwnCo "), "s_name")).otherwise(F.col("s_name")).alias("name"))
    invited = V.table(spark, sf, "lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("seq"), "name")
    typed = jobs.where(mode == "2-HIGH").select(F.col("id").alias("job_id"), F.lit(1).alias("seq"), F.lit("Robin (Typed)").alias("name"))
    return J.company_name(packs, invited, typed, "ownco")
