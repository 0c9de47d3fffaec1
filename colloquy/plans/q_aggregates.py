"""Grouped figures over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import views as V
from colloquy.functions.cost import catalogue, with_estimate
from colloquy.operators import aggregates as A
from colloquy.operators import maintenance as M
from colloquy.plans.registry import query

BUDGET_MICRO = 90_000_000


@query("agg_month_spend", """
    SELECT CAST(coalesce(sum(cost_micro), 0) AS BIGINT) AS cost_micro FROM @api_usage
    WHERE created_at >= TIMESTAMP '1997-05-01' AND created_at < TIMESTAMP '1997-06-01'""")
def agg_month_spend(spark, sf):
    return A.month_spend(V.api_usage(spark, sf), "1997-05")


@query("agg_usage_summary", """
    SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
           CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost_micro) AS BIGINT) / 1000000.0 AS cost_usd
    FROM @api_usage GROUP BY 1 ORDER BY 1 DESC LIMIT 24""")
def agg_usage_summary(spark, sf):
    return A.usage_summary(V.api_usage(spark, sf), 24)


_ESTIMATE = """
    SELECT id, created_at, model, CAST(CASE WHEN bill = 'per_hour' THEN 0 ELSE ms * 32 // 1000 + 400 END AS BIGINT) AS input_tokens,
           CAST(CASE WHEN bill = 'per_hour' THEN 0 ELSE ms * 10 // 1000 + 300 END AS BIGINT) AS output_tokens,
           CASE WHEN bill = 'per_hour' THEN ms * c_hour ELSE (ms * 32 // 1000 + 400) * c_in + (ms * 10 // 1000 + 300) * c_out END AS n,
           CASE WHEN bill = 'per_hour' THEN 360 ELSE 100 END AS d
    FROM (SELECT j.*, coalesce(p0.billing, dd.billing) AS bill, coalesce(p0.cents_in, dd.cents_in) AS c_in,
                 coalesce(p0.cents_out, dd.cents_out) AS c_out, coalesce(p0.cents_hour, dd.cents_hour) AS c_hour FROM (SELECT id, created_at, CAST(floor(price) AS BIGINT) * 10 AS ms,
                 CASE mode WHEN '1-URGENT' THEN 'gladia-solaria-3' WHEN '2-HIGH' THEN 'deepgram-nova-3' WHEN '3-MEDIUM' THEN 'gemini-2.5-flash'
                           WHEN '5-LOW' THEN 'somebody-elses' ELSE 'gemini-3.6-flash' END AS model FROM @jobs) j
    LEFT JOIN @prices p0 ON p0.model = j.model CROSS JOIN @dearest dd)"""


def _estimates(spark, sf):
    mode = F.col("mode")
    recordings = V.jobs(spark, sf).select(
        "id", "created_at", (F.floor("price").cast("long") * 10).alias("duration_ms"),
        F.when(mode == "1-URGENT", "gladia-solaria-3").when(mode == "2-HIGH", "deepgram-nova-3").when(mode == "3-MEDIUM", "gemini-2.5-flash")
        .when(mode == "5-LOW", "somebody-elses").otherwise("gemini-3.6-flash").alias("model"))
    return with_estimate(recordings, catalogue(spark))


_ROUNDED = "CAST(n // d + CASE WHEN 2 * (n % d) > d OR (2 * (n % d) = d AND (n // d) % 2 = 1) THEN 1 ELSE 0 END AS BIGINT)"


@query("fn_cost", f"""
    WITH e AS ({_ESTIMATE})
    SELECT id, model, input_tokens, output_tokens, {_ROUNDED} AS cost_micro FROM e""")
def fn_cost(spark, sf):
    return _estimates(spark, sf).select("id", "model", "input_tokens", "output_tokens", "cost_micro")


@query("agg_budget_guard", f"""
    WITH e AS ({_ESTIMATE}),
    s AS (SELECT strftime(created_at, '%Y-%m') AS month, CAST(sum(cost_micro) AS BIGINT) AS spent FROM @api_usage GROUP BY 1),
    r AS (SELECT id, strftime(created_at, '%Y-%m') AS month, {_ROUNDED} AS c FROM e)
    SELECT id, month, coalesce(spent, 0) AS spent_micro, c AS estimate_micro, coalesce(spent, 0) + c > {BUDGET_MICRO} AS refused,
           coalesce(spent, 0) * 100 >= CAST(80 AS BIGINT) * {BUDGET_MICRO} AS near_cap
    FROM r LEFT JOIN s USING (month)""")
def agg_budget_guard(spark, sf):
    return A.budget_guard(_estimates(spark, sf), V.api_usage(spark, sf), BUDGET_MICRO)


@query("fn_month", """
    SELECT coalesce(job_id, -1) AS job_id, usage_id, strftime(created_at, '%Y-%m') AS month FROM @api_usage""")
def fn_month(spark, sf):
    return V.api_usage(spark, sf).select(F.coalesce("job_id", F.lit(-1).cast("long")).alias("job_id"), "usage_id", A.month_of("created_at").alias("month"))


@query("agg_speaker_stats", """
    SELECT job_id, speaker, count(*) AS utterances, CAST(sum(greatest(end_ms - start_ms, 0)) AS BIGINT) AS spoken_ms
    FROM @segments WHERE trim(coalesce(speaker, '')) <> '' GROUP BY 1, 2""")
def agg_speaker_stats(spark, sf):
    return A.speaker_stats(V.segments(spark, sf))


@query("agg_opening_speaker", """
    WITH o AS (SELECT job_id, speaker, CAST(sum(least(end_ms, 60000) - start_ms) AS BIGINT) AS ms, min(start_ms) AS f
               FROM @captions WHERE start_ms < 60000 AND speaker IS NOT NULL GROUP BY 1, 2),
    rec AS (SELECT DISTINCT job_id, 'SPEAKER_01' AS speaker, CASE WHEN event_type = 'signup' THEN 'owner' ELSE 'Zoe' END AS name
            FROM @timeline WHERE start_ms < 2000 AND event_type IN ('signup', 'view')),
    c AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.job_id = o.job_id AND r.speaker = o.speaker)),
    b AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ms DESC, f, speaker DESC) AS rn FROM c)
    SELECT job_id, speaker, 'Owner' AS name, ms AS spoken_ms FROM b
    WHERE rn = 1 AND ms >= 1000 AND NOT EXISTS (SELECT 1 FROM rec r WHERE r.job_id = b.job_id AND r.name = 'owner')""")
def agg_opening_speaker(spark, sf):
    recognized = (
        V._timeline(spark, sf).where((F.col("start_ms") < 2000) & F.col("event_type").isin("signup", "view"))
        .select("job_id", F.lit("SPEAKER_01").alias("speaker"), F.when(F.col("event_type") == "signup", "owner").otherwise("Zoe").alias("name")).distinct())
    users = V._timeline(spark, sf).select("job_id", F.lit("Owner").alias("name")).distinct()
    return A.opening_speaker(V.captions(spark, sf), recognized, users)


@query("agg_step_durations", """
    WITH s AS (SELECT l_orderkey AS job_id, l_quantity AS q, CASE l_linenumber % 4 WHEN 0 THEN 'compression' WHEN 1 THEN 'diarisation'
                      WHEN 2 THEN 'diarization' ELSE 'transcription' END AS step FROM lineitem)
    SELECT job_id, coalesce(sum(q) FILTER (step = 'compression'), 0.0) AS ffmpeg, coalesce(sum(q) FILTER (step = 'diarization'), 0.0) AS diarization,
           coalesce(sum(q) FILTER (step IN ('diarisation', 'transcription')), 0.0) AS whisper, sum(q) AS total FROM s GROUP BY 1""")
def agg_step_durations(spark, sf):
    n = F.col("l_linenumber") % 4
    steps = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_quantity").alias("seconds"),
        F.when(n == 0, "compression").when(n == 1, "diarisation").when(n == 2, "diarization").otherwise("transcription").alias("step"))
    return A.step_durations(steps)


@query("agg_eta_history", """
    WITH head AS (SELECT * FROM (SELECT mode, duration_total FROM @jobs WHERE status = 'COMPLETED' ORDER BY created_at DESC, id DESC LIMIT 30) WHERE duration_total >= 10),
    m AS (SELECT DISTINCT mode FROM @jobs),
    r AS (SELECT m.mode, duration_total, row_number() OVER (PARTITION BY m.mode ORDER BY duration_total) - 1 AS i, count(*) OVER (PARTITION BY m.mode) AS n
          FROM m JOIN head ON head.mode = m.mode)
    SELECT m.mode, r.duration_total AS eta_seconds FROM m LEFT JOIN r ON r.mode = m.mode AND n >= 2 AND i = CAST(round_even((n - 1) * 0.65::DOUBLE, 0) AS BIGINT)""")
def agg_eta_history(spark, sf):
    jobs = V.jobs(spark, sf)
    return A.eta_history(jobs, jobs.select("mode").distinct())


@query("agg_speaker_eligible", """
    SELECT job_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS spoken_ms, count(*) AS turns
    FROM @turns WHERE end_ms - start_ms >= 400 GROUP BY 1, 2 HAVING sum(end_ms - start_ms) >= 6000""")
def agg_speaker_eligible(spark, sf):
    return A.eligible_speakers(V.turns(spark, sf))


_SLICES = """
    SELECT job_id, speaker, seq, a AS src_start, b AS src_end, trim_start, trim_start + b - a AS trim_end FROM (
        SELECT *, CAST(coalesce(sum(b - a) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS trim_start,
               sum(b - a) OVER (PARTITION BY job_id, speaker) AS total
        FROM (SELECT job_id, speaker, seq, greatest(start_ms - 400, 0) AS a, end_ms + 400 AS b FROM @turns WHERE end_ms - start_ms >= 400)
        WINDOW w AS (PARTITION BY job_id, speaker ORDER BY seq)) WHERE total >= 5000"""


@query("agg_speaker_slices", _SLICES)
def agg_speaker_slices(spark, sf):
    return A.speaker_slices(V.turns(spark, sf))


@query("agg_speaker_map", """
    WITH s AS (SELECT job_id, speaker AS label, min(seq) AS first_seq FROM @segments WHERE speaker IS NOT NULL GROUP BY 1, 2)
    SELECT s.job_id, label, first_seq, CASE WHEN label = 'SPEAKER_01' AND j.status = 'COMPLETED' THEN 'Owner ' || j.owner_id ELSE '' END AS name
    FROM s LEFT JOIN @jobs j ON j.id = s.job_id""")
def agg_speaker_map(spark, sf):
    names = V.jobs(spark, sf).where(F.col("status") == "COMPLETED").select(
        F.col("id").alias("job_id"), F.lit("SPEAKER_01").alias("label"), F.concat(F.lit(" Owner "), F.col("owner_id").cast("string")).alias("name"))
    return A.speaker_map(V.segments(spark, sf), names)


@query("agg_declared_merge", """
    WITH det AS (SELECT DISTINCT l_orderkey AS job_id, 'label' || l_linenumber AS label, CASE WHEN l_returnflag = 'R' THEN p_name ELSE '' END AS name
                 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber IN (SELECT l_linenumber FROM lineitem)),
    d AS (SELECT job_id, label, max(name) AS name FROM det GROUP BY 1, 2),
    dec AS (SELECT l_orderkey AS job_id, l_linenumber * 2 AS seq, upper(p_name) AS name FROM lineitem JOIN part ON p_partkey = l_partkey
            UNION ALL SELECT l_orderkey, l_linenumber * 2 + 1, 'label1' FROM lineitem WHERE l_returnflag = 'A'),
    fill AS (SELECT d.job_id, d.label, CASE WHEN trim(d.name) = '' AND EXISTS (SELECT 1 FROM dec WHERE dec.job_id = d.job_id AND dec.name = d.label) THEN d.label ELSE d.name END AS name FROM d),
    neu AS (SELECT job_id, arg_min(name, seq) AS name FROM dec
            WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.job_id = dec.job_id AND (lower(d.label) = lower(dec.name) OR lower(d.name) = lower(dec.name)))
            GROUP BY job_id, lower(name))
    SELECT * FROM fill UNION ALL SELECT job_id, name, name FROM neu""")
def agg_declared_merge(spark, sf):
    part = V.table(spark, sf, "part").select("p_partkey", "p_name")
    items = V.table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    detected = items.groupBy(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("label"), F.col("l_linenumber").cast("string")).alias("label")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", F.col("p_name")).otherwise("")).alias("name"))
    declared = items.select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") * 2).alias("seq"), F.upper("p_name").alias("name"))
    declared = declared.unionByName(items.where(F.col("l_returnflag") == "A").select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") * 2 + 1).alias("seq"), F.lit(" label1 ").alias("name")))
    return A.declared_merge(detected, declared)


@query("agg_discover_speakers", """
    WITH f AS (SELECT DISTINCT job_id, coalesce(speaker, '?') AS label FROM @segments),
    st AS (SELECT id AS job_id, 'SPEAKER_00' AS label, 'Owner ' || owner_id AS name FROM @jobs WHERE status = 'COMPLETED')
    SELECT * FROM st UNION ALL
    SELECT job_id, label, CASE WHEN label = '?' THEN '?' ELSE '' END FROM f WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.job_id = f.job_id AND st.label = f.label)""")
def agg_discover_speakers(spark, sf):
    stored = V.jobs(spark, sf).where(F.col("status") == "COMPLETED").select(
        F.col("id").alias("job_id"), F.lit("SPEAKER_00").alias("label"), F.concat(F.lit("Owner "), F.col("owner_id").cast("string")).alias("name"))
    return A.discover_speakers(V.transcript_lines(spark, sf), stored)


def chunk_parts(spark, sf):
    """``segments`` cut into cloud chunks of three rows, with what a model returns per chunk."""
    seg = V.segments(spark, sf).select(
        "job_id", "seq", F.floor(F.col("seq") / 3).alias("chunk"), "speaker", F.split("text", " ").alias("w"), "end_ms", "start_ms")
    speakers = seg.where(F.col("speaker").isNotNull()).select(
        "job_id", "chunk", F.col("speaker").alias("label"),
        F.when((F.col("job_id") + F.col("chunk")) % 2 == 0, "").otherwise(F.concat(F.lit("P"), (F.col("job_id") % 5).cast("string"), F.lit("-"), F.col("chunk").cast("string"))).alias("name")).distinct()
    terms = seg.select("job_id", "chunk", F.col("seq").alias("pos"), F.get("w", F.lit(0)).alias("term"))
    meta = seg.groupBy("job_id", "chunk").agg(
        F.min_by(F.concat_ws(" ", F.slice("w", 1, 3)), "seq").alias("t"), F.sum(F.size("w")).alias("input_tokens"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("output_tokens"), F.count(F.lit(1)).alias("cost_micro"))
    meta = meta.withColumn("title", F.when((F.col("job_id") + F.col("chunk")) % 3 == 0, F.col("t")).otherwise("")).drop("t")
    return speakers, terms, meta


@query("agg_chunk_merge", """
    WITH s AS (SELECT job_id, seq, seq // 3 AS chunk, speaker, string_split(text, ' ') AS w, end_ms - start_ms AS d FROM @segments),
    sp AS (SELECT DISTINCT job_id, chunk, speaker AS label, CASE WHEN (job_id + chunk) % 2 = 0 THEN '' ELSE 'P' || (job_id % 5) || '-' || chunk END AS name FROM s WHERE speaker IS NOT NULL),
    meta AS (SELECT job_id, chunk, CASE WHEN (job_id + chunk) % 3 = 0 THEN array_to_string(list_slice(arg_min(w, seq), 1, 3), ' ') ELSE '' END AS title,
                    sum(len(w)) AS i, sum(d) AS o, count(*) AS c FROM s GROUP BY 1, 2),
    m AS (SELECT job_id, coalesce(arg_min(title, chunk) FILTER (title <> ''), '') AS title, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o, CAST(sum(c) AS BIGINT) AS c FROM meta GROUP BY 1)
    SELECT job_id, 'speaker' AS kind, label AS item, coalesce(arg_max(name, chunk) FILTER (name <> ''), '') AS value FROM sp GROUP BY job_id, label
    UNION ALL SELECT job_id, 'term', lower(w[1]), arg_min(w[1], seq) FROM s GROUP BY job_id, lower(w[1])
    UNION ALL SELECT job_id, 'meta', 'title', title FROM m UNION ALL SELECT job_id, 'meta', 'input_tokens', CAST(i AS VARCHAR) FROM m
    UNION ALL SELECT job_id, 'meta', 'output_tokens', CAST(o AS VARCHAR) FROM m UNION ALL SELECT job_id, 'meta', 'cost_micro', CAST(c AS VARCHAR) FROM m""")
def agg_chunk_merge(spark, sf):
    return A.merge_chunks(*chunk_parts(spark, sf))


@query("agg_enrich_merge", """
    SELECT id AS job_id, CASE WHEN status = 'FAILED' THEN 'Titre ' || id ELSE 'Old ' || id END AS title,
           CASE WHEN mode = '5-LOW' THEN 'SPEAKER_00=Own;SPEAKER_01=' ELSE 'SPEAKER_00=Own;SPEAKER_01=G' || (owner_id % 7) END AS speakers,
           CASE WHEN mode = '5-LOW' THEN 'alpha' WHEN owner_id % 2 = 0 THEN 'alpha,beta' ELSE 'alpha,Alpha' END AS terms,
           CASE WHEN status = 'RUNNING' THEN 'old' WHEN mode = '5-LOW' THEN '' ELSE 'new' END AS uncertain,
           CASE WHEN mode = '5-LOW' THEN '' ELSE 'c' || id END AS corrections
    FROM (SELECT *, CASE WHEN mode = '5-LOW' AND status = 'FAILED' THEN 'X' END AS z FROM @jobs) WHERE z IS NULL
    UNION ALL SELECT id, '', 'SPEAKER_00=Own;SPEAKER_01=', 'alpha', '', '' FROM @jobs WHERE mode = '5-LOW' AND status = 'FAILED'""")
def agg_enrich_merge(spark, sf):
    jobs = V.jobs(spark, sf).withColumn("k", F.col("id").cast("string"))
    text = lambda *v: F.array(*v).cast("array<string>")
    pair = lambda a, b: F.create_map(F.lit("SPEAKER_00"), a, F.lit("SPEAKER_01"), b)
    merged = jobs.select(
        F.col("id").alias("job_id"), F.when(F.col("status") == "FAILED", "").otherwise(F.concat(F.lit("Old "), "k")).alias("title"),
        pair(F.lit("Own"), F.lit("")).alias("speakers"), text(F.lit("alpha")).alias("terms"),
        F.when(F.col("status") == "RUNNING", text(F.lit("old"))).otherwise(text()).alias("uncertain"))
    extra = jobs.where(F.col("mode") != "5-LOW").select(
        F.col("id").alias("job_id"), F.concat(F.lit("Titre "), "k").alias("title"),
        pair(F.lit("Other"), F.concat(F.lit("G"), (F.col("owner_id") % 7).cast("string"))).alias("speakers"),
        text(F.lit("alpha"), F.when(F.col("owner_id") % 2 == 0, "beta").otherwise("Alpha")).alias("terms"),
        text(F.lit("new")).alias("uncertain"), text(F.concat(F.lit("c"), "k")).alias("corrections"))
    out = A.enrich_merge(merged, extra)
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("speakers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("job_id", "title", flat.alias("speakers"), *[F.array_join(c, ",").alias(c) for c in ("terms", "uncertain", "corrections")])


@query("agg_label_numbers", """
    WITH u AS (SELECT job_id, seq, start_ms // 60000 AS chunk, coalesce(speaker, '') AS label FROM @captions),
    f AS (SELECT job_id, chunk, label, row_number() OVER (PARTITION BY job_id, chunk ORDER BY min(seq)) AS n FROM u WHERE label <> '' GROUP BY 1, 2, 3)
    SELECT u.job_id, u.seq, u.chunk, CASE WHEN f.n IS NULL THEN '' ELSE 'Intervenant ' || f.n END AS speaker FROM u LEFT JOIN f USING (job_id, chunk, label)""")
def agg_label_numbers(spark, sf):
    rows = V.captions(spark, sf).select("job_id", "seq", F.floor(F.col("start_ms") / 60000).alias("chunk"), F.concat(F.lit(" "), "speaker").alias("label"))
    return A.number_labels(rows).select("job_id", "seq", "chunk", "speaker")


def cells(df, key):
    """One row per vector element, rounded, so that arrays compare by value."""
    return df.select(key, "sample_count", F.posexplode("embedding").alias("pos", "x")).select(
        key, "sample_count", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def sql_centroids(name: str, rel: str, key: str) -> str:
    """CTE ``name``(key, pos, x, n) of normalised means of ``rel``(key, embedding)."""
    return f"""{name}_s AS (SELECT {key}, pos, sum(x) AS x, count(*) AS n FROM (SELECT {key}, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM {rel}) GROUP BY 1, 2),
    {name} AS (SELECT {key}, pos, x / n / sqrt(sum((x / n) * (x / n)) OVER (PARTITION BY {key})) AS x, n FROM {name}_s)"""


@query("agg_centroid", f"""
    WITH {sql_centroids('c', '@profile_vectors', 'name')}
    SELECT name, n AS sample_count, CAST(pos AS BIGINT) AS pos, round(x, 6) AS x FROM c""")
def agg_centroid(spark, sf):
    return cells(A.centroids(V.profile_vectors(spark, sf), ["name"]), "name")


_FRESH = "(SELECT 'label_' || label AS name, vec_id, embedding FROM @vectors WHERE vec_id % 2 = 1)"


@query("agg_centroid_update", f"""
    WITH {sql_centroids('c', '@profile_vectors', 'name')},
    f AS (SELECT name, pos, sum(x) AS t, count(*) AS k FROM (SELECT name, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM {_FRESH}) GROUP BY 1, 2),
    m AS (SELECT f.name, f.pos, CASE WHEN f.name = 'label_3' THEN t / k ELSE (c.x * c.n + t) / (c.n + k) END AS x, CASE WHEN f.name = 'label_3' THEN k ELSE c.n + k END AS n
          FROM f JOIN c ON c.name = f.name AND c.pos = f.pos)
    SELECT name, n AS sample_count, CAST(pos AS BIGINT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY name)), 6) AS x FROM m""")
def agg_centroid_update(spark, sf):
    old = A.centroids(V.profile_vectors(spark, sf), ["name"])
    old = old.withColumn("embedding", F.when(F.col("name") == "label_3", F.slice("embedding", 1, 5)).otherwise(F.col("embedding")))
    fresh = V.vectors(spark, sf).where(F.col("vec_id") % 2 == 1).select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("name"), "embedding")
    return cells(A.update_centroids(old, fresh), "name")


_MERGED = f"""
    WITH {sql_centroids('a', '@profile_vectors', 'name')},
    {sql_centroids('b', _FRESH, 'name')},
    m AS (SELECT a.name, a.pos, (a.x * a.n + b.x * b.n) / (a.n + b.n) AS x, a.n + b.n AS n FROM a JOIN b ON a.name = b.name AND a.pos = b.pos)"""


@query("agg_centroid_merge", _MERGED + """
    SELECT name, n AS sample_count, CAST(pos AS BIGINT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY name)), 6) AS x FROM m""")
def agg_centroid_merge(spark, sf):
    a = A.centroids(V.profile_vectors(spark, sf), ["name"])
    b = A.centroids(V.vectors(spark, sf).where(F.col("vec_id") % 2 == 1).select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("name"), "embedding"), ["name"])
    b = b.select("name", F.col("embedding").alias("b"), F.col("sample_count").alias("nb"))
    out = a.join(b, "name").select("name", M.merged_centroid(F.col("embedding"), F.col("sample_count"), F.col("b"), F.col("nb")).alias("embedding"), (F.col("sample_count") + F.col("nb")).alias("sample_count"))
    return cells(out, "name")


@query("dml_merge_profiles", _MERGED + """
    SELECT name, n AS sample_count, CASE WHEN name IN ('label_1', 'label_2') THEN 7 WHEN name = 'label_4' THEN 9 END AS odoo_partner_id, CAST(pos AS BIGINT) AS pos,
           round(x / sqrt(sum(x * x) OVER (PARTITION BY name)), 6) AS x FROM m WHERE name <> 'label_0'
    UNION ALL SELECT name, n, NULL, CAST(pos AS BIGINT), round(x, 6) FROM a WHERE name = 'label_0'
    UNION ALL SELECT 'dup ' || name, n, 7, CAST(pos AS BIGINT), round(x, 6) FROM b WHERE name = 'label_0'""")
def dml_merge_profiles(spark, sf):
    name = F.concat(F.lit("label_"), F.col("label").cast("string"))
    vec = V.vectors(spark, sf)
    side = lambda parity: A.centroids(vec.where(F.col("vec_id") % 2 == parity).select("label", name.alias("name"), "embedding"), ["label", "name"])
    low = lambda: F.col("label").isin(1, 2, 4)
    survivors = side(0).select(F.col("label").alias("id"), "name", "sample_count", "embedding",
                               F.when(F.col("label").isin(2, 4), F.when(F.col("label") == 2, 7).otherwise(8)).cast("long").alias("odoo_partner_id"))
    absorbed = side(1).select((F.col("label") + 100).alias("id"), F.concat(F.lit("dup "), "name").alias("name"), "sample_count", "embedding",
                              F.when(F.col("label").isin(0, 1), 7).when(low(), 9).cast("long").alias("odoo_partner_id"))
    pairs = vec.select("label").distinct().where(F.col("label") != 0).select(
        F.col("label").alias("survivor_id"), (F.col("label") + 100).alias("absorbed_id"),
        F.when(F.col("label") == 4, "absorbed").otherwise("survivor").alias("odoo_from"))
    out = M.merge_profiles(survivors.unionByName(absorbed), pairs)
    return out.select("name", "sample_count", "odoo_partner_id", F.posexplode("embedding").alias("pos", "x")).select(
        "name", "sample_count", "odoo_partner_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("agg_term_usage", "SELECT term, count(DISTINCT run) AS runs FROM @runs_terms GROUP BY 1")
def agg_term_usage(spark, sf):
    return A.term_usage(V.runs_terms(spark, sf))


_PAIRS = """
    SELECT a.term, b.term AS other, count(*) AS runs FROM (SELECT DISTINCT run, term FROM @runs_terms) a
    JOIN (SELECT DISTINCT run, term FROM @runs_terms) b ON a.run = b.run AND a.term <> b.term GROUP BY 1, 2"""


@query("agg_cooccurrence", _PAIRS)
def agg_cooccurrence(spark, sf):
    return A.cooccurrence(V.runs_terms(spark, sf))


@query("agg_workspace_usage", """
    SELECT f.*, t.total_bytes FROM @files f JOIN (SELECT job_id, CAST(sum(size) AS BIGINT) AS total_bytes FROM @files GROUP BY 1) t USING (job_id)""")
def agg_workspace_usage(spark, sf):
    return A.workspace_usage(V.files(spark, sf))


@query("agg_profiles_by_company", """
    WITH p AS (SELECT partner_id, name, coalesce(company, 'Sans société Odoo') AS company FROM @partners)
    SELECT p.*, n.profiles FROM p JOIN (SELECT company, count(*) AS profiles FROM p GROUP BY 1) n USING (company)""")
def agg_profiles_by_company(spark, sf):
    return A.profiles_by_company(V.partners(spark, sf).select("partner_id", "name", "company"))
