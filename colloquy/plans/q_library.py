"""Library listing, search and maintenance over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import views as V
from colloquy.functions.cost import LOCAL_MODELS, catalogue, local_models
from colloquy.operators import library as L
from colloquy.operators import maintenance as M
from colloquy.operators.aggregates import speaker_stats
from colloquy.plans.registry import query

QUERY_TEXT, QUERY_SPEAKER, PATH_TEXT = "en_", "SPEAKER_00", "/7"

_SEARCH = f"""
    SELECT s.job_id, s.seq, s.start_ms, s.speaker, j.created_at
    FROM @segments s JOIN @jobs j ON j.id = s.job_id
    WHERE s.speaker = '{QUERY_SPEAKER}' AND lower(translate(s.text, 'ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜÁÍÓÚÑ', '...................')) LIKE '%{QUERY_TEXT}%'
    ORDER BY j.created_at DESC, s.start_ms, s.job_id, s.seq LIMIT 200"""


@query("lib_list", """
    SELECT id, created_at, status, source_path FROM @jobs WHERE status = 'COMPLETED'
    ORDER BY created_at DESC, id DESC LIMIT 100""")
def lib_list(spark, sf):
    return L.list_jobs(V.jobs(spark, sf), 100, "COMPLETED").select("id", "created_at", "status", "source_path")


@query("lib_get", """
    SELECT id, status, mode AS settings_mode, duration_total AS settings_duration FROM @jobs
    WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def lib_get(spark, sf):
    jobs = V.jobs(spark, sf).withColumn(
        "settings_json", F.to_json(F.struct("mode", F.col("duration_total").alias("duration"))))
    wanted = V.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("id"))
    return L.get_jobs(jobs, wanted, "mode string, duration double").select(
        "id", "status", F.col("settings.mode").alias("settings_mode"), F.col("settings.duration").alias("settings_duration"))


@query("lib_sorted", """
    SELECT j.id,
           CASE j.status WHEN 'RUNNING' THEN 0 WHEN 'COMPLETED' THEN 2 WHEN 'FAILED' THEN 3 ELSE 4 END AS sort_status,
           coalesce(u.updated_at, j.created_at) AS sort_updated,
           coalesce(f.bytes, 0) AS sort_bytes, coalesce(u.cost, 0) AS sort_cost, coalesce(u.model, 'zzz') AS sort_model,
           printf('%03d-%s', CASE WHEN n.names IS NULL THEN 0 ELSE len(n.names) END, coalesce(array_to_string(n.names, ','), '')) AS sort_speakers
    FROM @jobs j
    LEFT JOIN (SELECT job_id, CAST(sum(cost_micro) AS BIGINT) AS cost, max(model) AS model, max(created_at) + INTERVAL 1 DAY AS updated_at
               FROM @api_usage WHERE job_id IS NOT NULL GROUP BY 1) u ON u.job_id = j.id
    LEFT JOIN (SELECT job_id, CAST(sum(size) AS BIGINT) AS bytes FROM @files GROUP BY 1) f ON f.job_id = j.id
    LEFT JOIN (SELECT job_id, list(DISTINCT speaker ORDER BY speaker) AS names FROM @segments WHERE speaker IS NOT NULL GROUP BY 1) n ON n.job_id = j.id
""")
def lib_sorted(spark, sf):
    usage = V.api_usage(spark, sf).where(F.col("job_id").isNotNull()).groupBy(F.col("job_id").alias("id")).agg(
        F.sum("cost_micro").alias("cost_micro"), F.max("model").alias("model"),
        (F.max("created_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    size = V.files(spark, sf).groupBy(F.col("job_id").alias("id")).agg(F.sum("size").alias("total_bytes"))
    labels = V.segments(spark, sf).where(F.col("speaker").isNotNull()).select(
        "job_id", F.col("speaker").alias("label"), F.lit("").alias("name")).distinct()
    names = L.speaker_names(labels).withColumnRenamed("job_id", "id")
    rows = V.jobs(spark, sf).join(usage, "id", "left").join(size, "id", "left").join(names, "id", "left")
    rows = rows.withColumn("speaker_names", F.coalesce("speaker_names", F.array().cast("array<string>")))
    return L.with_sort_keys(rows).orderBy(F.col("sort_updated").desc(), "sort_status", F.col("id").desc())


@query("lib_best_artifact", """
    SELECT id, CASE WHEN status = 'COMPLETED' AND price > 200000 THEN source_path || '.enhanced.txt'
                    WHEN status = 'COMPLETED' THEN source_path || '.txt'
                    WHEN mode = '1-URGENT' THEN source_path || '.small.mp4' ELSE source_path END AS best
    FROM @jobs""")
def lib_best_artifact(spark, sf):
    done = F.col("status") == "COMPLETED"
    at = lambda cond, tail: F.when(cond, F.concat("source_path", F.lit(tail)))
    jobs = V.jobs(spark, sf).select(
        "id",
        at(done & (F.col("price") > 200000), ".enhanced.txt").alias("enhanced_transcript_path"),
        F.coalesce(at(done, ".txt"), F.lit("")).alias("transcript_path"),
        F.coalesce(at(F.col("mode") == "1-URGENT", ".small.mp4"), F.lit("")).alias("compressed_path"),
        F.col("source_path").alias("output_path"))
    return jobs.select("id", L.best_artifact("enhanced_transcript_path", "transcript_path", "compressed_path", "output_path").alias("best"))


@query("lib_segments", "SELECT job_id, seq, start_ms, end_ms, speaker, text FROM @segments")
def lib_segments(spark, sf):
    return V.segments(spark, sf).select("job_id", "seq", "start_ms", "end_ms", "speaker", "text").orderBy("job_id", "start_ms", "seq")


@query("lib_search_segments", _SEARCH)
def lib_search_segments(spark, sf):
    return L.search_segments(V.segments(spark, sf), V.jobs(spark, sf), QUERY_TEXT, QUERY_SPEAKER).select(
        "job_id", "seq", "start_ms", "speaker", "created_at")


@query("lib_search_stats", f"""
    WITH hits AS ({_SEARCH}),
    stats AS (SELECT job_id, speaker, count(*) AS utterances, CAST(sum(greatest(end_ms - start_ms, 0)) AS BIGINT) AS spoken_ms
              FROM @segments WHERE trim(coalesce(speaker, '')) <> '' GROUP BY 1, 2)
    SELECT h.job_id, h.seq, h.start_ms, h.speaker, h.created_at, s.utterances, s.spoken_ms
    FROM hits h JOIN stats s ON s.job_id = h.job_id AND s.speaker = h.speaker""")
def lib_search_stats(spark, sf):
    """Flagship: search hits with the speaker's totals in the meeting."""
    return lib_search_segments(spark, sf).join(speaker_stats(V.segments(spark, sf)), ["job_id", "speaker"])


@query("lib_search_jobs", f"""
    WITH head AS (SELECT * FROM @jobs ORDER BY created_at DESC, id DESC LIMIT 500),
    said AS (SELECT DISTINCT job_id FROM (
        SELECT s.job_id, s.start_ms, s.seq, j.created_at FROM @segments s JOIN @jobs j ON j.id = s.job_id
        WHERE lower(s.text) LIKE '%{PATH_TEXT}%' ORDER BY j.created_at DESC, s.start_ms, s.job_id, s.seq LIMIT 200))
    SELECT id, created_at, source_path FROM head
    WHERE id IN (SELECT job_id FROM said) OR contains(lower(source_path), '{PATH_TEXT}')""")
def lib_search_jobs(spark, sf):
    return L.search_jobs(V.jobs(spark, sf), V.segments(spark, sf), PATH_TEXT).select("id", "created_at", "source_path")


@query("lib_speaker_names", """
    WITH m AS (SELECT DISTINCT s.job_id, s.speaker AS label,
                      CASE WHEN s.speaker = 'SPEAKER_00' AND j.status <> 'FAILED' THEN ' Owner ' || (j.owner_id % 9) || ' '
                           WHEN j.status = 'COMPLETED' THEN 'Guest' ELSE '  ' END AS name
               FROM @segments s JOIN @jobs j ON j.id = s.job_id WHERE s.speaker IS NOT NULL)
    SELECT job_id, CASE WHEN count(*) FILTER (trim(name) <> '') > 0
                        THEN string_agg(DISTINCT trim(name), ' · ' ORDER BY trim(name)) FILTER (trim(name) <> '')
                        ELSE string_agg(DISTINCT label, ' · ' ORDER BY label) END AS listing
    FROM m GROUP BY job_id""")
def lib_speaker_names(spark, sf):
    jobs = V.jobs(spark, sf).select(F.col("id").alias("job_id"), "status", "owner_id")
    labels = V.segments(spark, sf).where(F.col("speaker").isNotNull()).select("job_id", F.col("speaker").alias("label")).distinct()
    owner = F.concat(F.lit(" Owner "), (F.col("owner_id") % 9).cast("string"), F.lit(" "))
    named = labels.join(jobs, "job_id").select(
        "job_id", "label",
        F.when((F.col("label") == "SPEAKER_00") & (F.col("status") != "FAILED"), owner)
        .when(F.col("status") == "COMPLETED", "Guest").otherwise("  ").alias("name"))
    return L.speaker_names(named).select("job_id", F.array_join("speaker_names", " · ").alias("listing"))


@query("lib_failed_chunks", """
    SELECT id, i AS index, i * 600.0 AS start, (i + 1) * 600.0 AS "end"
    FROM (SELECT id, unnest(range(id % 4 + 1)) AS i FROM @jobs) WHERE (id + i) % 3 = 0""")
def lib_failed_chunks(spark, sf):
    i = lambda x: F.struct(
        x.alias("index"), (x * F.lit(600.0)).alias("start"), ((x + 1) * F.lit(600.0)).alias("end"),
        ((F.col("id") + x) % 3 != 0).alias("ok"))
    jobs = V.jobs(spark, sf).select("id", F.to_json(F.transform(F.sequence(F.lit(0).cast("long"), F.col("id") % 4), i)).alias("cloud_chunks_json"))
    return L.failed_chunks(jobs).select("id", "index", "start", "end")


@query("lib_attendee_hints", """
    WITH inv AS (SELECT m.meeting_id, p.partner_id, p.name FROM (SELECT meeting_id, unnest(partner_ids) AS pid FROM @meetings) m
                 JOIN @partners p ON p.partner_id = m.pid),
    seen AS (SELECT DISTINCT date_trunc('hour', ts) AS h, user_id FROM events WHERE event_type = 'signup'),
    known AS (SELECT CAST(epoch(h) AS BIGINT) // 3600 * 1000000 + user_id // 6 AS meeting_id, lower(trim(' ' || upper(p.name))) AS k
              FROM seen JOIN @partners p ON p.partner_id = user_id)
    SELECT meeting_id, partner_id, name FROM inv
    WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.meeting_id = inv.meeting_id AND k = lower(trim(inv.name)))""")
def lib_attendee_hints(spark, sf):
    people = V.partners(spark, sf).select("partner_id", "name")
    invitees = V.meetings(spark, sf).select("meeting_id", F.explode("partner_ids").alias("partner_id")).join(people, "partner_id")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    expected = (
        V.table(spark, sf, "events").where(F.col("event_type") == "signup")
        .select((hour * 1_000_000 + F.floor(F.col("user_id") / 6)).alias("meeting_id"), F.col("user_id").alias("partner_id")).distinct()
        .join(people, "partner_id").select("meeting_id", F.concat(F.lit(" "), F.upper("name")).alias("name")))
    return L.attendee_hints(invitees, expected).select("meeting_id", "partner_id", "name")


@query("lib_redact", """
    SELECT id, '{"mode":"' || mode || '","token":"[redacted]","cloud":{"provider":"x","cloud_api_key":"[redacted]","keys":[{"password":"[redacted]"},{"password":0}]},"access_token":""}' AS settings_json
    FROM @jobs""")
def lib_redact(spark, sf):
    key = F.col("id").cast("string")
    text = F.concat(
        F.lit('{"mode":"'), F.col("mode"), F.lit('","token":"t-'), key,
        F.lit('","cloud":{"provider":"x","cloud_api_key":{"a":["'), key, F.lit('",{"b":1}]},"keys":[{"password":'), F.col("id") + 1,
        F.lit('},{"password":0}]},"access_token":""}'))
    return V.jobs(spark, sf).select("id", L.redact(text).alias("settings_json"))


@query("lib_usable_profiles", """
    SELECT vec_id, len(embedding) AS dim FROM @vectors
    WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND (label = 5 OR label % 3 <> 0)""")
def lib_usable_profiles(spark, sf):
    rows = V.vectors(spark, sf).select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, "[0.1, oops").when(F.col("vec_id") % 11 == 0, "[]")
        .otherwise(F.to_json("embedding")).alias("embedding_json"),
        F.when(F.col("label") == 5, F.lit(None)).when(F.col("label") % 3 == 0, 0).otherwise(F.col("label")).cast("long").alias("sample_count"))
    return L.usable_profiles(rows).select("vec_id", F.size("embedding").cast("long").alias("dim"))


@query("lib_file_label", """
    SELECT path, CASE WHEN ends_with(path, '.txt') OR ends_with(path, '.srt') THEN 'Transcription'
                      WHEN ends_with(path, '.md') THEN 'Rapport à vérifier' WHEN ends_with(path, '.mp4') THEN 'Vidéo compressée'
                      WHEN ends_with(path, '.wav') THEN 'Audio' WHEN ends_with(path, '.json') THEN 'Données moteur (JSON)'
                      ELSE 'Autre' END AS label FROM @files""")
def lib_file_label(spark, sf):
    return V.files(spark, sf).select("path", L.file_label(F.col("path")).alias("label"))


_LOCAL = ", ".join(f"('{m}', '{f}', '{r}')" for m, f, r in LOCAL_MODELS)


@query("lib_model_catalog", f"""
    WITH cat AS (SELECT model, family, role, 'local' AS kind, 0 AS cents_in, 0 AS cents_out, 0 AS cents_hour FROM (VALUES {_LOCAL}) t(model, family, role)
                 UNION ALL SELECT model, family, 'cloud_transcription', 'cloud', cents_in, cents_out, cents_hour FROM @prices)
    SELECT c.*, coalesce(u.calls, 0) AS calls FROM cat c
    LEFT JOIN (SELECT model, count(*) AS calls FROM @api_usage GROUP BY 1) u ON u.model = c.model AND c.kind = 'cloud'""")
def lib_model_catalog(spark, sf):
    """The catalogue with how often the ledger shows each model in use."""
    used = V.api_usage(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("calls")).withColumn("kind", F.lit("cloud"))
    cat = L.model_catalog(catalogue(spark), local_models(spark))
    return cat.join(used, ["model", "kind"], "left").withColumn("calls", F.coalesce("calls", F.lit(0).cast("long")))


# ---------------------------------------------------------------- maintenance

@query("dml_replace_segments", """
    SELECT job_id, seq, speaker, text FROM @segments WHERE job_id NOT IN (SELECT id FROM @jobs WHERE status = 'FAILED')
    UNION ALL SELECT job_id, seq, speaker, '# ' || text FROM @segments
    WHERE job_id IN (SELECT id FROM @jobs WHERE status = 'FAILED') AND speaker IS NOT NULL""")
def dml_replace_segments(spark, sf):
    seg = V.segments(spark, sf).select("job_id", "seq", "speaker", "text")
    failed = V.jobs(spark, sf).where(F.col("status") == "FAILED").select(F.col("id").alias("job_id"))
    redo = seg.where(F.col("speaker").isNotNull()).join(failed, "job_id", "left_semi").withColumn("text", F.concat(F.lit("# "), "text"))
    return M.replace_segments(seg, redo)


@query("dml_cascade_delete", """
    SELECT 'jobs' AS kind, id AS job_id, CAST(NULL AS BIGINT) AS seq FROM @jobs WHERE status <> 'FAILED'
    UNION ALL SELECT 'segments', job_id, seq FROM @segments WHERE job_id NOT IN (SELECT id FROM @jobs WHERE status = 'FAILED')
    UNION ALL SELECT 'usage', usage_id, NULL FROM @api_usage""")
def dml_cascade_delete(spark, sf):
    jobs, seg = V.jobs(spark, sf), V.segments(spark, sf)
    left_jobs, left_seg = M.cascade_delete(jobs, seg, jobs.where(F.col("status") == "FAILED"))
    none = F.lit(None).cast("long").alias("seq")
    return (
        left_jobs.select(F.lit("jobs").alias("kind"), F.col("id").alias("job_id"), none)
        .unionByName(left_seg.select(F.lit("segments").alias("kind"), "job_id", "seq"))
        .unionByName(V.api_usage(spark, sf).select(F.lit("usage").alias("kind"), F.col("usage_id").alias("job_id"), none)))


@query("dml_upsert_profile", """
    WITH b AS (SELECT lower(trim(name)) AS k, name, n, version FROM (
        SELECT c_name AS name, 1 AS n, -1 AS version FROM customer
        UNION ALL SELECT '  ' || upper(c_name) || ' ', o_orderkey % 7 + 2, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
        UNION ALL SELECT s_name, 5, 0 FROM supplier))
    SELECT k AS name_key, name, n AS sample_count FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS rn FROM b) WHERE rn = 1""")
def dml_upsert_profile(spark, sf):
    row = lambda df, name, n, v: df.select(name.alias("name"), n.cast("long").alias("sample_count"), v.cast("long").alias("version"))
    cust = V.table(spark, sf, "customer")
    base = row(cust, F.col("c_name"), F.lit(1), F.lit(-1))
    seen = V.table(spark, sf, "orders").join(cust, F.col("c_custkey") == F.col("o_custkey"))
    new = row(seen, F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")), F.col("o_orderkey") % 7 + 2, F.col("o_orderkey"))
    new = new.unionByName(row(V.table(spark, sf, "supplier"), F.col("s_name"), F.lit(5), F.lit(0)))
    return M.upsert_profiles(base, new).select("name_key", "name", "sample_count")


@query("dml_partial_update", """
    WITH d AS (SELECT l_orderkey AS id, max(CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS status,
                      max(CASE WHEN l_quantity > 45 THEN l_extendedprice END) AS price FROM lineitem GROUP BY 1)
    SELECT j.id, coalesce(d.status, j.status) AS status, coalesce(d.price, j.price) AS price, j.source_path
    FROM @jobs j LEFT JOIN d ON d.id = j.id""")
def dml_partial_update(spark, sf):
    deltas = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", "returned")).alias("status"),
        F.max(F.when(F.col("l_quantity") > 45, F.col("l_extendedprice"))).alias("price"))
    jobs = V.jobs(spark, sf).select("id", "status", "price", "source_path")
    return M.partial_update(jobs, deltas, "id", ["status", "price"])


@query("dml_version_prepend", """
    SELECT id, least(CASE WHEN status = 'FAILED' THEN 0 ELSE id % 13 END + 1, 10) AS versions, source_path AS newest,
           CASE WHEN status = 'FAILED' OR id % 13 = 0 THEN source_path ELSE 'v' || least(id % 13, 9) END AS oldest
    FROM @jobs""")
def dml_version_prepend(spark, sf):
    old = F.to_json(F.transform(F.sequence(F.lit(1).cast("long"), F.col("id") % 13), lambda i: F.struct(F.concat(F.lit("v"), i.cast("string")).alias("path"))))
    old = F.when(F.col("status") == "FAILED", "[{oops").when(F.col("id") % 13 == 0, "[]").otherwise(old)
    jobs = V.jobs(spark, sf).select("id", "source_path", old.alias("old"))
    v = M.prepend_version("old", F.struct(F.col("source_path").alias("path")), "struct<path:string>")
    return jobs.withColumn("v", v).select(
        "id", F.size("v").cast("long").alias("versions"), F.get("v", F.lit(0))["path"].alias("newest"), F.element_at("v", -1)["path"].alias("oldest"))


@query("dml_mode_columns", """
    WITH r AS (SELECT id, CASE mode WHEN '1-URGENT' THEN 'compress' WHEN '2-HIGH' THEN 'transcribe' WHEN '3-MEDIUM' THEN 'compress_transcribe' ELSE 'enhance' END AS mode,
                      source_path || '.mp4' AS compressed_path, source_path || '.txt' AS transcript_path,
                      CASE WHEN status = 'COMPLETED' THEN source_path || '.md' ELSE '' END AS review_path FROM @jobs)
    SELECT id, mode, 'compressed_path' AS artefact, compressed_path AS path FROM r WHERE mode IN ('compress', 'compress_transcribe')
    UNION ALL SELECT id, mode, 'transcript_path', transcript_path FROM r WHERE mode <> 'compress'
    UNION ALL SELECT id, mode, 'review_path', review_path FROM r WHERE mode <> 'compress' AND review_path <> ''""")
def dml_mode_columns(spark, sf):
    path = lambda tail: F.concat("source_path", F.lit(tail))
    reruns = V.jobs(spark, sf).select(
        "id",
        F.when(F.col("mode") == "1-URGENT", "compress").when(F.col("mode") == "2-HIGH", "transcribe")
        .when(F.col("mode") == "3-MEDIUM", "compress_transcribe").otherwise("enhance").alias("mode"),
        path(".mp4").alias("compressed_path"), path(".txt").alias("transcript_path"),
        F.lit(None).cast("string").alias("enhanced_transcript_path"),
        F.when(F.col("status") == "COMPLETED", path(".md")).otherwise("").alias("review_path"))
    return M.overwritten_artifacts(reruns)


@query("dml_remember_names", """
    WITH n AS (SELECT trim(' ' || upper(c_name)) AS name, c_custkey AS seq FROM customer
               UNION ALL SELECT s_name, s_suppkey + 1000000000 FROM supplier
               UNION ALL SELECT upper(s_name), s_suppkey + 2000000000 FROM supplier),
    f AS (SELECT lower(name) AS name_key, arg_min(name, seq) AS name FROM n GROUP BY 1)
    SELECT name_key, name, 0 AS sample_count FROM f WHERE name_key NOT IN (SELECT lower(c_name) FROM customer WHERE c_acctbal > 0)""")
def dml_remember_names(spark, sf):
    cust, sup = V.table(spark, sf, "customer"), V.table(spark, sf, "supplier")
    names = (
        cust.select(F.concat(F.lit(" "), F.upper("c_name")).alias("name"), F.col("c_custkey").alias("seq"))
        .unionByName(sup.select(F.col("s_name").alias("name"), (F.col("s_suppkey") + 1_000_000_000).alias("seq")))
        .unionByName(sup.select(F.upper("s_name").alias("name"), (F.col("s_suppkey") + 2_000_000_000).alias("seq"))))
    return M.remember_names(cust.where(F.col("c_acctbal") > 0).select(F.col("c_name").alias("name")), names)


@query("dml_link_profiles", """
    WITH a AS (SELECT lower(trim(name)) AS k, min(partner_id) AS pid FROM @partners WHERE company IS NOT NULL AND partner_id > 0 GROUP BY 1),
    p AS (SELECT upper(c_name) AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 999999 END AS pid FROM customer)
    SELECT name, CASE WHEN coalesce(p.pid, 0) = 0 AND a.pid IS NOT NULL THEN a.pid ELSE p.pid END AS odoo_partner_id
    FROM p LEFT JOIN a ON a.k = lower(trim(name))""")
def dml_link_profiles(spark, sf):
    seg = F.col("c_mktsegment")
    profiles = V.table(spark, sf, "customer").select(
        F.upper("c_name").alias("name"),
        F.when(seg == "BUILDING", 0).when(seg == "MACHINERY", 999999).cast("long").alias("odoo_partner_id"))
    attendees = V.partners(spark, sf).where(F.col("company").isNotNull()).select("partner_id", "name")
    return M.link_profiles(profiles, attendees)


@query("dml_repair_maps", """
    WITH c AS (SELECT job_id, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS want FROM @segments WHERE speaker IS NOT NULL GROUP BY 1),
    h AS (SELECT DISTINCT job_id FROM @segments),
    s AS (SELECT h.job_id IS NOT NULL AS has,
                 CASE WHEN j.status = 'COMPLETED' THEN 'SPEAKER_00,SPEAKER_01' WHEN j.status = 'RUNNING' THEN 'x' ELSE '' END = coalesce(c.want, '') AS same
          FROM @jobs j LEFT JOIN h ON h.job_id = j.id LEFT JOIN c ON c.job_id = j.id)
    SELECT count(*) AS checked, count(*) FILTER (has AND NOT same) AS repaired, count(*) FILTER (NOT has) AS skipped_no_segments,
           count(*) FILTER (has AND same) AS unchanged FROM s""")
def dml_repair_maps(spark, sf):
    jobs = V.jobs(spark, sf).select(
        "id",
        F.when(F.col("status") == "COMPLETED", '{"SPEAKER_01":"","SPEAKER_00":""}')
        .when(F.col("status") == "RUNNING", '{"Robin":"Robin"}').otherwise("{not json").alias("speaker_map_json"))
    return M.repair_maps(jobs, V.segments(spark, sf))


@query("dml_recompute_bytes", """
    SELECT j.id, coalesce(b.bytes, CAST(floor(j.price) AS BIGINT)) AS total_bytes, b.bytes IS NOT NULL AS updated
    FROM @jobs j LEFT JOIN (SELECT job_id, CAST(sum(size) AS BIGINT) AS bytes FROM @files GROUP BY 1) b ON b.job_id = j.id""")
def dml_recompute_bytes(spark, sf):
    jobs = V.jobs(spark, sf).select("id", F.floor("price").cast("long").alias("total_bytes"))
    return M.recompute_bytes(jobs, V.files(spark, sf))
