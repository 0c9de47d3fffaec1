"""Readers and writers, fed with payloads that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import stage
from colloquy import views as V
from colloquy.functions.clock import clock_short
from colloquy.operators import sequences as S
from colloquy.plans.q_sequences import REPEATS
from colloquy.plans.q_text import _EVAL, eval_cases
from colloquy.plans.registry import query
from colloquy.sources import payloads as P
from colloquy.sources import render as R
from colloquy.sources import tables as T
from colloquy.sources.review import review

CHUNK_ROWS = 256


@query("src_asr_json", f"WITH {REPEATS} SELECT job_id, start_ms, end_ms, text, 1 AS words FROM placed WHERE k <= 2")
def src_asr_json(spark, sf):
    """Captions as decoder documents of 256 segments, written, read and cleaned."""
    sec = lambda c: F.col(c) / F.lit(1000.0)
    seg = V.captions(spark, sf).select(
        "job_id", F.floor(F.col("seq") / CHUNK_ROWS).alias("chunk"),
        F.struct(
            F.col("seq").alias("id"), sec("start_ms").alias("start"), sec("end_ms").alias("end"), F.concat(F.lit(" "), "text").alias("text"), "compression_ratio",
            F.array(F.struct(sec("start_ms").cast("string").alias("start"), sec("end_ms").alias("end"), F.col("text").alias("word")),
                    F.struct(F.lit(None).cast("string").alias("start"), sec("end_ms").alias("end"), F.lit("?").alias("word"))).alias("words")).alias("s"))
    docs = seg.groupBy("job_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("s.id").alias("i"), "s"))), lambda x: x["s"]).alias("segments"))
    path = stage.fresh_path(spark, "asr")
    docs.withColumn("segments", F.transform("segments", lambda s: s.withField("words", F.transform(s["words"], lambda w: w.withField("start", w["start"].cast("double")))))).write.json(path)
    return P.read_asr(spark, path).select("job_id", "start_ms", "end_ms", "text", F.size("words").cast("long").alias("words"))


def provider_payloads(spark, sf):
    """Captions in chunks of 256 rows as payloads of the four speech providers; some only have flat text."""
    cap = V.captions(spark, sf).withColumn("chunk", F.floor(F.col("seq") / CHUNK_ROWS))
    prov = F.element_at(F.array(*[F.lit(x) for x in ("openai", "assemblyai", "deepgram", "gladia")]), (F.col("job_id") % 4 + 1).cast("int"))
    sec = lambda c: (F.col(c) / F.lit(1000.0)).cast("string")
    ms = lambda c: F.col(c).cast("string")
    spk = F.coalesce(F.right("speaker", F.lit(1)), F.lit(None))
    utt = F.struct(
        F.when(prov == "assemblyai", ms("start_ms")).otherwise(sec("start_ms")).alias("start"), F.when(prov == "assemblyai", ms("end_ms")).otherwise(sec("end_ms")).alias("end"),
        spk.alias("speaker"), F.when(prov != "deepgram", F.col("text")).alias("text"), F.when(prov == "deepgram", F.col("text")).alias("transcript"))
    rows = cap.groupBy("job_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", utt.alias("u"), "text"))).alias("r"))
    u = F.transform("r", lambda x: x["u"])
    flat = F.array_join(F.transform("r", lambda x: F.concat(x["text"], F.lit("."))), " ")
    thin = F.col("job_id") % 9 == 0
    none = F.lit(None)
    payload = (
        F.when((prov == "openai") & thin, F.to_json(F.struct(flat.alias("text")))).when(prov == "openai", F.to_json(F.struct(u.alias("segments"))))
        .when((prov == "assemblyai") & thin, F.to_json(F.struct(flat.alias("text")))).when(prov == "assemblyai", F.to_json(F.struct(u.alias("utterances"))))
        .when((prov == "deepgram") & thin, F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(flat.alias("transcript"))).alias("alternatives"))).alias("channels")).alias("results"))))
        .when(prov == "deepgram", F.to_json(F.struct(F.struct(u.alias("utterances")).alias("results"))))
        .when(thin, F.to_json(F.struct(F.struct(F.struct(flat.alias("full_transcript")).alias("transcription")).alias("result"))))
        .otherwise(F.to_json(F.struct(F.struct(F.struct(u.alias("utterances")).alias("transcription")).alias("result")))))
    return rows.select("job_id", "chunk", prov.alias("provider"), payload.alias("payload"), (F.col("chunk") * 1000).alias("offset_ms"), (F.size("r") * 2000).cast("long").alias("duration_ms"))


@query("src_provider_json", """
    WITH c AS (SELECT *, seq // 256 AS chunk FROM @captions WHERE job_id % 9 <> 0),
    f AS (SELECT job_id, chunk, speaker, row_number() OVER (PARTITION BY job_id, chunk ORDER BY min(seq)) AS n FROM c WHERE speaker IS NOT NULL GROUP BY 1, 2, 3)
    SELECT c.job_id, c.chunk, c.start_ms + c.chunk * 1000 AS start_ms, c.end_ms + c.chunk * 1000 AS end_ms, CASE WHEN f.n IS NULL THEN '' ELSE 'Intervenant ' || f.n END AS speaker, text
    FROM c LEFT JOIN f ON f.job_id = c.job_id AND f.chunk = c.chunk AND f.speaker = c.speaker""")
def src_provider_json(spark, sf):
    """Timed payloads; the flat-text ones run in src_provider_flat."""
    return P.provider_utterances(provider_payloads(spark, sf).where(F.col("job_id") % 9 != 0)).select("job_id", "chunk", "start_ms", "end_ms", "speaker", "text")


@query("src_provider_flat")
def src_provider_flat(spark, sf):
    return P.provider_utterances(provider_payloads(spark, sf).where(F.col("job_id") % 9 == 0)).select("job_id", "chunk", "seq", "start_ms", "end_ms", "speaker", "text")


def bundle_payloads(spark, sf):
    """Captions in chunks of 256 rows as a model's bundled answer, with gaps in its times."""
    cap = V.captions(spark, sf).withColumn("chunk", F.floor(F.col("seq") / CHUNK_ROWS))
    e = F.col("event_id")
    row = F.struct(
        F.when(e % 4 != 0, clock_short("start_ms")).alias("start"), F.when(e % 3 == 0, clock_short("end_ms")).when(e % 3 == 1, "0:00").alias("end"),
        F.concat("speaker", F.lit(" ")).alias("speaker"), F.when(e % 37 == 0, "  ").otherwise(F.col("text")).alias("text"))
    rows = cap.groupBy("job_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("s")))), lambda x: x["s"]).alias("segments"))
    key = F.col("job_id").cast("string")
    extra = [
        F.concat(F.lit(" Point "), key).alias("title"),
        F.array(F.struct(F.lit("SPEAKER_00").alias("label"), F.lit("Robin").alias("name")), F.struct(F.lit(" SPEAKER_00 ").alias("label"), F.concat(F.lit("Zoe "), key).alias("name")),
                F.struct(F.lit(" ").alias("label"), F.lit("x").alias("name"))).alias("speakers"),
        F.array(F.lit("ERP "), F.lit(" "), key).alias("technical_terms"),
        F.array(F.struct(F.lit("0:01").alias("timestamp"), F.lit("mot").alias("text"), F.lit("bruit").alias("reason")), F.struct(F.lit("0:02").alias("timestamp"), F.lit(" ").alias("text"), F.lit("x").alias("reason"))).alias("uncertain"),
    ]
    return rows.select("job_id", "chunk", (F.col("chunk") * 30_000).alias("offset_ms"), F.to_json(F.struct(*extra, "segments")).alias("payload"))


@query("src_bundle_json", """
    WITH c AS (SELECT *, seq // 256 AS chunk, CASE WHEN event_id % 37 = 0 THEN '' ELSE text END AS said, CASE WHEN event_id % 4 <> 0 THEN start_ms // 1000 END AS s0,
                      CASE WHEN event_id % 3 = 0 THEN end_ms // 1000 WHEN event_id % 3 = 1 THEN 0 END AS e0 FROM @captions),
    k AS (SELECT *, coalesce(last_value(s0 IGNORE NULLS) OVER (PARTITION BY job_id, chunk ORDER BY seq), 0) AS s FROM c WHERE said <> '')
    SELECT job_id, chunk, CAST(s + chunk * 30 AS DOUBLE) AS start,
           round(CASE WHEN e0 IS NULL OR e0 < s THEN s + greatest(len(string_split(text, ' ')) / 3.0::DOUBLE, 1.0) ELSE e0 END + chunk * 30, 2) AS "end", coalesce(speaker, '') AS speaker, text FROM k""")
def src_bundle_json(spark, sf):
    return P.bundle_segments(bundle_payloads(spark, sf)).select("job_id", "chunk", "start", "end", "speaker", "text")


@query("src_enrich_json", """
    SELECT DISTINCT job_id, seq // 256 AS chunk, CASE WHEN job_id % 5 = 0 THEN '' ELSE 'Point ' || job_id END AS title, CASE WHEN job_id % 5 = 0 THEN '' ELSE 'SPEAKER_00=Zoe ' || job_id END AS speakers,
           CASE WHEN job_id % 5 = 0 THEN '' ELSE 'ERP,' || job_id END AS terms, CASE WHEN job_id % 5 = 0 THEN 0 ELSE 1 END AS doubts FROM @captions""")
def src_enrich_json(spark, sf):
    cut = F.when(F.col("job_id") % 5 == 0, F.substring("payload", 1, 40)).otherwise(F.col("payload"))
    out = P.bundle_metadata(bundle_payloads(spark, sf).withColumn("payload", cut))
    return out.select("job_id", "chunk", "title", F.array_join(F.transform(F.map_entries("speakers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("speakers"),
                      F.array_join("technical_terms", ",").alias("terms"), F.size("uncertain").cast("long").alias("doubts"))


def tool_logs(spark, sf):
    """A log per 256 turns of a user: progress lines, then the turns as JSON, or a failure."""
    t = V.turns(spark, sf).withColumn("chunk", F.floor(F.col("seq") / CHUNK_ROWS))
    turn = F.struct((F.col("start_ms") / F.lit(1000.0)).alias("start"), (F.col("end_ms") / F.lit(1000.0)).alias("end"), "speaker")
    rows = t.groupBy("job_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", turn.alias("t")))), lambda x: x["t"]).alias("turns"))
    n = F.col("job_id") % 7
    last = F.when(n == 0, '{"error": "out of memory"}').when(n == 1, '{"turns": [').when(n == 2, "").otherwise(F.to_json(F.struct("turns")))
    return rows.select(F.struct("job_id", "chunk").alias("id"), F.when(n == 2, "").otherwise(F.concat(F.lit("loading\n50%\n"), last, F.lit("\n"))).alias("value"))


@query("src_last_json_line", """
    SELECT job_id, seq // 256 AS chunk, 'ok' AS state, count(*) AS turns FROM @turns WHERE job_id % 7 > 2 GROUP BY 1, 2
    UNION ALL SELECT DISTINCT job_id, seq // 256, CASE job_id % 7 WHEN 0 THEN 'error: out of memory' WHEN 1 THEN 'bad_json' ELSE 'empty' END, 0 FROM @turns WHERE job_id % 7 <= 2""")
def src_last_json_line(spark, sf):
    good, bad = P.last_json_line(tool_logs(spark, sf))
    return good.select("id.job_id", "id.chunk", F.lit("ok").alias("state"), F.size("turns").cast("long").alias("turns")).unionByName(
        bad.select("id.job_id", "id.chunk", F.col("reason").alias("state"), F.lit(0).cast("long").alias("turns")))


@query("src_llm_markdown", r"""
    WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(text, '[^\p{L}]+'), lambda t: t <> '') AS w FROM documents WHERE doc_id % 10 <> 0),
    f AS (SELECT id, -2 AS pos, '0:01' AS timestamp, w[2] AS original, w[3] AS replacement, 'accord' AS reason FROM d WHERE len(w) >= 3
          UNION ALL SELECT id, -1, '0:02', w[3], w[4], '' FROM d WHERE len(w) >= 4
          UNION ALL SELECT id, i, '0:05', w[i], 'z', '' FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM d))
    SELECT id, 'correction' AS kind, n, timestamp, original, replacement, CAST(0.85 AS DOUBLE) AS confidence, reason FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM f) WHERE n <= 20
    UNION ALL SELECT id, 'doubt', 1, '00:12:30', w[1], NULL, NULL, 'peu clair' FROM d WHERE len(w) >= 1""")
def src_llm_markdown(spark, sf):
    w = F.filter(F.split("text", r"[^\p{L}]+"), lambda t: t != "")
    line = lambda i, sep, why: F.concat(F.lit("- [0:0"), F.lit(str(i)), F.lit('] "'), F.get("w", F.lit(i)), F.lit('" ' + sep + ' "'), F.get("w", F.lit(i + 1)), F.lit('"' + why))
    doubt = F.concat(F.lit('* 00:12:30 "'), F.get("w", F.lit(0)), F.lit('" (raison : peu clair)'))
    many = F.transform("w", lambda x: F.concat(F.lit('- [0:05] "'), x, F.lit('" => "z"')))
    text = F.array_join(F.concat(
        F.array(F.lit("Voici"), F.lit("# Corrections"), line(1, "->", " (raison : accord)"), line(2, "→", ""), F.lit("- sans guillemets")), many,
        F.array(F.lit("# Doutes"), doubt)), "\n")
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), w.alias("w"))
    return P.markdown_findings(docs.select("id", F.when(F.col("id") % 10 == 0, "Aucune correction.\nAucun doute.").otherwise(text).alias("text")))


@query("src_title_json", """
    SELECT id, CASE WHEN id % 5 = 4 THEN '' ELSE 'Point ' || mode END AS title, CASE WHEN id % 5 = 4 THEN '' ELSE 'SPEAKER_00=Robin' END AS speakers,
           CASE WHEN id % 5 = 4 THEN '' ELSE 'ERP,' || owner_id END AS terms FROM @jobs""")
def src_title_json(spark, sf):
    body = F.concat(F.lit('{"title": " Point '), "mode", F.lit('", "speakers": {"SPEAKER_00": "Robin", "Other": "X", "SPEAKER_01": ""}, "technical_terms": ["ERP", "ERP", "'), F.col("owner_id").cast("string"), F.lit('"'))
    n = F.col("id") % 5
    text = (
        F.when(n == 0, F.concat(body, F.lit("]}"))).when(n == 1, F.concat(F.lit("voici\n"), body, F.lit("]}")))
        .when(n == 2, F.concat(F.lit("Bien sûr : "), body, F.lit("]} voilà }"))).when(n == 3, F.concat(body, F.lit(",],}\nfin"))).otherwise('{"error": "timeout"}'))
    out = P.title_answers(V.jobs(spark, sf).select("id", text.alias("text")))
    return out.select("id", "title", F.array_join(F.transform(F.map_entries("speakers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("speakers"), F.array_join("technical_terms", ",").alias("terms"))


@query("src_transcript_lines", r"""
    SELECT job_id, coalesce(speaker, '?') AS speaker, start_ms // 1000 AS seconds, regexp_replace(text, '\s+', ' ', 'g') AS text FROM @segments""")
def src_transcript_lines(spark, sf):
    path = stage.fresh_path(spark, "transcripts")
    R.write_lines(V.transcript_lines(spark, sf).withColumnRenamed("seq", "line_no"), path)
    return P.transcript_rows(R.read_lines(spark, path), ["job_id"], "value")


@query("src_library_tables", """
    SELECT usage_id, coalesce(job_id, -1) AS job_id, model, cost_micro, strftime(created_at, '%Y-%m') AS month FROM @api_usage WHERE created_at >= TIMESTAMP '1997-01-01'""")
def src_library_tables(spark, sf):
    """The ledger written by month and read with its fixed schema; older months are never opened."""
    path = stage.fresh_path(spark, "ledger")
    T.append_usage(V.api_usage(spark, sf), path)
    return T.read_usage(spark, path).where(F.col("month") >= "1997-01").select("usage_id", F.coalesce("job_id", F.lit(-1).cast("long")).alias("job_id"), "model", "cost_micro", "month")


@query("sink_usage_append", """
    SELECT j.id, j.status, coalesce(c.cost, 0) AS cost_micro FROM @jobs j
    LEFT JOIN (SELECT job_id, CAST(sum(cost_micro) AS BIGINT) AS cost FROM @api_usage WHERE job_id IS NOT NULL GROUP BY 1) c ON c.job_id = j.id""")
def sink_usage_append(spark, sf):
    """Two appends to the ledger, then the totals on the jobs."""
    path = stage.fresh_path(spark, "ledger")
    usage = V.api_usage(spark, sf)
    T.append_usage(usage.where(F.col("step") < "step_2"), path)
    T.append_usage(usage.where(F.col("step") >= "step_2"), path)
    return T.job_costs(V.jobs(spark, sf).select("id", "status"), T.read_usage(spark, path))


@query("src_eval_cases", f"""
    WITH {_EVAL} SELECT CAST(job_id AS VARCHAR) AS name, length(transcript) AS chars, (SELECT count(*) FROM te WHERE te.job_id = tr.job_id) AS terms FROM tr""")
def src_eval_cases(spark, sf):
    path = stage.fresh_path(spark, "cases")
    eval_cases(spark, sf).write.json(path)
    return T.read_eval_cases(spark, path, one_document_per_file=False).select("name", F.length("transcript").alias("chars"), F.size("expected_terms").cast("long").alias("terms"))


@query("src_files")
def src_files(spark, sf):
    """The files of the tables' own folder."""
    return T.list_files(spark, sf).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size")


_SRT = "printf('%02d:%02d:%02d{m}%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"


def _t(c: str, m: str) -> str:
    return _SRT.replace("{c}", c).replace("{m}", m)


_SEC = "CAST({c} // 1000 AS VARCHAR) || '.' || printf('%03d', {c} % 1000)"


@query("sink_plain", f"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM @segments)
    SELECT 'srt' AS fmt, job_id, n * 4 AS line_no, CAST(n AS VARCHAR) AS line FROM n
    UNION ALL SELECT 'srt', job_id, n * 4 + 1, {_t('start_ms', ',')} || ' --> ' || {_t('end_ms', ',')} FROM n
    UNION ALL SELECT 'srt', job_id, n * 4 + 2, text FROM n UNION ALL SELECT 'srt', job_id, n * 4 + 3, '' FROM n
    UNION ALL SELECT 'vtt', job_id, seq * 4, {_t('start_ms', '.')} || ' --> ' || {_t('end_ms', '.')} FROM n
    UNION ALL SELECT 'vtt', job_id, seq * 4 + 1, text FROM n UNION ALL SELECT 'vtt', job_id, seq * 4 + 2, '' FROM n
    UNION ALL SELECT DISTINCT 'vtt', job_id, -2, 'WEBVTT' FROM n UNION ALL SELECT DISTINCT 'vtt', job_id, -1, '' FROM n
    UNION ALL SELECT DISTINCT 'tsv', job_id, -1, 'start' || chr(9) || 'end' || chr(9) || 'text' FROM n
    UNION ALL SELECT 'tsv', job_id, seq, {_SEC.format(c='start_ms')} || chr(9) || {_SEC.format(c='end_ms')} || chr(9) || text FROM n
    UNION ALL SELECT 'json', job_id, seq, CASE WHEN n > 1 THEN ',' ELSE '' END || '{{"start": ' || {_SEC.format(c='start_ms')} || ', "end": ' || {_SEC.format(c='end_ms')} || ', "text": ' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}}' FROM n
    UNION ALL SELECT DISTINCT 'json', job_id, -1, '{{"segments": [' FROM n UNION ALL SELECT 'json', job_id, max(seq) + 1, ']}}' FROM n GROUP BY job_id
    UNION ALL SELECT 'txt', job_id, seq, text FROM n WHERE text <> ''""")
def sink_plain(spark, sf):
    seg = V.segments(spark, sf)
    out = None
    for fmt in ("srt", "vtt", "tsv", "json", "txt"):
        one = R.render(seg, fmt).select(F.lit(fmt).alias("fmt"), "job_id", "line_no", "line")
        out = one if out is None else out.unionByName(one)
    return out


@query("sink_speakers", f"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n, '[' || coalesce(speaker, '?') || '] ' || text AS body FROM @captions)
    SELECT 'srt' AS fmt, job_id, n * 4 AS line_no, CAST(n AS VARCHAR) AS line FROM n
    UNION ALL SELECT 'srt', job_id, n * 4 + 1, {_t('start_ms', ',')} || ' --> ' || {_t('end_ms', ',')} FROM n
    UNION ALL SELECT 'srt', job_id, n * 4 + 2, body FROM n UNION ALL SELECT 'srt', job_id, n * 4 + 3, '' FROM n
    UNION ALL SELECT DISTINCT 'tsv', job_id, -1, 'start' || chr(9) || 'end' || chr(9) || 'speaker' || chr(9) || 'text' FROM n
    UNION ALL SELECT 'tsv', job_id, seq, {_SEC.format(c='start_ms')} || chr(9) || {_SEC.format(c='end_ms')} || chr(9) || coalesce(speaker, '?') || chr(9) || text FROM n
    UNION ALL SELECT 'vtt', job_id, seq * 4, {_t('start_ms', '.')} || ' --> ' || {_t('end_ms', '.')} FROM n
    UNION ALL SELECT 'vtt', job_id, seq * 4 + 1, body FROM n UNION ALL SELECT 'vtt', job_id, seq * 4 + 2, '' FROM n
    UNION ALL SELECT DISTINCT 'vtt', job_id, -2, 'WEBVTT' FROM n UNION ALL SELECT DISTINCT 'vtt', job_id, -1, '' FROM n
    UNION ALL SELECT 'json', job_id, seq, CASE WHEN n > 1 THEN ',' ELSE '' END || '{{"start": ' || {_SEC.format(c='start_ms')} || ', "end": ' || {_SEC.format(c='end_ms')} || ', "speaker": ' || coalesce(CAST(to_json(speaker) AS VARCHAR), 'null')
        || ', "text": ' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}}' FROM n
    UNION ALL SELECT DISTINCT 'json', job_id, -1, '{{"segments": [' FROM n UNION ALL SELECT 'json', job_id, max(seq) + 1, ']}}' FROM n GROUP BY job_id""")
def sink_speakers(spark, sf):
    cap = V.captions(spark, sf)
    one = lambda fmt: R.render(cap, fmt, speakers=True).select(F.lit(fmt).alias("fmt"), "job_id", "line_no", "line")
    return one("srt").unionByName(one("tsv")).unionByName(one("vtt")).unionByName(one("json"))


@query("sink_speakers_txt")
def sink_speakers_txt(spark, sf):
    """The paragraph form, written as text files and read back."""
    path = stage.fresh_path(spark, "rendered")
    R.write_lines(R.render(V.captions(spark, sf), "txt", speakers=True), path)
    return R.read_lines(spark, path)


@query("sink_review")
def sink_review(spark, sf):
    """Reports over the caption jobs: loops, coverage, names, terms, corrections and doubts."""
    cap = V.captions(spark, sf)
    # Written once: three sections read the loops.
    loops = stage.cut(S.loop_records(cap), "loops")
    jobs = cap.select("job_id").distinct()
    titles = jobs.select("job_id", F.when(F.col("job_id") % 2 == 0, F.concat(F.lit("Point "), F.col("job_id").cast("string"))).otherwise("").alias("title"))
    speakers = cap.where(F.col("speaker").isNotNull()).select("job_id", "speaker").distinct().withColumn(
        "name", F.concat(F.lit("Nom "), F.right("speaker", F.lit(1)))).withColumn("recognized", F.col("speaker") == "SPEAKER_00")
    terms = cap.groupBy("job_id", F.col("text").alias("term")).agg(F.min("seq").alias("pos"))
    replaced = S.boundary_segments(cap).groupBy("job_id").agg(F.count(F.lit(1)).alias("replaced"))
    e = F.col("event_id")
    subs = cap.where(e % 10 == 0).select("job_id", "start_ms", F.col("seq").alias("pos"), F.lit("Audoo").alias("original"), F.lit("Odoo").alias("replacement"), F.lit("phonetic").alias("method"), F.lit(0.95).alias("confidence"))
    fixes = cap.where(e % 7 == 0).select(
        "job_id", "seq", clock_short("start_ms").alias("timestamp"), F.substring("text", 1, 5).alias("original"), F.lit("mot").alias("replacement"),
        F.when(e % 2 == 0, "applied").when(e % 3 == 0, "not_found").otherwise("too_distant").alias("outcome"), (e % 4).alias("occurrences"), F.lit("accord").alias("reason"))
    doubts = cap.where(e % 13 == 0).select("job_id", "seq", clock_short("start_ms").alias("timestamp"), "text", F.lit("bruit de fond").alias("reason"))
    return review(titles, speakers, terms, S.loop_loss(cap, loops), loops, replaced, subs, fixes, doubts)
