"""Expression jobs: each runs an expression over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import views as V
from colloquy.functions import clock as C
from colloquy.functions import rewrite as R
from colloquy.functions import text as T
from colloquy.functions import vectors as X
from colloquy.functions.phonetic import phonetic_key
from colloquy.operators.aggregates import centroids
from colloquy.plans.q_aggregates import sql_centroids
from colloquy.plans.registry import query


@query("fn_fold", "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def fn_fold(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.fold("text").alias("folded"))


def document_words(spark, sf):
    """Distinct words of all documents."""
    return V.exploded(V.pieces(spark, sf), F.split("piece", r"[\s|.,;:!?()\"]+"), "word").where(F.col("word") != "").distinct()


@query("fn_phonetic_key")
def fn_phonetic_key(spark, sf):
    return document_words(spark, sf).select("word", phonetic_key("word").alias("key"))


@query("fn_edit_distance", """
    WITH w AS (SELECT DISTINCT regexp_replace(lower(strip_accents(unnest(string_split_regex(text, '[\\s|.,;:!?()\"]+')))), '[^a-z]', '', 'g') AS word FROM documents),
    g AS (SELECT DISTINCT regexp_replace(lower(strip_accents(term)), '[^a-z]', '', 'g') AS term FROM @glossary)
    SELECT word, term, levenshtein(word, term) AS distance, round(levenshtein(word, term) / greatest(length(word), length(term))::DOUBLE, 6) AS ratio
    FROM w JOIN g ON abs(length(word) - length(term)) <= 1 AND levenshtein(word, term) <= 1 WHERE word <> '' AND term <> ''""")
def fn_edit_distance(spark, sf):
    """Words one edit away from a glossary term, found by an equi-join on deletions."""
    from colloquy.operators.glossary import close_pairs

    letters = lambda c: F.regexp_replace(T.fold(c), "[^a-z]", "")
    # Folding goes letter by letter and leaves blanks, so the pieces between them fold to the pieces of the folded text.
    plain = F.transform(F.split(T.fold("piece"), r"[\s|.,;:!?()\"]+"), lambda w: F.regexp_replace(w, "[^a-z]", ""))
    words = V.exploded(V.pieces(spark, sf), plain, "word").where(F.col("word") != "").distinct()
    terms = V.glossary(spark, sf).select(letters("term").alias("term")).where(F.col("term") != "").distinct()
    pairs = close_pairs(words, "word", terms, "term")
    longest = F.greatest(F.length("word"), F.length("term"))
    return pairs.select("word", "term", F.col("distance").cast("long").alias("distance"), F.round(F.col("distance") / longest, 6).alias("ratio"))


@query("fn_clock_parse", """
    SELECT job_id, seq, CASE WHEN seq % 6 = 5 THEN NULL WHEN seq % 6 IN (0, 3) THEN start_ms // 1000 * 1000 WHEN seq % 6 = 1 AND start_ms < 6000000 THEN start_ms // 1000 * 1000
                             WHEN seq % 6 = 1 THEN NULL ELSE start_ms END AS ms FROM @turns""")
def fn_clock_parse(spark, sf):
    s = F.col("start_ms")
    n = F.col("seq") % 6
    text = (
        F.when(n == 0, C.clock_short("start_ms")).when(n == 1, F.format_string("%02d:%02d", F.floor(s / 60_000), F.floor(s / 1000) % 60))
        .when(n == 2, C.clock_srt("start_ms")).when(n == 3, F.floor(s / 1000).cast("string"))
        .when(n == 4, F.concat(F.lit(" "), F.floor(s / 1000).cast("string"), F.lit(","), F.format_string("%03d", s % 1000))).otherwise("vers midi"))
    return V.turns(spark, sf).select("job_id", "seq", C.clock_parse_ms(text).alias("ms"))


_HMS = "printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60)"


@query("fn_clock_format", f"""
    SELECT job_id, seq, pos, {_HMS} || printf(',%03d', start_ms % 1000) AS srt, {_HMS} || printf('.%03d', start_ms % 1000) AS vtt, {_HMS} AS short FROM @words""")
def fn_clock_format(spark, sf):
    return V.words(spark, sf).select("job_id", "seq", "pos", C.clock_srt("start_ms").alias("srt"), C.clock_vtt("start_ms").alias("vtt"), C.clock_short("start_ms").alias("short"))


@query("fn_html_text", "SELECT * FROM @page_text")
def fn_html_text(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.html_text("html").alias("text"))


def spoken_lines(spark, sf):
    """The event timeline as dictated lines: times, spellings and addresses by event."""
    hours, tails = list(R.HOURS), ["", *R.MINUTES, "30", "75"]
    pick = lambda words, key: F.element_at(F.array(*[F.lit(w) for w in words]), (key % len(words) + 1).cast("int"))
    e = F.col("event_id")
    spell = pick(["N O U V I A L E", "A-P-I", "C A S T E.fr", "s q l", "il y a"], e)
    mail = pick(["robin arobase caste point fr", "écrire à jean tiret luc@caste . fr", "le point suivant", "www point caste.fr slash aide"], e * 3)
    return V._timeline(spark, sf).select(
        "job_id", "seq",
        F.concat_ws(" ", F.concat(F.lit("["), "speaker", F.lit("] ("), C.clock_short("start_ms"), F.lit(")")), F.lit("rendez-vous à"), pick(hours, e * 7),
                    F.lit("heures"), pick(tails, e * 5), F.lit("pour"), spell, F.lit("et"), mail).alias("line"))


@query("fn_spoken_times")
def fn_spoken_times(spark, sf):
    return spoken_lines(spark, sf).select("job_id", "seq", R.spoken_times(F.col("line")).alias("line"))


@query("fn_spelling")
def fn_spelling(spark, sf):
    return spoken_lines(spark, sf).select("job_id", "seq", R.spelled_words(F.col("line")).alias("line"))


@query("fn_spoken_punct")
def fn_spoken_punct(spark, sf):
    return spoken_lines(spark, sf).select("job_id", "seq", R.spoken_punctuation(F.col("line")).alias("line"))


@query("fn_glossary_case", r"""
    WITH t AS (SELECT lower(term) AS k, arg_max(term, term) AS term FROM (SELECT upper(term) AS term FROM @glossary) GROUP BY 1),
    p AS (SELECT job_id, seq, unnest(regexp_extract_all(line, '(\[[^\]\n]*\]|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\[]+|\[)', 1)) AS w, generate_subscripts(regexp_extract_all(line, '(\[[^\]\n]*\]|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\[]+|\[)', 1), 1) AS i FROM @transcript_lines)
    SELECT job_id, seq, string_agg(coalesce(t.term, p.w), '' ORDER BY i) AS line FROM p LEFT JOIN t ON t.k = lower(p.w) GROUP BY 1, 2""")
def fn_glossary_case(spark, sf):
    terms = V.glossary(spark, sf).select(F.upper("term").alias("term"), F.col("term").alias("pos"))
    return R.canonical_case(V.transcript_lines(spark, sf), terms, ["job_id", "seq"], "line")


@query("fn_replace_term", r"""
    SELECT doc_id, regexp_replace(text, '\b(?i:the)\b', 'Le', 'g') AS text, len(regexp_extract_all(text, '\b(?i:the)\b')) AS replaced FROM documents""")
def fn_replace_term(spark, sf):
    text, n = R.replace_term(F.col("text"), "the", "Le")
    return V.table(spark, sf, "documents").select("doc_id", text.alias("text"), n.alias("replaced"))


@query("fn_relabel_text", """
    SELECT job_id, seq, CASE WHEN speaker = 'SPEAKER_01' THEN replace(line, '[SPEAKER_01]', '[Marie $ C.]') ELSE line END AS line,
           CASE WHEN speaker = 'SPEAKER_01' THEN 1 ELSE 0 END AS changed FROM @transcript_lines JOIN @segments USING (job_id, seq)""")
def fn_relabel_text(spark, sf):
    text, n = R.relabel(F.col("line"), F.lit("SPEAKER_01"), F.lit("Marie $ C."))
    return V.transcript_lines(spark, sf).select("job_id", "seq", text.alias("line"), n.alias("changed"))


_PHRASES = r"""
    SELECT doc_id, source, pos, trim(regexp_replace(p, '\s+', ' ', 'g')) AS title
    FROM (SELECT doc_id, source, unnest(string_split_regex(text, '[.!?\n|,]')) AS p, generate_subscripts(string_split_regex(text, '[.!?\n|,]'), 1) - 1 AS pos FROM documents)"""


def phrases(spark, sf):
    """Every phrase of every document."""
    rows = V.table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", r"[.!?\n|,]")).alias("pos", "p"))
    return rows.select("doc_id", "source", F.col("pos").cast("long").alias("pos"), F.trim(F.regexp_replace("p", r"\s+", " ")).alias("title"))


@query("fn_title_useful", rf"""
    WITH t AS ({_PHRASES}),
    c0 AS (SELECT doc_id, pos, title, trim(regexp_replace(regexp_replace(title, '[<>:"/\\|?*]', ' ', 'g'), '\s+', ' ', 'g'), ' .-_') AS s FROM t),
    c AS (SELECT doc_id, pos, title, CASE WHEN length(s) > 80 THEN trim(regexp_replace(left(s, 80), ' [^ ]*$', ''), ' .-_') ELSE s END AS s FROM c0)
    SELECT doc_id, pos, title FROM c WHERE len(string_split(s, ' ')) BETWEEN 3 AND 12 AND length(s) BETWEEN 12 AND 80
      AND NOT regexp_matches(lower(s), '^(j[''’ ]|(je|tu|vous|nous|on|il faut|c''est|c’est|voilà|alors|du coup|là)([^\p{{L}}\p{{N}}_]|$))')
      AND NOT regexp_matches(lower(s), '(^|[^\p{{L}}\p{{N}}_])(j[''’]ai|je suis|je vais|j''aimerais|j’aimerais|on va|nous allons)([^\p{{L}}\p{{N}}_]|$)')""")
def fn_title_useful(spark, sf):
    return phrases(spark, sf).where(R.is_useful_title("title")).select("doc_id", "pos", "title")


@query("fn_title_prefix", rf"""
    WITH t AS ({_PHRASES})
    SELECT doc_id, pos, CASE WHEN doc_id % 4 = 0 AND NOT regexp_matches(title, '[\p{{L}}\p{{N}}]') THEN source || ' - Ównco — ' || title
                        WHEN doc_id % 4 = 1 THEN upper(source) || ' - ' || title
                        WHEN doc_id % 4 = 2 THEN 'Autre - ' || title ELSE source || ' - ' || title END AS title
    FROM t WHERE title <> ''""")
def fn_title_prefix(spark, sf):
    n = F.col("doc_id") % 4
    given = F.when(n == 0, F.concat(F.lit("Ównco — "), "title")).when(n == 1, F.concat(F.upper("source"), F.lit(" - "), "title")).when(
        n == 2, F.concat(F.lit("Autre - "), "title")).otherwise(F.col("title"))
    rows = phrases(spark, sf).where(F.col("title") != "")
    return rows.select("doc_id", "pos", R.prefixed_title(given, F.col("source"), ["ownco"]).alias("title"))


@query("fn_json_columns", """
    SELECT id, CASE WHEN status = 'FAILED' THEN 0 ELSE 2 END AS names, CASE WHEN status = 'FAILED' THEN '' ELSE 'SPEAKER_00=' || mode END AS first_name,
           CASE WHEN status = 'FAILED' THEN '' WHEN owner_id % 3 = 0 THEN 'erp' ELSE 'erp,t' || (owner_id % 3) END AS terms,
           CASE WHEN status = 'FAILED' THEN '{}' ELSE '{"SPEAKER_00":"' || mode || '","SPEAKER_01":""}' END AS stored FROM @jobs""")
def fn_json_columns(spark, sf):
    bad = F.col("status") == "FAILED"
    jobs = V.jobs(spark, sf).select(
        "id",
        F.when(bad, "{oops").otherwise(F.to_json(F.create_map(F.lit("SPEAKER_00"), F.col("mode"), F.lit("SPEAKER_01"), F.lit("")))).alias("m"),
        F.when(bad, "[1,").otherwise(F.to_json(F.array(F.lit("erp"), F.when(F.col("owner_id") % 3 == 0, "erp").otherwise(F.concat(F.lit("t"), (F.col("owner_id") % 3).cast("string")))))).alias("t"))
    names = F.coalesce(F.from_json("m", "map<string,string>"), F.create_map().cast("map<string,string>"))
    terms = F.array_distinct(F.coalesce(F.from_json("t", "array<string>"), F.array().cast("array<string>")))
    first = F.array_join(
        F.transform(F.filter(F.array_sort(F.map_entries(names)), lambda e: e["value"] != ""), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return jobs.select("id", F.size(names).cast("long").alias("names"), first.alias("first_name"), F.array_join(terms, ",").alias("terms"), F.to_json(names).alias("stored"))


@query("fn_meeting_time", """
    SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 1 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')
                          WHEN event_id % 5 = 3 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS utc FROM events""")
def fn_meeting_time(spark, sf):
    n = F.col("event_id") % 5
    text = (
        F.when(n == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(n == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(n == 3, F.date_format("ts", "yyyy-MM-dd")).otherwise("demain"))
    return V.table(spark, sf, "events").select("event_id", R.utc_text(R.meeting_instant(text)).alias("utc"))


@query("fn_cosine", f"""
    WITH {sql_centroids('c', '@profile_vectors', 'name')},
    v AS (SELECT vec_id, 'label_' || label AS name, unnest(embedding) AS y, generate_subscripts(embedding, 1) - 1 AS pos FROM @vectors)
    SELECT vec_id, v.name, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM v JOIN c ON c.name = v.name AND c.pos = v.pos GROUP BY 1, 2""")
def fn_cosine(spark, sf):
    own = centroids(V.profile_vectors(spark, sf), ["name"]).select("name", F.col("embedding").alias("c"))
    rows = V.vectors(spark, sf).select("vec_id", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("name"), "embedding")
    return rows.join(own, "name").select("vec_id", "name", F.round(X.cosine("embedding", "c"), 6).alias("cosine"))


@query("fn_embedding_codec", """
    SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 0 ELSE len(embedding) END AS dim, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE round(list_sum(embedding), 6) END AS total FROM @vectors""")
def fn_embedding_codec(spark, sf):
    text = F.when(F.col("vec_id") % 9 == 0, '[0.5, "x"').otherwise(F.to_json("embedding"))
    rows = V.vectors(spark, sf).select("vec_id", X.decode_embedding(text).alias("e"))
    total = F.when(F.size("e") > 0, F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    return rows.select("vec_id", F.size("e").cast("long").alias("dim"), F.round(total, 6).alias("total"))
