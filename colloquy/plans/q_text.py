"""Text mining, correction and ranking over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import stage
from colloquy import views as V
from colloquy.functions.cost import FALLBACKS, catalogue
from colloquy.operators import corrections as K
from colloquy.operators import glossary as G
from colloquy.operators import joins as J
from colloquy.operators import mining as N
from colloquy.operators import ranking as R
from colloquy.plans.q_functions import document_words
from colloquy.plans.q_joins import crm
from colloquy.plans.registry import query


def glossary_entries(spark, sf):
    """The glossary as entries, with two-word ones from neighbouring terms."""
    g = stage.cut(V.glossary(spark, sf), "terms")  # both kinds read it: the documents are read once
    two = g.groupBy(F.substring("term", 1, 3).alias("p")).agg(F.min("term").alias("a"), F.max("term").alias("b")).where(F.col("a") != F.col("b"))
    return g.select("term", F.col("term").alias("pos")).unionByName(two.select(F.concat_ws(" ", "a", "b").alias("term"), F.concat_ws(" ", "a", "b").alias("pos"))).select(
        "term", F.crc32("pos").alias("pos"))


_TERM_STRIP = "trim(trim(trim(trim(p), '\"'), ''''), '.')"


@query("txt_parse_glossary", r"""
    WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS t, generate_subscripts(string_split_regex(text, '\r?\n'), 1) - 1 AS line FROM documents),
    c AS (SELECT doc_id, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^[-*•·]+', ''), '^\s+', ''), '\s+$', '') AS t FROM l),
    i AS (SELECT *, regexp_matches(lower(t), '^(vocabulaire|noms?\s*propres?|termes?|priorité|priority|expected|attendu)') AS told FROM c WHERE t <> ''),
    r AS (SELECT doc_id, line, CASE WHEN told THEN regexp_replace(regexp_replace(t, '^[^:]*:', ''), '^\s+', '') ELSE t END AS t FROM i WHERE NOT told OR contains(t, ':')),
    p AS (SELECT doc_id, line, unnest(string_split_regex(t, '[,\n;·•|/]+')) AS p, generate_subscripts(string_split_regex(t, '[,\n;·•|/]+'), 1) - 1 AS pos FROM r),
    s AS (SELECT doc_id, line, pos, trim(trim(trim(regexp_replace(p, '^\s+|\s+$', '', 'g'), '"'), ''''), '.') AS term FROM p)
    SELECT doc_id, CAST(arg_min(line, line * 1000000 + pos) AS BIGINT) AS line, CAST(arg_min(pos, line * 1000000 + pos) AS BIGINT) AS pos, arg_min(term, line * 1000000 + pos) AS term
    FROM s WHERE length(term) >= 2 GROUP BY doc_id, lower(term)""")
def txt_parse_glossary(spark, sf):
    return G.parse_terms(V.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])


@query("txt_glossary_match")
def txt_glossary_match(spark, sf):
    return G.match_words(document_words(spark, sf), G.entries(glossary_entries(spark, sf)))


def _glossary_texts(spark, sf):
    return V.segments(spark, sf).select("job_id", "seq", "text")


def _flat_subs(df, ids):
    subs = F.array_join(F.transform("subs", lambda s: F.concat_ws("|", s["original"], s["replacement"], s["confidence"].cast("string"), s["method"], s["context_before"], s["context_after"])), "\n")
    return df.select(*ids, "text", F.size("subs").cast("long").alias("changes"), subs.alias("audit"))


@query("txt_glossary_apply")
def txt_glossary_apply(spark, sf):
    return _flat_subs(G.apply_glossary(_glossary_texts(spark, sf), ["job_id", "seq"], glossary_entries(spark, sf)), ["job_id", "seq"])


@query("txt_glossary_window")
def txt_glossary_window(spark, sf):
    return _flat_subs(G.apply_glossary(_glossary_texts(spark, sf), ["job_id", "seq"], glossary_entries(spark, sf), windows=True), ["job_id", "seq"])


@query("txt_proper_nouns")
def txt_proper_nouns(spark, sf):
    """Documents of a source and language as one job, each document a segment; known are the names of parts, partners and nations."""
    docs = V.table(spark, sf, "documents").select((F.xxhash64("source", "lang")).alias("job_id"), F.col("doc_id").alias("seq"), "text")
    names = [V.table(spark, sf, t).select(F.col(c).alias("term")) for t, c in (("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"), ("nation", "n_name"))]
    known = names[0].unionByName(names[1]).unionByName(names[2]).unionByName(names[3])
    whole = known.where(F.trim("term") != "")
    words = whole.select(F.explode(F.split("term", r"[\s_#]+")).alias("term"))
    return N.proper_nouns(docs, whole.unionByName(words).where(F.length("term") >= N.MIN_CHARS).distinct())


@query("txt_entities")
def txt_entities(spark, sf):
    return N.entities(V.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])


@query("txt_crm_terms")
def txt_crm_terms(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        "doc_id", F.lit(0).alias("seq"), F.concat(F.lit("Dossier "), "source").alias("display_name"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("Société "), F.upper("source"))).alias("partner_name"), F.col("text").alias("body"))
    return N.crm_terms(docs, ["doc_id"])


@query("txt_pack_summary")
def txt_pack_summary(spark, sf):
    """Each lead with its quotes and the messages on them, in 600 characters."""
    roots, quotes, projects, chatter = crm(spark, sf)
    related = J.context_pack(roots.where(F.col("root_kind") == "lead"), quotes, projects, chatter)
    related = related.select(
        F.col("root_id").alias("id"), "rank", F.lit("Devis").alias("label"), "name", F.lit("").alias("body"),
        F.split(F.coalesce("chatter", F.lit("")), " \\| ").alias("messages"))
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    primary = roots.where(F.col("root_kind") == "lead").select(F.col("root_id").alias("id")).join(docs, "id", "left").select(
        "id", F.lit("Opportunité").alias("label"), F.concat(F.lit("Lead "), F.col("id").cast("string")).alias("name"),
        F.coalesce("body", F.lit("")).alias("body"), F.array().cast("array<string>").alias("messages"))
    return N.pack_summary(primary, related, 600)


@query("txt_chatter_summary")
def txt_chatter_summary(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    msgs = V.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), F.row_number().over(w).alias("rank"), F.format_string("2024-01-%02d", F.col("turn") + 1).alias("date"),
        F.when(F.col("role") != "system", F.col("role")).alias("author"), F.col("text").alias("body"))
    names = V.jobs(spark, sf).select("id", F.col("source_path").alias("name"))
    return N.chatter_summary(msgs, names)


def proposals(spark, sf):
    """Six corrections per document with words, spread over its whole text, each made to meet another check."""
    docs = V.table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(\p{L}{4,})"), F.lit(1)).alias("w"))
    at = lambda i: F.get("w", F.floor(F.size("w") * i / 6).cast("int"))
    row = lambda seq, ts, o, r, c: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(ts).alias("timestamp"), o.alias("original"), r.alias("replacement"), F.lit(c).alias("confidence"))
    items = F.array(
        row(1, "0:02", at(0), F.concat(at(0), F.lit("s")), 0.9),
        row(2, "0:01", at(1), F.concat(at(1), F.lit("x")), 0.5),
        row(3, "", at(2), F.upper(at(2)), 0.9),
        row(4, "0:10", F.concat(at(3), F.lit("qqq")), at(3), 0.95),
        row(5, "0:05", at(4), F.concat(at(4), F.lit(" et tout à fait autre chose")), 0.8),
        row(6, "0:04", at(5), F.lit(" "), 0.8))
    # Words are taken once: a test of their number, or an inner generator, would take them once more. Without words there is no original.
    return docs.select(F.col("doc_id").alias("id"), F.inline_outer(items)).where(F.col("original").isNotNull())


@query("txt_apply_corrections")
def txt_apply_corrections(spark, sf):
    texts = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    out = K.apply_corrections(texts, proposals(spark, sf), glossary_entries(spark, sf))
    log = F.array_join(F.transform(F.array_sort("log"), lambda c: F.concat_ws(":", c["seq"].cast("string"), c["outcome"], c["occurrences"].cast("string"))), ",")
    return out.select("id", "text", log.alias("outcomes"))


_WORDS = r"list_filter(string_split_regex(text, '[^\p{L}]+'), lambda t: length(t) >= 4)"
_PROPOSALS = rf"""
    d0 AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
    d AS (SELECT id, list_transform([0, 1, 2, 3, 4, 5], lambda k: w[len(w) * k // 6 + 1]) AS w FROM d0 WHERE len(w) > 0),
    pr AS (SELECT id, 1 AS seq, w[1] AS o, w[1] || 's' AS r, 0.9 AS c FROM d UNION ALL SELECT id, 2, w[2], w[2] || 'x', 0.5 FROM d
           UNION ALL SELECT id, 3, w[3], replace(replace(upper(w[3]), 'ß', 'SS'), 'ẞ', 'SS'), 0.9 FROM d UNION ALL SELECT id, 4, w[4] || 'qqq', w[4], 0.95 FROM d
           UNION ALL SELECT id, 5, w[5], w[5] || ' et tout à fait autre chose', 0.8 FROM d UNION ALL SELECT id, 6, w[6], ' ', 0.8 FROM d)"""


@query("txt_correction_checks", f"""
    WITH {_PROPOSALS}
    SELECT id, seq, CASE WHEN trim(o) = '' OR trim(r) = '' THEN 'empty' WHEN c < 0.7 THEN 'low_confidence'
                         WHEN lower(strip_accents(o)) = lower(strip_accents(r)) THEN 'noop_after_normalization' END AS rejected
    FROM pr""")
def txt_correction_checks(spark, sf):
    """The checks of txt_apply_corrections that need no text."""
    return proposals(spark, sf).select("id", "seq", K.early_rejection().alias("rejected"))


@query("txt_apply_literal")
def txt_apply_literal(spark, sf):
    return K.apply_literal(V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), proposals(spark, sf))


@query("txt_betrays_glossary")
def txt_betrays_glossary(spark, sf):
    rows = proposals(spark, sf).select(F.struct("id", "seq").alias("id"), "original", "replacement")
    out = K.betrayed(rows, glossary_entries(spark, sf))
    return out.select(F.col("id.id").alias("doc_id"), F.col("id.seq").alias("seq"), "term")


@query("txt_title_suggest")
def txt_title_suggest(spark, sf):
    return N.suggest_titles(V.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])


@query("txt_title_choose", """
    SELECT id, CASE WHEN status = 'RUNNING' THEN NULL WHEN mode = '1-URGENT' THEN 'Point projet ' || owner_id || ' et budget'
                    WHEN mode IN ('2-HIGH', '3-MEDIUM') THEN 'Atelier paie ' || id ELSE NULL END AS title FROM @jobs""")
def txt_title_choose(spark, sf):
    mode = F.col("mode")
    k = lambda c: F.col(c).cast("string")
    rows = V.jobs(spark, sf).select(
        "id", F.when(F.col("status") == "RUNNING", "À la main").otherwise(" ").alias("custom_title"), F.concat(F.lit("Enregistrement "), k("id")).alias("source_stem"),
        F.when(mode == "1-URGENT", F.concat(F.lit("Point projet "), k("owner_id"), F.lit(" et budget"))).when(mode == "2-HIGH", "Je vais vous parler de tout")
        .when(mode == "5-LOW", F.concat(F.lit("Enregistrement "), k("id"))).otherwise("").alias("llm_title"),
        F.when(mode.isin("2-HIGH", "3-MEDIUM"), F.concat(F.lit("Atelier paie "), k("id"))).alias("suggestion"))
    return N.choose_titles(rows)


def eval_cases(spark, sf):
    """A case per recording: its rendered lines, and criteria from its own words."""
    lines = V.transcript_lines(spark, sf).join(V.segments(spark, sf).select("job_id", "seq", F.split("text", r"[^\p{L}]+").alias("w"), "speaker"), ["job_id", "seq"])
    rows = lines.select("job_id", "seq", "line", F.get("w", F.lit(0)).alias("first"), F.coalesce("speaker", F.lit("?")).alias("speaker"))
    return rows.groupBy(F.col("job_id").cast("string").alias("name")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]), "\n").alias("transcript"),
        F.array_sort(F.collect_set("first")).alias("expected_terms"),
        F.array_sort(F.collect_set(F.when(F.col("speaker") != "?", F.concat("speaker", F.when(F.col("seq") == 3, "x").otherwise(""))))).alias("expected_speakers"),
        F.array(F.lit("SPEAKER_01] ("), F.lit("zzz")).alias("forbidden_substrings"))


_EVAL = r"""
    l AS (SELECT t.job_id, t.seq, line,
                 string_split_regex(s.text, '[^\p{L}]+')[1] AS first, coalesce(s.speaker, '?') AS speaker
          FROM @transcript_lines t JOIN @segments s USING (job_id, seq)),
    tr AS (SELECT job_id, lower(string_agg(line, chr(10) ORDER BY seq)) AS transcript FROM l GROUP BY 1),
    te AS (SELECT DISTINCT job_id, first FROM l),
    sp AS (SELECT DISTINCT job_id, speaker || CASE WHEN seq = 3 THEN 'x' ELSE '' END AS s FROM l WHERE speaker <> '?'),
    mt AS (SELECT job_id, count(*) AS n, count(*) FILTER (NOT regexp_matches(' ' || transcript || ' ', '[^\p{L}\p{N}_]' || lower(first) || '[^\p{L}\p{N}_]')) AS bad FROM te JOIN tr USING (job_id) GROUP BY 1),
    ms AS (SELECT job_id, count(*) AS n, count(*) FILTER (NOT contains(transcript, '[' || lower(s) || ']')) AS bad FROM sp JOIN tr USING (job_id) GROUP BY 1),
    fr AS (SELECT job_id, count(*) FILTER (NOT starts_with(line, '[?]') AND len(string_split(trim(regexp_replace(line, '^\[[^\]]+\] \([^)]*\)', '')), ' ')) BETWEEN 1 AND 4
                  AND trim(regexp_replace(line, '^\[[^\]]+\] \([^)]*\)', '')) <> '') AS fragments, count(*) FILTER (starts_with(line, '[?]')) AS orphans FROM l GROUP BY 1),
    e AS (SELECT CAST(job_id AS VARCHAR) AS name, coalesce(mt.bad, 0) AS missing_terms, CASE WHEN contains(transcript, 'speaker_01] (') THEN 1 ELSE 0 END AS forbidden_hits,
                 coalesce(ms.bad, 0) AS missing_speakers, fragments, orphans, greatest(0, fragments - 5) + orphans AS pen, coalesce(mt.n, 0) + 2 + coalesce(ms.n, 0) AS n
          FROM tr LEFT JOIN mt USING (job_id) LEFT JOIN ms USING (job_id) JOIN fr USING (job_id))"""


@query("txt_eval", f"""
    WITH {_EVAL}
    SELECT name, missing_terms, forbidden_hits, missing_speakers, fragments, orphans,
           round(greatest(0.0, 1.0::DOUBLE - (missing_terms + forbidden_hits + missing_speakers + pen) / greatest(1, n + pen)::DOUBLE), 6) AS score FROM e""")
def txt_eval(spark, sf):
    out = N.evaluate(eval_cases(spark, sf))
    return out.select("name", *[F.size(c).cast("long").alias(c) for c in ("missing_terms", "forbidden_hits", "missing_speakers")], "fragments", "orphans", F.round("score", 6).alias("score"))


@query("txt_eval_gate", f"""
    WITH {_EVAL}
    SELECT round(avg(greatest(0.0, 1.0::DOUBLE - (missing_terms + forbidden_hits + missing_speakers + pen) / greatest(1, n + pen)::DOUBLE)), 6) AS score,
           avg(greatest(0.0, 1.0::DOUBLE - (missing_terms + forbidden_hits + missing_speakers + pen) / greatest(1, n + pen)::DOUBLE)) >= 0.95 AS passed, count(*) AS cases FROM e""")
def txt_eval_gate(spark, sf):
    return N.gate(N.evaluate(eval_cases(spark, sf))).withColumn("score", F.round("score", 6))


# ------------------------------------------------- limits, dedup, set operations

@query("sort_merge_streams", """
    SELECT job_id, seq, start_ms, end_ms, speaker FROM @captions WHERE speaker IS NOT NULL""")
def sort_merge_streams(spark, sf):
    cap = V.captions(spark, sf).select("job_id", "seq", "start_ms", "end_ms", "speaker")
    return R.sort_streams([cap.where(F.col("speaker") == s) for s in ("SPEAKER_01", "SPEAKER_00")])


@query("dedup_corrections", """
    WITH c AS (SELECT l_orderkey AS job_id, l_linenumber * 100000 + l_partkey AS seq, l_returnflag AS timestamp, upper(p_name) AS original, l_linestatus AS replacement
               FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT job_id, seq, timestamp, original, replacement FROM (SELECT *, row_number() OVER (PARTITION BY job_id, timestamp, original, replacement ORDER BY seq) AS rn FROM c) WHERE rn = 1""")
def dedup_corrections(spark, sf):
    part = V.table(spark, sf, "part").select("p_partkey", "p_name")
    rows = V.table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("seq"),
        F.col("l_returnflag").alias("timestamp"), F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "  ")).alias("original"), F.col("l_linestatus").alias("replacement"))
    out = R.dedup_corrections(rows)
    return out.select("job_id", "seq", "timestamp", F.upper(R.squeeze("original")).alias("original"), "replacement")


@query("dedup_bias_terms", """
    WITH b AS (SELECT l_partkey AS job_id, 0 AS src, l_orderkey AS pos, 'order ' || (l_orderkey % 17) AS term FROM lineitem
               UNION ALL SELECT l_partkey, 1, l_suppkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    f AS (SELECT job_id, min(src * 1000000000000 + pos) AS k, term FROM b GROUP BY job_id, term),
    r AS (SELECT job_id, term, row_number() OVER (PARTITION BY job_id ORDER BY k, term) AS rank FROM f)
    SELECT job_id, rank, lower(term) AS term FROM r WHERE rank <= 20""")
def dedup_bias_terms(spark, sf):
    items = V.table(spark, sf, "lineitem")
    words = items.select(F.col("l_partkey").alias("job_id"), F.col("l_orderkey").alias("pos"), F.concat(F.lit(" order "), (F.col("l_orderkey") % 17).cast("string")).alias("term"))
    sup = V.table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("term"))
    names = items.join(sup, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_partkey").alias("job_id"), F.col("l_suppkey").alias("pos"), "term")
    return R.bias_terms(words, names, 20).select("job_id", "rank", F.lower("term").alias("term"))


@query("dedup_doubts", """
    SELECT event_id, event_type AS text FROM events
    WHERE NOT (event_id % 6 = 0) AND NOT (event_id % 6 = 1) AND NOT (event_id % 6 = 2 AND event_type IN ('click', 'view'))""")
def dedup_doubts(spark, sf):
    n = F.col("event_id") % 6
    reason = (
        F.when(n == 0, " court ").when(n == 1, 'mot qui pourrait être "Zindoc" ou "zindoc"')
        .when(n == 2, F.concat(F.lit('"mot" qui pourrait être "'), F.substring("event_type", 1, 3), F.lit('" ou "'), F.when(F.col("event_type").isin("click", "view"), F.substring("event_type", 2, 3)).otherwise("autre"), F.lit('"')))
        .when(n == 3, "son inaudible à cet endroit").otherwise("mot qui pourrait être nom ou lieu"))
    rows = V.table(spark, sf, "events").select("event_id", F.col("event_type").alias("text"), reason.alias("reason"))
    return R.useful_doubts(rows).select("event_id", "text")


_USED = "(SELECT p_name AS term, count(DISTINCT l_orderkey) AS runs FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


@query("rank_vocabulary", f"""
    SELECT term, coalesce(runs, 0) AS runs FROM (SELECT term FROM @glossary UNION SELECT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) v LEFT JOIN {_USED} u USING (term)""")
def rank_vocabulary(spark, sf):
    return R.vocabulary(V.glossary(spark, sf), V.runs_terms(spark, sf))


@query("rank_suggestions", f"""
    WITH r AS (SELECT DISTINCT run, term FROM @runs_terms),
    s AS (SELECT b.term, count(*) AS score FROM r a JOIN r b ON a.run = b.run AND a.term IN ('red ring', 'cold rod') AND b.term NOT IN ('red ring', 'cold rod') GROUP BY 1),
    v AS (SELECT term FROM @glossary UNION SELECT term FROM r)
    SELECT v.term, coalesce(u.runs, 0) AS runs, coalesce(s.score, 0) AS score FROM v LEFT JOIN {_USED} u USING (term) LEFT JOIN s USING (term)
    WHERE v.term NOT IN ('red ring', 'cold rod') AND contains(lower(v.term), 'r')""")
def rank_suggestions(spark, sf):
    return R.suggestions(V.glossary(spark, sf), V.runs_terms(spark, sf), ["Red ring", "cold rod"], " R ")


@query("set_union", "SELECT term FROM @glossary UNION SELECT term FROM @runs_terms")
def set_union(spark, sf):
    return R.set_union(V.glossary(spark, sf), V.runs_terms(spark, sf))


_TOPICS = ", ".join(f"('{w}')" for w in N.TOPIC_WORDS)


@query("set_intersect", f"""
    WITH t AS (SELECT event_id, event_type || ' Client, ' || CASE WHEN value > 20 THEN 'projet (PAIE)' ELSE 'budgetaire' END AS title FROM events),
    w AS (SELECT DISTINCT event_id, trim(lower(unnest(string_split(title, ' '))), ' ,.;:!?()[]') AS w FROM t)
    SELECT event_id, w AS topic FROM w JOIN (SELECT * FROM (VALUES {_TOPICS}) v(t)) ON w = t""")
def set_intersect(spark, sf):
    title = F.concat("event_type", F.lit(" Client, "), F.when(F.col("value") > 20, "projet (PAIE)").otherwise("budgetaire"))
    return V.table(spark, sf, "events").select("event_id", F.explode(N.topic_words(title)).alias("topic"))


@query("set_except", """
    SELECT DISTINCT lower(strip_accents(name)) AS term FROM (SELECT c_name AS name FROM customer UNION ALL SELECT upper(s_name) FROM supplier)
    EXCEPT SELECT lower(strip_accents(c_name)) FROM customer WHERE c_acctbal > 1000""")
def set_except(spark, sf):
    cust, sup = V.table(spark, sf, "customer"), V.table(spark, sf, "supplier")
    found = cust.select(J.fold("c_name").alias("term")).union(sup.select(J.fold(F.upper("s_name"))))
    return found.distinct().subtract(cust.where(F.col("c_acctbal") > 1000).select(J.fold("c_name")))


@query("topk_fallback_models", """
    SELECT DISTINCT u.model, 'gemini-2.5-flash' AS fallback, 1 AS rank FROM @api_usage u JOIN @prices p ON p.model = u.model
    WHERE p.family = 'Gemini' AND u.model <> 'gemini-2.5-flash'""")
def topk_fallback_models(spark, sf):
    values = ", ".join(f"('{f}', '{m}', {r})" for f, m, r in FALLBACKS)
    fallbacks = spark.sql(f"SELECT * FROM VALUES {values} AS t(family, fallback, rank)")
    return R.fallback_models(V.api_usage(spark, sf).select("model").distinct(), catalogue(spark), fallbacks)


@query("fold_text_chunks", """
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
    w AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS opened, CAST(-1 AS BIGINT) AS stop FROM d
          UNION ALL SELECT doc_id, i + (stop >= 0)::INT, CASE WHEN stop >= 0 THEN after ELSE opened END, cut FROM (
              SELECT *, CASE WHEN opening > 0 AND back + opening - 1 < stop THEN back + opening ELSE back END AS after FROM (
                  SELECT w.*, d.n, d.text, greatest(stop - 300, opened + 1) AS back, strpos(substr(d.text, greatest(stop - 300, opened + 1) + 1), chr(10)) AS opening FROM w JOIN d USING (doc_id) WHERE stop < d.n)) o,
              LATERAL (SELECT CASE WHEN stop >= 0 THEN after ELSE opened END AS here) h,
              LATERAL (SELECT strpos(reverse(substr(text, here + 1, 4000)), chr(10)) AS r) q,
              LATERAL (SELECT CASE WHEN here + 4000 >= n THEN n WHEN r > 0 AND here + 4000 - r > here + 2000 THEN here + 4000 - r ELSE here + 4000 END AS cut) z)
    SELECT doc_id, i AS "index", count(*) OVER (PARTITION BY doc_id) AS total, substr(text, opened + 1, stop - opened) AS text FROM w JOIN d USING (doc_id) WHERE stop >= 0""")
def fold_text_chunks(spark, sf):
    """Windows of 4 000 characters, as few documents reach the default of 22 000."""
    from colloquy.operators.chunks import text_chunks

    return text_chunks(V.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], 4_000, 300)
