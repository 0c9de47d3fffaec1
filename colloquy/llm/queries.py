"""The queries of this subpackage over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.llm import bpe, chat_format, chunk_dedup, divergence, importance, langid, license_scan, minhash, sharding, simhash, url_rules, vector_forest, winnow
from colloquy.llm.ordering import with_next
from colloquy.llm.registry import query, table

VOCABULARY = "word_bpe_49k.json"


def hex64(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


@query("op1_minhash_fingerprints")
def op1_minhash_fingerprints(spark, sf):
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text"))
    ids = docs.select("doc_id", "h", F.char_length("text").alias("n")).distinct()
    links = with_next(ids, ["doc_id", "h"]).select("doc_id", "h", "n", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))
    marked = docs.withColumn("fp", minhash.fingerprint(F.col("text"), by_bin=True))
    # both joins take the marked texts as they are, so that they are shuffled once
    after = links.alias("l").join(marked.alias("f"), F.col("l.next_id").eqNullSafe(F.col("f.doc_id")) & (F.col("l.next_h") == F.col("f.h")))
    third = F.floor(F.col("l.n") / 3).cast("int")
    tails = after.select(F.col("l.doc_id").alias("t_id"), F.col("l.h").alias("t_h"), F.col("l.n").alias("n"), F.left("f.text", third).alias("tail"), F.col("f.fp").alias("next_fp"))
    both = marked.join(tails, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")))
    both = both.select("doc_id", "text", "n", "fp", "next_fp", F.concat(F.left("text", (F.col("n") - F.floor(F.col("n") / 3)).cast("int")), "tail").alias("edited"))
    told = both.withColumn("edited_fp", minhash.fingerprint(F.col("edited"), by_bin=True))
    return told.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        minhash.hex_digits(F.col("fp")).alias("fingerprint"),
        minhash.hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        minhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        minhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


@query("op2_chat_turns")
def op2_chat_turns(spark, sf):
    said = table(spark, sf, "conversations")
    model = chat_format.fit(said.select(F.col("conv_id").alias("conv"), "turn", "role", "text"))
    told = chat_format.format_chats(chat_format.transcript_lines(said), model)
    return told.select(F.col("conv").alias("conv_id"), "turn", "role", "text", "rendered")


@query("op3_chunk_dedup")
def op3_chunk_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunk_dedup.without_repeats(docs, spans="removed")


@query("op4_bpe_codec")
def op4_bpe_codec(spark, sf):
    coded = bpe.coded(table(spark, sf, "documents").select("doc_id", "text"), VOCABULARY, decoded="decoded", drop_text=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _joined_labels(labels):
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


@query("op5_license_notices")
def op5_license_notices(spark, sf):
    found = license_scan.with_licenses(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "licenses.*")
    base, more = F.transform("phrases", lambda p: p["label"]), F.transform("notices", lambda n: n["label"])
    places = F.transform("phrases", lambda p: p["word"])
    nearest = F.coalesce(F.array_max(F.transform("notices", lambda n: n["likeness"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        _joined_labels(base).alias("base_labels"),
        _joined_labels(F.concat(base, more)).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(nearest).alias("score"),
    )


BASE_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
PATTERNS = [
    url_rules.Pattern("adult", r"^[^:]*://[^/?#]*\badult-[a-z0-9]", ("adult",)),
    url_rules.Pattern("casino", r"^[^:]*://[^/?#]*\bcasino-win\b", ("casino", "win")),
    url_rules.Pattern("bets", r"^[^:]*://[^/?#]*\bfree-bets\b", ("free", "bets")),
    url_rules.Pattern("ads", r"^[^:]*://[^/?#]*\bads-track\b", ("ads", "track")),
    url_rules.Pattern("spam", r"^[^:]*://[^/?#]*\bspam-farm\b", ("spam", "farm")),
    url_rules.Pattern("pills", r"^[^:]*://[^/?#]*\bcheap-pills\b", ("cheap", "pills")),
    url_rules.Pattern("blog-feed", r"^[^:]*://blog\.[^?#]*\?utm_source=feed", ("blog", "utm", "source")),
]
_HOST_SQL = r"translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH_SQL = r"coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"


def _url_sql() -> str:
    fits = lambda rule: f"((host = '{rule[: rule.index('/')]}' OR ends_with(host, '.{rule[: rule.index('/')]}')) AND starts_with(path, '{rule[rule.index('/'):]}'))"
    longest = sorted(BASE_RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in longest)
    hit = lambda p: f"CASE WHEN regexp_matches(lower(url), '{p.regex}') THEN '{p.name}' END"
    names = ", ".join(hit(p) for p in sorted(PATTERNS, key=lambda p: p.name))
    return f"""
WITH parted AS (SELECT page_id, url, {_HOST_SQL} AS host, {_PATH_SQL} AS path FROM pages),
ruled AS (SELECT *, CASE {rule} END AS rule, concat_ws(',', {names}) AS patterns FROM parted)
SELECT page_id, host, path, rule, CASE {verdict} WHEN patterns <> '' THEN 'block' ELSE 'allow' END AS verdict, patterns FROM ruled"""


@query("op6_url_verdicts", _url_sql())
def op6_url_verdicts(spark, sf):
    judged = url_rules.judge(table(spark, sf, "pages").select("page_id", "url"), BASE_RULES, PATTERNS)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("patterns", ",").alias("patterns"))


@query("op7_simhash_near_copies")
def op7_simhash_near_copies(spark, sf):
    groups = simhash.near_copy_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


@query("op8_even_shards")
def op8_even_shards(spark, sf):
    packed = sharding.pack(table(spark, sf, "documents").select("doc_id", "text"), 40)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_winnowed_benchmark")
def op9_winnowed_benchmark(spark, sf):
    judged = winnow.hits(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    joined = F.array_join("item_ids", ",")
    return judged.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op10_language_id")
def op10_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.predict(docs.select("doc_id", "text"), model)
    return told.select("doc_id", langid.held_out().alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.ambiguous").alias("ambiguous"))


@query("op11_vector_near_copies")
def op11_vector_near_copies(spark, sf):
    return vector_forest.near_duplicate_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))


def _checksum_sql(word: str) -> str:
    """CRC-32 of a text column: eight shifts a byte, the divisor where a one falls out."""
    step = "reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(acc, b))"
    data = f"list_transform(string_split(regexp_replace(hex(encode({word})), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT)"
    return f"xor(reduce({data}, lambda acc, b: {step}, 4294967295::BIGINT), 4294967295)"


_RESAMPLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
b AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
dw AS (SELECT doc_id, r, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
bw AS (SELECT regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM b),
df AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM dw),
bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM bw),
f AS (SELECT f, {_checksum_sql("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT bucket, count(*) AS s FROM df JOIN f USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN f USING (f) GROUP BY bucket),
a AS (SELECT (SELECT count(*) FROM df) AS ss, (SELECT count(*) FROM bf) AS tt),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
m AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS gain FROM df JOIN f USING (f) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 WHEN gain >= 0 OR gain % n = 0 THEN gain // n ELSE gain // n - 1 END AS weight,
    ('0x' || left(sha256('7:' || doc_id), 8))::BIGINT AS h FROM dw LEFT JOIN m USING (r)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN z.rank <= 25 * (SELECT count(*) FROM z) // 100 THEN z.rank END AS rank FROM y LEFT JOIN z USING (doc_id)"""


@query("op12_importance_resampling", _RESAMPLE_SQL)
def op12_importance_resampling(spark, sf):
    return importance.resampled(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("text"))


_AUDIT_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
gp AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (gn.n + 2 * v.v)::HUGEINT AS p
    FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY lang),
lp AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c.n) + 2)::HUGEINT // (any_value(ln.n) + 2 * any_value(v.v))::HUGEINT AS q
    FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
no_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    WHERE a.lang NOT IN (SELECT lang FROM v)),
more AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM no_pairs UNION ALL SELECT * FROM more),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""


@query("op13_source_divergence", _AUDIT_SQL)
def op13_source_divergence(spark, sf):
    return divergence.audit(table(spark, sf, "documents").select("lang", "source", "text"))
