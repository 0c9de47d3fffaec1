"""Readers of decoder, provider and model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.clock import clock_parse_ms, line_clock_seconds
from colloquy.operators.aggregates import number_labels
from colloquy.operators.ordered import Step, scan
from colloquy.operators.sequences import drop_loops, split_plain_text

def valid_json(c: Column | str) -> Column:
    """The text if all of it is JSON, else NULL; a reader alone would keep the readable part."""
    return F.when(F.try_parse_json(F.col(c) if isinstance(c, str) else c).isNotNull(), c if isinstance(c, Column) else F.col(c))


ASR = (
    "job_id bigint, chunk bigint, language string, segments array<struct<id:bigint,start:double,`end`:double,text:string,avg_logprob:double,"
    "compression_ratio:double,no_speech_prob:double,words:array<struct<start:double,`end`:double,word:string,probability:double>>>>"
)


def read_asr(spark: SparkSession, path: str, one_document_per_file: bool = False) -> DataFrame:
    """Decoder JSON to cleaned segments with words (src_asr_json).

    Documents come one per line, or one per file, whose folder or name then
    tells the job. Words without times are dropped.
    """
    docs = spark.read.schema(ASR).json(path, multiLine=one_document_per_file)
    if one_document_per_file:
        named = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)[^/]*$", 1).try_cast("long")
        docs = docs.select(F.coalesce("job_id", named).alias("job_id"), F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"), "segments")
    seg = docs.select("job_id", "chunk", F.posexplode("segments").alias("pos", "s"))
    ms = lambda c: F.round(F.coalesce(c, F.lit(0.0)) * F.lit(1000.0), 0).cast("long")
    words = F.filter(F.coalesce("s.words", F.array().cast("array<struct<start:double,end:double,word:string,probability:double>>")), lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    rows = seg.select(
        "job_id", (F.col("chunk") * 1_000_000 + F.col("pos")).alias("seq"), ms(F.col("s.start")).alias("start_ms"), ms(F.col("s.end")).alias("end_ms"),
        F.trim(F.coalesce("s.text", F.lit(""))).alias("text"), F.col("s.avg_logprob").alias("avg_logprob"),
        F.col("s.compression_ratio").alias("compression_ratio"), F.col("s.no_speech_prob").alias("no_speech_prob"), words.alias("words"))
    return drop_loops(rows)


_UTT = "array<struct<start:string,`end`:string,speaker:string,speaker_id:string,text:string,transcript:string>>"
PROVIDER = (
    f"struct<text:string,segments:{_UTT},utterances:{_UTT},"
    f"results:struct<utterances:{_UTT},channels:array<struct<alternatives:array<struct<transcript:string>>>>>,"
    f"result:struct<transcription:struct<full_transcript:string,utterances:{_UTT}>>>"
)


def provider_utterances(chunks: DataFrame) -> DataFrame:
    """Utterances of any provider's payload on the source timeline (src_provider_json).

    ``chunks``: job_id, chunk, provider (openai, assemblyai, deepgram,
    gladia), payload, offset_ms, duration_ms. Flat text is cut into
    sentences. Speakers are numbered within a chunk.
    """
    p = chunks.withColumn("p", F.from_json(valid_json("payload"), PROVIDER))
    prov = F.col("provider")
    utt = (
        F.when(prov == "openai", F.when(F.size(F.coalesce("p.segments", F.array().cast(_UTT))) > 0, F.col("p.segments")).otherwise(F.col("p.utterances")))
        .when(prov == "assemblyai", F.col("p.utterances")).when(prov == "deepgram", F.col("p.results.utterances"))
        .when(prov == "gladia", F.col("p.result.transcription.utterances"))
    )
    flat = (
        F.when(prov.isin("openai", "assemblyai"), F.col("p.text"))
        .when(prov == "deepgram", F.get(F.get("p.results.channels", F.lit(0))["alternatives"], F.lit(0))["transcript"])
        .when(prov == "gladia", F.col("p.result.transcription.full_transcript"))
    )
    base = p.select("job_id", "chunk", "provider", "offset_ms", "duration_ms", utt.alias("utt"), flat.alias("flat"))
    timed = base.where(F.size(F.coalesce("utt", F.array().cast(_UTT))) > 0).select("job_id", "chunk", "provider", "offset_ms", F.posexplode("utt").alias("pos", "u"))
    seconds = lambda c: F.when(prov == "openai", clock_parse_ms(c)).when(
        prov == "assemblyai", F.round(c.try_cast("double"), 0).cast("long")).otherwise(F.round(c.try_cast("double") * F.lit(1000.0), 0).cast("long"))
    label = F.when(prov.isin("deepgram", "gladia") & F.col("u.speaker").isNotNull(), F.concat(F.lit("spk"), "u.speaker")).otherwise(F.coalesce(F.nullif("u.speaker", F.lit("")), "u.speaker_id", F.lit("")))
    said = F.trim(F.coalesce(F.nullif("u.text", F.lit("")), "u.transcript", F.lit("")))
    zero = F.lit(0).cast("long")
    timed = timed.select("job_id", "chunk", F.col("pos").cast("long").alias("seq"), "offset_ms", F.coalesce(seconds(F.col("u.start")), zero).alias("s"),
                         F.coalesce(seconds(F.col("u.end")), zero).alias("e"), label.alias("label"), said.alias("text"))
    bare = base.where(F.size(F.coalesce("utt", F.array().cast(_UTT))) == 0).select(
        F.struct("job_id", "chunk", "offset_ms").alias("id"), F.coalesce("flat", F.lit("")).alias("text"), "duration_ms")
    bare = split_plain_text(bare).select(
        "id.job_id", "id.chunk", F.col("pos").alias("seq"), "id.offset_ms", (F.col("start") * 1000).cast("long").alias("s"), (F.col("end") * 1000).cast("long").alias("e"),
        F.lit("").alias("label"), "text")
    rows = timed.unionByName(bare).where(F.col("text") != "")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    end = F.when(F.col("e") < F.col("s"), F.col("s") + F.greatest(F.floor(words * 1000 / F.lit(3)), F.lit(1000).cast("long"))).otherwise(F.col("e"))
    return number_labels(rows.withColumn("e", end)).select(
        "job_id", "chunk", "seq", (F.col("s") + F.col("offset_ms")).alias("start_ms"), (F.col("e") + F.col("offset_ms")).alias("end_ms"), "speaker", "text")


BUNDLE = (
    "struct<title:string,speakers:array<struct<label:string,name:string>>,technical_terms:array<string>,"
    "uncertain:array<struct<timestamp:string,text:string,reason:string>>,"
    "corrections:array<struct<timestamp:string,original:string,replacement:string,confidence:double,reason:string>>,"
    "segments:array<struct<start:string,`end`:string,speaker:string,text:string>>>"
)


def bundle_metadata(chunks: DataFrame) -> DataFrame:
    """Title, names, terms, doubts and corrections of a model's answer (src_enrich_json).

    ``chunks``: job_id, chunk, payload. Text that is no JSON gives empty values.
    """
    b = chunks.withColumn("b", F.from_json(valid_json("payload"), BUNDLE))
    tidy = lambda c: F.trim(F.coalesce(c, F.lit("")))
    named = F.filter(F.coalesce("b.speakers", F.array().cast("array<struct<label:string,name:string>>")), lambda s: tidy(s["label"]) != "")
    terms = F.filter(F.transform(F.coalesce("b.technical_terms", F.array().cast("array<string>")), tidy), lambda t: t != "")
    doubts = F.filter(F.coalesce("b.uncertain", F.array().cast("array<struct<timestamp:string,text:string,reason:string>>")), lambda d: tidy(d["text"]) != "")
    return b.select(
        "job_id", "chunk", tidy(F.col("b.title")).alias("title"),
        # The last entry of a label counts, as in a dictionary.
        F.aggregate(named, F.create_map().cast("map<string,string>"), lambda m, s: F.map_concat(
            F.map_filter(m, lambda k, v: k != tidy(s["label"])), F.create_map(tidy(s["label"]), tidy(s["name"])))).alias("speakers"),
        terms.alias("technical_terms"), doubts.alias("uncertain"),
        F.coalesce("b.corrections", F.array().cast("array<struct<timestamp:string,original:string,replacement:string,confidence:double,reason:string>>")).alias("corrections"))


def bundle_segments(chunks: DataFrame) -> DataFrame:
    """Timed segments of a model's answer, on the source timeline (src_bundle_json).

    ``chunks``: job_id, chunk, payload, offset_ms. A missing start is the
    segment before's; a missing or early end is a third of a second per word
    after the start, one second at least; blank texts go.
    """
    seg = chunks.select("job_id", "chunk", "offset_ms", F.posexplode(F.from_json(valid_json("payload"), BUNDLE)["segments"]).alias("pos", "s"))
    seg = seg.withColumn("text", F.trim(F.coalesce("s.text", F.lit("")))).where(F.col("text") != "")
    seg = seg.select("job_id", "chunk", "offset_ms", F.col("pos").cast("long").alias("seq"), clock_parse_ms("s.start").alias("s"), clock_parse_ms("s.end").alias("e"),
                     F.trim(F.coalesce("s.speaker", F.lit(""))).alias("speaker"), "text")
    known = scan(seg, [Step("_s", "last", F.col("s"))], keys=("job_id", "chunk"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    start = F.coalesce("_s", F.lit(0).cast("long"))
    rows = known.withColumn("s", start)
    end = F.when(F.col("e").isNull() | (F.col("e") < F.col("s")), F.col("s") / F.lit(1000.0) + F.greatest(words / F.lit(3.0), F.lit(1.0))).otherwise(F.col("e") / F.lit(1000.0))
    offset = F.col("offset_ms") / F.lit(1000.0)
    return rows.select("job_id", "chunk", "seq", F.bround(F.col("s") / F.lit(1000.0) + offset, 2).alias("start"), F.bround(end + offset, 2).alias("end"), "speaker", "text")


LAST_LINE = (
    "struct<error:string,turns:array<struct<start:double,`end`:double,speaker:string>>,"
    "spans:array<struct<src_start:double,src_end:double,trim_start:double,trim_end:double>>,clusters:map<string,array<array<double>>>>"
)


def last_json_line(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool logs whose last line is the result: parsed rows and rejected ones (src_last_json_line).

    ``logs``: id, value.
    """
    lines = F.filter(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n"), lambda l: F.trim(l) != "")
    last = F.trim(F.element_at(lines, -1))
    rows = logs.select("id", F.when(F.size(lines) > 0, last).alias("last")).withColumn("r", F.from_json(valid_json("last"), LAST_LINE))
    object_like = F.col("last").rlike(r"^\{.*\}$")
    reason = (
        F.when(F.col("last").isNull(), "empty").when(~object_like | F.col("r").isNull(), "bad_json")
        .when(F.get_json_object("last", "$.error").isNotNull(), F.concat(F.lit("error: "), F.get_json_object("last", "$.error")))
    )
    judged = rows.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select("id", "r.turns", "r.spans", "r.clusters")
    return good, judged.where(F.col("reason").isNotNull()).select("id", "reason", "last")


_STAMP = r"^[-*]\s*\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?\s*"
_WHY = r"(?:\(raison\s*:\s*([^)]*)\))?"
FIX_LINE = "(?i)" + _STAMP + r'"([^"]+)"\s*(?:->|→|=>)\s*"([^"]+)"\s*' + _WHY
DOUBT_LINE = "(?i)" + _STAMP + r'"([^"]+)"\s*' + _WHY
MARKDOWN_CAP, MARKDOWN_CONFIDENCE = 20, 0.85


def markdown_findings(answers: DataFrame) -> DataFrame:
    """Corrections and doubts of a markdown answer (src_llm_markdown).

    ``answers``: id, text. A header holds until the next one; at most twenty
    of each kind per answer. An answer is read once from its top, in its own row; lines of a kind that is full are not looked at.
    """
    none = F.col("text").contains("Aucune correction") & F.col("text").contains("Aucun doute")
    found = "array<struct<kind:string,n:bigint,l:string>>"
    now = lambda kind, fixes, doubts, out: F.struct(kind.alias("kind"), fixes.alias("fixes"), doubts.alias("doubts"), out.alias("out"))
    zero = F.lit(0).cast("long")
    start = now(F.lit(""), zero, zero, F.array().cast(found))

    def step(a: Column, l: Column) -> Column:
        low = F.lower(l)
        fix, doubt = low.startswith("# correction"), low.startswith("# doute") | low.startswith("# uncertain")
        open_to = lambda kind, n, pattern: (a["kind"] == kind) & (a[n] < MARKDOWN_CAP) & l.rlike(pattern)
        more = lambda n: F.concat(a["out"], F.array(F.struct(a["kind"].alias("kind"), (a[n] + 1).alias("n"), l.alias("l"))))
        return (
            F.when(l.startswith("#") & (fix | doubt), now(F.when(fix, "correction").otherwise("doubt"), a["fixes"], a["doubts"], a["out"]))
            .when(open_to("correction", "fixes", FIX_LINE), now(a["kind"], a["fixes"] + 1, a["doubts"], more("fixes")))
            .when(open_to("doubt", "doubts", DOUBT_LINE), now(a["kind"], a["fixes"], a["doubts"] + 1, more("doubts")))
            .otherwise(a))

    lines = F.transform(F.split("text", r"\r?\n"), lambda l: F.trim(l))
    # An outer generator, and no filter on the text: Spark would put either before the answer is built and build it anew for it.
    rows = answers.select("id", F.inline_outer(F.when(~none, F.aggregate(lines, start, step, lambda a: a["out"])))).where(F.col("kind").isNotNull())
    fix = F.col("kind") == "correction"
    part = lambda pattern, i: F.trim(F.regexp_extract("l", pattern, i))
    return rows.select(
        "id", "kind", "n", F.when(fix, part(FIX_LINE, 1)).otherwise(part(DOUBT_LINE, 1)).alias("timestamp"),
        F.when(fix, part(FIX_LINE, 2)).otherwise(part(DOUBT_LINE, 2)).alias("original"), F.when(fix, part(FIX_LINE, 3)).alias("replacement"),
        F.when(fix, F.lit(MARKDOWN_CONFIDENCE)).alias("confidence"), F.when(fix, part(FIX_LINE, 4)).otherwise(part(DOUBT_LINE, 3)).alias("reason"))


TITLE_ANSWER = "struct<error:string,title:string,speakers:map<string,string>,technical_terms:array<string>,terms:array<string>>"
TERM_CAP = 30
_PIECE = r'("(?:[^"\\]++|\\.)*+"|[{}]|[^"{}]++|"[\s\S]*+)'


def first_object(text: Column) -> Column:
    """The object that the first { opens, up to the } that closes it at whatever depth; empty if none does.

    Braces inside strings don't count: the pieces are whole strings, single braces and what lies between.
    """
    rest = F.substring(text, F.locate("{", text), F.length(text))
    pieces = F.when(F.locate("{", text) > 0, F.regexp_extract_all(rest, F.lit(_PIECE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("open"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        still = F.when(x == "{", a["open"] + 1).when(x == "}", a["open"] - 1).otherwise(a["open"])
        return F.when(a["done"], a).otherwise(F.struct((a["n"] + 1).alias("n"), still.alias("open"), (still == 0).alias("done")))

    whole = lambda ps: F.aggregate(ps, start, step, lambda a: F.when(a["done"], F.array_join(F.slice(ps, 1, a["n"]), "")).otherwise(""))
    return F.array_join(F.transform(F.array(pieces), whole), "")


def title_answers(answers: DataFrame) -> DataFrame:
    """Title, names and terms of a model's loose JSON answer (src_title_json).

    ``answers``: id, text. The last line if it parses, else the first balanced
    object, if need be without trailing commas. Only SPEAKER_ keys count.
    """
    t = F.trim("text")
    last = F.trim(F.element_at(F.split(t, r"\r?\n"), -1))
    first = first_object(t)
    cleaned = F.regexp_replace(first, r",(\s*[}\]])", "$1")
    parse = lambda c: F.when(c.rlike(r"(?s)^\{.*\}$"), F.from_json(valid_json(c), TITLE_ANSWER))
    whole = lambda r: r.isNotNull() & (r["title"].isNotNull() | r["speakers"].isNotNull() | r["technical_terms"].isNotNull() | r["terms"].isNotNull() | r["error"].isNotNull())
    rows = answers.select("id", parse(last).alias("a"), parse(first).alias("b"), parse(cleaned).alias("c"))
    r = F.when(whole(F.col("a")), F.col("a")).when(whole(F.col("b")), F.col("b")).when(whole(F.col("c")), F.col("c"))
    rows = rows.select("id", r.alias("r"))
    unquote = lambda c: F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), '^"+|"+$', ""))
    strings = F.array().cast("array<string>")
    bad = F.col("r.error").isNotNull()
    terms = F.coalesce(F.when(F.size("r.technical_terms") > 0, F.col("r.technical_terms")), F.col("r.terms"), strings)
    names = F.transform_values(F.coalesce("r.speakers", F.create_map().cast("map<string,string>")), lambda k, v: unquote(v))
    return rows.select(
        "id", F.when(bad, "").otherwise(unquote(F.col("r.title"))).alias("title"),
        F.when(bad, F.create_map().cast("map<string,string>")).otherwise(F.map_filter(names, lambda k, v: F.trim(k).startswith("SPEAKER_") & (v != ""))).alias("speakers"),
        F.when(bad, strings).otherwise(F.slice(F.array_distinct(F.filter(F.transform(terms, unquote), lambda x: x != "")), 1, TERM_CAP)).alias("technical_terms"))


TRANSCRIPT_LINE = r"^\[([^\]\n]+)\]\s+\((\d{1,2}:\d{2}(?::\d{2})?)\)\s*(.*)$"


def transcript_rows(lines: DataFrame, ids: list[str], line: str = "line") -> DataFrame:
    """Rendered lines to speaker, seconds and text; other lines are left out (src_transcript_lines)."""
    t = F.trim(line)
    part = lambda i: F.regexp_extract(t, TRANSCRIPT_LINE, i)
    return lines.where(t.rlike(TRANSCRIPT_LINE)).select(*ids, F.trim(part(1)).alias("speaker"), line_clock_seconds(part(2)).alias("seconds"), part(3).alias("text"))
