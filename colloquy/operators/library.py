"""Listing, search and lookup over the meeting library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import ascii_lower


def list_jobs(jobs: DataFrame, limit: int = 100, status: str | None = None) -> DataFrame:
    """Newest jobs first (lib_list)."""
    kept = jobs if status is None else jobs.where(F.col("status") == status)
    return kept.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def get_jobs(jobs: DataFrame, wanted: DataFrame, settings_schema: str) -> DataFrame:
    """Look up the jobs of ``wanted(id)`` and decode their settings (lib_get)."""
    found = jobs.join(wanted.select("id").distinct(), "id", "left_semi")
    return found.withColumn("settings", F.from_json("settings_json", settings_schema)).drop("settings_json")


# Listing order of the states.
STATUS_RANK = (("RUNNING", 0), ("QUEUED", 1), ("PENDING", 1), ("COMPLETED", 2), ("FAILED", 3))


def status_rank(status: Column | str = "status") -> Column:
    s = F.upper(F.coalesce(F.col(status) if isinstance(status, str) else status, F.lit("")))
    out = F.lit(4)
    for name, rank in reversed(STATUS_RANK):
        out = F.when(s == name, rank).otherwise(out)
    return out


def with_sort_keys(rows: DataFrame) -> DataFrame:
    """Sort columns of the library listing (lib_sorted)."""
    model = F.lower(F.coalesce("model", F.lit("")))
    return rows.select(
        "id",
        status_rank().alias("sort_status"),
        F.coalesce("updated_at", "created_at").alias("sort_updated"),
        F.coalesce("total_bytes", F.lit(0).cast("long")).alias("sort_bytes"),
        F.coalesce("cost_micro", F.lit(0).cast("long")).alias("sort_cost"),
        F.when(model == "", "zzz").otherwise(model).alias("sort_model"),
        F.format_string("%03d-%s", F.size("speaker_names"), F.array_join("speaker_names", ",")).alias("sort_speakers"),
    )


def best_artifact(*paths: str) -> Column:
    """First non-blank path, in the order given (lib_best_artifact)."""
    return F.coalesce(*[F.nullif(F.col(p), F.lit("")) for p in paths])


def text_like(text: Column | str, query: str) -> Column:
    """LIKE '%query%' with A-Z folding only; '%' and '_' in the query stay live."""
    pattern = query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return ascii_lower(text).like("%" + pattern.replace("\\", "\\\\") + "%")


def search_segments(
    segments: DataFrame, jobs: DataFrame, query: str | None = None, speaker: str | None = None, limit: int = 200
) -> DataFrame:
    """Segments that contain a text and/or belong to a speaker (lib_search_segments)."""
    hits = segments
    if speaker is not None:
        hits = hits.where(F.col("speaker") == speaker)
    if query:
        hits = hits.where(text_like("text", query))
    parents = jobs.select(F.col("id").alias("job_id"), "created_at", "source_path")
    return (
        hits.join(parents, "job_id")
        .orderBy(F.col("created_at").desc(), "start_ms", "job_id", "seq")
        .limit(limit)
    )


def search_jobs(jobs: DataFrame, segments: DataFrame, query: str, newest: int = 500) -> DataFrame:
    """Among the newest jobs, those said or named like the query (lib_search_jobs)."""
    head = list_jobs(jobs, newest)
    said = search_segments(segments, jobs, query).select(F.col("job_id").alias("id")).distinct().withColumn("_said", F.lit(True))
    path = F.lower(F.coalesce("source_path", F.lit("")))
    named = path.contains(query.lower()) | F.element_at(F.split(path, "/"), -1).contains(query.lower())
    return head.join(said, "id", "left").where(F.col("_said") | named).drop("_said")


def speaker_names(speaker_map: DataFrame) -> DataFrame:
    """Display names of rows (job_id, label, name); labels if no name is set (lib_speaker_names)."""
    name = F.trim("name")
    return (
        speaker_map.groupBy("job_id")
        .agg(
            F.array_sort(F.collect_set(F.nullif(name, F.lit("")))).alias("names"),
            F.array_sort(F.collect_set("label")).alias("labels"),
        )
        .select("job_id", F.when(F.size("names") > 0, F.col("names")).otherwise(F.col("labels")).alias("speaker_names"))
    )


CHUNKS = "array<struct<index:bigint,start:double,`end`:double,ok:boolean>>"


def failed_chunks(jobs: DataFrame, chunks_json: str = "cloud_chunks_json") -> DataFrame:
    """Chunks that did not come back, by index (lib_failed_chunks)."""
    return (
        jobs.select("id", F.inline(F.from_json(chunks_json, CHUNKS)))
        .where(~F.coalesce("ok", F.lit(False)))
        .orderBy("id", "index")
    )


def attendee_hints(invitees: DataFrame, expected: DataFrame) -> DataFrame:
    """Invitees of a meeting whose name is not expected yet (lib_attendee_hints)."""
    known = expected.select("meeting_id", F.lower(F.trim("name")).alias("_k")).distinct()
    return invitees.withColumn("_k", F.lower(F.trim("name"))).join(known, ["meeting_id", "_k"], "left_anti").drop("_k")


# Settings whose value must never be shown.
SECRET_KEYS = (
    "api_key", "access_token", "client_secret", "cloud_api_key", "hf_token", "password", "refresh_token", "token",
)


_JSON_STRING = r'"(?:[^"\\]++|\\.)*+"'
_JSON_TOKEN = _JSON_STRING + r'|[{}\[\],:]|\s+|[^"{}\[\],:\s]+|"'
_SECRET = '"(?:' + "|".join(SECRET_KEYS) + r')"\s*+:\s*+'
_NESTING = 5


def _secret_value() -> str:
    """Pattern of a value that must go: a truthy scalar as one whole token, or a filled object or list of bounded nesting, closed or not."""
    end = r'(?=["{}\[\],:\s]|\z)'
    number = rf"-?+(?!0(?:\.0++)?+(?:[eE]|{end}))\d[\d.eE+-]*+"
    inside = rf'{_JSON_STRING}|[^"{{}}\[\]]++|"'
    for _ in range(_NESTING):
        inside = rf'{_JSON_STRING}|[^"{{}}\[\]]++|"|[{{\[](?:{inside})*+(?:[}}\]]|\z)'
    return rf'(?:(?!""){_JSON_STRING}|(?:true|{number}){end}|[{{\[](?!\s*+(?:[}}\]]|\z))(?:{inside})*+(?:[}}\]]|\z))'


# What comes before a secret value is passed over by whole strings, so that a key is told from the inside of a text.
_REDACTION = rf'\G((?:(?!{_SECRET}{_secret_value()})(?:[^"]++|{_JSON_STRING}|"))*+)({_SECRET}){_secret_value()}'
# A filled bracket left after a key is nested deeper than the pattern; a key as the value of a key stands in no valid text.
_LEFT = rf"{_SECRET}[{{\[](?!\s*+[}}\]])"
_CHAIN = rf'{_SECRET}{_SECRET}'


def redact(settings_json: Column | str) -> Column:
    """Replace the truthy values of secret keys, at any depth, in JSON text (lib_redact).

    One pattern does it where a secret value nests up to ``_NESTING`` brackets;
    only other texts are folded token by token, with the same result.
    """
    text = F.col(settings_json) if isinstance(settings_json, str) else settings_json
    done = F.regexp_replace(text, _REDACTION, '$1$2"[redacted]"')
    odd = done.rlike(_LEFT) | text.rlike(_CHAIN)
    return F.when(odd, redact_by_tokens(text)).otherwise(done)


def redact_by_tokens(settings_json: Column | str) -> Column:
    """As ``redact``, for any nesting.

    The tokens are folded: after a secret key and its colon a truthy scalar is
    replaced, and a filled object or list is left out up to the bracket that
    closes it, however deep it nests.
    """
    text = F.col(settings_json) if isinstance(settings_json, str) else settings_json
    tokens = F.regexp_extract_all(text, F.lit(f"({_JSON_TOKEN})"), F.lit(1))
    opens, closes = lambda t: t.isin("{", "["), lambda t: t.isin("}", "]")
    secret = lambda t: t.isin(*[f'"{k}"' for k in SECRET_KEYS])
    space = lambda t: t.rlike(r"^\s")
    truthy = lambda t: t.rlike(r'^(?:"(?s:.)+"|true|-?(?!0(?:\.0+)?(?:[eE]|$))\d[\d.eE+-]*)$')
    # the next token that is no space, to tell empty brackets
    after = lambda ts: F.transform(ts, lambda t, i: F.struct(t.alias("t"), F.when(space(F.get(ts, i + 1)), F.get(ts, i + 2)).otherwise(F.get(ts, i + 1)).alias("n")))
    # said: 0 nothing, 1 a secret key, 2 its colon too; open: brackets still to close of a value that goes
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("said"), F.lit(0).alias("open"))

    def step(a: Column, x: Column) -> Column:
        t, value = x["t"], (a["said"] == 2) & ~space(x["t"])
        drops = value & opens(t) & ~closes(x["n"])
        put = F.when(drops | (value & truthy(t)), F.lit('"[redacted]"')).otherwise(t)
        said = F.when(space(t), a["said"]).when(secret(t), 1).when((t == ":") & (a["said"] == 1), 2).otherwise(0)
        inside = a["open"] > 0
        return F.struct(
            F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(put))).alias("out"),
            F.when(inside, 0).otherwise(said).alias("said"),
            F.when(inside, a["open"] + opens(t).cast("int") - closes(t).cast("int")).otherwise(drops.cast("int")).alias("open"),
        )

    parts = F.flatten(F.transform(F.array(tokens), lambda ts: F.aggregate(after(ts), start, step, lambda a: a["out"])))
    return F.when(text.isNotNull(), F.array_join(parts, ""))


def usable_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles with a decodable embedding and not zero samples (lib_usable_profiles)."""
    from colloquy.functions.vectors import decode_embedding

    return (
        profiles.withColumn("embedding", decode_embedding("embedding_json"))
        .where((F.size("embedding") > 0) & (F.col("sample_count").isNull() | (F.col("sample_count") >= 1)))
    )


# Labels by file or folder name, then by suffix.
FILE_LABELS = (
    ("audio.vad.wav", "Audio filtré (VAD)"),
    ("audio.wav", "Audio extrait"),
    ("whisper.json", "Sortie Whisper (JSON)"),
    ("transcript_for_local_analysis.txt", "Transcription pour le LLM"),
    ("speaker_samples", "Extraits audio par locuteur"),
)
SUFFIX_LABELS = (
    ((".txt", ".srt", ".vtt", ".tsv"), "Transcription"),
    ((".md",), "Rapport à vérifier"),
    ((".mov", ".mp4", ".m4v", ".mkv"), "Vidéo compressée"),
    ((".wav", ".m4a", ".mp3"), "Audio"),
    ((".json",), "Données moteur (JSON)"),
)


def file_label(path: Column | str) -> Column:
    """Kind of a workspace file, by name, ancestor folder or suffix (lib_file_label)."""
    parts = F.split(path, "/")
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit("Autre")
    for group, label in reversed(SUFFIX_LABELS):
        out = F.when(suffix.isin(*group), label).otherwise(out)
    for fragment, label in reversed(FILE_LABELS):
        out = F.when(F.array_contains(parts, fragment), label).otherwise(out)
    return out


def model_catalog(cloud: DataFrame, local: DataFrame) -> DataFrame:
    """One list of local and cloud models with role and price (lib_model_catalog)."""
    free = [F.lit(0).cast("long").alias(c) for c in ("cents_in", "cents_out", "cents_hour")]
    return local.select("model", "family", "role", F.lit("local").alias("kind"), *free).unionByName(
        cloud.select("model", "family", F.lit("cloud_transcription").alias("role"), F.lit("cloud").alias("kind"),
                     "cents_in", "cents_out", "cents_hour"))
