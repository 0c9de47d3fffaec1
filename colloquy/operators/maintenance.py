"""Table maintenance: every change is a new version of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.vectors import unit


def replace_segments(segments: DataFrame, incoming: DataFrame) -> DataFrame:
    """Jobs named by ``incoming`` lose their rows and get the new ones (dml_replace_segments)."""
    touched = incoming.select("job_id").distinct()
    return segments.join(touched, "job_id", "left_anti").unionByName(incoming.select(*segments.columns))


def cascade_delete(jobs: DataFrame, segments: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete the jobs of ``gone(id)`` with their segments; the ledger is not touched (dml_cascade_delete)."""
    ids = gone.select("id").distinct()
    return (
        jobs.join(ids, "id", "left_anti"),
        segments.join(ids.withColumnRenamed("id", "job_id"), "job_id", "left_anti"),
    )


def upsert_profiles(profiles: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest version wins per ``lower(trim(name))`` (dml_upsert_profile)."""
    both = profiles.unionByName(incoming).withColumn("name_key", F.lower(F.trim("name")))
    fields = [c for c in profiles.columns if c != "version"]
    newest = both.groupBy("name_key").agg(F.max_by(F.struct(*fields, "version"), F.struct("version", *fields)).alias("row"))
    return newest.select("name_key", "row.*")


def partial_update(table: DataFrame, deltas: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A NULL in ``deltas`` keeps the old value (dml_partial_update)."""
    new = deltas.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns]
    return table.join(new, key, "left").select(*kept)


def prepend_version(old_json: Column | str, snapshot: Column, schema: str, keep: int = 10) -> Column:
    """Snapshot first, at most ``keep`` entries; bad JSON counts as none (dml_version_prepend)."""
    old = F.coalesce(F.from_json(old_json, f"array<{schema}>"), F.array().cast(f"array<{schema}>"))
    old = F.filter(old, lambda v: v.isNotNull())
    return F.slice(F.concat(F.array(snapshot), old), 1, keep)


# Artefact columns that a mode writes anew.
PRODUCED = (
    ("compress", ("compressed_path",)),
    ("transcribe", ("transcript_path", "enhanced_transcript_path", "review_path")),
    ("compress_transcribe", ("compressed_path", "transcript_path", "enhanced_transcript_path", "review_path")),
)
PRODUCED_OTHERWISE = ("transcript_path", "enhanced_transcript_path", "review_path")
ARTEFACTS = ("compressed_path", "transcript_path", "enhanced_transcript_path", "review_path")


def overwritten_artifacts(reruns: DataFrame) -> DataFrame:
    """Existing artefacts that a rerun in ``mode`` overwrites (dml_mode_columns)."""
    cols = F.array(*[F.lit(c) for c in PRODUCED_OTHERWISE])
    for mode, names in PRODUCED:
        cols = F.when(F.col("mode") == mode, F.array(*[F.lit(c) for c in names])).otherwise(cols)
    long = reruns.select("id", "mode", cols.alias("_cols"), *ARTEFACTS).unpivot(
        ["id", "mode", "_cols"], list(ARTEFACTS), "artefact", "path")
    return long.where(F.array_contains("_cols", F.col("artefact")) & (F.coalesce("path", F.lit("")) != "")).drop("_cols")


def remember_names(profiles: DataFrame, names: DataFrame) -> DataFrame:
    """Profiles to insert, without samples, for names not known yet (dml_remember_names)."""
    new = (
        names.withColumn("name", F.trim("name")).where(F.col("name") != "")
        .groupBy(F.lower("name").alias("name_key")).agg(F.min_by("name", "seq").alias("name"))
    )
    known = profiles.select(F.lower(F.trim("name")).alias("name_key")).distinct()
    return new.join(known, "name_key", "left_anti").select("name_key", "name", F.lit(0).cast("long").alias("sample_count"))


def link_profiles(profiles: DataFrame, attendees: DataFrame) -> DataFrame:
    """Link an unlinked profile to the attendee's partner of that name (dml_link_profiles).

    Of several attendees with one name the one with the smallest partner id counts.
    """
    by_name = (
        attendees.where(F.col("partner_id") > 0)
        .groupBy(F.lower(F.trim("name")).alias("_k")).agg(F.min("partner_id").alias("_pid"))
    )
    free = F.col("odoo_partner_id").isNull() | (F.col("odoo_partner_id") == 0)
    return (
        profiles.withColumn("_k", F.lower(F.trim("name"))).join(by_name, "_k", "left")
        .withColumn("odoo_partner_id", F.when(free & F.col("_pid").isNotNull(), F.col("_pid")).otherwise(F.col("odoo_partner_id")))
        .drop("_k", "_pid")
    )


def merged_centroid(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Count-weighted mean of two unit vectors; an empty side yields (agg_centroid_merge).

    Of two vectors of different length the one with more samples stays.
    """
    mixed = unit(F.zip_with(a, b, lambda x, y: (x * na + y * nb) / (na + nb)))
    no_a, no_b = (F.size(a) == 0) | (na <= 0), (F.size(b) == 0) | (nb <= 0)
    return (
        F.when(no_a & no_b, F.array().cast("array<double>"))
        .when(no_a, b).when(no_b, a)
        .when(F.size(a) != F.size(b), F.when(na >= nb, a).otherwise(b))
        .otherwise(mixed)
    )


def merge_profiles(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fold ``absorbed`` profiles into ``survivor`` ones and drop them (dml_merge_profiles).

    The survivor keeps its name. Its link stays, unless the pair says the
    absorbed one's wins or the survivor has none.
    """
    side = lambda p: profiles.select(*[F.col(c).alias(f"{p}_{c}") for c in profiles.columns])
    merged = (
        pairs.where(F.col("survivor_id") != F.col("absorbed_id"))
        .join(side("s"), F.col("survivor_id") == F.col("s_id"))
        .join(side("a"), F.col("absorbed_id") == F.col("a_id"))
    )
    n = lambda p: F.greatest(F.coalesce(f"{p}_sample_count", F.lit(0).cast("long")), F.lit(0).cast("long"))
    linked = lambda p: F.coalesce(f"{p}_odoo_partner_id", F.lit(0).cast("long")) > 0
    takes = linked("a") & ((F.col("odoo_from") == "absorbed") | ~linked("s"))
    rows = merged.select(
        F.col("s_id").alias("id"), F.col("s_name").alias("name"),
        (n("s") + n("a")).alias("sample_count"),
        merged_centroid(F.col("s_embedding"), n("s"), F.col("a_embedding"), n("a")).alias("embedding"),
        F.when(takes, F.col("a_odoo_partner_id")).otherwise(F.col("s_odoo_partner_id")).alias("odoo_partner_id"),
    )
    out = merged.select(F.explode(F.array("s_id", "a_id")).alias("id"))
    return profiles.join(out, "id", "left_anti").select(*rows.columns).unionByName(rows)


def canonical_maps(segments: DataFrame) -> DataFrame:
    """Speaker map rows (job_id, label, name, first_seq) as the segments spell them.

    Grouped on (job, label) with map-side partials, so only one row per label
    of a job is ever gathered.
    """
    label = F.trim(F.coalesce("speaker", F.lit("")))
    return (
        segments.select("job_id", "seq", label.alias("label")).where(F.col("label") != "")
        .groupBy("job_id", "label").agg(F.min("seq").alias("first_seq"))
        .withColumn("name", F.when(F.upper("label").startswith("SPEAKER_"), "").otherwise(F.col("label")))
    )


def repair_maps(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """Audit of rebuilding every job's speaker map from its segments (dml_repair_maps)."""
    canonical = canonical_maps(segments).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("label", "name"))).alias("want"))
    with_rows = segments.select("job_id").distinct().withColumn("_has", F.lit(True))
    have = F.array_sort(F.transform(
        F.map_entries(F.from_json("speaker_map_json", "map<string,string>")),
        lambda e: F.struct(e["key"].alias("label"), e["value"].alias("name"))))
    empty = F.array().cast("array<struct<label:string,name:string>>")
    state = (
        jobs.join(with_rows, F.col("id") == with_rows["job_id"], "left").drop("job_id")
        .join(canonical, F.col("id") == canonical["job_id"], "left")
        .select(
            F.coalesce("_has", F.lit(False)).alias("has"),
            (F.coalesce(have, empty) == F.coalesce("want", empty)).alias("same"),
        )
    )
    return state.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("has") & ~F.col("same")).alias("repaired"),
        F.count_if(~F.col("has")).alias("skipped_no_segments"),
        F.count_if(F.col("has") & F.col("same")).alias("unchanged"),
    )


def recompute_bytes(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes on disk by job; jobs without files keep their figure (dml_recompute_bytes)."""
    sums = files.groupBy(F.col("job_id").alias("id")).agg(F.sum("size").alias("_bytes"))
    return jobs.join(sums, "id", "left").select(
        *[c for c in jobs.columns if c != "total_bytes"],
        F.coalesce("_bytes", "total_bytes").alias("total_bytes"),
        F.col("_bytes").isNotNull().alias("updated"),
    )
