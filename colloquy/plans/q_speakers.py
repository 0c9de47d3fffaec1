"""Voice matching over the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import views as V
from colloquy.operators import speakers as P
from colloquy.operators.aggregates import centroids
from colloquy.plans.q_aggregates import sql_centroids
from colloquy.plans.registry import query

_SCORES = f"""
    {sql_centroids('p', '@profile_vectors', 'name')},
    cl AS (SELECT job_id * 100 + CAST(right(speaker, 1) AS BIGINT) AS k, embedding FROM @clusters),
    {sql_centroids('c', 'cl', 'k')},
    sc AS (SELECT k // 100 AS job_id, 'SPEAKER_0' || (k % 100) AS speaker, name, sum(c.x * p.x) AS score FROM c JOIN p ON p.pos = c.pos GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY job_id, speaker ORDER BY score DESC, name) AS rank FROM sc)"""


def _voices(spark, sf):
    return centroids(V.clusters(spark, sf), ["job_id", "speaker"]), centroids(V.profile_vectors(spark, sf), ["name"])


@query("join_profile_match", f"WITH {_SCORES} SELECT job_id, speaker, name, round(score, 6) AS score FROM rk WHERE rank = 1 AND score >= 0.3")
def join_profile_match(spark, sf):
    """At 0.3, as no voice of these tables reaches the default of 0.75."""
    return P.best_profiles(*_voices(spark, sf), ["job_id", "speaker"], 0.3).withColumn("score", F.round("score", 6))


@query("join_profile_topk", f"WITH {_SCORES} SELECT job_id, speaker, name, rank, round(score, 6) AS score FROM rk WHERE rank <= 3")
def join_profile_topk(spark, sf):
    return P.top_profiles(*_voices(spark, sf), ["job_id", "speaker"]).withColumn("score", F.round("score", 6))


@query("join_assign_unique", f"""
    WITH {_SCORES},
    vc AS (SELECT vec_id % 20 AS job_id, vec_id, embedding FROM @vectors WHERE vec_id % 2 = 1)
    SELECT job_id, name, min(speaker) AS speaker FROM (
        SELECT v.job_id, 'V' || printf('%06d', v.vec_id) AS speaker, p.name, row_number() OVER (PARTITION BY v.vec_id ORDER BY sum(v.x * p.x) / sqrt(sum(v.x * v.x)) DESC, p.name) AS rn,
               sum(v.x * p.x) / sqrt(sum(v.x * v.x)) AS score
        FROM (SELECT job_id, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM vc) v JOIN p ON p.pos = v.pos GROUP BY v.job_id, v.vec_id, p.name) WHERE rn = 1 AND score >= 0.3 GROUP BY 1, 2""")
def join_assign_unique(spark, sf):
    """Every single vector as a cluster of its own, so that names do clash."""
    voices = V.clusters(spark, sf).select("job_id", F.format_string("V%06d", "vec_id").alias("speaker"), "embedding")
    profiles = centroids(V.profile_vectors(spark, sf), ["name"])
    return P.assign_unique(P.best_profiles(voices, profiles, ["job_id", "speaker"], 0.3))
