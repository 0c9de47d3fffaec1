"""Matching voices against profiles by a ball tree, without comparing every pair.

Profiles of equal vectors are one point. A node above LEAF_ROWS points is split
around up to FAN of them, each point going to the nearest, and so on round by
round: the tree grows with the profiles, and no group is larger than a leaf.
Every node knows the largest angle between its pivot and a point below it. A
voice goes down to every child whose ball can still hold an answer, and meets
only the points of the leaves it reaches whose angle to their pivot allows it.
The bounds are exact: no match is ever missed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import stage
from colloquy.functions.text import ascii_lower
from colloquy.functions.vectors import dot, unit

#: Children of a node, and points of a leaf.
FAN, LEAF_ROWS = 16, 256
MATCH_SCORE = 0.75
SLACK = 1e-6
#: Nodes with their children up to which they are broadcast (FAN vectors a row); beyond it they are joined by shuffle.
BROADCAST_NODES = 2_000


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


@dataclass(frozen=True)
class BallTree:
    """``levels``: per level one row per split node (dim, node, kids: their node, pivot, radius, size); ``points``: dim, node (its leaf), point, u, ma (angle to the leaf's pivot; null at the root)."""

    levels: list[DataFrame]
    points: DataFrame


def _small(table: DataFrame, most: int) -> DataFrame:
    return F.broadcast(table) if table.count() <= most else table


def _below(node: str, turn: str) -> Column:
    """Path of a child: the turns taken from the root."""
    return F.concat(F.col(node), F.lit("."), F.col(turn).cast("string"))


def ball_tree(points: DataFrame) -> BallTree:
    """Tree over ``points``: point (an id), u (unit vector, all different), dim. A root of its own for each ``dim``.

    Points closer than the angles can tell are dealt to the near pivots by a hash, so every split parts its node.
    """
    now = stage.cut(points.select("dim", F.lit("").alias("node"), "point", "u", F.lit(None).cast("double").alias("ma")), "balls")
    levels: list[DataFrame] = []
    while True:
        large = stage.cut(now.groupBy("dim", "node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LEAF_ROWS), "split-balls")
        if large.isEmpty():
            return BallTree(levels, now)
        large = _small(large.drop("size"), 100 * BROADCAST_NODES)
        draw = Window.partitionBy("dim", "node").orderBy(F.xxhash64("point", "node"), "point")
        picked = now.join(large, ["dim", "node"]).withColumn("_r", F.row_number().over(draw)).where(F.col("_r") <= FAN)
        pivots = stage.cut(picked.groupBy("dim", "node").agg(F.array_sort(F.collect_list(F.struct(F.col("_r").cast("long").alias("r"), F.col("u").alias("p")))).alias("pivots")), "pivots")
        off = lambda p: angle(F.col("u"), p["p"])
        nearest = F.array_min(F.transform("pivots", lambda p: F.struct(F.round(off(p), 6).alias("step"), F.xxhash64("point", "node", p["r"]).alias("turn"), p["r"].alias("r"), off(p).alias("a"))))
        told = now.join(_small(pivots, BROADCAST_NODES), ["dim", "node"], "left").withColumn("_n", nearest)
        child = F.when(F.col("_n").isNull(), F.col("node")).otherwise(_below("node", "_n.r"))
        moved = F.col("_n").isNotNull()
        now = stage.cut(told.select("dim", child.alias("node"), "point", "u", F.when(moved, F.col("_n.a")).otherwise(F.col("ma")).alias("ma"), F.when(moved, F.col("node")).alias("parent")), "balls")
        balls = now.where("parent is not null").groupBy("dim", "parent", "node").agg(F.max("ma").alias("radius"), F.count(F.lit(1)).alias("size"))
        given = pivots.select("dim", F.col("node").alias("parent"), F.explode("pivots").alias("p")).select("dim", "parent", _below("parent", "p.r").alias("node"), F.col("p.p").alias("pivot"))
        kids = balls.join(given, ["dim", "parent", "node"]).groupBy("dim", F.col("parent")).agg(F.collect_list(F.struct("node", "pivot", "radius", "size")).alias("kids"))
        levels.append(stage.cut(kids.withColumnRenamed("parent", "node"), "ball-level"))
        now = now.drop("parent")


def _kids(asked: DataFrame, level: DataFrame) -> DataFrame:
    """``asked`` with ``kids``, each child of the node with its angle ``a`` to the voice; null below a leaf."""
    seen = F.transform("kids", lambda k: F.struct(angle(F.col("v"), k["pivot"]).alias("a"), k["node"].alias("node"), k["radius"].alias("radius"), k["size"].alias("size")))
    return asked.join(_small(level, BROADCAST_NODES), ["dim", "node"], "left").withColumn("kids", seen)


def _reached(asked: DataFrame, tree: BallTree) -> DataFrame:
    """Every leaf whose ball meets the voice's ``limit``, with the angle ``a`` to its pivot."""
    asked = asked.withColumn("node", F.lit("")).withColumn("a", F.lit(None).cast("double"))
    columns = asked.columns
    for level in tree.levels:
        told = _kids(asked, level)
        stay = F.array(F.struct(F.col("a"), F.col("node")))
        go = F.transform(F.filter("kids", lambda k: k["a"] - k["radius"] <= F.col("limit") + SLACK), lambda k: F.struct(k["a"].alias("a"), k["node"].alias("node")))
        told = told.withColumn("_to", F.explode(F.when(F.col("kids").isNull(), stay).otherwise(go)))
        asked = told.select(*[F.col(f"_to.{c}") if c in ("a", "node") else c for c in columns])
    return asked


def _near_limit(asked: DataFrame, tree: BallTree, keys: list[str], k: int) -> DataFrame:
    """Voices with ``limit``, an angle within which k points surely lie: from the balls of k points on the way down the nearest ones, and from the points of the leaf there."""
    asked = asked.withColumn("node", F.lit("")).withColumn("limit", F.lit(math.pi))
    columns = asked.columns
    for level in tree.levels:
        told = _kids(asked, level).withColumn("_k", F.array_min(F.filter("kids", lambda x: x["size"] >= k)))
        asked = told.withColumn("node", F.coalesce("_k.node", "node")).withColumn("limit", F.least("limit", F.col("_k.a") + F.col("_k.radius"))).select(*columns)
    asked = stage.cut(asked, "near-leaves")
    met = asked.join(tree.points, ["dim", "node"]).select(*keys, angle(F.col("v"), F.col("u")).alias("a"))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("a"))
    kth = met.withColumn("_r", turn).where(F.col("_r") <= k).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("kth")).where(F.col("n") >= k)
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in keys]
    return asked.drop("node").alias("x").join(kth.alias("y"), on, "left").select(*[F.col(f"x.{c}") for c in keys], "v", "dim", F.least("limit", "kth").alias("limit"))


def _unit_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    rows = df.where(F.size("embedding") > 0).select(*cols, unit("embedding").alias("u"))
    return rows.withColumn("dim", F.size("u"))


def _points(profiles: DataFrame, k: int) -> tuple[DataFrame, BallTree]:
    """(point, names) with the first ``k`` names of each different vector, and the tree over the vectors."""
    known = _unit_rows(profiles.where(F.trim(F.coalesce("name", F.lit(""))) != ""), ["name"])
    known = stage.cut(known.withColumn("point", F.xxhash64("dim", "u")), "voices")
    first = known.withColumn("_r", F.row_number().over(Window.partitionBy("point").orderBy(ascii_lower("name"), "name"))).where(F.col("_r") <= k)
    names = stage.cut(first.groupBy("point").agg(F.collect_list("name").alias("names")), "voice-names")
    return names, ball_tree(known.groupBy("dim", "point").agg(F.first("u").alias("u")))


def compared(asked: DataFrame, tree: BallTree, keys: list[str]) -> DataFrame:
    """(keys, point, score) of the pairs that no bound rules out; ``asked``: keys, v, dim, limit."""
    pairs = _reached(asked, tree).join(tree.points, ["dim", "node"])
    pairs = pairs.where(F.col("a").isNull() | (F.abs(F.col("a") - F.col("ma")) <= F.col("limit") + SLACK))
    return pairs.select(*keys, "point", dot("v", "u").alias("score"))


def best_profiles(voices: DataFrame, profiles: DataFrame, keys: list[str], threshold: float = MATCH_SCORE) -> DataFrame:
    """Best profile of each voice at or above the threshold (join_profile_match).

    Of equal scores the first profile by name, ignoring A-Z case, stays.
    ``voices``: ``keys``, embedding. ``profiles``: name, embedding. Blank names
    and empty vectors take no part, vectors of another length never match.
    """
    names, tree = _points(profiles, 1)
    asked = _unit_rows(voices, keys).withColumnRenamed("u", "v").withColumn("limit", F.lit(math.acos(threshold)))
    hits = compared(asked, tree, keys).where(F.col("score") >= threshold).join(names, "point").withColumn("name", F.col("names")[0])
    return hits.groupBy(*keys).agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), ascii_lower("name"), F.col("name"))).alias("b")).select(*keys, "b.*")


def top_profiles(voices: DataFrame, profiles: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The ``k`` best profiles of each voice, whatever their score (join_profile_topk).

    The k points of the nearest leaf, or a ball of at least k points, bound the
    angle; only what lies within it is compared. The first k of each task are
    taken before the shuffle.
    """
    names, tree = _points(profiles, k)
    asked = _near_limit(_unit_rows(voices, keys).withColumnRenamed("u", "v"), tree, keys, k)
    hits = compared(asked, tree, keys)
    by_score = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    near = hits.withColumn("_r", F.rank().over(by_score)).where(F.col("_r") <= k).drop("_r").join(names, "point")
    near = near.select(*keys, F.explode("names").alias("name"), "score")
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), ascii_lower("name"), "name")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def assign_unique(matches: DataFrame) -> DataFrame:
    """One cluster per name and job: the first label keeps it, the others get none (join_assign_unique)."""
    return matches.groupBy("job_id", "name").agg(F.min("speaker").alias("speaker"))
