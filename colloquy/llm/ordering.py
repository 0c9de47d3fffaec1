"""Following row in the order of an id, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.written import written


def with_next(rows: DataFrame, order: list[str], descending: bool = True) -> DataFrame:
    """``rows`` (narrow, all different) with ``next``, a struct of the columns ``order`` of the row that follows; the first follows the last.

    Rows are dealt by ranges of the order; each range looks ahead inside itself,
    and its last row takes the head of the next range that has rows. Nulls come last.
    """
    way = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *way).withColumn("_range", F.spark_partition_id()), "ranges")
    here = F.struct(*order)
    heads = ranged.groupBy("_range").agg(*[F.min_by(here, F.struct(*_ascending(order, descending))).alias("head")])
    turn = Window.orderBy("_range")  # one row per range
    heads = heads.select("_range", F.coalesce(F.lead("head").over(turn), F.first("head").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    inside = ranged.withColumn("next", F.lead(here).over(Window.partitionBy("_range").orderBy(*way)))
    return inside.join(F.broadcast(heads), "_range").withColumn("next", F.coalesce("next", "head")).drop("_range", "head")


def _ascending(order: list[str], descending: bool) -> list:
    """Keys whose smallest is the first row; integer columns only, nulls last."""
    return [x for c in order for x in (F.col(c).isNull(), -F.col(c).cast("decimal(20,0)") if descending else F.col(c))]
