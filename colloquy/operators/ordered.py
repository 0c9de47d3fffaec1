"""Ordered operators that never put a whole recording into one task.

A recording may hold a third of all rows, so a plain window over
``job_id`` would pull those rows into one task. Rows are instead windowed in
blocks of ``BLOCK_ROWS`` consecutive sequence numbers; what crosses a block
edge (the last row before it, the sum so far, ...) is computed on one summary
row per block and joined back on (keys, block). The big shuffle is on
(keys, block) and evenly sized; the summary is smaller by the block factor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 1024


@dataclass(frozen=True)
class Step:
    """One output column of ``scan``.

    kind: ``lag`` / ``lead`` (value of the neighbour row), ``sum`` and
    ``sum_before`` (running sum with and without the row), ``last`` and
    ``last_before`` (latest non-null value), ``next`` (first non-null value
    after the row), ``max_before`` (largest value before the row).
    """

    name: str
    kind: str
    value: Column


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def block_of(seq: Column | str = "seq") -> Column:
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(col / F.lit(BLOCK_ROWS)).cast("long")


def scan(
    df: DataFrame,
    steps: list[Step],
    *,
    keys: tuple[str, ...] = ("job_id",),
    order: str = "seq",
    block: Column | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """Add the columns of ``steps``, each as if windowed over all of ``keys``.

    ``order`` must be unique within ``keys``, and ``block`` must not decrease
    along it. ``keep_block`` leaves ``_blk``, on which the result is
    partitioned, so that a grouping by it needs no further shuffle.
    """
    base = df.withColumn("_blk", block if block is not None else block_of(order))
    for i, s in enumerate(steps):
        base = base.withColumn(f"_v{i}", s.value)
    part = [*keys, "_blk"]
    # The summary needs every column (through a digest), so that chained scans plan
    # the same exchange for it as for the rows they read, and Spark runs it once.
    digest = F.max(F.xxhash64(*[f.name for f in base.schema.fields if not _holds_map(f.dataType)]))
    base = base.repartition(*part)
    inside = Window.partitionBy(*part).orderBy(order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    after = inside.rowsBetween(1, Window.unboundedFollowing)

    local, summary = [], []
    for i, s in enumerate(steps):
        v = F.col(f"_v{i}")
        known = F.when(v.isNotNull(), F.col(order))
        if s.kind == "lag":
            local.append(F.lag(F.struct(v.alias("v"))).over(inside).alias(f"_l{i}"))
            summary.append(F.max_by(F.struct(v.alias("v")), F.col(order)).alias(f"_s{i}"))
        elif s.kind == "lead":
            local.append(F.lead(F.struct(v.alias("v"))).over(inside).alias(f"_l{i}"))
            summary.append(F.min_by(F.struct(v.alias("v")), F.col(order)).alias(f"_s{i}"))
        elif s.kind in ("sum", "sum_before"):
            local.append(F.sum(v).over(upto if s.kind == "sum" else before).alias(f"_l{i}"))
            summary.append(F.sum(v).alias(f"_s{i}"))
        elif s.kind in ("last", "last_before"):
            local.append(F.last(v, True).over(upto if s.kind == "last" else before).alias(f"_l{i}"))
            summary.append(F.max_by(v, known).alias(f"_s{i}"))
        elif s.kind == "next":
            local.append(F.first(v, True).over(after).alias(f"_l{i}"))
            summary.append(F.min_by(v, known).alias(f"_s{i}"))
        elif s.kind == "max_before":
            local.append(F.max(v).over(before).alias(f"_l{i}"))
            summary.append(F.max(v).alias(f"_s{i}"))
        else:
            raise ValueError(f"unknown step kind {s.kind!r}")

    blocks = Window.partitionBy(*keys).orderBy("_blk")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.rowsBetween(1, Window.unboundedFollowing)
    carry = []
    for i, s in enumerate(steps):
        v = F.col(f"_s{i}")
        carried = {
            "lag": lambda: F.lag(v).over(blocks),
            "lead": lambda: F.lead(v).over(blocks),
            "sum": lambda: F.sum(v).over(earlier),
            "sum_before": lambda: F.sum(v).over(earlier),
            "last": lambda: F.last(v, True).over(earlier),
            "last_before": lambda: F.last(v, True).over(earlier),
            "next": lambda: F.first(v, True).over(later),
            "max_before": lambda: F.max(v).over(earlier),
        }[s.kind]()
        carry.append(carried.alias(f"_c{i}"))
    edges = base.groupBy(*part).agg(*summary, digest.alias("_all")).where(F.col("_all").isNotNull()).select(*part, *carry)

    out = base.select("*", *local).join(edges, part, "left")
    for i, s in enumerate(steps):
        here, there = F.col(f"_l{i}"), F.col(f"_c{i}")
        if s.kind in ("lag", "lead"):
            col = F.coalesce(here, there)["v"]
        elif s.kind in ("sum", "sum_before"):
            col = F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        elif s.kind == "max_before":
            col = F.greatest(here, there)
        else:
            col = F.coalesce(here, there)
        out = out.withColumn(s.name, col)
    drop = ([] if keep_block else ["_blk"]) + [f"_{p}{i}" for i in range(len(steps)) for p in "vlc"]
    return out.drop(*drop)


def islands(
    df: DataFrame,
    starts: Column,
    *,
    keys: tuple[str, ...] = ("job_id",),
    order: str = "seq",
    name: str = "island",
    keep_block: bool = False,
) -> DataFrame:
    """Label each row with the order value of the row that opened its run.

    ``starts`` is true on the first row of every run.
    """
    return scan(df, [Step(name, "last", F.when(starts, F.col(order)))], keys=keys, order=order, keep_block=keep_block)


def ordered_text(text: Column | str, order: Column | str, sep: str = " ") -> Column:
    """Aggregate: join the texts of one (bounded) group in ``order``."""
    t = F.col(text) if isinstance(text, str) else text
    o = F.col(order) if isinstance(order, str) else order
    rows = F.array_sort(F.collect_list(F.struct(o.alias("o"), t.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep)
