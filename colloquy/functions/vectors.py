"""Voice embeddings as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; an empty or zero vector gives 0, unequal lengths an error."""
    a, b = _col(a), _col(b)
    d = F.sqrt(dot(a, a) * dot(b, b))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .when(F.size(a) != F.size(b), F.raise_error(F.lit("embeddings differ in length")).cast("double"))
        .when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)
    )


def unit(a: Column | str) -> Column:
    a = _col(a)
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v / n)).otherwise(a)


def sums_by(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Element-wise sum and count of the vectors of each key.

    The sum runs on (keys, position) with map-side partials, so a key with a
    third of all vectors is added up before anything is shuffled.
    """
    cells = df.select(*keys, F.size(vector).alias("_dim"), F.posexplode(vector).alias("_p", "_x"))
    added = cells.groupBy(*keys, "_dim", "_p").agg(F.sum("_x").alias("_x"), F.count(F.lit(1)).alias("_n"))
    return added.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda r: r["_x"]).alias("total"),
        F.max("_n").alias("n"),
        F.assert_true(F.min("_dim") == F.max("_dim"), F.lit("embeddings differ in length")).alias("_ok"),
    ).drop("_ok")


def centroid_from_sums(total: Column | str, n: Column | str) -> Column:
    n = _col(n)
    return unit(F.transform(_col(total), lambda v: v / n))


def decode_embedding(text: Column | str) -> Column:
    """JSON text to array; malformed or non-numeric text gives an empty array."""
    parsed = F.from_json(_col(text), "array<double>")
    return F.when(parsed.isNull() | F.exists(parsed, lambda v: v.isNull()), F.array().cast("array<double>")).otherwise(parsed)
