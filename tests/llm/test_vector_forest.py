"""Linked vectors against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import vector_forest
from colloquy.llm.queries import op11_vector_near_copies


def all_pairs(rows, least=0.9):
    """{id: (links, smallest id reached)} of (id, vector) rows with different ids."""
    fit = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {i: [0, i] for i, _ in rows}
    group = {i: {i} for i, _ in rows}
    for d in {len(v) for _, v in fit}:
        ids = [i for i, v in fit if len(v) == d]
        x = np.array([v / np.linalg.norm(v) for _, v in fit if len(v) == d])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1))):
            a, b = ids[a], ids[b]
            out[a][0] += 1
            out[b][0] += 1
            if group[a] is not group[b]:
                group[a] |= group[b]
                for i in group[b]:
                    group[i] = group[a]
    return {i: (n, min(group[i])) for i, (n, _) in out.items()}


def result(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("node", F.lit("x")).withColumn("entity", F.lit(1)).withColumn("m", F.lit(None).cast("int"))
    return vector_forest.near_duplicate_vectors(df).collect()


def test_whole_table_equals_all_pairs(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    base = [v for _, v in rows]
    rng = np.random.default_rng(3)
    # planted: copies, scaled copies, and partners on both sides of the bound
    rows += [(10_000 + i, base[i]) for i in range(40)] + [(11_000 + i, [2 * c for c in base[i]]) for i in range(20)]
    for k, cosine in enumerate((0.95, 0.901, 0.899)):
        rows += [(12_000 + 1000 * k + i, v.tolist()) for i, v in enumerate(vector_forest.planted(np.array(base[:60]) / np.linalg.norm(base[:60], axis=1, keepdims=True), cosine, rng)[1])]
    want = all_pairs(rows)
    got = result(spark, rows, "double")
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    given = op11_vector_near_copies(spark, sf)
    assert given.columns == ["vec_id", "n_links", "component_id", "kept"] and given.count() == len(base)


def test_trees_knots_and_blocks(spark, monkeypatch):
    """Small leaves, so that the trees split, crowded leaves give knots, and knots meet single vectors and each other."""
    for name, value in (("LEAF", 32), ("BLOCK_ROWS", 24)):
        monkeypatch.setattr(vector_forest, name, value)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((4, 16))
    centres[1] = centres[0] + 0.35 * rng.standard_normal(16)  # two groups side by side
    rows = [x for c, n, s in zip(centres, (400, 300, 200, 30), (0.05, 0.08, 0.15, 0.3)) for x in c + s * rng.standard_normal((n, 16))]
    rows += list(rng.standard_normal((700, 16))) + rows[:150] + rows[400:450]
    rows = [(i, np.float32(x).astype(float).tolist()) for i, x in enumerate(rows)]
    seen = []
    kept = vector_forest._with_knots
    monkeypatch.setattr(vector_forest, "_with_knots", lambda *a: seen.append(kept(*a)) or seen[-1])
    got = {r.vec_id: r for r in result(spark, rows)}
    want = all_pairs(rows)
    assert seen[0].where("centre is not null").count() > 300
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.98 * len(rows)


def test_forest_finds_partners_at_the_least_cosine():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = vector_forest.Forest(x[:2000], 1 << 17, 0.9)
    assert forest.depth == 7 and 1 < len(forest.trees) < vector_forest.MOST_TREES
    a, b = vector_forest.planted(x[2000:], 0.9, rng)
    assert np.allclose((a * b).sum(axis=1), 0.9)
    la, lb = forest.leaves(a), forest.leaves(b)
    met = ((la[..., :, None] == lb[..., None, :]) & (la[..., :, None] > 0)).any(axis=(1, 2, 3)).mean()
    assert met >= 0.95
    sizes = np.unique(forest.leaves(x)[:, 0, 0], return_counts=True)[1]
    assert sizes.max() < 20 * len(x) / (1 << forest.depth)


@pytest.mark.parametrize("knot", [True, False])
def test_odd_vectors(spark, knot, monkeypatch):
    if knot:
        monkeypatch.setattr(vector_forest, "LEAF", 2)
    odd = [None, [], [0.0, 0.0], [math.nan, 1.0], [math.inf, 1.0], [None, 1.0], [1.0], [2.0], [-1.0], [1.0, 0.0], [1.0, 0.0], [-0.0, 1.0], [0.0, 1.0], [1e30, 0.0], [1.0, 0.0, 0.0], [1e-38, 0.0]]
    rows = list(enumerate(odd))
    got = {r.vec_id: (r.n_links, r.component_id) for r in result(spark, rows)}
    assert got == all_pairs(rows)
    twice = result(spark, [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.1]), (None, [0.0, 1.0]), (None, None)])
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in twice) == [(-1, 0, -1, False), (-1, 0, -1, False), (-1, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]
    assert result(spark, []) == []


def test_heavy_keys_lose_no_row(spark):
    from colloquy.llm.lookup import joined

    rows = spark.range(5000).select(F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id") % 1500).alias("k"), "id").union(spark.createDataFrame([(None, 1)], "k long, id long"))
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    assert joined(rows, table, "k", "n", 50_000_000).exceptAll(rows.join(table.drop("n"), "k")).count() == 0
    assert joined(rows, table, "k", "n", 50_000_000).count() == joined(rows, table, "k", "n", 1).count() == 5000
