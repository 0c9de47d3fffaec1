"""Near-duplicate vectors found by a forest of random-projection trees.

Every tree splits the vectors recursively along random directions at the median
of a bounded sample in which linked vectors count once; beyond the sample's depth a node splits at the projection
of its centre. A vector near a split goes down both sides (spill overlap), to at
most LEAVES leaves of a tree. Vectors are compared where they share a leaf. The
forest has as many trees as planted partners at exactly the least cosine need
to be found with probability RECALL.

A pair is counted in the first leaf that both share, which the leaves that
travel with each vector tell, so a leaf's task writes counts and a spanning
forest and never its pairs.

Equal vectors are compared once. A crowded leaf of the first tree is searched
for knots: vectors within half the link angle of a common centre, which are
therefore all linked with each other. A knot takes part as its centre with its
radius: what is surely linked with all its members, or with none, is told from
the centre; only what may be linked with some is compared with its members.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.components import components
from colloquy.llm.lookup import joined
from colloquy.llm.written import written

LEAST_COSINE = 0.9
#: Vectors a leaf should hold, and of one block of a larger leaf.
LEAF, BLOCK_ROWS = 1024, 2048
#: Vectors the splits are fitted on, the depth they can tell, and the planted partners that the number of trees is fitted on.
SAMPLE, SAMPLE_DEPTH, PLANTED = 8192, 8, 512
#: Leaves of a tree that one vector may be in, and the share of the sample that a split's overlap takes.
LEAVES, OVERLAP = 3, 0.25
RECALL, MOST_TREES = 0.99, 48
#: Vectors of a crowded leaf that its knots are looked for in, and the share of them that a knot must hold.
KNOT_SAMPLE, KNOT_SHARE, MOST_KNOTS = 256, 0.1, 8
#: Small tables (leaves above a block, knots) up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 20_000
#: Angles are told apart to this; nearer ones are compared by their vectors.
SLACK = 1e-6


class Forest:
    """Directions and thresholds of all trees: a few MB, whatever the number of vectors."""

    def __init__(self, sample: np.ndarray, total: int, least: float, seed: int = 11):
        thin = thinned(sample, least)
        self.depth = max(0, math.ceil(math.log2(max(total * len(thin) / max(len(sample), 1), 1) / LEAF)))
        sample = thin
        self.fitted = min(self.depth, SAMPLE_DEPTH, max(0, int(math.log2(max(len(sample), 1) / 16))))
        self.trees: list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]] = []
        if self.depth > 28:
            raise ValueError("more vectors than leaf numbers of 30 bits can tell apart")
        rng = np.random.default_rng(seed)
        x, y = planted(sample[: PLANTED], least, rng)
        missed = 1.0
        while len(self.trees) < (1 if not self.depth else MOST_TREES):
            self.trees.append(self._tree(sample, rng))
            last = len(self.trees) - 1
            a, b = self.leaves(x, [last]), self.leaves(y, [last])
            share = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)).any(axis=(1, 2)).mean() if len(x) else 1.0
            missed *= 1 - share
            if not len(x) or missed <= 1 - RECALL:
                break

    def _tree(self, sample, rng):
        """Directions (dimensions x depth), thresholds and overlaps of the nodes of every level."""
        ways = rng.standard_normal((sample.shape[1], self.depth))
        ways /= np.maximum(np.linalg.norm(ways, axis=0), 1e-30)
        at = sample @ ways
        code = np.zeros(len(sample), np.int64)
        cuts, overlaps = [], []
        for level in range(self.depth):
            nodes = 1 << min(level, self.fitted)
            cut, overlap = np.zeros(nodes), np.zeros(nodes)
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(nodes + 1))
            for node in range(nodes):
                p = at[order[edges[node] : edges[node + 1]], level]
                if len(p):
                    cut[node] = np.median(p) if level < self.fitted else p.mean()
                    overlap[node] = np.quantile(np.abs(p - cut[node]), OVERLAP)
            cuts.append(cut)
            overlaps.append(overlap)
            if level < self.fitted:
                code = 2 * code + (at[:, level] > cut[code])
        return ways, cuts, overlaps

    def _down(self, at, cuts, overlaps, level, code):
        """From nodes ``code`` of a level to the leaves, and how near each split was in units of its overlap."""
        near = np.full((len(code), self.depth), np.inf)
        for step in range(level, self.depth):
            node = code >> max(step - self.fitted, 0)
            off = at[:, step] - cuts[step][node]
            near[:, step] = np.abs(off) / np.maximum(overlaps[step][node], 1e-30)
            code = 2 * code + (off > 0)
        return code, near

    def leaves(self, vectors: np.ndarray, trees=None) -> np.ndarray:
        """Leaf numbers (from 1; 0 for none) of each vector: LEAVES a tree, its own leaf first."""
        trees = range(len(self.trees)) if trees is None else trees
        out = np.zeros((len(vectors), len(trees), LEAVES), np.int32)
        for i, tree in enumerate(trees):
            ways, cuts, overlaps = self.trees[tree]
            at = vectors[:, : len(ways)] @ ways[: vectors.shape[1]]
            own, near = self._down(at, cuts, overlaps, 0, np.zeros(len(vectors), np.int64))
            out[:, i, 0] = own + 1
            levels = np.argsort(near, axis=1, kind="stable")[:, : LEAVES - 1]
            for j in range(levels.shape[1]):
                level = levels[:, j]
                over = np.flatnonzero(near[np.arange(len(near)), level] <= 1)
                for step in np.unique(level[over]):
                    rows = over[level[over] == step]
                    other = (own[rows] >> (self.depth - step - 1)) ^ 1
                    out[rows, i, j + 1] = self._down(at[rows], cuts, overlaps, step + 1, other)[0] + 1
        return out


def thinned(vectors: np.ndarray, least: float, step: int = 512) -> np.ndarray:
    """The vectors that no earlier one is linked with, so that splits part the space between groups and not a group of many copies."""
    kept = vectors[:0]
    for at in range(0, len(vectors), step):
        part = vectors[at : at + step]
        part = part[~(part @ kept.T >= least).any(axis=1)]
        kept = np.concatenate((kept, part[~np.tril(part @ part.T >= least, -1).any(axis=1)]))
    return kept


def planted(vectors: np.ndarray, cosine: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and for each a partner at exactly that cosine, in a random direction."""
    if not len(vectors) or vectors.shape[1] < 2:
        return vectors[:0], vectors[:0]
    aside = rng.standard_normal(vectors.shape)
    aside -= (aside * vectors).sum(axis=1, keepdims=True) * vectors
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-30)
    return vectors, cosine * vectors + math.sqrt(1 - cosine * cosine) * aside


def _stacked(column: pa.Array):
    """(rows, matrix) for each number of dimensions of an Arrow list column: its vectors scaled to length 1, in double precision."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    ends = column.offsets.to_numpy()
    size = np.diff(ends)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        x = flat[ends[rows][:, None] + np.arange(d)]
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def units(column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0)] * len(column)
    for rows, x in _stacked(column):
        for i, v in zip(rows.tolist(), x):
            out[i] = v
    return out


def _leaves_udf(forest: Forest):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def leaves(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), len(forest.trees) * LEAVES), np.int32)
        for rows, x in _stacked(column):
            out[rows] = forest.leaves(x).reshape(len(rows), -1)
        return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.int32()))

    return leaves


def _knots_udf(half: float):
    @F.arrow_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def knots(groups: pa.Array) -> pa.Array:
        out = []
        for group in groups:
            rest = next(_stacked(group.values))[1]  # one number of dimensions
            least, centres = max(2, KNOT_SHARE * len(rest)), []
            while len(rest) >= least and len(centres) < MOST_KNOTS:
                near = rest @ rest.T >= math.cos(half)
                first = near[near.sum(axis=1).argmax()]
                centre = rest[first].mean(axis=0).astype(np.float32).astype(np.float64)
                centre /= np.linalg.norm(centre)
                held = rest @ centre >= math.cos(half)
                if first.sum() < least or held.sum() < least:
                    break
                centres.append(centre.astype(np.float32))
                rest = rest[~held]
            out.append(centres)
        return pa.array(out, pa.list_(pa.list_(pa.float32())))

    return knots


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _nearest_udf(half: float):
    """Which centre lies within half the link angle, and its angle; -1 for none."""
    @F.arrow_udf(T.StructType([T.StructField("knot", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    def nearest(vectors: pa.Array, centres: pa.Array) -> pa.Array:
        knot, angle = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
        for i, x in enumerate(units(vectors)):
            if len(centres[i].values or []):
                off = _angle(np.array(units(centres[i].values)) @ x)
                if off.min() <= half - SLACK:
                    knot[i], angle[i] = off.argmin(), off.min()
        return pa.StructArray.from_arrays([pa.array(knot), pa.array(angle)], ["knot", "angle"])

    return nearest


def spanning(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of links between 0 .. size - 1."""
    label = np.arange(size)
    while True:
        la, lb = label[a], label[b]
        if not (la != lb).any():
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label != label[label]).any():
            label = label[label]
    linked = np.flatnonzero(label != np.arange(size))
    return linked, label[linked]


def _first_here(mine: np.ndarray, other: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Of pairs of leaf tables (pairs x trees x LEAVES): those whose first shared leaf is this one."""
    fits = np.ones(len(mine), bool)
    for t in range(tree + 1):
        rows = np.flatnonzero(fits)
        a, b = mine[rows, t], other[rows, t]
        shared = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)).any(axis=2)
        if t < tree:
            fits[rows] = ~shared.any(axis=1)
        else:
            fits[rows] = np.where(shared, a, np.iinfo(np.int32).max).min(axis=1) == leaf
    return fits


_FOUND = "kind int, a long, b long, n long"
_COUNT, _LINK, _UNSURE = 0, 1, 2


def _found(kind: int, a, b, n) -> pa.RecordBatch:
    return pa.record_batch({"kind": pa.array(np.full(len(a), kind), pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def _compared(group: dict, tree: int, leaf: int, apart: bool, least: float):
    """Links among the rows of one leaf; ``apart``: only between its two blocks."""
    x, m, rho, node, own, leaves = (group[k] for k in ("x", "m", "rho", "node", "own", "leaves"))
    count, link = np.zeros(len(x), np.int64), math.acos(least)
    sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, (1 << 21) // max(len(x), 1))
    for at in range(0, len(x), step):
        cosine = x[at : at + step] @ x[at:].T
        limit = least if not rho.any() else np.where(rho[at : at + step, None] + rho[None, at:] > 0, np.cos(np.minimum(np.pi, link + rho[at : at + step, None] + rho[None, at:] + SLACK)), least)
        i, j = np.nonzero(np.triu(cosine >= limit, 1))
        if not len(i):
            continue
        cosine, i, j = cosine[i, j], i + at, j + at
        for part in range(0, len(i), 1 << 18):
            a, b, c = (v[part : part + (1 << 18)] for v in (i, j, cosine))
            fits = _first_here(leaves[a], leaves[b], tree, leaf)
            if apart:
                fits &= own[a] != own[b]
            a, b, c = a[fits], b[fits], c[fits]
            wide = rho[a] + rho[b]
            sure = (wide == 0) | (_angle(c) + wide <= link - SLACK)
            np.add.at(count, a[sure], m[b[sure]])
            np.add.at(count, b[sure], m[a[sure]])
            if not sure.all():
                # the wider knot is the one whose members are looked at
                a2, b2 = a[~sure], b[~sure]
                swap = rho[a2] > rho[b2]
                yield _found(_UNSURE, node[np.where(swap, b2, a2)], node[np.where(swap, a2, b2)], np.zeros(len(a2)))
            sums = tuple(np.concatenate(z) for z in zip(sums, spanning(a[sure], b[sure], len(x))))
            if len(sums[0]) > 1 << 20:
                sums = spanning(*sums, len(x))
    rows = np.flatnonzero(count)
    if len(rows):
        yield _found(_COUNT, node[rows], node[rows], count[rows])
        a, b = spanning(*sums, len(x))
        yield _found(_LINK, node[a], node[b], np.zeros(len(a)))


def _grouped(batches, keys: int):
    """(key, rows) of runs of equal leading columns; a run may span Arrow batches."""
    key, held = None, []
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in itertools.pairwise([0, *change.tolist(), len(batch)]):
            if a == b:
                continue
            now = tuple(int(c[a]) for c in columns)
            if now != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _one(table, name):
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _leaf_tasks(least: float):
    def work(batches):
        for (tree, _, leaf, pair), rows in _grouped(batches, 4):
            if len(rows) < 2:
                continue
            leaves = _one(rows, "leaves")
            flat = leaves.values.to_numpy()[leaves.offsets[0].as_py() : leaves.offsets[-1].as_py()]
            group = {k: _one(rows, k).to_numpy() for k in ("m", "rho", "node", "own")} | {"x": next(_stacked(_one(rows, "embedding")))[1], "leaves": flat.reshape(len(rows), -1, LEAVES)}
            blocks = int(rows.column("blocks")[0].as_py() or 1)
            yield from _compared(group, tree, leaf, pair // blocks != pair % blocks, least)

    return work


def _member_tasks(least: float):
    """Links between outer vectors (side 0) and members of a knot (side 1); every pair meets in one group."""
    def work(batches):
        for _, rows in _grouped(batches, 3):
            side, node, m, entity = (_one(rows, k).to_numpy() for k in ("side", "node", "m", "entity"))
            x = next(_stacked(_one(rows, "embedding")))[1]
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                continue
            count = np.zeros(len(x), np.int64)
            links: set[tuple[int, int]] = set()
            for at in range(0, len(a), 512):
                mine = a[at : at + 512]
                i, j = np.nonzero(x[mine] @ x[b].T >= least)
                np.add.at(count, mine[i], m[b[j]])
                np.add.at(count, b[j], m[mine[i]])
                links.update(zip(entity[mine[i]].tolist(), entity[b[j]].tolist()))
            held = np.flatnonzero(count)
            if len(held):
                yield _found(_COUNT, node[held], node[held], count[held])
                yield _found(_LINK, [x for x, _ in links], [x for _, x in links], np.zeros(len(links)))

    return work


def _small(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast where it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _with_knots(nodes: DataFrame, least: float) -> DataFrame:
    """``nodes`` (node, m, least, embedding, leaves) with ``entity``, ``centre`` and ``angle``: its knot's, or itself with null and 0."""
    half = math.acos(least) / 2
    first = F.element_at("leaves", 1)
    by_leaf = nodes.select(F.size("embedding").alias("dim"), first.alias("leaf"), "node", "embedding", "m", "least", "leaves")
    crowded = by_leaf.groupBy("dim", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * LEAF)
    crowded = written(crowded, "crowded-leaves")
    alone = [F.col("node").alias("entity"), F.lit(None).cast("array<float>").alias("centre"), F.lit(0.0).alias("angle")]
    if crowded.isEmpty():
        return nodes.select("node", "m", "least", "embedding", "leaves", *alone)
    met = by_leaf.join(_small(crowded), ["dim", "leaf"])
    # about KNOT_SAMPLE vectors of each crowded leaf, chosen by a hash of the node
    picked = met.where(F.pmod(F.xxhash64("node", F.lit(3)), F.col("n")) < KNOT_SAMPLE).groupBy("dim", "leaf").agg(F.collect_list("embedding").alias("some"))
    knots = written(picked.select("dim", "leaf", _knots_udf(half)(F.col("some")).alias("centres")).where(F.size("centres") > 0), "knots")
    told = by_leaf.join(_small(knots), ["dim", "leaf"], "left").withColumn("near", _nearest_udf(half)(F.col("embedding"), F.coalesce("centres", F.array().cast("array<array<float>>"))))
    knot = F.col("near.knot")
    told = written(told.select("dim", "leaf", "node", "m", "least", "embedding", "leaves", knot.alias("knot"), F.when(knot >= 0, F.element_at("centres", knot + 1)).alias("centre"), F.col("near.angle").alias("angle")), "knotted")
    # a knot is named by its smallest member
    names = told.where("knot >= 0").groupBy("dim", "leaf", "knot").agg(F.min("node").alias("entity"))
    named = told.join(_small(names), ["dim", "leaf", "knot"], "left")
    return named.select("node", "m", "least", "embedding", "leaves", F.coalesce("entity", "node").alias("entity"), "centre", "angle")


def _dealt_leaves(entities: DataFrame) -> DataFrame:
    """Rows of every leaf that an entity is in; leaves above a block are dealt over pairs of blocks."""
    at = F.posexplode("leaves").alias("turn", "leaf")
    places = entities.select("node", F.size("embedding").alias("dim"), at).where("leaf > 0").select("node", "dim", F.floor(F.col("turn") / LEAVES).cast("int").alias("tree"), "leaf")
    large = written(places.groupBy("tree", "dim", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK_ROWS).select("tree", "dim", "leaf", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "large-leaves")
    rows = entities.select("*", F.size("embedding").alias("dim"), at).where("leaf > 0").withColumn("tree", F.floor(F.col("turn") / LEAVES).cast("int"))
    rows = rows.join(_small(large), ["tree", "dim", "leaf"], "left")
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0)).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.greatest(o, F.col("own")) * F.col("blocks") + F.least(o, F.col("own"))).cast("int")))
    rows = rows.withColumn("own", own).select("tree", "dim", "leaf", F.explode(pairs).alias("pair"), "own", "blocks", "node", "m", "rho", "leaves", "embedding")
    return rows.repartition("tree", "dim", "leaf", "pair").sortWithinPartitions("tree", "dim", "leaf", "pair")


def _with_members(unsure: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """What entities ``a`` have in common with the members of the knots ``b``, compared vector by vector in blocks."""
    sizes = members.groupBy("entity").agg(F.count("*").alias("size"))
    outer = unsure.join(members.withColumnRenamed("entity", "a"), "a").select(F.col("b").alias("knot"), F.col("a").alias("entity"), "node", "m", "embedding")
    outer = written(outer, "unsure")
    asked = outer.groupBy("knot").agg(F.count("*").alias("outer")).join(sizes.withColumnRenamed("entity", "knot"), "knot")
    asked = asked.select("knot", F.ceil(F.col("outer") / BLOCK_ROWS).cast("int").alias("rows"), F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("columns"))
    asked = _small(written(asked, "asked"))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = outer.join(asked, "knot").select("knot", own("rows").alias("i"), every("columns").alias("j"), F.lit(0).alias("side"), "node", "m", "entity", "embedding")
    inner = members.join(asked.withColumnRenamed("knot", "entity"), "entity").select(F.col("entity").alias("knot"), every("rows").alias("i"), own("columns").alias("j"), F.lit(1).alias("side"), "node", "m", "entity", "embedding")
    dealt = left.unionByName(inner).repartition("knot", "i", "j").sortWithinPartitions("knot", "i", "j")
    return written(dealt.mapInArrow(_member_tasks(least), _FOUND), "members-compared")


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    ``n_links`` counts the other rows found with a cosine of at least ``least``
    (0 < least < 1), ``component_id`` is the smallest id that links reach.
    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, and so do vectors of different lengths. Equal vectors are
    all linked. Rows that share an id each get their row; a row without an id
    joins a group, names none, and is not kept. An empty table gives none.
    Ids are integers; further columns are not looked at.
    """
    at = F.col(embedding)
    wrong = F.exists(at, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    fit = F.coalesce(at.isNotNull() & ~wrong & F.exists(at, lambda v: v != 0), F.lit(False))
    bare = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), at.alias("embedding"), fit.alias("fit"))
    bare = bare.withColumn("node", F.when(F.col("fit"), F.xxhash64("embedding")))
    ids = written(bare.select("vec_id", "node"), "vectors")
    nodes = bare.where("fit").groupBy("node").agg(F.count("*").alias("m"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"))
    nodes = written(nodes, "vector-nodes")
    total = nodes.count()
    lone = ids.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    if not total:
        return lone.select("*", kept)
    forest = Forest(_sample(nodes, total), total, least)
    coded = written(nodes.select("node", "m", "least", "embedding", _leaves_udf(forest)(F.col("embedding")).alias("leaves")), "vector-leaves")
    members = written(_with_knots(coded, least), "vector-entities")

    singles = members.where("centre is null").select("node", "m", F.lit(0.0).alias("rho"), "leaves", "embedding")
    knots = members.where("centre is not null").groupBy("entity").agg(F.sum("m").alias("m"), F.max("angle").alias("rho"), F.first("centre").alias("embedding"))
    knots = written(knots.withColumnRenamed("entity", "node"), "vector-knots")
    of_knots = knots.select("node", "m", (F.col("rho") + SLACK).alias("rho"), _leaves_udf(forest)(F.col("embedding")).alias("leaves"), F.col("embedding").cast(coded.schema["embedding"].dataType).alias("embedding"))
    found = written(_dealt_leaves(singles.unionByName(of_knots)).mapInArrow(_leaf_tasks(least), _FOUND), "vector-links")
    unsure = found.where(F.col("kind") == _UNSURE).select("a", "b")
    links = found.where(F.col("kind") == _LINK).select("a", "b")
    entity_n = found.where(F.col("kind") == _COUNT).groupBy(F.col("a").alias("entity")).agg(F.sum("n").alias("entity_n"))
    by_node = members.select("node", "m", "entity")
    if unsure.isEmpty():
        by_node = by_node.withColumn("node_n", F.lit(0).cast("long"))
    else:
        more = _with_members(unsure, members.select("entity", "node", "m", "embedding"), least)
        links = links.union(more.where(F.col("kind") == _LINK).select("a", "b"))
        node_n = more.where(F.col("kind") == _COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("node_n"))
        by_node = by_node.join(node_n, "node", "left")

    entities = members.groupBy("entity").agg(F.count("*").alias("of_entity"), F.sum("m").alias("entity_m"), F.min("least").alias("least"))
    entities = entities.join(entity_n, "entity", "left").join(components(links).withColumnRenamed("node", "entity"), "entity", "left")
    entities = written(entities.withColumn("root", F.coalesce("root", "entity")), "vector-roots")
    groups = written(entities.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("of_root")), "vector-groups")
    told = joined(entities, groups, "root", "of_root", entities.count()).select("entity", "of_entity", "entity_m", "entity_n", "component_id")
    by_node = joined(written(by_node, "vector-members"), written(told, "vector-told"), "entity", "of_entity", total)
    n_links = F.col("entity_m") - 1 + F.coalesce("entity_n", F.lit(0)) + F.coalesce("node_n", F.lit(0))
    by_node = written(by_node.select("node", "m", n_links.alias("n_links"), "component_id"), "vector-results")
    return joined(ids, by_node, "node", "m", ids.count()).drop("node").unionByName(lone).select("*", kept)


def _sample(nodes: DataFrame, total: int) -> np.ndarray:
    """At most about SAMPLE unit vectors, chosen by a hash; shorter ones are filled up with zeros."""
    some = nodes.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(total)) < SAMPLE).select("embedding").limit(2 * SAMPLE).toArrow()
    held = units(some.column(0).combine_chunks()) if len(some) else []
    out = np.zeros((len(held), max((len(x) for x in held), default=1)))
    for row, x in zip(out, held):
        row[: len(x)] = x
    return out
