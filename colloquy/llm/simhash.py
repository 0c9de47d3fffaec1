"""SimHash near-copies found by the generalised pigeonhole principle.

The 64 bits are dealt to a few parts, bits that vary together into one part.
Thresholds t_i with sum(t_i) = distance - parts + 1 lose no pair: a pair
within the distance is within t_i in some part i. A dynamic programme over
expected candidate counts chooses the thresholds, and the number of parts is
the cheapest of those tried. Two fingerprints are within t in a part exactly
if they agree there once some t bits are masked, so every fingerprint has one
row per mask, and rows with the same mask and key are candidates. A bucket's
candidates are compared inside its task, block by block, and only a spanning
forest of the true links leaves it; large buckets are dealt over pairs of
blocks, so no bucket is one task and no pair table is written.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.components import components
from colloquy.llm.written import written

BITS = 64
#: Seconds that a mask row and a compared pair cost, for choosing a plan.
ROW_COST, PAIR_COST = 2e-6, 6e-9
#: Rows of one block of a large bucket.
BLOCK_ROWS = 1024
#: Hot buckets up to which their table is broadcast (24 bytes a row); beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000
SEED = 42


def _bits_over_half(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        piece = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def text_simhash(text: bytes | None, words_in_shingle: int = 4) -> int:
    """Signed 64-bit SimHash of one text: repeats count; null, empty and blank texts give 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_in_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return _bits_over_half(np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8"))


def _fingerprint_udf(words_in_shingle: int):
    @F.arrow_udf(T.LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([text_simhash(x.as_py(), words_in_shingle) for x in texts.cast(pa.binary())], pa.int64())

    return simhash


def with_simhash(docs: DataFrame, text: str = "text", words_in_shingle: int = 4, to: str = "fp") -> DataFrame:
    """``docs`` with its SimHash in a new column ``to``."""
    return docs.withColumn(to, _fingerprint_udf(words_in_shingle)(F.col(text)))


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have both bits i and j set, over all of them."""

    def count(batches):
        total, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            rows = batch.column(0).to_numpy().astype("<i8")
            for at in range(0, len(rows), 1 << 14):
                bits = np.unpackbits(rows[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
                total += len(bits)
        if total:
            yield pa.record_batch({"cell": np.arange(BITS * BITS + 1, dtype=np.int32), "n": np.append(both.ravel(), total)})

    found = prints.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for cell, n in found:
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_order(total: int, both: np.ndarray) -> list[int]:
    """Bits in a chain, each followed by the free bit it is most correlated with."""
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, -1)
    chain = [int(np.unravel_index(np.argmax(corr), corr.shape)[0])]
    free = set(range(BITS)) - set(chain)
    while free:
        nxt = max(sorted(free), key=lambda b: corr[chain[-1], b])
        chain.append(nxt)
        free.remove(nxt)
    return chain


def bucket_pairs(total: int, p: np.ndarray, part: list[int], t: int) -> float:
    """Expected candidate pairs of a part with t bits masked, over all its masks, from each bit's share of ones.

    A pair meets under a mask if all its kept bits agree; the sum over masks is
    the elementary symmetric polynomial of the bits that are left out.
    """
    poly = np.zeros(t + 1)
    poly[0] = 1.0
    for b in part:
        agree = 1 - 2 * p[b] * (1 - p[b])
        shifted = np.concatenate(([0.0], poly[:-1]))
        poly = poly * agree + shifted
    return float(poly[t]) * total * (total - 1) / 2


def plan(total: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the cheapest parts; parts of threshold -1 are never probed and left out."""
    p = np.diag(both) / max(total, 1)
    order = correlated_order(total, both)
    best: tuple[float, list] = (math.inf, [])
    for m in range(1, distance + 2):
        cuts = [round(i * BITS / m) for i in range(m + 1)]
        parts = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        top = distance - m + 1
        cost = []
        for part in parts:
            cost.append([0.0] + [total * math.comb(len(part), t) * ROW_COST + bucket_pairs(total, p, part, t) * PAIR_COST for t in range(top + 1)])
        # left[s]: cheapest way to spend s = sum(t_i + 1) over the parts so far
        left: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part, costs in zip(parts, cost):
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (c, ts) in left.items():
                for t in range(-1, top + 1):
                    s = spent + t + 1
                    if s <= distance + 1 and (s not in step or c + costs[t + 1] < step[s][0]):
                        step[s] = (c + costs[t + 1], [*ts, t])
            left = step
        c, ts = left[distance + 1]
        if c < best[0]:
            best = (c, [(part, t) for part, t in zip(parts, ts) if t >= 0])
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def masks(parts: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """(part, mask) for every choice of t bits to leave out of a part of threshold t."""
    out = []
    for i, (bits, t) in enumerate(parts):
        for gone in itertools.combinations(bits, t):
            out.append((i, _signed(sum(1 << b for b in bits if b not in gone))))
    return out


def _hot_buckets(prints: DataFrame, parts, keep) -> DataFrame:
    """(mask, key, blocks) of the buckets above BLOCK_ROWS, summed from the exact keys of their part."""
    whole = [_signed(sum(1 << b for b in bits)) for bits, _ in parts]
    exact = prints.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(w)).alias("exact")) for i, w in enumerate(whole)])).alias("x")).select("x.*")
    least = BLOCK_ROWS // max(2**t for _, t in parts)
    hot = exact.groupBy("part", "exact").agg(F.count("*").alias("n")).where(F.col("n") > max(1, least // 2))
    by_part = [F.array(*[F.struct(F.lit(m).alias("mask"), F.col("exact").bitwiseAND(F.lit(w)).alias("key")) for m, (i, w) in enumerate(keep) if i == k]) for k in range(len(parts))]
    masked = hot.select("n", F.explode(F.element_at(F.array(*by_part), F.col("part") + 1)).alias("x")).select("x.*", "n")
    sizes = masked.groupBy("mask", "key").agg(F.sum("n").alias("n"))
    return sizes.where(F.col("n") > BLOCK_ROWS).select("mask", "key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))


def forest(group: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their roots: a spanning forest of the links inside groups of neighbouring rows."""
    label = np.arange(len(group))
    rows = np.arange(len(group))
    a_held: list[np.ndarray] = []
    b_held: list[np.ndarray] = []
    held, step = 0, 0

    def fold() -> None:
        nonlocal label
        a, b = np.concatenate(a_held), np.concatenate(b_held)
        while True:
            la, lb = label[a], label[b]
            if not (la != lb).any():
                return
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            while (label != label[label]).any():
                label = label[label]

    while True:
        step += 1
        rows = rows[rows + step < len(group)]
        rows = rows[group[rows + step] == group[rows]]
        if not len(rows):
            break
        near = np.bitwise_count(prints[rows] ^ prints[rows + step]) <= distance
        if near.any():
            a_held.append(rows[near])
            b_held.append(rows[near] + step)
            held += int(near.sum())
        if held > 1_000_000:
            fold()
            a_held, b_held, held = [], [], 0
    if held:
        fold()
    linked = np.flatnonzero(label != np.arange(len(group)))
    return linked, label[linked]


def _links_in_buckets(distance: int):
    """Task body: rows come sorted by bucket; a bucket may span Arrow batches."""

    def work(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                rest = now if rest is None else [np.concatenate((x, y)) for x, y in zip(rest, now)]
            if rest is None or not len(rest[0]):
                continue
            mask, key, pair, fp = rest
            change = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
            group = np.concatenate(([0], np.cumsum(change)))
            end = len(group) if batch is None else int(np.searchsorted(group, group[-1]))
            if end:
                prints = fp[:end].astype(np.uint64)
                row, root = forest(group[:end], prints, distance)
                if len(row):
                    yield pa.record_batch({"a": fp[row], "b": fp[root]})
            rest = [x[end:] for x in rest]

    return work


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs within ``distance``."""
    total, both = bit_statistics(prints)
    if total < 2:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    parts = plan(total, both, distance)
    keep = masks(parts)
    hot = written(_hot_buckets(prints, parts, keep), "hot-buckets")
    few = hot.count() <= BROADCAST_ROWS
    rows = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(w)).alias("key")) for m, (_, w) in enumerate(keep)])).alias("x")).select("x.*", "fp")
    rows = rows.join(F.broadcast(hot) if few else hot, ["mask", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.greatest(o, own) * F.col("blocks") + F.least(o, own)).cast("int"))
    )
    dealt = rows.select("mask", "key", F.explode(pairs).alias("pair"), "fp").repartition("mask", "key", "pair").sortWithinPartitions("mask", "key", "pair")
    return dealt.mapInArrow(_links_in_buckets(distance), "a long, b long")


def near_copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_in_shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``, the smallest id of its group.

    Groups are what links of at most ``distance`` differing bits reach. Null,
    empty and blank texts have the fingerprint 0 and group like any other.
    Repeated rows each get their row. Rows with a null id join groups, yet name
    none: a group of null ids only has a null component. An empty table gives none.
    """
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = written(with_simhash(bare, words_in_shingle=words_in_shingle).select("doc_id", "fp"), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = components(links(distinct, distance))
    reached = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = reached.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = reached.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")
