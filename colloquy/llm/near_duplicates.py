"""Near duplicates by SimHash and MinHash candidates, confirmed by exact shingle similarity.

Texts meet whose SimHash fingerprints are linked as in op7 (four or fewer differing bits).
Bits of texts at similarity 0.8 differ too often for a small distance,
and a wide one makes nearly all pairs candidates. So texts also meet where all
minima of one of BANDS bands agree, and what meets is compared by its shingles
inside the bucket's task; only a spanning forest of the true links leaves it.
Buckets of equal members are compared once. A large bucket first compares each
block within itself and with the bucket's first text; only where that leaves
more than one group are its blocks dealt over pairs of blocks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import simhash
from colloquy.llm.components import components
from colloquy.llm.written import written

WORDS_IN_SHINGLE = 5
LEAST_LIKENESS = 0.8
#: A pair of likeness s is a candidate with probability 1 - (1 - s**ROWS)**BANDS: 0.9993 at 0.8, 0.02 at 0.3.
BANDS, ROWS = 24, 6
#: Texts of one block of a large bucket.
BLOCK_ROWS = 512
#: Texts to be compared up to which their hashes are broadcast (8 bytes a row); beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Shingles whose minima are taken at once.
PIECE = 4096

_DRAW = np.random.default_rng(11)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACE = _DRAW.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = (1 << 64) - 1


def shingle_hashes(text: bytes | None, words_in_shingle: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; fewer words are one shingle, no words none."""
    words = text.decode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    held = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    k = min(words_in_shingle, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        out += held[j : len(words) - k + 1 + j] * _PLACE[j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def band_keys(shingles: np.ndarray) -> list[int]:
    """A signed key of every band; texts without words share theirs."""
    least = np.full(BANDS * ROWS, _LAST, np.uint64)
    for at in range(0, len(shingles), PIECE):
        np.minimum(least, (_TIMES[:, None] * shingles[at : at + PIECE] + _PLUS[:, None]).min(axis=1), out=least)
    return [xxhash.xxh3_64_intdigest(b.tobytes()) - (1 << 63) for b in least.reshape(BANDS, ROWS)]


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the common shingles are at least that share of all; texts without words are alike."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(both) - common) - 1e-9


def spanning_links(nodes: list[int], texts: list[bytes], least: float, words_in_shingle: int = WORDS_IN_SHINGLE) -> list[tuple[int, int]]:
    """A spanning forest of the links among some texts; pairs that are connected already are not compared."""
    sets = [shingle_hashes(x, words_in_shingle) for x in texts]
    groups: list[list[int]] = []
    out = []
    for i in range(len(nodes)):
        joined, apart = [i], []
        for group in groups:
            other = next((j for j in group if alike(sets[i], sets[j], least)), None)
            if other is None:
                apart.append(group)
            else:
                out.append((nodes[i], nodes[other]))
                joined = group + joined
        groups = [*apart, joined]
    return out


def _keys_udf(words_in_shingle: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys(texts: pa.Array) -> pa.Array:
        return pa.array([band_keys(shingle_hashes(x.as_py(), words_in_shingle)) for x in texts.cast(pa.binary())], pa.list_(pa.int64()))

    return keys


def _links_in_tasks(least: float, words_in_shingle: int):
    """Task body: rows (key, pair, node, text) come sorted by key and pair; a bucket may span Arrow batches."""

    def work(batches):
        def rows():
            for batch in batches:
                for at in range(0, len(batch), 64):
                    part = batch.slice(at, 64)
                    yield from zip(*(part.column(i).to_pylist() for i in range(3)), part.column(3).cast(pa.binary()).to_pylist())

        for _, held in itertools.groupby(rows(), lambda r: r[:2]):
            bucket = list(held)
            found = spanning_links([r[2] for r in bucket], [r[3] for r in bucket], least, words_in_shingle)
            if found:
                yield pa.record_batch({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return work


def _verified(dealt: DataFrame, texts: DataFrame, least: float, words_in_shingle: int) -> DataFrame:
    rows = dealt.join(texts, "node").select("key", "pair", "node", "text").repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
    return written(rows.mapInArrow(_links_in_tasks(least, words_in_shingle), "a long, b long"), "verified")


def links(nodes: DataFrame, texts: DataFrame, least: float = LEAST_LIKENESS, words_in_shingle: int = WORDS_IN_SHINGLE) -> DataFrame:
    """(node, root) of the linked ``nodes`` (node, keys); ``texts`` (node, text) may repeat."""
    met = nodes.select("node", F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    sizes = met.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    buckets = sizes.groupBy("n", "first", "sum").agg(F.min("key").alias("key")).select("key", "n", "first")
    members = written(met.join(buckets, "key"), "members")
    asked = members.select("node").distinct()
    few = asked.count() <= BROADCAST_ROWS
    told = texts.join(F.broadcast(asked) if few else asked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    told = written(told, "texts")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")
    seats = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    near = _verified(members.select("key", "node", F.explode(seats).alias("pair")), told, least, words_in_shingle)
    large = members.where(F.col("n") > BLOCK_ROWS)
    if large.isEmpty():
        return components(near)
    roots = written(components(near), "roots")
    rooted = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: (F.greatest(o, own) * blocks + F.least(o, own)).cast("int"))
    far = _verified(large.join(mixed, "key").select("key", "node", F.explode(pairs).alias("pair")), told, least, words_in_shingle)
    return components(near.union(far))


def simhash_groups(nodes: DataFrame) -> DataFrame:
    """(fp, group): every different fingerprint of ``nodes`` and one of those it is linked to, directly or by others."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "near-prints")
    roots = components(simhash.links(prints))
    return prints.select("fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("group"))


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST_LIKENESS, words_in_shingle: int = WORDS_IN_SHINGLE) -> DataFrame:
    """One row per document: its id and ``component_id``, the smallest id of its group.

    Groups are what links of pairs reach whose different shingles are common by
    at least ``least``. Null, empty and blank texts are alike. Repeated rows each
    get their row. Rows with a null id join groups, yet name none: a group of
    null ids only has a null component. An empty table gives none.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("node"), body.alias("text"))
    ids = bare.select("doc_id", "node")
    told = simhash.with_simhash(bare.withColumn("keys", _keys_udf(words_in_shingle)(F.col("text"))))
    nodes = written(told.select("doc_id", "node", "keys", "fp").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "nodes")
    # The SimHash group is one more band: its members meet and are compared as those of a MinHash bucket.
    nodes = nodes.join(simhash_groups(nodes), "fp").select("node", "least", F.concat("keys", F.array("group")).alias("keys"))
    roots = links(nodes.select("node", "keys"), bare.select("node", "text"), least, words_in_shingle)
    reached = written(nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "reached")
    named = reached.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = reached.join(named, "root").select("node", "component_id")
    return ids.join(by_node, "node").select("doc_id", "component_id")
