"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible. Groups sorted by size, the largest
first, go into the bin of the tightest remaining capacity that still holds
them, found in a balanced tree of the bins. For a given number of shards the
capacity is the smallest at which the packing needs no more of them.

Groups of at least 1/FINE of a shard are packed one by one: there are fewer
than FINE times the shards. Smaller groups are first poured by the hash of their
text into LOTS parcels a shard, which are packed as wholes. So what is packed is
bounded by the number of shards, however many documents there are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.written import written

FINE = 1024
LOTS = 256
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Rows about that one task numbers.
SLOT_ROWS = 20_000


class Bins:
    """Bins by remaining capacity in an AA tree; equal capacities by bin number."""

    def __init__(self):
        self.left, self.right, self.level, self.key = [0], [0], [0], [None]
        self.root = 0

    def _skew(self, t: int) -> int:
        a = self.left[t]
        if t and self.level[a] == self.level[t]:
            self.left[t], self.right[a] = self.right[a], t
            return a
        return t

    def _split(self, t: int) -> int:
        r = self.right[t]
        if t and self.level[self.right[r]] == self.level[t]:
            self.right[t], self.left[r] = self.left[r], t
            self.level[r] += 1
            return r
        return t

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def _add(self, t: int, key) -> int:
        if not t:
            self.left.append(0)
            self.right.append(0)
            self.level.append(1)
            self.key.append(key)
            return len(self.key) - 1
        side = self.left if key < self.key[t] else self.right
        side[t] = self._add(side[t], key)
        return self._split(self._skew(t))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Smallest (remaining, bin) with remaining >= size."""
        t, found = self.root, None
        while t:
            if self.key[t] >= (size, -1):
                t, found = self.left[t], self.key[t]
            else:
                t = self.right[t]
        return found

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, t: int, key) -> int:
        if not t:
            return t
        if key == self.key[t]:
            if not self.left[t] and not self.right[t]:
                return 0
            side, towards = (self.right, self.left) if self.right[t] else (self.left, self.right)
            s = side[t]
            while towards[s]:
                s = towards[s]
            self.key[t] = self.key[s]
            side[t] = self._remove(side[t], self.key[s])
        elif key < self.key[t]:
            self.left[t] = self._remove(self.left[t], key)
        else:
            self.right[t] = self._remove(self.right[t], key)
        return self._balanced(t)

    def _balanced(self, t: int) -> int:
        least = min(self.level[self.left[t]], self.level[self.right[t]]) + 1
        if least < self.level[t]:
            self.level[t] = least
            if self.right[t] and self.level[self.right[t]] > least:
                self.level[self.right[t]] = least
        t = self._skew(t)
        r = self._skew(self.right[t])
        if t:
            self.right[t] = r
        if r:
            self.right[r] = self._skew(self.right[r])
        t = self._split(t)
        if t:
            self.right[t] = self._split(self.right[t])
        return t


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each size; a size over the capacity gets a bin of its own. Ties go by position and by bin number. None beyond ``most`` bins."""
    bins, n, out = Bins(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = bins.tightest(sizes[i])
        if fit is None:
            out[i], left = n, capacity - sizes[i]
            n += 1
            if most is not None and n > most:
                return None
        else:
            bins.remove(fit)
            out[i], left = fit[1], fit[0] - sizes[i]
        if left >= 0:
            bins.add((left, out[i]))
    return out


def even_bins(sizes: list[int], shards: int) -> list[int]:
    """Bin of each size, at most ``shards`` bins, at about the smallest capacity (to a ten-thousandth) for which the packing needs no more."""
    if not sizes:
        return []
    rest, room = sum(sizes), shards
    for size in sorted(sizes, reverse=True):  # sizes over the even share of what is left have bins of their own
        if room == 1 or size * room <= rest:
            break
        rest, room = rest - size, room - 1
    low, high, best = max(1, -(-rest // room)), max(sum(sizes), 1), [0] * len(sizes)
    step = low // 10_000 + 1
    reach = low
    while (found := best_fit_decreasing(sizes, reach, shards)) is None:
        low, reach = reach + 1, min(high, reach + step)
        step *= 2
    best, high = found, reach
    while high - low > low // 10_000:
        middle = (low + high) // 2
        if (found := best_fit_decreasing(sizes, middle, shards)) is None:
            low = middle + 1
        else:
            best, high = found, middle
    return best


def pack(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes (null: none) plus ROW_BYTES. Equal texts
    share a shard; a null text counts as an empty one. A group over a shard's
    even share gets one of its own. Shards number from 0, the largest first; slots
    number the rows of a shard from 0 without gaps. Repeated rows each have a slot.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # two independent hashes name a text: 128 bits
    bare = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit("text"), body).alias("k2"))
    rows = written(bare, "sizes")
    groups = rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = max(total[0] // shards, 1)
    least = max(share // FINE, 1)
    lots = LOTS * shards
    alone = F.col("bytes") >= least
    units = groups.select("k1", "k2", "bytes", F.when(alone, -1).otherwise(F.pmod("k1", F.lit(lots))).cast("long").alias("lot"), *[F.when(alone, F.col(k)).otherwise(0).cast("long").alias(u) for k, u in (("k1", "u1"), ("k2", "u2"))])
    # fewer than shards * FINE large groups, and shards * LOTS parcels
    sizes = units.groupBy("lot", "u1", "u2").agg(F.sum("bytes").alias("bytes")).orderBy("lot", "u1", "u2").toArrow()
    bins = even_bins(sizes.column("bytes").to_pylist(), shards)
    held: dict[int, int] = {}
    for b, n in zip(bins, sizes.column("bytes").to_pylist()):
        held[b] = held.get(b, 0) + n
    number = {b: i for i, b in enumerate(sorted(held, key=lambda b: (-held[b], b)))}
    placed = sizes.drop_columns(["bytes"]).append_column("shard", pa.array([number[b] for b in bins], pa.int32()))
    lookup = docs.sparkSession.createDataFrame(placed)  # as many rows as were packed
    where = units.join(F.broadcast(lookup), ["lot", "u1", "u2"]).select("k1", "k2", "shard")
    dealt = rows.join(where, ["k1", "k2"])
    parts = max(1, total[1] // (shards * SLOT_ROWS) + 1)
    keyed = written(dealt.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int").alias("part")), "dealt")
    counts = keyed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32")) - 1
    return keyed.withColumn("at", within).join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"))
