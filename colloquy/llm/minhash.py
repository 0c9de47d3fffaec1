"""One-permutation MinHash in DataFrame functions only.

Every shingle is hashed once; the top bits of the hash choose a bin and each
bin keeps its smallest hash. An empty bin borrows from a full one by optimal
densification: it walks a fixed order of the bins, its own and the same for
all texts, to the first full one. Of each bin only the low bits are stored,
packed into longs; the likeness of two fingerprints subtracts the share of
bins that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE = 5
BINS = 256
LOW_BITS = 4
#: Hashed steps of the walk; a bin that finds none full there takes the full bin of the smallest hash with it.
PROBES = 8
_REST = 56
_FULL = (1 << _REST) - 1
_PER_LONG = 64 // LOW_BITS
_LOWEST = 0x1111111111111111


def _longs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def words(text: Column) -> Column:
    """Lower-case words between white space; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """A hash of every ``size`` words in a row; fewer words are one shingle, no words none."""
    last = F.greatest(F.size(w) - size, F.lit(0))
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))


def bin_minima(hashes: Column) -> Column:
    """Smallest hash of each bin in bin order; a bin without one holds its largest possible value."""
    half = BINS // 2
    empty = _longs((b << _REST) + _FULL for b in range(-half, half))
    bound = F.array(F.sort_array(F.concat(hashes, empty)))
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _REST) != F.shiftright(F.get(s, i - 1), _REST)))
    return F.flatten(F.transform(bound, lambda s: first(s)))


def densified(minima: Column) -> Column:
    """``minima`` with every empty bin filled from a full one; all stay empty where none is full."""
    full = lambda x: x.bitwiseAND(F.lit(_FULL)) != _FULL
    bound = F.transform(F.array(minima), lambda v: F.struct(v.alias("v"), F.filter(v, lambda x: full(x)).alias("full")))

    def probe(v: Column, i: Column, a: int) -> Column:
        x = F.get(v, F.shiftrightunsigned(F.xxhash64(i, F.lit(a)), 64 - BINS.bit_length() + 1).cast("int"))
        return F.when(full(x), x)

    def rendezvous(filled: Column, i: Column) -> Column:
        ranked = F.transform(filled, lambda x: F.struct(F.xxhash64(i, F.shiftright(x, _REST)).alias("rank"), x.alias("x")))
        return F.array_min(ranked)["x"]

    def fill(b: Column) -> Column:
        one = lambda x, i: F.when(full(x), x).otherwise(F.coalesce(*[probe(b["v"], i, a) for a in range(PROBES)], rendezvous(b["full"], i), x))
        return F.transform(b["v"], one)

    return F.flatten(F.transform(bound, lambda b: fill(b)))


def packed(bins: Column) -> Column:
    """Low bits of the bins, sixteen bins to a long."""
    low = (1 << LOW_BITS) - 1
    join = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x.bitwiseAND(F.lit(low))))
    bound = F.array(bins)
    return F.flatten(F.transform(bound, lambda v: F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), lambda g: join(F.slice(v, g * _PER_LONG + 1, _PER_LONG)))))


def told_by_bin(bins: Column) -> Column:
    """Every bin's hash taken anew with the bin's number, so that two different hashes agree in each bin they fill by a chance of its own."""
    bound = F.array(bins)
    return F.flatten(F.transform(bound, lambda v: F.transform(v, lambda x, i: F.xxhash64(x, i))))


def fingerprint(text: Column, by_bin: bool = False) -> Column:
    """Packed fingerprint (array<bigint>) of a text. Null, empty and blank texts share one of their own.

    ``by_bin`` stores each bin's hash with its number, which ``likeness`` counts
    on; without it a short text, whose few hashes fill many bins, looks like
    every text whose hashes end in the same bits.
    """
    bins = densified(bin_minima(shingles_of(text)))
    return packed(told_by_bin(bins) if by_bin else bins)


def shingles_of(text: Column) -> Column:
    """Shingle hashes of a text, its words bound once."""
    return F.flatten(F.transform(F.array(words(text)), lambda w: shingles(w)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two texts, 0 to 1, from their packed fingerprints; null if either is null."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(_LOWEST)))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, n: acc + n)
    chance = 1 / (1 << LOW_BITS)
    return F.greatest((1 - apart / BINS - chance) / (1 - chance), F.lit(0.0))


def hex_digits(print_: Column) -> Column:
    """One lowercase hex digit per bin."""
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), _PER_LONG, "0")), "")
