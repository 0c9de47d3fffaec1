"""How far the words of each source stand from those of its language, by late string materialization.

Terms are counted under a 64-bit digest: what is shuffled and joined for the
figures are digests and counts, never words. The words stay where the texts
were read, in a written table of partial counts. Only digests that are frequent
enough to be kept have their words looked at again: the smallest and the largest
word of a digest differ exactly if two words share it, and such a digest is
split by recounting its words one by one. Words are joined back to the rows of
the report alone.

Sources of a language are numbered and dealt in blocks, so that the sum over
all terms for each pair of sources is taken on a matrix of terms by sources
and no row is written per term and pair.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.written import written

#: A term is kept in a language if it stands in so many of its documents.
LEAST_DOCS = 10
#: Shares are counted in parts of 1000 ** 3; 2 is added to every count.
DIGITS, ADDED = 3, 2
#: Sources of one block of the pair sums.
BLOCK = 128
#: Different words by source that a task holds before it writes their partial counts.
HELD = 200_000
#: Pair sums that a task holds, and rows of a matrix.
HELD_PAIRS, MATRIX = 64, 512
#: Rows up to which the kept digests and the blocks' defaults are broadcast (20 bytes and about 3 KB a row); beyond it they are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BLOCKS = 1_000_000, 10_000

#: Bytes of letters and of all characters beyond ASCII stay, capitals become small, all others part the words.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Words of letters A to Z and characters beyond ASCII, only A to Z lower-cased; none for null."""
    return text.translate(_FOLDED).split() if text else []


_PARTIAL = "lang string, digest long, term string, docs long, counts array<struct<source: string, n: long>>"


def _partial_counts(digest_bits: int):
    mask = (1 << digest_bits) - 1

    def count(batches):
        # language -> documents of each term, and language -> source -> occurrences of each term
        docs: dict[str, Counter] = {}
        said: dict[str, dict[str, Counter]] = {}
        size = 0

        def rows():
            for lang, seen in docs.items():
                words, counters = list(seen), list(said[lang].values())
                place = dict(zip(words, range(len(words)))).__getitem__
                at = np.concatenate([np.fromiter(map(place, c), np.int64, len(c)) for c in counters])
                n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counters])
                who, names = np.repeat(np.arange(len(counters)), [len(c) for c in counters]), pa.array(list(said[lang]), pa.string())
                order = np.argsort(at, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(words)))]).astype(np.int32)
                for low in range(0, len(words), 20_000):
                    part = words[low : low + 20_000]
                    bounds = ends[low : low + len(part) + 1]
                    mine = order[bounds[0] : bounds[-1]]
                    flat = [names.take(pa.array(who[mine])), pa.array(n[mine])]
                    yield pa.record_batch({
                        "lang": pa.array([lang] * len(part), pa.string()),
                        "digest": pa.array(np.array([xxhash.xxh64_intdigest(w) & mask for w in part], np.uint64).astype(np.int64)),
                        "term": pa.array(part, pa.binary()).cast(pa.string()),
                        "docs": pa.array([seen[w] for w in part], pa.int64()),
                        "counts": pa.ListArray.from_arrays(pa.array(bounds - bounds[0]), pa.StructArray.from_arrays(flat, ["source", "n"])),
                    })

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary())
            for i in range(len(batch)):
                words = terms(texts[i].as_py())
                if not words:
                    continue
                own = said.setdefault(langs[i], {}).setdefault(sources[i], Counter())
                size -= len(own)
                own.update(words)
                size += len(own)
                docs.setdefault(langs[i], Counter()).update(set(words))
                if size >= HELD:
                    yield from rows()
                    docs.clear()
                    said.clear()
                    size = 0
        yield from rows()

    return count


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str, most: int) -> DataFrame:
    return left.join(F.broadcast(right) if right.count() <= most else right, on, how)


def _share(count, total):
    """1 + floor(1000 ** DIGITS * count / total) by base-1000 digits, so that no product leaves 64 bits."""
    digits, rest = F.call_function("div", count, total), F.pmod(count, total)
    for _ in range(DIGITS):
        digits, rest = digits * 1000 + F.call_function("div", rest * 1000, total), F.pmod(rest * 1000, total)
    return (digits + 1).cast("long")


def _apart(p, q):
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _kept_counts(partial: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """From rows of ``_PARTIAL``: (lang, source, digest, turn, n) of kept terms, and (lang, digest, turn, term); turn parts the words of one digest."""
    frequent = written(partial.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "digest"), "frequent-digests")
    of_kept = _met(partial, frequent, ["lang", "digest"], "left_semi", BROADCAST_ROWS)
    spelled = written(of_kept.groupBy("lang", "digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "spelled")
    shared = spelled.where("term <> last").select("lang", "digest")
    counts = of_kept.select("lang", "digest", F.inline("counts")).groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"))
    if shared.isEmpty():
        counts = counts.withColumn("turn", F.lit(0))
        return written(counts, "kept-counts"), spelled.select("lang", "digest", F.lit(0).alias("turn"), "term")
    alone = _met(counts, shared, ["lang", "digest"], "left_anti", BROADCAST_ROWS).withColumn("turn", F.lit(0))
    words = written(_met(partial, shared, ["lang", "digest"], "left_semi", BROADCAST_ROWS), "split-digests")
    kept = words.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = kept.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "digest").orderBy("term"))).drop("docs")
    split = words.join(kept, ["lang", "digest", "term"]).select("lang", "digest", "turn", F.inline("counts")).groupBy("lang", "source", "digest", "turn").agg(F.sum("n").alias("n"))
    names = spelled.where("term = last").select("lang", "digest", F.lit(0).alias("turn"), "term").unionByName(kept)
    return written(alone.unionByName(split), "kept-counts"), written(names, "names")


def _pair_sums(batches):
    """Sums of ``_apart`` over the rows of a task: rows hold (lang, lo, hi, width of lo, defaults of both blocks, present slots and shares)."""
    held: dict[tuple, np.ndarray] = {}
    seen: dict[tuple, int] = {}
    waiting: dict[tuple, list[np.ndarray]] = {}

    def add(key) -> None:
        p = np.array(waiting.pop(key))
        total = held.setdefault(key, np.zeros((p.shape[1], p.shape[1]), np.int64))
        for i in range(p.shape[1] - 1):
            mine, other = p[:, i : i + 1], p[:, i + 1 :]
            total[i, i + 1 :] += ((mine - other) ** 2 // (mine + other)).sum(axis=0)

    def rows():
        for key in list(waiting):
            add(key)
        for key, total in held.items():
            (lang, lo, hi, width), size = key, len(total)
            a, b = np.triu_indices(size, 1)
            if lo != hi:
                across = (a < width) & (b >= width)
                a, b = a[across], b[across]
            at = lambda x: np.where(x < width, lo * BLOCK + x, hi * BLOCK + x - width)
            yield pa.record_batch({
                "lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(at(a), pa.int64()), "b": pa.array(at(b), pa.int64()), "lo": pa.array([lo] * len(a), pa.int64()), "hi": pa.array([hi] * len(a), pa.int64()),
                "value": pa.array(total[a, b], pa.int64()), "seen": pa.array([seen[key]] * len(a), pa.int64()),
            })
        held.clear()
        seen.clear()

    for batch in batches:
        lang, lo, hi, width = (batch.column(i).to_pylist() for i in range(4))
        given, slots, shares = batch.column(4), batch.column(5), batch.column(6)
        for i in range(len(batch)):
            key = (lang[i], lo[i], hi[i], width[i])
            p = given[i].values.to_numpy().copy()
            p[slots[i].values.to_numpy()] = shares[i].values.to_numpy()
            waiting.setdefault(key, []).append(p)
            seen[key] = seen.get(key, 0) + 1
            if len(waiting[key]) >= MATRIX:
                add(key)
            if len(seen) > HELD_PAIRS:
                yield from rows()
    yield from rows()


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = 10, digest_bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source that occur.

    Part ``pair``: item is each other source of the language, value the summed
    distance of their term shares over all kept terms (0 if none is kept). Part
    ``term``: item is each of the ``top`` terms that the source uses more than
    its language. Ranks follow the value, larger first, then the item's UTF-8.
    Null text, language and source are read as ''. Ties in value are told apart
    by the words, so those of the last rank are all spelled. Repeated rows count
    as documents of their own; further columns are not looked at; an empty table
    gives no rows. ``digest_bits`` below 64 makes words share digests (tests).
    """
    blank = lambda c, to: F.coalesce(F.col(c), F.lit("")).alias(to)
    bare = docs.select(blank(lang, "lang"), blank(source, "source"), blank(text, "text"))
    partial = written(bare.mapInArrow(_partial_counts(digest_bits), _PARTIAL), "partial-counts")
    counts, names = _kept_counts(partial, least_docs)

    kept = names.groupBy("lang").agg(F.count("*").alias("v"))
    in_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    in_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = bare.select("lang", "source").distinct().join(kept, "lang", "left").join(in_lang, "lang", "left").join(in_group, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "group_n"])
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("at", turn.cast("long")).withColumn("block", F.floor(F.col("at") / BLOCK)).withColumn("total", F.col("group_n") + ADDED * F.col("v"))
    groups = written(groups.withColumn("absent", F.when(F.col("v") > 0, _share(F.lit(ADDED).cast("long"), F.greatest("total", F.lit(1))))), "groups")

    present = counts.join(groups.select("lang", "source", "at", "block", "total", "v", "lang_n"), ["lang", "source"])
    present = written(present.withColumn("p", _share(F.col("n") + ADDED, F.col("total"))), "present")
    return _pairs(present, groups).unionByName(_terms(present, names, top))


def _pairs(present: DataFrame, groups: DataFrame) -> DataFrame:
    blocks = groups.where("v > 0").groupBy("lang", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "absent"))), lambda x: x["absent"]).alias("given"))
    lo, hi = blocks.select("lang", F.col("block").alias("lo"), F.col("given").alias("lo_given")), blocks.select("lang", F.col("block").alias("hi"), F.col("given").alias("hi_given"))
    both = lo.join(hi, "lang").where("lo <= hi").select("lang", "lo", "hi", F.size("lo_given").cast("long").alias("width"), F.when(F.col("lo") == F.col("hi"), F.col("lo_given")).otherwise(F.concat("lo_given", "hi_given")).alias("given"))
    both = written(both, "block-pairs")
    of_lang = groups.groupBy("lang").agg(F.max("block").alias("last"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    dealt = present.join(of_lang, "lang").select("lang", "digest", "turn", "block", "at", "p", other)
    dealt = dealt.select("lang", "digest", "turn", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "at", "block", "p")
    met = dealt.groupBy("lang", "digest", "turn", "lo", "hi").agg(F.collect_list(F.struct("block", "at", "p")).alias("met"))
    rows = _met(met, both, ["lang", "lo", "hi"], "inner", BROADCAST_BLOCKS)
    slot = lambda x: (F.when(x["block"] == F.col("lo"), x["at"] - F.col("lo") * BLOCK).otherwise(x["at"] - F.col("hi") * BLOCK + F.col("width"))).cast("int")
    rows = rows.select("lang", "lo", "hi", "width", "given", F.transform("met", slot).alias("slots"), F.transform("met", lambda x: x["p"]).alias("shares"))
    sums = rows.mapInArrow(_pair_sums, "lang string, a long, b long, lo long, hi long, value long, seen long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = groups.select("lang", "source", F.col("at").alias("a"), F.col("absent").alias("a_absent"), "v")
    two = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"), F.col("absent").alias("b_absent"))
    # a report of all ranks has every two sources of a language
    told = one.join(two, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    unseen = F.col("v") - F.coalesce("seen", F.lit(0))
    value = F.when(F.col("v") == 0, F.lit(0)).otherwise(F.coalesce("value", F.lit(0)) + unseen * _apart(F.col("a_absent"), F.col("b_absent"))).cast("long")
    told = told.select("lang", "source", "item", value.alias("value"))
    told = told.unionByName(told.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    turn = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return told.select("lang", "source", F.lit("pair").alias("part"), "item", "value", turn.alias("rank"))


def _terms(present: DataFrame, names: DataFrame, top: int) -> DataFrame:
    whole = present.groupBy("lang", "digest", "turn").agg(F.sum("n").alias("all_n"), F.first("lang_n").alias("lang_n"), F.first("v").alias("v"))
    whole = whole.select("lang", "digest", "turn", _share(F.col("all_n") + ADDED, F.col("lang_n") + ADDED * F.col("v")).alias("q"))
    more = present.join(whole, ["lang", "digest", "turn"]).where("p > q").select("lang", "source", "digest", "turn", _apart(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    first = more.withColumn("place", F.rank().over(by_value)).where(F.col("place") <= top).drop("place")
    spelled = first.join(names, ["lang", "digest", "turn"])
    by_item = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    ranked = spelled.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("value").cast("long").alias("value"), "rank")
