"""Documents resampled towards a target distribution by importance weights and a radix sort.

Every feature (a run of one or two words) falls into one of a fixed number of
buckets. The log-ratio of each bucket's share in the target and in the corpus
is an array that goes with the task, so a document is scored by looking its
buckets up. Gumbel noise from the id makes the highest scores a sample without
replacement.

Ranks come from a least-significant-digit radix sort of (score, id): each pass
is a stable counting sort of one digit. Rows lie in blocks of consecutive
places; a block counts its digits, running totals over (digit, block) give each
block the first place of each digit, and a row's new place is that plus its turn
among the same digits of its block. After the last pass the place is the rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.written import written

BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN_PERCENT = 25
SEED = 7
#: Bits of a digit, and places of a block.
DIGIT_BITS, BLOCK_ROWS = 11, 1 << 13

#: Digits, small letters and bytes beyond ASCII stay, capitals become small, all others part the words.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_buckets(text: bytes | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words of a text and the bucket of every run of one and of two words; null has none."""
    words = text.translate(_FOLDED).split() if text else []
    crc = zlib.crc32
    ones = [crc(w) for w in words]
    # the checksum of two joined words goes on from that of the first
    twos = [crc(b, crc(b" ", a)) for a, b in zip(ones, words[1:])]
    return len(words), np.array(ones + twos, np.int64) % buckets


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of every bucket over all texts: an array of fixed size, added up per task first. An empty table gives zeros."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0).cast(pa.binary()):
                total += np.bincount(feature_buckets(x.as_py(), buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(held, pa.int32()), "n": pa.array(total[held], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log-ratio of each bucket's share in both, one added to every count."""
    t, s, n = target.astype(np.float64), corpus.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, all long.

    ``weight`` is the floored mean gain of the row's features, 0 without any;
    ``score`` adds Gumbel noise drawn from the id alone. A null id draws its
    noise as an empty one.
    """

    def weigh(batches):
        for batch in batches:
            words, features, weight = [], [], []
            for x in batch.column(1).cast(pa.binary()):
                n, at = feature_buckets(x.as_py(), len(gain))
                words.append(n)
                features.append(len(at))
                weight.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            yield pa.record_batch({"doc_id": batch.column(0), **{k: pa.array(v, pa.int64()) for k, v in (("n_words", words), ("n_features", features), ("weight", weight))}})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    drawn = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def radix_ranked(rows: DataFrame, keys: list[tuple[str, bool]], to: str = "rank", digit_bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with their rank (1, 2, 3 ... without gaps) in the order of integer columns ``keys`` (name, descending).

    The first key counts most. Nulls come last. Rows equal in all keys get
    different ranks, in an order that only hangs on where they were first
    written. An empty table stays one. No task sees more than a block of places
    at once or sorts by more than one digit.
    """
    spans = rows.agg(*[f(c).alias(f"{f.__name__}{i}") for i, (c, _) in enumerate(keys) for f in (F.min, F.max)]).first()
    digits = []
    columns = {}
    for i, (c, down) in enumerate(keys):
        low, high = (0 if x is None else int(x) for x in (spans[2 * i], spans[2 * i + 1]))
        from_start = (F.lit(high) - F.col(c)) if down else (F.col(c) - F.lit(low))
        columns[f"_k{i}"] = F.coalesce(from_start, F.lit(high - low + 1)).cast("long")
        bits = (high - low + 1).bit_length()
        if bits > 62:
            raise ValueError(f"{c} spans more than 62 bits")
        digits.append([(f"_k{i}", at) for at in range(0, bits, digit_bits)])
    taken = set(rows.columns)
    if taken & {"_k0", "_k1", "_place", "_digit", "_block", "_turn", "_start"}:
        raise ValueError("columns of the sort's own names")
    # places of the first pass: read from a written table, so that a repeated task sees the same ones
    now = written(rows.withColumns(columns).withColumn("_place", F.monotonically_increasing_id()), "radix")
    width = block_rows.bit_length() - 1
    for key, at in [d for of_key in reversed(digits) for d in of_key]:
        now = written(_counting_pass(now, F.shiftright(F.col(key), at).bitwiseAND(F.lit((1 << digit_bits) - 1)).cast("int"), width), "radix")
    return now.withColumn(to, F.col("_place") + 1).drop("_place", *columns)


def _counting_pass(rows: DataFrame, digit, width: int) -> DataFrame:
    """Stable counting sort of one digit: ``_place`` becomes the row's place among all."""
    dealt = rows.withColumn("_digit", digit).withColumn("_block", F.shiftright("_place", width))
    counts = written(dealt.groupBy("_digit", "_block").agg(F.count("*").alias("n")), "digit-counts")
    by_digit = counts.groupBy("_digit").agg(F.sum("n").alias("of_digit"))
    # at most 2 ** DIGIT_BITS rows
    before = by_digit.select("_digit", (F.sum("of_digit").over(Window.orderBy("_digit")) - F.col("of_digit")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("n")
    start = counts.withColumn("inside", inside).join(F.broadcast(before), "_digit").select("_digit", "_block", (F.col("before") + F.col("inside")).alias("_start"))
    turn = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("_place"))
    placed = dealt.withColumn("_turn", turn).join(start, ["_digit", "_block"])
    return placed.withColumn("_place", F.col("_start") + F.col("_turn") - 1).select(*rows.columns)


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null where the document is not drawn.

    Of the N documents with at least ``least_words`` words the floor(percent * N / 100)
    highest scores are drawn, ties to the smaller id; a null id comes after all
    others of its score. Repeated rows are documents of their own. Null texts
    have no features. ``target`` only gives its column ``text``; an empty one
    leaves all shares to the added counts. Ids must be integers.
    """
    gain = gains(bucket_counts(target, "text", buckets), bucket_counts(docs, text, buckets))
    told = written(scored(docs, gain, doc_id, text, seed), "scores")
    enough = told.where(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    ranked = radix_ranked(enough, [("score", True), ("doc_id", False)])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = told.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
