"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; a word end where it falls below a
threshold cuts. Cuts hang on the last bytes only, so an insertion moves the
chunks around it and no others, and a passage is cut alike in every document.
Chunks in a row that make up enough words meet by digest as one stretch; the
document of the smallest id keeps a stretch, and the others lose it. So what goes
stands together in one other place, and chunks that are common alone stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.names import free_name

#: Bytes that the rolling hash looks back on.
WINDOW = 16
#: A cut comes at about one word end in CUT_ONE_IN.
CUT_ONE_IN = 4
#: Words of a stretch, which must stand together in another place to go.
LEAST_WORDS = 16
#: Bytes chunked at once.
PIECE = 1 << 20

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_GEAR[0] = 0
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def cut_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places after which a chunk may end, word ends before and at each) of bytes in which 0 separates texts."""
    gear = _GEAR[data]
    reach = 1
    while reach < WINDOW:  # the sum over twice as many bytes
        gear[reach:] = gear[reach:] + (gear[:-reach] << np.uint32(reach))
        reach *= 2
    space = _SPACE[data]
    word_end = ~space
    word_end[:-1] &= space[1:] | (data[1:] == 0)
    ends = np.flatnonzero(word_end & (data != 0))
    mixed = (gear[ends] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return ends[mixed < (1 << 16) // CUT_ONE_IN], ends


def chunked(texts: list[bytes | None]):
    """Per text (chunk ends, digests, words in each chunk); chunks cover the text. Empty for null or empty texts."""
    row = 0
    while row < len(texts):
        size, rows = 0, []
        while row < len(texts) and (not rows or size < PIECE):
            rows.append(texts[row] or b"")
            size += len(rows[-1])
            row += 1
        gap = b"\0" * WINDOW
        data = np.frombuffer(gap.join(rows) + gap, np.uint8)
        cuts, words = cut_ends(data)
        start = 0
        for text in rows:
            stop = start + len(text)
            inner = cuts[np.searchsorted(cuts, start) : np.searchsorted(cuts, stop)] + 1
            ends = inner if len(inner) and inner[-1] == stop else np.append(inner, stop)
            if not text:
                yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                n_words = np.diff(np.searchsorted(words, np.concatenate(([start], ends))))
                at = (ends - start).tolist()
                digest = xxhash.xxh3_64_intdigest
                digests = np.array([digest(text[a:b]) for a, b in zip([0, *at[:-1]], at)], np.uint64).view(np.int64)
                yield ends - start, digests, n_words
            start = stop + WINDOW


def _first_in_text(digests: np.ndarray) -> np.ndarray:
    first = np.zeros(len(digests), bool)
    first[np.unique(digests, return_index=True)[1]] = True
    return first


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def stretches(digests: np.ndarray, n_words: np.ndarray, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first chunk, chunk after the last, digest) of the shortest stretches of enough words from each chunk on and up to each chunk.

    Any run of chunks of enough words is covered by the stretches inside it.
    """
    n = len(digests)
    total = np.concatenate(([0], np.cumsum(n_words)))
    ahead = np.searchsorted(total, total[:-1] + least_words)
    back = np.searchsorted(total, total[1:] - least_words, "right") - 1
    up, down = np.flatnonzero(ahead <= n), np.flatnonzero(back >= 0)
    pairs = np.unique(np.concatenate((up * (n + 1) + ahead[up], back[down] * (n + 1) + down + 1)))
    first, last = pairs // (n + 1), pairs % (n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digests.view(np.uint64) * _powers(_BASE, n), dtype=np.uint64)))
    return first, last, ((sums[last] - sums[first]) * _powers(_UNBASE, n)[first]).view(np.int64)


def repeated_spans(ends, digests, n_words, elsewhere, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Byte spans to take out: stretches kept in another text or earlier in this one."""
    first, last, told = stretches(digests, n_words, least_words)
    # in the order of their places, so that the first of equal stretches stays
    gone = np.isin(told, elsewhere) | ~_first_in_text(told)
    if not gone.any():
        return []
    n = len(digests)
    inside = np.cumsum(np.bincount(first[gone], minlength=n + 1) - np.bincount(last[gone], minlength=n + 1)) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside[:n], [False])).astype(np.int8)))
    starts = np.concatenate(([0], ends))
    return [(int(starts[a]), int(starts[b])) for a, b in edge.reshape(-1, 2)]


def stretch_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, doc_id) of every different stretch of every document."""

    def work(batches):
        for batch in batches:
            ids = batch.column(0)
            held_ids, held, n = [], [], 0
            for r, (_, digests, n_words) in enumerate(chunked(batch.column(1).cast(pa.binary()).to_pylist())):
                own = np.unique(stretches(digests, n_words)[2])
                held.append(own)
                held_ids.append(np.full(len(own), r))
                n += len(own)
                if n > 50_000 or r == len(ids) - 1:
                    yield pa.record_batch([pa.array(np.concatenate(held)), ids.take(pa.array(np.concatenate(held_ids)))], names=["digest", "doc_id"])
                    held_ids, held, n = [], [], 0

    bare = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text <> ''")
    return bare.mapInArrow(work, f"digest long, doc_id {bare.schema['doc_id'].dataType.simpleString()}")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", to: str | None = None, spans: str | None = None) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` (or in a new column ``to``), every row kept.

    The document of the smallest id (an integer or a text) keeps a passage; within one text the first
    place does. ``spans`` names a column for the (start, end) byte spans that
    went. Null and empty texts stay as they are. Rows that share an id count as
    one document, each still losing what it repeats itself; rows with a null id
    come after all others. Nothing goes that does not stand with LEAST_WORDS words
    in a row in one other place.
    """
    key, lost_in = free_name(docs.columns, "_key"), free_name(docs.columns, "_elsewhere")
    told = stretch_digests(docs, doc_id, text)
    span = [F.min("doc_id").alias("keeper"), F.max("doc_id").alias("latest")]
    if docs.where(F.col(doc_id).isNull()).isEmpty():
        held = told.groupBy("digest").agg(*span).where("keeper <> latest")
    else:  # min and max pass over rows without an id
        held = told.groupBy("digest").agg(*span, F.max(F.col("doc_id").isNull()).alias("nameless")).where("keeper <> latest or (nameless and keeper is not null)")
    repeated = held.select("digest", "keeper")
    losing = told.join(repeated, "digest").where("not doc_id <=> keeper").groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("digest").alias(lost_in))
    target = to or text
    out = [f for f in docs.schema.fields if f.name not in (target, spans)]
    kinds = [*out, T.StructField(target, T.StringType())]
    if spans:
        kinds.append(T.StructField(spans, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))
    names = [f.name for f in out]

    def work(batches):
        for big in batches:
            for at in range(0, len(big), 1024):
                batch = big.slice(at, 1024)
                column = dict(zip(batch.schema.names, batch.columns))
                texts = column[text].cast(pa.binary()).to_pylist()
                lost = column[lost_in].to_pylist()
                kept, went = [], []
                for body, elsewhere, (ends, digests, n_words) in zip(texts, lost, chunked(texts)):
                    gone = repeated_spans(ends, digests, n_words, np.array(elsewhere or [], np.int64)) if body else []
                    went.append([{"start": a, "end": b} for a, b in gone])
                    if gone:
                        keep = zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(body)])
                        body = b"".join(body[a:b] for a, b in keep)
                    kept.append(body)
                arrays = [*(column[x] for x in names), pa.array(kept, pa.binary()).cast(pa.string())]
                if spans:
                    arrays.append(pa.array(went, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, target, *([spans] if spans else [])])

    cleaned = docs.join(losing, F.col(doc_id).eqNullSafe(F.col(key)), "left").drop(key).mapInArrow(work, T.StructType(kinds))
    order = [*docs.columns, *(x for x in (to, spans) if x and x not in docs.columns)]
    return cleaned.select(*order)
