"""Benchmark decontamination by winnowing, in DataFrame functions only.

A shared span of WINDOW words is to be found wherever it stands. Both sides
keep the smallest hash of the word k-grams in every window of w = WINDOW-k+1
k-grams in a row; equal windows keep equal hashes, so the join of these sparse
fingerprints misses no shared span. Around the places of the joined hashes the
windows are then compared word by word, and the words inside count as hit.
An item of fewer words is one window of its own length, with its own k and w.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
GRAM = 5
#: Rows of benchmark fingerprints or windows up to which they are broadcast (some 200 bytes a row at most); beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z lowered: runs of letters, digits and all beyond ASCII. Null has none."""
    pieces = F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.coalesce(F.array_remove(pieces, ""), F.array().cast("array<string>"))


def _up_to(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(w: Column, k: int) -> Column:
    """Hash of the k words from each word on."""
    return F.transform(_up_to(F.size(w) - (k - 1)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def winnowed(h: Column, w: int) -> Column:
    """Different minima of every w hashes in a row."""
    if w == 1:
        return F.array_distinct(h)
    return F.array_distinct(F.transform(_up_to(F.size(h) - (w - 1)), lambda i: F.array_min(F.slice(h, i + 1, w))))


def _sizes(c: int) -> tuple[int, int]:
    k = min(GRAM, c)
    return k, c - k + 1


def _fingerprints(df: DataFrame, classes: list[int], *ids: str) -> DataFrame:
    """(ids, class, fp) of rows with a column ``w`` of words."""
    ks = sorted({_sizes(c)[0] for c in classes})
    hashed = df.select(*ids, *[grams(F.col("w"), k).alias(f"h{k}") for k in ks])
    labelled = lambda c, h: F.transform(h, lambda f: F.struct(F.lit(c).alias("class"), f.alias("fp")))
    kept = [labelled(c, winnowed(F.col(f"h{_sizes(c)[0]}"), _sizes(c)[1])) for c in classes]
    return hashed.select(*ids, F.explode(F.concat(*kept) if len(kept) > 1 else kept[0]).alias("x")).select(*ids, "x.*")


def _windows_at(w: Column, starts: Column, c: int) -> Column:
    """(at, class, words) of the windows of c words from each of ``starts``."""
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.lit(c).alias("class"), F.array_join(F.slice(w, s + 1, c), " ").alias("words")))


def _starts(w: Column, found: Column, c: int) -> Column:
    """Starts of the windows of c words around the places of the fingerprints found."""
    k, reach = _sizes(c)
    mine = F.transform(F.filter(found, lambda x: x["class"] == c), lambda x: x["fp"])
    # both arrays are bound once: a one-element array is mapped, then opened
    both = F.array(F.struct(grams(w, k).alias("h"), mine.alias("f")))
    at = F.flatten(F.transform(both, lambda b: F.filter(_up_to(F.size(b["h"])), lambda i: F.array_contains(b["f"], F.get(b["h"], i)))))
    first, last = lambda p: F.greatest(p - (reach - 1), F.lit(0)), lambda p: F.least(p, F.size(w) - c)
    around = lambda p: F.when(last(p) >= first(p), F.sequence(first(p), last(p))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(at, lambda p: around(p))))


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (those with an occurring window, sorted as strings), contaminated.

    A document word is hit if it stands inside any occurrence of a window of an
    item; ``contaminated`` is n_hit > 0 and 20 n_hit >= n_words. Null and empty
    texts have no words on either side. Rows that share an id (or all have a null
    one) give one row: the largest n_words, all their hits. Items that repeat or
    lack an id count once, without an id not at all in item_ids. No documents: no rows;
    no items: no hits.
    """
    bench = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    bench = bench.withColumn("class", F.least(F.size("w"), F.lit(WINDOW)))
    classes = sorted(r[0] for r in bench.select("class").distinct().collect())  # 1 to WINDOW
    bare = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    if not classes:
        none = F.array().cast("array<string>")
        return bare.groupBy("doc_id").agg(F.max(F.size("w")).cast("long").alias("n_words")).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids"), F.lit(False).alias("contaminated"))
    by_class = [_fingerprints(bench.where(F.col("class") == c), [c]) for c in classes]
    prints = by_class[0]
    for more in by_class[1:]:
        prints = prints.union(more)
    prints = prints.distinct()
    every = [F.when(F.col("class") == c, _windows_at(F.col("w"), _up_to(F.size("w") - (c - 1)), c)) for c in classes]
    windows = bench.select("item_id", F.explode(F.coalesce(*every)).alias("x")).select("item_id", "x.class", "x.words").distinct()
    bounded = windows.count() <= BROADCAST_ROWS  # prints are no more than windows
    small = F.broadcast if bounded else (lambda df: df)

    found = _fingerprints(bare, classes, "doc_id").join(small(prints), ["class", "fp"])
    found = found.groupBy("doc_id").agg(F.collect_set(F.struct("class", "fp")).alias("found"))
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))  # the text travels, not its words
    spots = whole.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", words(F.col("text")).alias("w"), "found")
    none = F.array().cast("array<struct<at:int,class:int,words:string>>")
    near = [_windows_at(F.col("w"), _starts(F.col("w"), F.col("found"), c), c) for c in classes]
    looked = spots.select("doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.col("found").isNull(), none).otherwise(F.concat(*near) if len(near) > 1 else near[0]).alias("near"))
    rows = looked.select("doc_id", "n_words", F.explode_outer("near").alias("x")).select("doc_id", "n_words", "x.*")
    met = rows.join(small(windows.withColumn("met", F.lit(True))), ["class", "words"], "left")
    per = met.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("met"), F.struct("at", "class")))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    n_hit = F.aggregate(
        "spans", start,
        lambda a, x: F.struct((a["n"] + F.greatest(x["at"] + x["class"] - F.greatest(a["end"], x["at"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["at"] + x["class"]).alias("end")),
        lambda a: a["n"],
    )
    counted = per.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids")
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
