"""Importance resampling and source divergence against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from colloquy.llm import divergence, importance
from colloquy.llm.queries import op12_importance_resampling
from tests.llm import odd

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain_resampled(docs, target):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            counts.update(plain_features(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000))))
    out = []
    for d, text in docs:
        words, f = plain_features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(enough[: 25 * len(enough) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resampling_equals_plain_python(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op12_importance_resampling(spark, sf)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resampled(docs, target)


def test_resampling_of_odd_rows(spark):
    docs = odd.docs(spark).withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("_place", F.lit(0))
    target = spark.createDataFrame([("alpha beta gamma",), (None,)], "text string")
    got = sorted(map(tuple, importance.resampled(docs, target).collect()), key=repr)
    assert got == plain_resampled([r[:2] for r in odd.ROWS], ["alpha beta gamma", None])
    assert importance.resampled(docs.limit(0), target.limit(0)).count() == 0
    assert importance.resampled(docs, target.limit(0)).count() == len(odd.ROWS)


def test_radix_ranks_of_ties_nulls_and_hot_digits(spark):
    rng = random.Random(4)
    rows = [(rng.choice([7, 7, 7, -3, 10**12, None]), rng.choice([None, 5, rng.randint(-(10**9), 10**9)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "score long, doc_id long, rank0 long")
    got = importance.radix_ranked(df, [("score", True), ("doc_id", False)], digit_bits=8, block_rows=64).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    key = lambda s, d: (s is None, -(s or 0), d is None, d or 0)
    assert [(r.score, r.doc_id) for r in got] == [r[:2] for r in sorted(rows, key=lambda r: key(*r[:2]))]
    assert {r.rank0 for r in got} == set(range(len(rows)))
    assert importance.radix_ranked(df.limit(0), [("score", True)]).count() == 0
    assert importance.radix_ranked(df.limit(1), [("score", True)]).first()["rank"] == 1


def plain_audit(docs, least_docs=10, top=10):
    """docs: (text, lang, source)."""
    docs = [tuple(x or "" for x in d) for d in docs]
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(UPPER))
    out = []
    for lang in {d[1] for d in docs}:
        mine = [(terms(t), s) for t, g, s in docs if g == lang]
        seen = Counter(w for t, _ in mine for w in set(t))
        kept = {w for w, n in seen.items() if n >= least_docs}
        counts = {s: Counter() for _, s in mine}
        for t, s in mine:
            counts[s].update(w for w in t if w in kept)

        def share(c):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        apart = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            rank = lambda items: sorted(items, key=lambda x: (-x[1], x[0].encode()))
            pairs = rank([(o, sum(apart(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s])
            words = rank([(w, apart(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]])[:top]
            out += [(lang, s, part, item, value, i + 1) for part, found in (("pair", pairs), ("term", words)) for i, (item, value) in enumerate(found)]
    return sorted(out)


def test_audit_equals_plain_python_also_where_digests_collide(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_audit([(r.text, r.lang, r.source) for r in df.collect()])
    for bits in (64, 9):
        got = sorted(map(tuple, divergence.audit(df, digest_bits=bits).collect()))
        assert got == want
    # many sources in small blocks, flushed often
    for name, value in (("BLOCK", 3), ("HELD", 50), ("HELD_PAIRS", 2), ("MATRIX", 4), ("BROADCAST_ROWS", 0), ("BROADCAST_BLOCKS", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.audit(df, digest_bits=10).collect())) == want


def test_audit_of_odd_rows(spark):
    rows = [*odd.ROWS, *[(20 + i, f"alpha alpha beta word{i % 2} Ünï", "en", s) for i, s in enumerate(["a", "b", None, "", "c"] * 5)], *[(60 + i, None, "xx", f"s{i}") for i in range(3)]]
    docs = odd.docs(spark, rows).withColumn("term", F.lit(1)).withColumn("n", F.lit("x")).withColumn("block", F.lit(None).cast("int"))
    want = plain_audit([r[1:] for r in rows])
    assert sorted(map(tuple, divergence.audit(docs).collect())) == want
    assert [r for r in want if r[:2] == ("xx", "s0")] == [("xx", "s0", "pair", "s1", 0, 1), ("xx", "s0", "pair", "s2", 0, 2)]
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    rows = [(0, 1), (7, 7), (3, 10**15 + 1), (10**15, 10**15 + 7), (123456789012345, 987654321098765)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", divergence._share(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * a // b for a, b in rows]
