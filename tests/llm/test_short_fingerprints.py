"""Unrelated short texts don't look alike."""

import numpy as np
from pyspark.sql import functions as F

from __spark_entry__ import queries
from colloquy.llm import minhash
from tests.llm import odd


def test_unrelated_short_texts_are_apart(spark):
    texts = [(n, " ".join(odd.words(n, 1000 * n + k))) for n in range(1, 8) for k in range(40)]
    df = spark.createDataFrame(texts, "n int, text string").withColumn("fp", minhash.fingerprint(F.col("text"), by_bin=True))
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.n = b.n and a.text < b.text"))
    got = pairs.select(minhash.likeness(F.col("a.fp"), F.col("b.fp")).alias("x")).collect()
    assert max(r.x for r in got) < 0.3 and np.mean([r.x for r in got]) < 0.03
    assert df.select(minhash.hex_digits("fp")).distinct().count() == len({t for _, t in texts})


def test_op1_tells_short_texts_apart(spark, tmp_path):
    rows = [(i, " ".join(odd.words(1 + i % 5, 70 + i))) for i in range(100)] + [(100 + i, None) for i in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries()["op1_minhash_fingerprints"](spark, str(tmp_path)).collect()}
    assert len(got) == 102 and len({got[i].fingerprint for i in range(100)}) == 100
    assert max(got[i].near_next for i in range(1, 100)) < 0.3 and got[100].fingerprint == got[101].fingerprint
