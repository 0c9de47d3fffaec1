"""One-edit pairs: keys that only meet within an edit, and pieces of texts that give the same words as the whole."""

import re

from pyspark.sql import functions as F

from colloquy import views as V
from colloquy.functions.text import fold
from colloquy.operators import glossary as G
from colloquy.plans.q_functions import document_words, fn_edit_distance


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


TEXTS = ["", "a", "b", "ab", "ba", "aab", "aaab", "abb", "a|", "a|1", "|", "été", "éte", "ét", "😀a", "a😀", "ereston", "erestan", "eresto", "reston", "erestonn", "erestoning", "eaeston"]


def test_keys_meet_only_within_one_edit(spark):
    one = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    a = {r.t: set(r.k) for r in one.select("t", G._one_edit(F.col("t"), "|<", "|>").alias("k")).collect()}
    b = {r.t: set(r.k) for r in one.select("t", G._one_edit(F.col("t"), "|>", "|<").alias("k")).collect()}
    for x in TEXTS:
        for y in TEXTS:
            if x != y:
                assert len(a[x] & b[y]) == (_edits(x, y) <= 1), (x, y)


def test_close_pairs_in_groups(spark):
    rows = spark.createDataFrame([(g, t) for g in ("p", "q", None) for t in [*TEXTS, None]], "g string, x string")
    other = rows.where("g = 'p'").select("g", F.col("x").alias("y"))
    got = sorted(map(tuple, G.close_pairs(rows, "x", other, "y", group=("g",)).collect()))
    assert got == sorted(("p", x, y, _edits(x, y)) for x in TEXTS for y in TEXTS if _edits(x, y) <= 1)


def test_pieces_give_the_words_of_the_whole_text(spark, tmp_path):
    texts = ["Alpha Betaux…Gammas  Deltas", "\tEpsilon\n\nZetaux|Thetas!", " Éclair ÀBCdefgh eLarge  Large", "", None, "Alpha Betaúx (Alphas)"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = [t for t in texts if t]
    assert {r.term for r in V.glossary(spark, str(tmp_path)).collect()} == {m for t in whole for m in re.findall("[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{4,}", t)}
    assert sorted(r.word for r in document_words(spark, str(tmp_path)).collect()) == sorted({w for t in whole for w in re.split(r"(?a)[\s|.,;:!?()\"]+", t) if w})
    folded = spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.explode(F.split(fold("text"), r"[\s|.,;:!?()\"]+")).alias("w"))
    words = {r.w for r in folded.select(F.regexp_replace("w", "[^a-z]", "").alias("w")).collect()} - {""}
    terms = {r.w for r in V.glossary(spark, str(tmp_path)).select(F.regexp_replace(fold("term"), "[^a-z]", "").alias("w")).collect()} - {""}
    got = sorted((r.word, r.term, r.distance) for r in fn_edit_distance(spark, str(tmp_path)).collect())
    assert got == sorted((w, t, _edits(w, t)) for w in words for t in terms if _edits(w, t) <= 1)


def test_heads_meet_once_where_first_letters_are_equal(spark):
    words = ["", "e", "er", "ere", "eres", "erst", "erest", "eresto", "erinto", "ers"]
    one = spark.createDataFrame([(w,) for w in words], "w string")
    asked = {r.w: r.h for r in one.select("w", G._asked(F.col("w")).alias("h")).collect()}
    offered = {r.w: r.h for r in one.select("w", G._offered(F.col("w")).alias("h")).collect()}
    for x in words:
        for y in words:
            k = 2 if min(len(x), len(y)) <= 4 else 3
            assert len(set(asked[x]) & set(offered[y])) == (bool(x and y) and x[:k] == y[:k]), (x, y)
