"""Fingerprints, chunks, tokens, licenses, benchmark hits and languages against plain Python."""

import hashlib
import random
import sys
import re

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from __spark_entry__ import queries
from colloquy.llm import bpe, chunk_dedup, langid, license_scan, minhash, winnow
from tests.llm import odd

VOCABULARY = "word_bpe_49k.json"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate(str.maketrans(winnow.UPPER, winnow.LOWER))


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w if isinstance(w, bytes) else w.encode(), h)
    return h


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_fingerprint(text):
    full = [None] * 256
    for s in plain_shingles(text):
        h = signed(chained(s))
        b = (h >> 56) + 128
        full[b] = h if full[b] is None else min(full[b], h)
    number = lambda *xs: chained([int(x).to_bytes(n, "little", signed=True) for x, n in xs])
    out = []
    for i in range(256):
        x = full[i]
        for a in range(8):
            x = full[number_int(i, a) >> 56] if x is None else x
        if x is None and any(f is not None for f in full):
            x = min((signed(number_rest(i, f >> 56)), f) for f in full if f is not None)[1]
        out.append("f" if x is None else f"{x & 15:x}")
    return "".join(out)


def spark_hash(spark, pairs, cast):
    """Spark's xxhash64 of number pairs, as the operator computes it."""
    df = spark.createDataFrame(pairs, "i int, j long")
    return {(r.i, r.j): r.h for r in df.select("i", "j", F.xxhash64("i", F.col("j").cast(cast)).alias("h")).collect()}


def number_int(i, a):
    return TABLE[i, a] & ((1 << 64) - 1)


def number_rest(i, b):
    return REST[i, b] & ((1 << 64) - 1)


TABLE, REST = {}, {}


def test_fingerprints_equal_plain_python(spark):
    TABLE.update(spark_hash(spark, [(i, a) for i in range(256) for a in range(8)], "int"))
    REST.update(spark_hash(spark, [(i, b) for i in range(256) for b in range(-128, 128)], "long"))
    rows = odd.docs(spark).where("text is null or text not like '%İ%'").select("text", minhash.hex_digits(minhash.fingerprint(F.col("text"))).alias("print")).collect()
    for text, print_ in rows:
        assert print_ == plain_fingerprint(text), (text or "")[:40]
    assert odd.empty(spark).select(minhash.fingerprint(F.col("text"))).collect() == []


def test_likeness_follows_common_shingles(spark):
    base = odd.words(400, 11)
    pairs = []
    for k in range(0, 200, 20):
        other = base[:]
        other[100 : 100 + k] = odd.words(k, 12 + k)
        pairs.append((" ".join(base), " ".join(other)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("x")).collect()
    errors = []
    for a, b, x in got:
        sa, sb = plain_shingles(a), plain_shingles(b)
        errors.append(abs(x - len(sa & sb) / len(sa | sb)))
        assert 0 <= x <= 1 and (a != b or x == 1)
    assert np.mean(errors) < 0.04


def test_op1_edits_and_neighbours(spark, sf):
    texts = {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in queries()["op1_minhash_fingerprints"](spark, sf).collect()}
    assert sorted(got) == sorted(texts)
    off = []
    for d, after in zip(order, order[1:] + order[:1]):
        n = len(texts[d])
        edited = texts[d][: n - n // 3] + texts[after][: n // 3]
        r = got[d]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (plain_shingles(x) for x in (texts[d], edited, texts[after]))
        off += [abs(r.near_edited - len(a & b) / max(1, len(a | b))), abs(r.near_next - len(a & c) / max(1, len(a | c)))]
    assert np.mean(off) < 0.04


# --- chunks


def plain_chunks(text):
    """Cut byte by byte."""
    data, ends, start = text.encode(), [], 0
    space = b"\t\n\x0b\x0c\r "
    for i, c in enumerate(data):
        if c in space or (i + 1 < len(data) and data[i + 1] not in space):
            continue
        h = sum(int(chunk_dedup._GEAR[data[i - j]]) << j for j in range(min(chunk_dedup.WINDOW, i + 1))) & 0xFFFFFFFF
        if (h * 0x9E3779B1 & 0xFFFFFFFF) >> 16 < (1 << 16) // chunk_dedup.CUT_ONE_IN:
            ends.append(i + 1)
    if not ends or ends[-1] != len(data):
        ends.append(len(data))
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def test_chunks_resist_insertions():
    text = " ".join(odd.words(2000, 3))
    shifted = "some new words at the front " + text
    a, b = set(plain_chunks(text)), set(plain_chunks(shifted))
    assert len(a - b) <= 2
    ends, digests, n_words = next(chunk_dedup.chunked([text.encode()]))
    assert [text.encode()[x:y] for x, y in zip([0, *ends[:-1]], ends)] == plain_chunks(text) and n_words.sum() == 2000


def test_chunk_dedup_of_odd_rows(spark):
    df = odd.docs(spark)
    got = chunk_dedup.without_repeats(df, spans="went")
    assert got.columns == [*df.columns, "went"]
    rows = got.collect()
    assert len(rows) == len(odd.ROWS)
    by = {r.doc_id: r for r in rows}
    assert odd.PASSAGE in by[8].text and len(set(odd.PASSAGE.split()) & set(by[9].text.split())) < 30
    assert by[2].text is None and by[3].text == "" and by[6].text == odd.LONG and by[10].text == odd.ROWS[12][1]
    assert by[7].text == by[1].text  # eight words are too few
    assert chunk_dedup.without_repeats(odd.empty(spark)).collect() == []


# --- tokens


def test_bpe_equals_the_library(spark):
    lib, v = Tokenizer.from_file(bpe.vocabulary_path(VOCABULARY)), bpe.Vocabulary(VOCABULARY)
    r = random.Random(2)
    letters = "abAB 'stréÉΣσςİ  \x1c\x85\n\t09½Ⅳ!?-—🙂日本éǅﬀ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += ["a" * 501, "<|endoftext|>x<|startoftext|>", "'S it's DON'T we'll", "--......", "", "oooooooo zzzzz"]
    ours = bpe.Encoder(v).encode(texts)
    for t, a, b in zip(texts, ours, lib.encode_batch(texts, add_special_tokens=False)):
        assert a.tolist() == b.ids, t


def test_bpe_knows_every_code_point_as_the_library_does():
    lib, v = Tokenizer.from_file(bpe.vocabulary_path(VOCABULARY)), bpe.Vocabulary(VOCABULARY)
    # all that any installed table knows; the others are private or unassigned everywhere
    known = regex.compile(r"[^\p{Cn}\p{Co}\p{Cs}]")
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(sys.maxunicode + 1) if known.match(chr(c))]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        for t, a, b in zip(part, bpe.Encoder(v).encode(part), lib.encode_batch(part, add_special_tokens=False)):
            assert a.tolist() == b.ids, [hex(ord(c)) for c in t]


def test_bpe_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(bpe, "WORDS_HELD", 200)
    lib = Tokenizer.from_file(bpe.vocabulary_path(VOCABULARY))
    df = odd.docs(spark)
    got = bpe.coded(df, VOCABULARY, decoded="back")
    assert got.columns == [*df.columns, "ids", "back"]
    for r in got.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.back == lib.decode(ids, skip_special_tokens=False)
    again = bpe.with_decoded(got, VOCABULARY, to="twice").where("twice <> back or twice is null").count()
    assert again == 0
    assert bpe.coded(odd.empty(spark), VOCABULARY).collect() == []
    with pytest.raises(ValueError):
        bpe.coded(df, VOCABULARY, ids="fp")


# --- licenses


def test_license_words_equal_plain_python(spark, sf):
    got = {r.doc_id: r for r in queries()["op5_license_notices"](spark, sf).collect()}
    for d, text in [(r.doc_id, r.text) for r in documents(spark, sf).collect()]:
        w = WORD.findall(lowered(text))
        hits = sorted((i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
        row = left
    return row[-1]


def test_notices_with_edits():
    scan, r = license_scan.Scanner(), random.Random(4)
    for n in license_scan.NOTICES:
        for k in range(n.edits + 1):
            body = list(n.text)
            for at in r.sample(range(len(body)), k):
                body[at] = r.choice(["", "#", body[at] + "~"])
            found = [x for x in scan.fuzzy("xx yy " + "".join(body) + " zz") if x[0] == n.label]
            assert found and found[0][3] <= k
            span = ("xx yy " + "".join(body) + " zz")[found[0][1] : found[0][2]]
            assert edit_distance(span, n.text) == found[0][3] or found[0][3] <= n.edits
    assert scan.fuzzy("the quick brown fox has no rights at all") == []


def test_every_place_of_a_notice_counts():
    scan = license_scan.Scanner()
    text = "all right reserved. all rights reserved. all rights reserve."
    assert [(x[0], x[3]) for x in scan.fuzzy(text)] == [("all-rights-reserved", k) for k in (1, 0, 1)]
    n = next(n for n in license_scan.NOTICES if n.label == "apache")
    rough = n.text.replace("licensed", "licenced")
    assert [x[3] for x in scan.fuzzy(f"{rough} {n.text} {rough}") if x[0] == "apache"] == [1, 0, 1]


def test_licenses_of_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", None, None), (3, "MIT\nLicense; mit-license. smit license, MIT LICENSES", None, None), (3, "General Public  License", None, None)]
    got = license_scan.with_licenses(odd.docs(spark, rows)).select("doc_id", "licenses.*").collect()
    assert [(r.n_words, [(p.label, p.word) for p in r.phrases]) for r in got] == [(0, []), (0, []), (8, [("mit", 0), ("mit", 2)]), (3, [("gpl", 0)])]
    assert license_scan.with_licenses(odd.empty(spark)).collect() == []
    assert license_scan.with_licenses(odd.docs(spark)).count() == len(odd.ROWS)


# --- benchmark


def plain_hits(docs, items):
    windows = {}
    for i, text in items:
        w = WORD.findall(lowered(text))
        c = min(13, len(w))
        for s in range(len(w) - c + 1) if w else ():
            windows.setdefault(tuple(w[s : s + c]), set()).add(None if i is None else str(i))
    sizes = sorted({len(x) for x in windows})
    out = {}
    for d, text in docs:
        w = WORD.findall(lowered(text))
        hit, found = set(), set()
        for c in sizes:
            for s in range(len(w) - c + 1):
                if (g := windows.get(tuple(w[s : s + c]))) is not None:
                    hit.update(range(s, s + c))
                    found |= g
        out[d] = (len(w), len(hit), sorted(found - {None}), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_winnowing_equals_plain_python(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_hits([(r.doc_id, r.text) for r in documents(spark, sf).collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in winnow.hits(documents(spark, sf), bench).collect()}
    assert got == want and any(x[3] for x in want.values())
    mine = {r.doc_id: r for r in queries()["op9_winnowed_benchmark"](spark, sf).collect()}
    for d, (n, hit, items, bad) in want.items():
        assert (mine[d].n_words, mine[d].n_hit, mine[d].n_items, mine[d].contaminated) == (n, hit, len(items), bad)
        assert mine[d].items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()


@pytest.mark.parametrize("bound", [winnow.BROADCAST_ROWS, 0])
def test_winnowing_random_and_short_items(spark, monkeypatch, bound):
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", bound)
    r = random.Random(6)
    few = ["aa", "bb", "cc", "DD", "é", "x1"]
    items = [(i, " ".join(r.choice(few) for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 7, 12, 13, 14, 20, 40, 0, 13])] + [(None, "aa bb"), (3, "aa bb cc"), (99, None)]
    docs = [(i, ". ".join(r.choice(few) for _ in range(r.randint(0, 60)))) for i in range(60)] + [(100, None), (101, "zz " * 50)]
    docs += [(102 + k, "qq " + items[k][1] + " ww " + items[9][1][:50]) for k in range(12)]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as w", "2 as `class`", "3 as item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as w", "4 as doc_id")
    got = {x.doc_id: (x.n_words, x.n_hit, x.item_ids, x.contaminated) for x in winnow.hits(a, b).collect()}
    assert got == plain_hits(docs, items)


def test_winnowing_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, odd.PASSAGE)], "item_id long, text string")
    got = {r.doc_id: r for r in winnow.hits(odd.docs(spark), bench).collect()}
    assert len(got) == len({r[0] for r in odd.ROWS}) and got[8].n_hit == 70 == got[9].n_hit and got[2].n_words == 0
    assert all(r.n_hit == 0 for r in winnow.hits(odd.docs(spark), bench.limit(0)).collect())
    assert winnow.hits(odd.empty(spark), bench).collect() == []


# --- languages


def test_language_accuracy_on_held_out(spark):
    got = queries()["op10_language_id"](spark, "/root/testdata/sf0.01")
    truth = documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 300 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark):
    df = odd.docs(spark)
    model = langid.fit(df)
    assert model.langs == ["de", "en", "fr"]
    got = langid.predict(df, model)
    assert got.columns == [*df.columns, "language"]
    for r in got.collect():
        none = not any(c.isalpha() for c in r.text or "")
        assert (r.language.lang_pred == "und") == none and 0 <= r.language.score <= 1
    assert {r.language.lang_pred for r in langid.predict(df, langid.fit(odd.empty(spark))).collect()} == {"und"}
    one = langid.predict(df, langid.fit(df.where("lang = 'en'")))
    assert {r.language.lang_pred for r in one.collect()} == {"en", "und"}
    assert langid.predict(odd.empty(spark), model).collect() == []


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 20):
        code = langid.codewords(n)
        assert len({tuple(x) for x in code.tolist()}) == n
        assert (np.abs(code.sum(axis=0)) < n).all()
