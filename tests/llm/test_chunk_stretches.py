"""Repeated passages go only where they stand together in one other place."""

from __future__ import annotations

import bisect
import itertools

from colloquy.llm import chunk_dedup
from colloquy.llm.queries import op3_chunk_dedup
from tests.llm import odd
from tests.llm.test_text_operators import plain_chunks


def plain_stretches(chunks):
    """(first, after the last) of the shortest runs of enough words from and up to each chunk."""
    so_far = [0, *itertools.accumulate(len(c.split()) for c in chunks)]
    least = chunk_dedup.LEAST_WORDS
    from_each = {(a, b) for a in range(len(chunks)) if (b := bisect.bisect_left(so_far, so_far[a] + least)) <= len(chunks)}
    return from_each | {(a, b) for b in range(1, len(chunks) + 1) if (a := bisect.bisect_right(so_far, so_far[b] - least) - 1) >= 0}


def plain_without_stretches(rows):
    """rows: (id, text) of different ids."""
    first, out = {}, {}
    for d, text in sorted(rows):
        chunks = plain_chunks(text) if text else []
        gone = set()
        for a, b in sorted(plain_stretches(chunks)):
            if first.setdefault(tuple(chunks[a:b]), (d, a, b)) != (d, a, b):
                gone.update(range(a, b))
        out[d] = b"".join(c for i, c in enumerate(chunks) if i not in gone).decode() if text else text
    return out


def test_stretches_equal_plain_python(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.text for r in op3_chunk_dedup(spark, sf).collect()} == plain_without_stretches(rows)
    rows += [(10_000, "ha " * 300), (10_001, None), (10_002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in chunk_dedup.without_repeats(df).collect()} == plain_without_stretches(rows)


def test_prose_of_chunks_of_many_documents_stays(spark):
    """Every chunk of the last text stands in another document, no two in a row in the same one."""
    rows = [(i, " ".join(odd.words(60, 100 + i))) for i in range(20)]
    long = [[c for c in plain_chunks(t)[1:-1] if len(c) >= chunk_dedup.WINDOW] for _, t in rows]
    mosaic = b"".join(x[k] for k in range(2) for x in long).decode()
    passage = " ".join(rows[0][1].split()[5:56])
    rows += [(50, mosaic), (51, " ".join(odd.words(30, 7)) + " " + passage + " " + " ".join(odd.words(30, 8)))]
    got = {r.doc_id: r.text for r in chunk_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == mosaic
    assert all(got[d] == t for d, t in rows[:20])
    assert len(set(passage.split()) & set(got[51].split())) < 20


def test_text_ids_and_rows_without_an_id(spark):
    passage = " ".join(odd.words(60, 21))
    texts = [("d1", passage), ("d0", "before it " + passage), (None, passage + " after it"), (None, passage), ("d2", " ".join(odd.words(40, 22)))]
    got = chunk_dedup.without_repeats(spark.createDataFrame(texts, "doc_id string, text string")).collect()
    left = sorted((r.doc_id or "", len(set(passage.split()) & set(r.text.split()))) for r in got)
    assert [n > 50 for _, n in left] == [False, False, True, False, False] and len(got) == 5
    alone = [(None, passage), (None, passage)]
    assert [r.text for r in chunk_dedup.without_repeats(spark.createDataFrame(alone, "doc_id string, text string")).collect()] == [passage] * 2
