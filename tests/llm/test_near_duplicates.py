"""Near duplicates of the pipeline against all pairs of exact shingle similarity."""

import itertools
import random

import corpus_pipeline
import pytest

from colloquy.llm import near_duplicates
from tests.llm import odd


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows, least=0.8):
    """Smallest id of each document's group by all pairs; rows: (id, text) of different ids."""
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {d: rows[root(i)][0] for i, (d, _) in enumerate(rows)}


def test_stage_drops_what_is_alike_by_four_fifths(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    groups = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    kept = {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, sf).collect()}
    assert kept == set(groups.values())


@pytest.mark.parametrize("rows", [near_duplicates.BLOCK_ROWS, 8])
@pytest.mark.parametrize("bound", [near_duplicates.BROADCAST_ROWS, 0])
def test_groups_equal_all_pairs(spark, monkeypatch, rows, bound):
    """Edited texts on both sides of the bound, a crowded group of chains among them, with small blocks too."""
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", rows)
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", bound)
    r = random.Random(3)
    texts = []
    for base, n in ((odd.words(200, 1), 60), (odd.words(120, 2), 10), (odd.words(7, 3), 4)):
        for _ in range(n):
            own = base[:]
            for at in r.sample(range(len(own)), r.randint(0, len(own) // 40)):
                own[at] = f"w{r.randint(0, 999)}"
            texts.append(" ".join(own))
    texts += ["one", "One ", "two", "", " ", "\n", "Öl und Wasser", "öl UND wasser"]
    data = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in near_duplicates.near_duplicate_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == plain_groups(data)


def test_near_duplicates_of_odd_rows(spark):
    got = near_duplicates.near_duplicate_groups(odd.docs(spark)).collect()
    assert len(got) == len(odd.ROWS)
    by = {x.doc_id: x.component_id for x in got}
    assert by[1] == by[7] == 1 and by[2] == by[3] == by[4] == 2 and by[None] is None and by[5] == 5
    assert near_duplicates.near_duplicate_groups(odd.empty(spark)).collect() == []
