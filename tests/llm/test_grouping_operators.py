"""Near copies, shards, URL rules and chats against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from colloquy.llm import chat_format, components, sharding, simhash, url_rules
from tests.llm import odd
from tests.oracle import compare


def plain_groups(prints, distance):
    """Root (smallest index) of each fingerprint by all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(prints))]


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op7_equals_all_pairs(spark, sf):
    docs = sorted((r.doc_id, plain_simhash(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    roots = plain_groups([p for _, p in docs], 4)
    want = {d: (f"{p:016x}", docs[r][0]) for (d, p), r in zip(docs, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op7_simhash_near_copies"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("rows", [simhash.BLOCK_ROWS, 16])
@pytest.mark.parametrize("bound", [simhash.BROADCAST_ROWS, 0])
def test_links_of_planted_fingerprints(spark, monkeypatch, rows, bound):
    """Clusters of near fingerprints, a crowded one among them, with small blocks too."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", bound)
    r = random.Random(8)
    prints = [r.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1, 1 << 63]
    for base, n in ((prints[0], 250), (prints[1], 20), (prints[2], 20)):
        for _ in range(n):
            x = base
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4)).collect()
    group = {x: x for x in signed} | {n: root for n, root in found}
    want, got = defaultdict(set), defaultdict(set)
    for x, root in zip(signed, plain_groups(prints, 4)):
        want[root].add(x)
        got[group[x]].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_threshold_plans_lose_no_pair():
    r = np.random.default_rng(3)
    both = np.full((64, 64), 250) + np.diag(np.full(64, 250))
    for total in (10, 10_000, 10**7, 10**10):
        for distance in (0, 1, 3, 4, 6):
            parts = simhash.plan(total, (both * total / 1000).astype(np.int64), distance)
            bits = [b for part, _ in parts for b in part]
            assert len(bits) == len(set(bits))
            for _ in range(50):
                flipped = set(r.choice(64, distance, replace=False).tolist())
                assert any(len(flipped & set(part)) <= t for part, t in parts)


def test_near_copies_of_odd_rows(spark):
    got = simhash.near_copy_groups(odd.docs(spark)).collect()
    assert len(got) == len(odd.ROWS)
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[7] == 1 and by[2] == by[3] == by[4] == 2 and by[None] is None
    assert simhash.near_copy_groups(odd.empty(spark)).collect() == []
    assert simhash.near_copy_groups(odd.docs(spark).limit(1)).count() == 1


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 98), (98, 98), (7, 6), (None, 3), (200, 205), (203, 205)]
    found = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98, 200: 200, 203: 200, 205: 200}


# --- shards


def plain_best_fit(sizes, capacity):
    left, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(left) if room >= sizes[i]]
        if fits:
            out[i] = min(fits)[1]
            left[out[i]] -= sizes[i]
        else:
            out[i] = len(left)
            left.append(capacity - sizes[i])
    return out


def test_best_fit_decreasing_equals_a_plain_scan():
    r = random.Random(5)
    for _ in range(200):
        sizes = [r.randint(0, 30) for _ in range(r.randint(0, 60))]
        capacity = r.randint(1, 60)
        assert sharding.best_fit_decreasing(sizes, capacity) == plain_best_fit(sizes, capacity)
        assert not sizes or max(sharding.even_bins(sizes, 5)) < 5


def check_shards(rows, texts, shards):
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((d is None, d) for d, _ in texts)
    sizes = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == sizes
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert 0 <= r.shard < shards
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    where = defaultdict(set)
    body = {d: t or "" for d, t in texts}
    for r in rows:
        where[body[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    return {s: sum(r["size"] for r in held) for s, held in by.items()}


def test_op8_shards_are_even(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    load = check_shards(queries()["op8_even_shards"](spark, sf).collect(), texts, 40)
    assert len(load) == 40 and max(load.values()) <= 1.02 * sum(load.values()) / 40


def test_small_groups_share_parcels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FINE", 4)
    monkeypatch.setattr(sharding, "LOTS", 16)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    texts = [(i, " ".join(odd.words(5 + i % 7, i % 150))) for i in range(400)] + [(1000 + i, "hot " * 40) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as `size`", "3 as lot")
    load = check_shards(sharding.pack(df, 5).collect(), texts, 5)
    rest = sorted(load.values())[:-1]  # the hot text fills one shard
    assert max(rest) < 1.3 * min(rest)


def test_shards_of_odd_rows(spark):
    rows = sharding.pack(odd.docs(spark), 3).collect()
    check_shards(rows, [(d, t) for d, t, _, _ in odd.ROWS], 3)
    assert sharding.pack(odd.empty(spark), 3).collect() == []


# --- URL rules


def test_url_rules_of_odd_rows(spark, sf):
    name = "op6_url_verdicts"
    assert compare(queries()[name](spark, "/root/testdata/sf0.01"), oracle_sql()[name], "/root/testdata/sf0.01") == []
    urls = [None, "", "no scheme", "HTTPS://Sub.EXAMPLE.org/es/1?x#y", "http://example.org", "http://org/", "x://a.com/de/?://b.org/", "http://casino-win.net/", "http://casino-win.org/", "http://xorg/", "http://a.org/en/19"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(1, "http://casino-win.net/")], "page_id long, url string").selectExpr("*", "'q' as host", "1 as token", "2 as pattern")
    from colloquy.llm.queries import BASE_RULES, PATTERNS

    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, BASE_RULES, PATTERNS).select("page_id", "host", "path", "rule", "verdict").collect())
    want = [
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (1, "casino-win.net", "/", None, "block"), (2, "", "", None, "allow"), (3, "sub.example.org", "/es/1", "example.org/es/", "block"),
        (4, "example.org", "", None, "allow"), (5, "org", "/", "org/", "allow"), (6, "a.com", "/de/", "com/de/", "block"), (7, "casino-win.net", "/", None, "block"),
        (8, "casino-win.org", "/", "org/", "allow"), (9, "xorg", "/", None, "allow"), (10, "a.org", "/en/19", "org/", "allow"),
    ]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert url_rules.judge(df.limit(0), BASE_RULES, PATTERNS).collect() == []


def test_rarest_token_is_the_key(spark):
    urls = spark.createDataFrame([("http://a.b/free",), ("http://a.c/free-bets",), ("http://free.d/",)], "url string")
    pattern = url_rules.Pattern("bets", "free-bets", ("free", "bets"))
    assert url_rules.rarest_tokens(urls, [pattern]) == {"bets": "bets"}
    assert [r.url for r in url_rules.matches(urls, [pattern]).collect()] == ["http://a.c/free-bets"]


# --- chats


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_op2_gives_the_marked_turns_back(spark, sf):
    said = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    got = {(r.conv_id, r.turn): r for r in queries()["op2_chat_turns"](spark, sf).collect()}
    assert len(got) == len(said)
    for r in said:
        assert (got[r.conv_id, r.turn].role, got[r.conv_id, r.turn].text) == (r.role, r.text.strip(" "))


def test_unmarked_roles_are_recovered(spark):
    said = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    m = chat_format.fit(said.withColumnRenamed("conv_id", "conv"), unmarked=1 / 3)
    hidden = chat_format.label_lines(chat_format.transcript_lines(said, marked=F.col("turn") % 3 != 2), m).select("conv", "pos", "role")
    truth = said.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("truth"))
    rows = hidden.withColumn("turn", F.shiftright("pos", 32)).join(truth, ["conv", "turn"]).collect()
    assert len(rows) > 1000 and np.mean([r.role == r.truth for r in rows]) > 0.88
    unseen = [r for r in rows if r.turn % 3 == 2 and r.pos % (1 << 32) == 0]
    assert len(unseen) > 100 and np.mean([r.role == r.truth for r in unseen]) > 0.4  # of lines without a marker, among four roles


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(1)
    for n in (1, 2, 3):
        start, step, scores = r.normal(size=8), r.normal(size=(8, 8)), r.normal(size=(n, 8))
        score = lambda p: start[p[0]] + scores[0, p[0]] + sum(step[a, b] + scores[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))
        assert tuple(chat_format.best_path(start, scores, step)) == max(itertools.product(range(8), repeat=n), key=score)


def test_blocks_change_nothing(spark, monkeypatch):
    said = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    m = chat_format.fit(said.withColumnRenamed("conv_id", "conv"), unmarked=0.3)
    found = []
    for size in (64, 1, 2):
        monkeypatch.setattr(chat_format, "BLOCK_TURNS", size)
        lines = chat_format.transcript_lines(said, marked=F.col("turn") % 2 == 0)
        found.append(sorted(map(tuple, chat_format.format_chats(lines, m).collect())))
    assert found[0] == found[1] == found[2]


def test_chats_of_odd_rows(spark):
    rows = [(1, 0, "user", "Hello?"), (1, 1, "assistant", "**Bot:** yes\n\nno"), (1, 2, None, None), (2, 0, "user", ""), (2, 0, "user", ""), (None, 0, "user", "x"), (3, None, "user", "y"), (4, 5, "narrator", "once"), (6, -3, "user", "early"), (6, 70, "assistant", "late"), (5, 0, "tool", "z " * 50_000)]
    said = messages(spark, rows).selectExpr("*", "1 as block", "2 as pos", "3 as line")
    m = chat_format.fit(said.withColumnRenamed("conv_id", "conv"))
    got = chat_format.format_chats(chat_format.transcript_lines(said), m).collect()
    assert {r.conv for r in got} == {1, 2, 4, 5, 6}
    assert [(r.turn, r.role, r.text) for r in sorted((r for r in got if r.conv == 6), key=lambda r: r.turn)] == [(0, "user", "early"), (1, "assistant", "late")]
    assert [r.role for r in sorted((r for r in got if r.conv == 1), key=lambda r: r.turn)][:2] == ["user", "assistant"]
    assert next(r for r in got if r.conv == 5).role == "tool"
    assert chat_format.format_chats(chat_format.transcript_lines(said.limit(0)), m).collect() == []
