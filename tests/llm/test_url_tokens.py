"""Tokens of URL patterns are whole tokens of whatever the pattern matches."""

import re

import pytest
from pyspark.sql import functions as F

from colloquy.llm import url_rules
from colloquy.llm.queries import BASE_RULES, PATTERNS

MATCHED = {
    "adult": ["http://adult-x9.net/"],
    "casino": ["http://casino-win.net/", "http://my.casino-win-now.net/"],
    "bets": ["http://free-bets.net/"],
    "ads": ["http://ads-track.net/"],
    "spam": ["http://spam-farm.net/"],
    "pills": ["http://cheap-pills.net/"],
    "blog-feed": [f"http://blog.x.net/p?utm_source={x}" for x in ("feed", "feedburner", "feedly", "feed2&a=b", "feed#c")],
}


def test_listed_tokens_stand_in_every_match():
    for p in PATTERNS:
        for url in MATCHED[p.name]:
            assert re.search(p.regex, url), (p.name, url)
            assert set(p.tokens) <= set(re.split("[^a-z0-9]+", url)), (p.name, url)


@pytest.mark.parametrize("beside", [[], ["http://a.net/utm?source=1"] * 3, ["http://b.net/feed"]])
def test_a_longer_last_word_is_blocked_beside_any_rows(spark, beside):
    urls = MATCHED["blog-feed"] + beside
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.patterns) for r in url_rules.judge(pages, BASE_RULES, PATTERNS).collect()}
    assert [got[i] for i in range(5)] == [("block", ["blog-feed"])] * 5


def test_columns_of_the_operators_own_names(spark):
    pages = spark.createDataFrame([(1, "http://spam-farm.net/", "a", "b"), (2, None, "c", "d")], "page_id long, url string, _matched string, _url string")
    got = url_rules.judge(pages.withColumns({"_block": F.lit(1), "_RULE": F.lit("x")}), BASE_RULES, PATTERNS)
    assert {"_matched", "_url", "_block", "_RULE"} <= set(got.columns)
    assert sorted((r.page_id, r.verdict, r["_matched"], r["_url"]) for r in got.collect()) == [(1, "block", "a", "b"), (2, "allow", "c", "d")]
