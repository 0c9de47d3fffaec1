"""Redaction by one pattern gives what the fold over tokens gives, on valid and on broken texts."""

import json
import random

from colloquy.operators import library


def nested(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.4:
        return rng.choice([0, 0.0, 1, -2.5, 1e9, True, False, None, "", "x", "token", 'a"b\\', "{[", "é\n"])
    if kind < 0.7:
        return {rng.choice(["token", "password", "mode", "api_key", 'to"ken', "k"]): nested(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    return [nested(rng, depth - 1) for _ in range(rng.randint(0, 3))]


def test_pattern_equals_the_fold(spark):
    rng = random.Random(15)
    texts = [json.dumps(nested(rng, rng.randint(1, 9)), separators=rng.choice([(",", ":"), (" , ", " : ")]), ensure_ascii=False) for _ in range(3000)]
    soup = ['"token"', '"password"', '"mode"', ":", ":", ":", ",", "{", "}", "[", "]", " ", "\n", '"', '""', '"a"', "\\", "0", "0.0", "0e5", "-0", "12", "true", "truex", "null", "token"]
    texts += ["".join(rng.choice(soup) for _ in range(rng.randint(0, 25))) for _ in range(12000)]
    texts += ['{"token":' + "[" * n + "1" + "]" * n + ',"mode":{"password":"p"}}' for n in range(1, 12)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", library.redact("t").alias("got"), library.redact_by_tokens("t").alias("want")).collect()
    assert [r for r in rows if r.got != r.want][:3] == []


def test_plain_settings_are_not_folded(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(library, "redact_by_tokens", lambda text: F.raise_error(F.lit("folded")))
    text = '{"mode":"m","token":"t","cloud":{"cloud_api_key":{"a":["1",{"b":1}]},"keys":[{"password":5},{"password":0}]},"access_token":""}'
    want = '{"mode":"m","token":"[redacted]","cloud":{"cloud_api_key":"[redacted]","keys":[{"password":"[redacted]"},{"password":0}]},"access_token":""}'
    many = "[" + ",".join([text] * 20000) + "]"
    df = spark.createDataFrame([(text,), (many,)], "t string").repartition(1)
    assert sorted(len(r[0]) for r in df.select(library.redact("t")).collect()) == [len(want), 20000 * (len(want) + 1) + 1]
