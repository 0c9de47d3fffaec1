"""Places of quotes in a text, and what the glossary check reads."""

import random
import re
import unicodedata

from colloquy import stage
from colloquy.operators import corrections


def plain_places(text, quote):
    """Stretches whose matching form is that of the quote, letter by letter."""
    base = lambda s: "".join("".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower() for x in s)
    ends, out = [len(base(text[: i + 1])) for i in range(len(text))], []
    wanted = base(quote).split()
    for m in re.finditer("(?=(" + r"\s+".join(map(re.escape, wanted)) + "))", base(text)) if wanted else []:
        first = next(i for i, e in enumerate(ends) if e > m.start(1))
        out.append((first, next(i for i, e in enumerate(ends) if e >= m.end(1)) + 1))
    return out


def test_places_are_those_of_the_letter_by_letter_form():
    rng = random.Random(11)
    for _ in range(3000):
        letters = rng.choice(["aA b", "aéÀ b\n", "aéﬁ…İß ́", "ab ́̂"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        quote = "".join(rng.choice(letters) for _ in range(rng.randint(0, 4)))
        assert corrections._Text(text).places(quote) == plain_places(text, quote), (text, quote)


def test_originals_are_spelled_once(spark, monkeypatch):
    rows = [(i, s, "", f"Moli{i % 3}", r, c) for i in range(60) for s, r, c in ((1, "autre", 0.9), (2, "faible", 0.1), (3, " ", 0.9))]
    fixes = spark.createDataFrame(rows, "id long, seq long, timestamp string, original string, replacement string, confidence double")
    texts = spark.createDataFrame([(i, f"un moli{i % 3} ici") for i in range(60)] + [(99, None)], "id long, text string")
    cut, seen = stage.cut, {}

    def counted(df, name):
        out = cut(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(stage, "cut", counted)
    terms = spark.createDataFrame([("Mollie", 1)], "term string, pos long")
    got = {r.id: (r.text, {c.seq: (c.outcome, c.occurrences) for c in r.log}) for r in corrections.apply_corrections(texts, fixes, terms).collect()}
    assert got.pop(99) == (None, {})
    assert got == {i: (f"un moli{i % 3} ici", {1: ("betrays_glossary", 0), 2: ("low_confidence", 0), 3: ("empty", 0)}) for i in range(60)}
    assert seen["originals"] == 3
