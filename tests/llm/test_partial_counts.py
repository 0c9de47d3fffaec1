"""Partial counts of op13: blocks of a task, several sources, texts without terms."""

from collections import Counter

import pyarrow as pa

from colloquy.llm import divergence


def test_partial_counts_hold_every_occurrence(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    rows = [("fr", "a", "un deux un"), ("fr", "b", "deux é trois"), ("en", "a", None), ("en", "b", "12 !"), ("fr", "a", "Un quatre"), ("en", "a", "one"), ("", "", "x x x")]
    batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], names=["lang", "source", "text"])
    docs, counts = Counter(), Counter()
    out = list(divergence._partial_counts(64)(iter([batch, batch])))
    for b in out:
        for r in b.to_pylist():
            docs[r["lang"], r["term"]] += r["docs"]
            counts.update({(r["lang"], c["source"], r["term"]): c["n"] for c in r["counts"]})
    words = [(lang, source, [w.decode() for w in divergence.terms(text and text.encode())]) for lang, source, text in rows * 2]
    assert docs == Counter((lang, w) for lang, _, ws in words for w in set(ws))
    assert counts == Counter((lang, source, w) for lang, source, ws in words for w in ws)
    assert len(out) > 2
