"""License scan: exact phrases by words, short notices with a bounded number of edits.

A notice that may have k edits is split into k+1 pieces; whatever matches it
holds one piece unchanged (pigeonhole). One automaton finds all pieces of all
notices; around a found piece the regex library's bounded-error matching
verifies the notice and says where it stands and how many edits it has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (words, label) of exact phrases.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Notice:
    """A notice in lower case, the label it stands for, and the edits it may have."""

    text: str
    label: str
    edits: int


NOTICES = (
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted, free of charge, to any person obtaining a copy", "mit", 6),
    Notice("licensed under the apache license, version 2.0", "apache", 4),
    Notice("you may not use this file except in compliance with the license", "apache", 5),
    Notice("licensed under the gnu general public license, version 3", "gpl", 5),
    Notice("under the terms of the gnu general public license", "gpl", 4),
    Notice("redistribution and use in source and binary forms, with or without modification", "bsd", 6),
    Notice("licensed under cc by-nc 4.0", "cc-by-nc", 2),
    Notice("licensed under a creative commons attribution", "cc", 4),
    Notice("this source code form is subject to the terms of the mozilla public license", "mpl", 6),
    Notice("all rights reserved", "all-rights-reserved", 1),
)

_WORD = rb"[0-9A-Za-z\x80-\xff]"
_BETWEEN = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

RESULT = "struct<n_words:bigint,phrases:array<struct<label:string,word:bigint>>,notices:array<struct<label:string,start:bigint,end:bigint,edits:int,likeness:double>>>"


def word_starts(text: bytes) -> np.ndarray:
    inside = _IN_WORD[np.frombuffer(text, np.uint8)]
    inside[1:] &= ~inside[:-1].copy()
    return np.flatnonzero(inside)


def _phrase_patterns(phrases):
    out = []
    for phrase, label in phrases:
        body = _BETWEEN.join(map(re.escape, phrase.encode().split()))
        out.append((phrase.encode().split()[-1], re.compile(rb"(?<!" + _WORD + rb")(?=" + body + rb"(?!" + _WORD + rb"))"), label))
    return out


class Scanner:
    """Compiled phrases and notices."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases = _phrase_patterns(phrases)
        self.notices = notices
        self.verify = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in notices]
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            cuts = [round(p * len(n.text) / (n.edits + 1)) for p in range(n.edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(n.text[a:b], []).append((i, a))
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if seeds:
            self.automaton.make_automaton()

    def _windows(self, low: str) -> dict[int, list[list[int]]]:
        """Per notice the stretches of text where it may stand, overlapping ones joined."""
        out: dict[int, list[list[int]]] = {}
        if not len(self.automaton):
            return out
        for end, (size, uses) in self.automaton.iter(low):
            for i, offset in uses:
                n = self.notices[i]
                a = max(0, end + 1 - size - offset - n.edits)
                b = min(len(low), end + 1 - size - offset + len(n.text) + n.edits)
                mine = out.setdefault(i, [])
                if mine and a <= mine[-1][1]:
                    mine[-1] = [min(a, mine[-1][0]), max(b, mine[-1][1])]
                else:
                    mine.append([a, b])
        return out

    def fuzzy(self, low: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, likeness) of the notices in a lower-case text, not overlapping for one notice."""
        found = []
        for i, windows in self._windows(low).items():
            n = self.notices[i]
            # The search gives the best place of a stretch, so both what is before and what is after it is searched again.
            open_parts = windows
            while open_parts:
                a, b = open_parts.pop()
                if a < b and (m := self.verify[i].search(low, a, b)):
                    edits = sum(m.fuzzy_counts)
                    found.append((n.label, m.start(), m.end(), edits, 1 - edits / len(n.text)))
                    open_parts += [[a, m.start()], [m.end(), b]]
        return sorted(found, key=lambda x: (x[1], x[2], x[0], x[3]))

    def scan(self, text: bytes | None) -> dict:
        low = (text or b"").lower()
        starts = word_starts(low)
        exact = []
        for last, pattern, label in self.phrases:
            if last in low:
                places = np.array([m.start() for m in pattern.finditer(low)], np.int64)
                exact += [{"label": label, "word": int(w)} for w in np.searchsorted(starts, places)]
        near = [dict(zip(("label", "start", "end", "edits", "likeness"), x)) for x in self.fuzzy(low.decode())]
        return {"n_words": len(starts), "phrases": sorted(exact, key=lambda x: (x["word"], x["label"])), "notices": near}


def with_licenses(docs: DataFrame, text: str = "text", to: str = "licenses", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """``docs`` with a struct ``to``: n_words, exact phrases (label, word) and notices (label, character span, edits, likeness).

    A-Z are lowered, nothing else. Null and empty texts have no words and no
    finds. Every place counts, in whole texts; finds of one notice don't overlap.
    """

    @F.arrow_udf(RESULT)
    def licenses(texts: pa.Array) -> pa.Array:
        scanner = Scanner(phrases, notices)
        kind = pa.struct([("n_words", pa.int64()), ("phrases", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))), ("notices", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("likeness", pa.float64())])))])
        return pa.array([scanner.scan(x.as_py()) for x in texts.cast(pa.binary())], kind)

    return docs.withColumn(to, licenses(F.col(text)))
