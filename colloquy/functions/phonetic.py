"""Coarse French sound key of a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import fold

# Spelling to sound, applied in this order, ignoring case.
SOUND_RULES = (
    ("sch", "S"), ("ch", "S"), ("ph", "F"), ("th", "T"), ("gh", "G"), ("qu", "K"), ("gn", "N"),
    ("ll", "L"), ("mm", "M"), ("nn", "N"), ("tt", "T"), ("ss", "S"), ("rr", "R"), ("pp", "P"),
    ("ck", "K"), ("x", "KS"), ("z$", "S"), ("c(?=[eiy])", "S"), ("g(?=[eiy])", "J"),
    ("c", "K"), ("q", "K"), ("w", "V"),
)
SILENT_TAIL = "(?:[sStTdDxXzZpP]|(?<=..)e)+$"


def phonetic_key(word: Column | str) -> Column:
    c = F.regexp_replace(fold(word), "[^a-z]", "")
    for pattern, sound in SOUND_RULES:
        c = F.regexp_replace(c, "(?i)" + pattern, sound)
    c = F.regexp_replace(c, "[h ]", "")
    c = F.regexp_replace(c, r"(.)\1+", "$1")
    c = F.regexp_replace(c, SILENT_TAIL, "")
    return F.upper(F.regexp_replace(c, "(?i)[aeiouy]+", "A"))
