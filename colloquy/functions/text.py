"""Text expressions used by the transcript jobs (all JVM-side)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _base(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Letters whose compatibility form is one character, and the few longer ones."""
    one, to, many = [], [], []
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        ch = chr(cp)
        b = _base(ch)
        if b == ch or not b:
            continue
        if len(b) == 1:
            one.append(ch)
            to.append(b)
        elif cp in (0x2026,) or 0xFB00 <= cp < 0xFB07:
            many.append((ch, b))
    return "".join(one), "".join(to), tuple(many)


def fold(text: Column | str) -> Column:
    """Lower case without accents: compatibility letters to their base form."""
    one, to, many = _fold_tables()
    c = F.translate(_col(text), one, to)
    for ch, b in many:
        c = F.replace(c, F.lit(ch), F.lit(b))
    return F.lower(F.regexp_replace(c, r"\p{M}", ""))


def nfc(text: Column | str) -> Column:
    """Compose the accents that follow a Latin letter (NFD text from macOS)."""
    t = _col(text)
    composed = t
    for mark in ("̀", "́", "̂", "̃", "̈", "̊", "̧"):
        for base in "aAeEiIoOuUyYnNcC":
            one = unicodedata.normalize("NFC", base + mark)
            if len(one) == 1:
                composed = F.replace(composed, F.lit(base + mark), F.lit(one))
    return F.when(t.rlike(r"\p{M}"), composed).otherwise(t)


def norm_text(text: Column | str) -> Column:
    """Comparison form of a segment text."""
    c = F.lower(F.trim(_col(text)))
    c = F.replace(F.replace(c, F.lit("’"), F.lit("'")), F.lit("…"), F.lit("..."))
    return F.trim(F.regexp_replace(c, "[^a-z0-9à-öø-ÿ']+", " "))


# Phrases of telephone hold messages.
HOLD_PHRASES = (
    "merci de votre appel",
    "merci de rester en ligne",
    "patienter quelques instants",
    "un correspondant va vous repondre",
    "votre appel est en attente",
    "cours de transfert",
    "nous allons y donner suite",
    "bienvenue a",
)
HOLD_REPEATED = ("merci de rester en ligne", "un correspondant va vous repondre")
# Subtitle credits a decoder invents over silence.
STOCK_LINES = (
    "sous titrage st 501",
    "sous titres realises par la communaute d'amara org",
    "merci d'avoir regarde cette video",
)
NOISE_COMPRESSION, NOISE_MAX_CHARS = 2.4, 4


def bind(value: Column, body) -> Column:
    """``body(value)`` as a boolean, with ``value`` computed once per row."""
    return F.exists(F.array(value), body)


def is_hold_message(normalized: Column) -> Column:
    """Hold-line speech: two phrases, or one of the stubborn ones twice."""
    def spoken(f: Column) -> Column:
        hits = sum((F.when(f.contains(p), 1).otherwise(0) for p in HOLD_PHRASES), F.lit(0))
        again = [F.regexp_count(f, F.lit(p)) >= 2 for p in HOLD_REPEATED]
        return (hits >= 2) | again[0] | again[1]

    # Two phrases, none inside another, are longer than the second shortest. Folding adds letters only to texts that are not plain.
    return ((F.length(normalized) >= sorted(map(len, HOLD_PHRASES))[1]) | normalized.rlike(r"[^\x00-\xFF]")) & bind(fold(normalized), spoken)


def is_hallucination(text: str = "text", compression: str = "compression_ratio") -> Column:
    """Blank, letterless, stock credit, hold message or over-compressed stub."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    stuffed = F.coalesce(F.col(compression), F.lit(0.0)) >= NOISE_COMPRESSION
    return (
        ~t.rlike("[A-Za-zÀ-ÖØ-öø-ÿ0-9]")
        | bind(norm_text(t), lambda n: n.isin(*STOCK_LINES) | n.startswith("sous titrage") | (stuffed & (F.length(n) <= NOISE_MAX_CHARS)) | is_hold_message(n))
    )


# Longest n-gram and fewest repeats of a decoder loop.
LOOP_MAX_NGRAM, LOOP_MIN_REPEATS = 6, 4
_ENOUGH_WORDS = r"\S" + r"\s++\S++" * (LOOP_MIN_REPEATS - 1)
_BARE = r"[.,;:!?…\"'()«»]*"


def _loop_pattern(n: int) -> str:
    gram = r"\S++ " * (n - 1) + r"\S++"
    spoken = rf"(?!{_BARE}(?: {_BARE}){{{n - 1}}}(?: |$))"
    return rf"(?<!\S){spoken}({gram})(?: \1(?!\S)){{{LOOP_MIN_REPEATS - 1},}}+"


def collapse_loops(text: Column | str) -> Column:
    """Cut an n-gram said four times or more to one and an ellipsis.

    Every pass collapses at the shortest size that repeats, and there are at
    most six passes. A text without any loop comes back as it was.
    """
    t = _col(text)
    squeezed = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), "^ | $", "")
    patterns = [_loop_pattern(n) for n in range(1, LOOP_MAX_NGRAM + 1)]

    def one_pass(c: Column) -> Column:
        out = c
        for p in reversed(patterns):
            out = F.when(c.rlike(p), F.regexp_replace(c, p, "$1 …")).otherwise(out)
        return out

    # A transform over a one-element array binds each pass once; the passes
    # after the first only run on a text that has a loop.
    first = F.transform(F.array(squeezed), one_pass)
    arr = first
    for _ in range(LOOP_MAX_NGRAM - 1):
        arr = F.transform(arr, one_pass)
    looped = F.transform(F.array(squeezed), lambda c: c.rlike("|".join(f"(?:{_numbered(p, i)})" for i, p in enumerate(patterns, 1))))
    # No loop without as many words as the fewest repeats, which is cheap to see.
    return F.when(t.rlike(_ENOUGH_WORDS) & F.element_at(looped, 1), F.element_at(arr, 1)).otherwise(t)


def _numbered(pattern: str, group: int) -> str:
    return pattern.replace(r"\1", rf"\{group}")


def html_text(raw: Column | str) -> Column:
    """Plain text of rich HTML: tags dropped, five entities read, blanks squeezed."""
    c = F.regexp_replace(F.coalesce(_col(raw), F.lit("")), "<[^>]+>", "")
    for entity, ch in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        c = F.replace(c, F.lit(entity), F.lit(ch))
    c = F.regexp_replace(c, r"&(?:nbsp|amp|lt|gt|quot|#\d+);", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def ascii_lower(text: Column | str) -> Column:
    """Lower case of A-Z only, as the library search folds."""
    return F.translate(_col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
