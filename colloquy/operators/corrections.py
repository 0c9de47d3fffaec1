"""Proposed corrections: checks without the text, and their application to it."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import stage
from colloquy.functions.phonetic import phonetic_key
from colloquy.functions.text import fold
from colloquy.operators.glossary import close_pairs

MIN_CONFIDENCE, MAX_EDIT_SHARE, MAX_OCCURRENCES = 0.7, 0.45, 4
BETRAY_EDITS = 1


def matching_form(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(fold(c), r"\s+", " ")))


def edit_share(a: Column | str, b: Column | str) -> Column:
    na, nb = matching_form(a), matching_form(b)
    longest = F.greatest(F.length(na), F.length(nb))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(na, nb) / longest)


def early_rejection() -> Column:
    """Reasons that need neither the text nor the glossary, in order of test."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(blank("original") | blank("replacement"), "empty")
        .when(F.coalesce("confidence", F.lit(0.0)) < MIN_CONFIDENCE, "low_confidence")
        .when(matching_form("original") == matching_form("replacement"), "noop_after_normalization")
    )


def betrayed(corrections: DataFrame, terms: DataFrame) -> DataFrame:
    """Corrections that lead away from the glossary (txt_betrays_glossary).

    ``corrections``: id, original, replacement. ``terms``: term, pos. The
    first term that sounds like the original decides: it must be in the
    replacement. Each distinct original is spelled as a sound and decided once.
    """
    led = _decided(corrections.select("id", "original", "replacement"), terms)
    return led.where(F.col("term").isNotNull() & ~_kept()).select("id", "term")


def _kept() -> Column:
    """Whether the replacement holds the deciding term."""
    return (matching_form("term") != "") & F.contains(matching_form("replacement"), matching_form("term"))


def _decided(corrections: DataFrame, terms: DataFrame) -> DataFrame:
    """Corrections with the ``term`` that decides about their original, null if none does."""
    c = stage.cut(corrections.select("original").distinct().withColumn("key", phonetic_key("original")), "originals").where(F.col("key") != "")
    t = terms.select(F.trim("term").alias("term"), "pos").where(F.col("term") != "").withColumn("term_key", phonetic_key("term"))
    t = stage.cut(t, "terms").where(F.col("term_key") != "")
    keys = close_pairs(c, "key", t, "term_key", BETRAY_EDITS).drop("distance")
    # The deciding term is found once per distinct key, not per correction.
    decides = keys.join(t, "term_key").groupBy("key").agg(F.min_by("term", "pos").alias("term"))
    return corrections.join(c.join(decides, "key").select("original", "term"), "original", "left")


class _Bases(dict):
    """Lower-case compatibility forms of characters without their marks, by code point, as they come up."""

    def __missing__(self, cp: int) -> str:
        form = self[cp] = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c)).lower()
        return form


_BASES = _Bases()


class _Text:
    """A text whose matching form is searched; white space matches any other."""

    def __init__(self, text: str):
        self.text, self.form, self._ends = text, text.translate(_BASES), None

    def _span(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the text whose form stands from ``start`` to ``end``."""
        if self._ends is None:
            # Most texts keep their length letter by letter, so that places in the form are those in the text.
            same = len(self.form) == len(self.text) and all(len(_BASES[ord(c)]) == 1 for c in set(self.text))
            self._ends = () if same else list(accumulate(len(_BASES[ord(c)]) for c in self.text))
        return (bisect_right(self._ends, start), bisect_left(self._ends, end) + 1) if self._ends else (start, end)

    def places(self, quote: str) -> list[tuple[int, int]]:
        """Every stretch of the text, overlapping ones too, whose matching form is that of ``quote``."""
        wanted = quote.translate(_BASES).split()
        if not wanted:
            return []
        rest, out = re.compile(r"\s+".join(map(re.escape, wanted))), []
        at = self.form.find(wanted[0])
        while at >= 0:
            m = rest.match(self.form, at)
            if m:
                out.append(self._span(at, m.end()))
            at = self.form.find(wanted[0], at + 1)
        return out


def _stamp(c) -> tuple:
    """Sort key: corrections with a clock by it, the others after them, in the order given."""
    clock = re.match(r"(\d{1,2}):(\d{2})(?::(\d{2}))?", (c["timestamp"] or "").strip())
    return (not clock, *(int(x or 0) for x in clock.groups()), c["seq"]) if clock else (True, c["seq"])


def _outcome(c, places) -> str:
    """Why a correction is not applied, or that it is."""
    if c["early"]:
        return c["early"]
    checks = (("not_found", not places), ("betrays_glossary", c["betrays"]), ("too_distant", c["share"] > MAX_EDIT_SHARE))
    return next((name for name, fails in checks if fails), "applied")


def _corrected(text: str, corrections):
    """The corrections of one text; a later one sees the text that the earlier ones leave."""
    now, log = _Text(text), []
    for c in sorted(corrections, key=_stamp):
        places = [] if c["early"] else now.places(c["original"])
        outcome = _outcome(c, places)
        places = places[:MAX_OCCURRENCES] if outcome == "applied" else []
        log.append((c["seq"], outcome, len(places)))
        if places:
            put = c["replacement"].strip()
            now = _Text(reduce(lambda t, span: t[: span[0]] + put + t[span[1] :], reversed(places), now.text))
    return now.text, log


def _correct(batches):
    for batch in batches:
        texts, lists = batch.column("text").to_pylist(), batch.column("corrections").to_pylist()
        done = [(t, []) if c is None else _corrected(t, c) for t, c in zip(texts, lists)]
        log = pa.array([[dict(zip(("seq", "outcome", "occurrences"), x)) for x in d[1]] for d in done], _LOG)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([d[0] for d in done], pa.string()), log], ["id", "text", "log"])


_LOG = pa.list_(pa.struct([("seq", pa.int64()), ("outcome", pa.string()), ("occurrences", pa.int64())]))


def apply_corrections(texts: DataFrame, corrections: DataFrame, terms: DataFrame) -> DataFrame:
    """Texts with the accepted corrections and the outcome of each (txt_apply_corrections).

    ``texts``: id, text. ``corrections``: id, seq, timestamp, original,
    replacement, confidence, at most some dozens per text. Checks that do not
    depend on the text are columns; only the replacing is a helper per text.
    A correction that is rejected early is not held against the glossary.
    """
    checked = stage.cut(corrections.withColumn("early", early_rejection()), "checked-early")
    open_ = _decided(checked.where(F.col("early").isNull()), terms).withColumn("betrays", F.col("term").isNotNull() & ~_kept())
    closed = checked.where(F.col("early").isNotNull()).withColumn("betrays", F.lit(False))
    lists = open_.select(closed.columns).unionByName(closed).groupBy("id").agg(F.collect_list(F.struct(
        "seq", "timestamp", F.trim(F.coalesce("original", F.lit(""))).alias("original"), F.coalesce("replacement", F.lit("")).alias("replacement"),
        "early", "betrays", F.when(F.col("early").isNull(), edit_share("original", "replacement")).alias("share"))).alias("corrections"))
    kind = texts.schema["id"].dataType.simpleString()
    log = "array<struct<seq:bigint,outcome:string,occurrences:bigint>>"
    return texts.select("id", "text").join(lists, "id", "left").mapInArrow(_correct, f"id {kind}, text string, log {log}")


LITERAL_CONFIDENCE, LITERAL_MIN_CHARS = 0.75, 3


def apply_literal(texts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Older rule: exact quotes, every occurrence, in the order given (txt_apply_literal)."""
    o, r = F.trim(F.coalesce("original", F.lit(""))), F.trim(F.coalesce("replacement", F.lit("")))
    usable = (F.length(o) >= LITERAL_MIN_CHARS) & (r != "") & (o != r) & (F.coalesce("confidence", F.lit(0.0)) >= LITERAL_CONFIDENCE)
    lists = corrections.where(usable).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", o.alias("o"), r.alias("r")))).alias("c"))
    start = lambda text: F.struct(text.alias("text"), F.lit(0).cast("long").alias("applied"))
    step = lambda acc, c: F.struct(
        F.replace(acc["text"], c["o"], c["r"]).alias("text"), (acc["applied"] + F.when(F.contains(acc["text"], c["o"]), 1).otherwise(0)).alias("applied"))
    none = F.array().cast("array<struct<seq:bigint,o:string,r:string>>")
    rows = texts.join(lists, "id", "left").withColumn("a", F.aggregate(F.coalesce("c", none), start(F.col("text")), step))
    return rows.select("id", F.col("a.text").alias("text"), F.col("a.applied").alias("applied"))
