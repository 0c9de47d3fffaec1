"""Clock texts. Times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("long")


def clock_srt(ms: Column | str, mark: str = ",") -> Column:
    m = F.greatest(_col(ms), F.lit(0).cast("long"))
    return F.format_string(
        f"%02d:%02d:%02d{mark}%03d", _div(m, 3_600_000), _div(m, 60_000) % 60, _div(m, 1000) % 60, m % 1000)


def clock_vtt(ms: Column | str) -> Column:
    return clock_srt(ms, ".")


def clock_short(ms: Column | str) -> Column:
    m = F.greatest(_col(ms), F.lit(0).cast("long"))
    return F.format_string("%02d:%02d:%02d", _div(m, 3_600_000), _div(m, 60_000) % 60, _div(m, 1000) % 60)


CLOCK = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?\s*$"


def clock_parse_ms(text: Column | str) -> Column:
    """``h:mm:ss(.mmm)``, ``mm:ss`` or bare seconds to milliseconds, else NULL."""
    t = F.trim(_col(text))
    part = lambda i: F.regexp_extract(t, CLOCK, i)
    whole = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(0).cast("long"))
    clock = (whole(1) * 3600 + whole(2) * 60 + whole(3)) * 1000 + F.coalesce(F.rpad(part(4), 3, "0").try_cast("long"), F.lit(0).cast("long"))
    seconds = F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
    return (
        F.when(t.rlike(CLOCK), clock)
        .when(t.rlike(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)$"), F.greatest(F.bround(seconds * F.lit(1000.0), 0).cast("long"), F.lit(0).cast("long")))
    )


def line_clock_seconds(stamp: Column) -> Column:
    """Two- or three-part clock of a rendered line to seconds."""
    parts = F.split(stamp, ":")
    at = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    return F.when(F.size(parts) == 2, at(0) * 60 + at(1)).when(
        F.size(parts) == 3, at(0) * 3600 + at(1) * 60 + at(2)).otherwise(F.lit(0).cast("long"))
