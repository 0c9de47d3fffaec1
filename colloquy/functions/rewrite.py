"""Rewrites of transcript lines: spoken times, spelling, punctuation, case, labels, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import bind, fold, nfc

# Spoken hours.
HOURS = {
    "zéro": 0, "une": 1, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8,
    "neuf": 9, "dix": 10, "onze": 11, "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16,
    "dix-sept": 17, "dix sept": 17, "dix-huit": 18, "dix huit": 18, "dix-neuf": 19, "dix neuf": 19, "vingt": 20,
    "vingt et un": 21, "vingt-et-un": 21, "vingt-et-une": 21, "vingt-deux": 22, "vingt deux": 22,
    "vingt-trois": 23, "vingt trois": 23, "vingt-quatre": 24, "vingt quatre": 24,
}
# What may follow the hour, in minutes.
MINUTES = {
    "et demie": 30, "et demi": 30, "et quart": 15, "moins le quart": -15, "et quinze": 15, "et trente": 30,
    "et quarante-cinq": 45, "et quarante cinq": 45, "pile": 0,
}


def _alternatives(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


SPOKEN_TIME = rf"(?iU)(?<!\w)({_alternatives(HOURS)})\s+heures?(?:\s+({_alternatives(MINUTES)}|\d{{1,2}}))?(?!\w)"
# A private-use character that no transcript holds.
MARK = "\ue000"


def _lookup(table: dict[str, int], word: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.lower(word))


def _replace_each(text: Column, pattern: str, found: Column, new) -> Column:
    """Put ``new(match)`` in place of every match of ``pattern``.

    The text is cut at the matches and joined with the rewritten ones, so one
    pass serves any number of matches.
    """
    rest = F.split(F.regexp_replace(text, pattern, MARK), MARK)
    fresh = F.concat(F.transform(found, new), F.array(F.lit("")))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.zip_with(rest, fresh, lambda a, b: F.concat(a, b)), ""))


def spoken_times(text: Column) -> Column:
    """"neuf heures et demie" to "9h30" (fn_spoken_times)."""
    def clock(m: Column) -> Column:
        hour = _lookup(HOURS, F.regexp_extract(m, SPOKEN_TIME, 1))
        tail = F.lower(F.regexp_extract(m, SPOKEN_TIME, 2))
        digits = tail.try_cast("int")
        more = F.coalesce(_lookup(MINUTES, tail), F.when(digits < 60, digits), F.lit(0))
        h = F.when(more < 0, F.pmod(hour - 1, F.lit(24))).otherwise(hour)
        minutes = F.when(more < 0, more + 60).otherwise(more)
        return F.when(minutes > 0, F.format_string("%dh%02d", h, minutes)).otherwise(F.format_string("%dh", h))

    return _replace_each(text, SPOKEN_TIME, F.regexp_extract_all(text, F.lit(SPOKEN_TIME), F.lit(0)), clock)


# Endings of addresses.
TLDS = "fr|com|org|net|io|app|tech|eu"
SPELLED = rf"(?iU)(?<!\w)((?:[A-Za-zÀ-ÖØ-öø-ÿ][\s.\-]+){{2,}}[A-Za-zÀ-ÖØ-öø-ÿ])(\.(?:{TLDS}))?(?!\w)"


def spelled_words(text: Column) -> Column:
    """"C A S T E.fr" to "caste.fr"; up to three letters stay capitals (fn_spelling)."""
    def joined(m: Column) -> Column:
        letters = F.regexp_replace(F.regexp_extract(m, SPELLED, 1), r"[^A-Za-zÀ-ÖØ-öø-ÿ]", "")
        return F.concat(F.when(F.length(letters) <= 3, F.upper(letters)).otherwise(F.lower(letters)), F.lower(F.regexp_extract(m, SPELLED, 2)))

    return _replace_each(text, SPELLED, F.regexp_extract_all(text, F.lit(SPELLED), F.lit(0)), joined)


# Spoken signs, replaced in this order.
SPOKEN_SIGNS = (
    ("arobase", "@"), ("arrobase", "@"), ("arrobas", "@"), ("arobas", "@"), ("arobaze", "@"), ("at", "@"),
    ("point", "."), ("dot", "."), ("tiret", "-"), ("trait d'union", "-"), ("underscore", "_"), ("souligné", "_"),
    ("barre oblique", "/"), ("slash", "/"),
)
ADDRESS = rf"(?iU)@|\.(?:{TLDS})\b"
LINE_HEAD = r"^(\s*\[[^\]]*\]\s*(?:\([^)]*\)\s*)?)"


def spoken_punctuation(text: Column) -> Column:
    """Spoken signs to signs in the lines that hold an address (fn_spoken_punct)."""
    def one_line(line: Column) -> Column:
        head = F.regexp_extract(line, LINE_HEAD, 1)
        body = F.substring(line, F.length(head) + 1, F.length(line))
        out = body
        for spoken, sign in SPOKEN_SIGNS:
            out = F.regexp_replace(out, rf"(?iU)(?<!\w){spoken}(?!\w)", sign)
        out = F.regexp_replace(out, r"\s*@\s*", "@")
        out = F.regexp_replace(out, r"(?U)(?<=\w)\s*\.(?=\s*[a-zA-Z]{2,4}\b)", ".")
        out = F.regexp_replace(out, r"(?U)(?<=\w)\.\s+(?=[a-zA-Z]{2,4}\b)", ".")
        return F.when(body.rlike(ADDRESS), F.concat(head, out)).otherwise(line)

    lines = F.split(text, "(?<=\n)")
    return F.when(text.rlike(ADDRESS), F.array_join(F.transform(lines, one_line), "")).otherwise(text)


def canonical_case(lines: DataFrame, terms: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Glossary spelling for one-word terms outside brackets (fn_glossary_case).

    The words of a line are looked up in the glossary instead of running
    every term over every line. Terms made of word characters only are
    exact words; the later of two spellings wins, as when applied in order.
    """
    clean = terms.select(F.trim("term").alias("term"), "pos").where((F.length("term") >= 2) & F.col("term").rlike(r"(?U)^\w+$"))
    canon = clean.groupBy(F.lower("term").alias("_k")).agg(F.max_by("term", "pos").alias("_t"))
    # Odd pieces are words, even ones the text between them; bracket tags count as text.
    token = r"(?U)\[[^\]\n]*\]|\w+|(?:(?!\[[^\]\n]*\])\W)+"
    parts = lines.select(*ids, F.posexplode(F.regexp_extract_all(text, F.lit(token), F.lit(0))).alias("_i", "_w"))
    fixed = parts.join(canon, F.lower("_w") == F.col("_k"), "left").select(*ids, "_i", F.coalesce("_t", "_w").alias("_w"))
    return fixed.groupBy(*ids).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_w"))), lambda r: r["_w"]), "").alias(text))


def literal(word: str) -> str:
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


def replace_term(text: Column, old: str, new: str) -> tuple[Column, Column]:
    """Whole-word, any-case replacement and how often it happened (fn_replace_term)."""
    new = new.strip()
    t = nfc(text)
    if not old or not new or old.lower() == new.lower():
        return text, F.lit(0).cast("long")
    pattern = rf"(?iuU)\b{literal(old)}\b"
    return F.regexp_replace(t, pattern, new.replace("\\", r"\\").replace("$", r"\$")), F.regexp_count(t, F.lit(pattern)).cast("long")


def replace_in_list(terms: Column, old: str, new: str) -> Column:
    """The same in a list of terms, kept distinct whatever the case."""
    swapped = F.transform(terms, lambda t: F.when(F.lower(nfc(t)) == old.lower(), F.lit(new.strip())).otherwise(t))
    seen = lambda acc, t: F.when((t == "") | F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t)))
    return F.aggregate(swapped, F.array().cast("array<string>"), seen)


def relabel(text: Column, old: Column, new: Column) -> tuple[Column, Column]:
    """``[old]``, `` `old` `` and line-start ``old :`` to the new name, with the count (fn_relabel_text)."""
    t = nfc(text)
    quoted = F.concat(F.lit(r"\Q"), old, F.lit(r"\E"))
    safe = F.regexp_replace(new, r"([\\$])", r"\\$1")
    shapes = (
        (F.concat(F.lit(r"\["), quoted, F.lit(r"\]")), F.concat(F.lit("["), safe, F.lit("]"))),
        (F.concat(F.lit("`"), quoted, F.lit("`")), F.concat(F.lit("`"), safe, F.lit("`"))),
        (F.concat(F.lit("(?m)^"), quoted, F.lit(r"(\s*:)")), F.concat(safe, F.lit("$1"))),
    )
    out, count = t, F.lit(0)
    for pattern, put in shapes:
        count = count + F.regexp_count(out, pattern)
        out = F.regexp_replace(out, pattern, put)
    noop = (old == "") | (F.trim(new) == "") | (old == new)
    return F.when(noop, t).otherwise(out), F.when(noop, 0).otherwise(count).cast("long")


TITLE_MIN_WORDS, TITLE_MAX_WORDS, TITLE_MIN_CHARS, TITLE_MAX_CHARS = 3, 12, 12, 80
# Openings and phrases that make a sentence, not a title.
SENTENCE_START = r"^(j['’ ]|je\b|tu\b|vous\b|nous\b|on\b|il faut\b|c'est\b|c’est\b|voilà\b|alors\b|du coup\b|là\b)"
FIRST_PERSON = r"\b(j['’]ai|je suis|je vais|j'aimerais|j’aimerais|on va|nous allons)\b"


def _strip_chars(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def file_stem(c: Column | str, fallback: str = "") -> Column:
    """A name safe for a file, 80 characters at most, cut at a word."""
    plain = _strip_chars(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " "), r" .\-_")

    def named(t: Column) -> Column:
        cut = _strip_chars(F.regexp_replace(F.substring(t, 1, 80), r" [^ ]*$", ""), r" .\-_")
        return F.coalesce(F.nullif(F.when(F.length(t) > 80, cut).otherwise(t), F.lit("")), F.lit(fallback))

    return F.element_at(F.transform(F.array(plain), named), 1)


def is_useful_title(title: Column | str, fallback: Column | str | None = None) -> Column:
    """Three to twelve words that name a topic (fn_title_useful)."""
    def named(t: Column) -> Column:
        low = F.lower(t)
        ok = (
            F.length(t).between(TITLE_MIN_CHARS, TITLE_MAX_CHARS)
            & F.size(F.filter(F.split(t, " "), lambda w: w != "")).between(TITLE_MIN_WORDS, TITLE_MAX_WORDS)
            & ~low.rlike("(?U)" + SENTENCE_START) & ~low.rlike("(?U)" + FIRST_PERSON)
        )
        return ok if fallback is None else ok & bind(file_stem(fallback), lambda f: (f == "") | (low != F.lower(f)))

    return bind(file_stem(title), named)


# Separators between a company and a topic, tried in this order.
TITLE_SEPARATORS = (" - ", " — ", " – ", " : ", " -- ")
HEAD_CHARS = 30


def strip_own_company(title: Column, variants: list[str]) -> Column:
    """Drop the user's own company, in any of its spellings, before a separator."""
    t = F.regexp_replace(title, r"^\s+", "")
    out = title
    for sep in reversed(TITLE_SEPARATORS):
        at = F.instr(t, sep) - 1
        head = fold(F.trim(F.substring(t, F.lit(1), at)))
        rest = F.regexp_replace(F.substring(t, at + 1 + len(sep), F.length(t)), r"^\s+", "")
        hit = (at > 0) & (at <= HEAD_CHARS) & head.isin(*variants) & rest.rlike(r"[\p{L}\p{N}]")
        out = F.when(hit, rest).otherwise(out)
    return out


def prefixed_title(title: Column, company: Column, own_variants: list[str]) -> Column:
    """"Company - title" unless the title has such a head already (fn_title_prefix)."""
    t = strip_own_company(title, own_variants)
    n = F.trim(t)
    low, c = F.lower(n), F.lower(company)
    return (
        F.when((company == "") | (n == ""), t)
        .when(F.startswith(low, F.concat(c, F.lit(" -"))) | F.startswith(low, F.concat(c, F.lit(" :"))), n)
        .when(F.substring(n, 1, HEAD_CHARS).contains(" - "), n)
        .otherwise(F.concat(company, F.lit(" - "), n))
    )


def meeting_instant(text: Column | str) -> Column:
    """ISO-8601 text to a UTC instant; no zone means UTC, nonsense gives NULL (fn_meeting_time)."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    iso = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?(?:Z|[+-]\d{2}:?\d{2})?$"
    zoned = t.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & t.rlike(r"\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})$") & t.rlike("[T ]")
    full = F.regexp_replace(F.when(zoned, t).otherwise(F.concat(t, F.when(t.rlike("[T ]"), "Z").otherwise("T00:00:00Z"))), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(t.rlike(iso), full.try_cast("timestamp"))


def utc_text(ts: Column | str) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
