"""BPE encoding by an index of pair occurrences, and decoding.

A task lays the distinct words of a batch end to end as symbols and keeps, for
every mergeable pair, the list of all its positions in the batch. The lowest
rank that still has positions is merged everywhere at once; the pairs that
vanish are skipped when their list is read, the new neighbours are appended to
the lists of their ranks. A text's ids are its words' ids in order.

The vocabulary file (JSON of the tokenizers library, BPE over byte letters
with a word-end mark) is a parameter, a path or a name that each executor looks up, not copied.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct words that a task remembers, new ones that are merged at once, texts that are encoded and that leave a task at once.
WORDS_HELD = 300_000
WORDS_AT_ONCE = 60_000
TEXTS_TOGETHER = 2_048
TEXTS_AT_ONCE = 256


def byte_letters() -> list[str]:
    """The printable letter of each byte: Latin-1's printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: Letters and numbers that Unicode 16.0 added to 15.1, which ``unicodedata`` may not know yet. The tokenizers library has 16.0.
ADDED = {
    "L": (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
        (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ),
    "N": (
        (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
    ),
}

#: Capitals that Unicode 16.0 and 17.0 added, as (first, last, first small letter).
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
SMALL = {c: small + c - a for a, b, small in CAPITALS for c in range(a, b + 1)}
NEW_CAPITAL = re.compile("[" + "".join(map(chr, SMALL)) + "]")

#: No letter, number or space stands in the planes from the fourth on.
LETTERS_END = 0x40000
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _ranges(head: str, end: int) -> str:
    """The code points below ``end`` of a general category (or white space), as ranges of a character set.

    The installed regex library knows newer letters and digits than the tokenizers library, so they are not taken from there.
    """
    end = min(end, LETTERS_END)
    if head == "s":
        runs = regex.finditer(r"\p{White_Space}+", "".join(map(chr, range(end))))
    else:
        heads = [kind[0] for kind in map(unicodedata.category, map(chr, range(end)))]
        for a, b in ADDED[head]:
            heads[a : b + 1] = [head] * len(heads[a : b + 1])
        runs = re.finditer(f"{head}+", "".join(heads))
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in runs)


def pattern_below(pattern: str, end: int) -> str:
    """``pattern`` with its letter, number and space classes written out for texts of the code points below ``end``."""
    sets = {r"\p{L}": _ranges("L", end), r"\p{N}": _ranges("N", end), r"\s": _ranges("s", end)}
    out = re.sub(r"\[(\^?)([^\]]*)\]", lambda m: "[" + m[1] + "".join(sets[x] for x in re.findall(r"\\p\{.\}|\\s", m[2])) + "]", pattern)
    for name, chars in sets.items():
        out = out.replace(name, f"[{chars}]")
    return out


def vocabulary_path(name: str) -> str:
    """Where this machine keeps a vocabulary: a path as it is, a bare file name from the installed package of public vocabularies."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Tokens, merge ranks, and the text rules of one vocabulary file."""

    def __init__(self, name: str):
        with open(vocabulary_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = np.array([None] * (max([*ids.values(), *special.values()]) + 1), object)
        for token, i in (*ids.items(), *special.items()):
            self.tokens[i] = token
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        steps = [s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        pattern = steps[0]["pattern"]["Regex"]
        self.words = re.compile(pattern_below(pattern, sys.maxunicode + 1))
        self.plain_words = re.compile(pattern_below(pattern, 0x10000))
        self.latin_words = re.compile(pattern_below(pattern, 256))
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int64)
        self.last = np.array([ids[x + end] for x in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.pair_keys, self.pair_ranks = key[order], order
        self.left, self.right, self.made = left, right, made

    def normal(self, text: str) -> str:
        """NFC and lower case letter by letter (a final sigma stays a plain one)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if NEW_CAPITAL.search(text):
                text = text.translate(SMALL)
        return text.lower()

    def split_words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            # a class of characters of the first plane is one look into a table, one of all planes a walk over ranges
            return (self.words if ASTRAL.search(text) else self.plain_words).findall(text)
        return self.latin_words.findall(text)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, ids of each word) by the pair occurrence index."""
    data = [w.encode() for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    n = int(sizes.sum())
    flat = np.frombuffer(b"".join(data), np.uint8)
    symbol = np.empty(n + 2, np.int64)
    symbol[:n] = v.inner[flat]
    stops = np.cumsum(sizes) - 1
    symbol[stops] = v.last[flat[stops]]
    symbol[n:] = -1
    word = np.repeat(np.arange(len(data)), sizes)
    # neighbours of each position; n and n + 1 stand for "none" after and before
    after, before = np.arange(1, n + 3), np.arange(-1, n + 1)
    after[stops] = n
    before[np.concatenate(([0], stops[:-1] + 1))] = n + 1
    alive = np.ones(n + 2, bool)
    alive[n:] = False
    fresh = np.zeros(n, bool)
    places: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def index(at: np.ndarray) -> None:
        rank = v.ranks(symbol[at], symbol[after[at]])
        hit = rank >= 0
        if not hit.any():
            return
        at, rank = at[hit], rank[hit]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, a, b in zip(rank[np.concatenate(([0], cuts))].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            if r in places:
                places[r].append(at[a:b])
            else:
                places[r] = [at[a:b]]
                heapq.heappush(active, r)

    firsts = np.flatnonzero(after[:n] < n)
    index(firsts)
    while active:
        r = heapq.heappop(active)
        lists = places.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)  # a place may be listed twice
        a, b = v.left[r], v.right[r]
        at = at[alive[at] & (symbol[at] == a) & (symbol[after[at]] == b)]
        if a == b and len(at) > 1:  # in a run of one symbol the first, third, ... place is merged
            at = np.unique(at)
            joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
            run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at] = v.made[r]
        alive[gone] = False
        after[at] = after[gone]
        behind = after[at]
        before[behind[behind < n]] = at[behind < n]
        ahead = before[at]
        ahead = ahead[ahead < n]
        fresh[at] = True
        index(np.concatenate((at[behind < n], ahead[~fresh[ahead]])))
        fresh[at] = False
    keep = np.flatnonzero(alive[:n])
    return symbol[keep], np.bincount(word[keep], minlength=len(data))


class _Words(dict):
    """Number of each distinct word, in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _numbered(text: str | None, v: Vocabulary, known: _Words) -> np.ndarray:
    """Word numbers of a text; special tokens written in it are -1 - id."""
    if not text:
        return np.zeros(0, np.int32)
    parts = v.split_special.split(text) if v.split_special else [text]
    out = []
    for k, part in enumerate(parts):
        if k % 2:
            out.append(np.array([-1 - v.special[part]], np.int32))
        elif part:
            found = v.split_words(v.normal(part))
            out.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.int32)


def _gather(numbers: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ids of a sequence of word numbers."""
    special = numbers < 0
    if not len(size):
        return -1 - numbers
    plain = np.where(special, 0, numbers)
    n = np.where(special, 1, size[plain])
    ends = np.cumsum(n)
    inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
    flat = np.repeat(np.where(special, 0, first[plain]), n) + inside
    out = ids[np.minimum(flat, len(ids) - 1)]
    if special.any():
        out[(ends - n)[special]] = -1 - numbers[special]
    return out


class Encoder:
    """Encodes texts; remembers the ids of about WORDS_HELD distinct words, then starts afresh."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.size = _Words(), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _merge_new(self) -> None:
        new = list(itertools.islice(self.known, len(self.size), None))
        if new:
            ids, size = encode_words(new, self.v)
            self.ids, self.size = np.concatenate((self.ids, ids)), np.concatenate((self.size, size))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; words that are new are merged together."""
        if len(self.known) >= WORDS_HELD:
            self._forget()
        out: list[np.ndarray] = []
        numbered: list[np.ndarray] = []
        for k, text in enumerate(texts):
            numbered.append(_numbered(text, self.v, self.known))
            if len(self.known) - len(self.size) >= WORDS_AT_ONCE or k == len(texts) - 1:
                self._merge_new()
                first = np.cumsum(self.size) - self.size
                out += [_gather(x, self.ids, first, self.size) if len(x) else x for x in numbered]
                numbered = []
        return out


def _list_array(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)))


def _decoded(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    """The tokens of each list of ids, joined by one space."""
    first = ids.offsets[0].as_py() if len(ids) else 0
    named = pa.ListArray.from_arrays(pc.subtract(ids.offsets, first), tokens.take(ids.flatten()), mask=ids.is_null() if ids.null_count else None)
    return pc.binary_join(named, " ")


def coded(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None, drop_text: bool = False) -> DataFrame:
    """``docs`` with the token ids of ``text`` in ``ids`` (array<int>) and, if asked for, the text they decode to in ``decoded``.

    No special tokens are added; those written in a text count. Decoding joins
    all tokens, special ones too, by one space. A null or blank text has no ids (an
    empty array) and decodes to an empty text. Every other column stays.
    """
    new = [ids, *([decoded] if decoded else [])]
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text)]
    kinds = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded or "", T.StringType())][: len(new)]
    names = [f.name for f in kept]

    def work(batches):
        v = Vocabulary(vocabulary)
        encoder, tokens = Encoder(v), pa.array(v.tokens, pa.string())
        for batch in batches:
            for start in range(0, len(batch), TEXTS_TOGETHER):
                block = batch.slice(start, TEXTS_TOGETHER)
                coded_rows = encoder.encode(block.column(block.schema.get_field_index(text)).to_pylist())
                for at in range(0, len(block), TEXTS_AT_ONCE):
                    part = block.slice(at, TEXTS_AT_ONCE)
                    column = dict(zip(part.schema.names, part.columns))
                    rows = _list_array(coded_rows[at : at + TEXTS_AT_ONCE])
                    yield pa.RecordBatch.from_arrays([*(column[x] for x in names), rows, *([_decoded(rows, tokens)] if decoded else [])], names=[*names, *new])

    return docs.mapInArrow(work, T.StructType([*kept, *kinds]))


def with_decoded(docs: DataFrame, vocabulary: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text of a column of ids. Null ids give null."""

    held: list[pa.Array] = []  # filled once in each task

    @F.arrow_udf(T.StringType())
    def decode(rows: pa.Array) -> pa.Array:
        if not held:
            held.append(pa.array(Vocabulary(vocabulary).tokens, pa.string()))
        tokens = held[0]
        return pa.concat_arrays([_decoded(rows.slice(at, TEXTS_AT_ONCE), tokens) for at in range(0, len(rows), TEXTS_AT_ONCE)] or [pa.array([], pa.string())])

    return docs.withColumn(to, decode(F.col(ids)))
