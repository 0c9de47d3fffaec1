"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1 and -1 bits. Per bit a binary
classifier over hashed byte n-grams (lower-case letters; everything else is one
separator) gives the mean log-odds of the two sides; the codeword with the
smallest weighted exponential loss is the prediction. A prediction whose loss
hardly differs from the runner-up's is flagged ambiguous.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents per language that a model is fitted on, about: the others of a language are left out by a hash of their id.
SAMPLE_DOCS = 4_000
#: Hashed n-gram features of each order 1 to 3.
FEATURES = 1 << 12
ORDERS = 3
#: Below this score a prediction is ambiguous.
AMBIGUOUS = 0.02
UNKNOWN = "und"
#: Bytes scored at once in a task.
PIECE = 1 << 17

_LETTER = regex.compile(r"\p{L}")


def codewords(n: int) -> np.ndarray:
    """n x bits matrix of +1 and -1: every split of up to six languages, else 63 splits far from each other."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        rest = list(itertools.product((1, -1), repeat=n - 1))[1:]
        return np.array([[1] * len(rest)] + [[s[i] for s in rest] for i in range(n - 1)], float)
    rng = np.random.default_rng(n)
    best, gap = None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, 63))
        code[:, np.abs(code.sum(axis=0)) == n] *= -1
        code[0, np.abs(code.sum(axis=0)) == n] *= -1
        apart = np.min(63 - (code @ code.T) - 1000 * np.eye(n) * -1)
        if apart > gap:
            best, gap = code, apart
    return best


def _letters() -> np.ndarray:
    """Byte map: A-Z to a-z, other ASCII but letters to 0, the bytes of other scripts stay."""
    to = np.arange(256)
    to[:128] = 0
    to[97:123] = np.arange(97, 123)
    to[65:91] = np.arange(97, 123)
    return to.astype(np.uint32)


_MAP = _letters()


def features(data: np.ndarray, ends: np.ndarray):
    """Per order, (byte places, slots) of the hashed n-grams that lie inside one text and hold a letter."""
    code = _MAP[data]
    new = np.zeros(len(data), bool)
    new[np.concatenate(([0], ends[:-1]))] = True
    gram, alive, whole = np.zeros(len(data), np.uint32), np.zeros(len(data), bool), np.ones(len(data), bool)
    for order in range(min(ORDERS, len(data))):
        if order:  # a gram of the order ends at a byte if the byte order-1 places before is no text's last one
            whole[order - 1 :] &= ~new[: len(data) - order + 1] if order > 1 else ~new
            whole[: order] = False
        gram[order:] = gram[order:] * np.uint32(0x01000193) + code[: len(data) - order] * np.uint32(0x9E3779B1)
        alive[order:] |= code[: len(data) - order] > 0
        at = np.flatnonzero(alive & whole)
        mixed = gram[at]
        yield at, ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(20)).astype(np.int64)


def pieces(texts: pa.Array):
    """(rows, bytes, ends) of runs of texts of about PIECE bytes."""
    data = [x.as_py() or b"" for x in texts.cast(pa.binary())]
    rows, size = [], 0
    for r, x in enumerate(data):
        if x:
            rows.append(r)
            size += len(x)
        if rows and (size >= PIECE or r == len(data) - 1):
            yield rows, np.frombuffer(b"".join(data[i] for i in rows), np.uint8), np.cumsum([len(data[i]) for i in rows])
            rows, size = [], 0


@dataclass
class Model:
    """Languages, their codewords, the weight of each n-gram per bit, and scale and weight of each bit."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    bit_weight: np.ndarray

    def margins(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean log-odds per bit of each text, in units of the bit's usual margin; 0 where a text has no n-gram."""
        owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends)))) * FEATURES
        total, n = np.zeros((len(ends), len(self.scale))), np.zeros(len(ends))
        for order, (at, slot) in enumerate(features(data, ends)):
            seen = np.bincount(owner[at] + slot, minlength=len(ends) * FEATURES).reshape(len(ends), FEATURES).astype(np.float32)
            total += seen @ self.weights[order]
            n += seen.sum(axis=1)
        return total / np.maximum(n, 1)[:, None] / self.scale

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score): the codeword of least weighted loss and how far the runner-up is, 0 to 1."""
        loss = np.exp(-np.clip(margins[:, None, :] * self.code[None], -4, 4)) @ self.bit_weight
        best = np.argmin(loss, axis=1)
        least = loss[np.arange(len(loss)), best]
        loss[np.arange(len(loss)), best] = np.inf
        second = loss.min(axis=1) if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, 1 - least / np.maximum(second, 1e-300)


def _count_features(batches):
    tally: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for rows, data, ends in pieces(batch.column(1)):
            names = sorted({langs[r] for r in rows})
            of = np.repeat(np.array([names.index(langs[r]) for r in rows]), np.diff(np.concatenate(([0], ends))))
            for order, (at, slot) in enumerate(features(data, ends)):
                seen = np.bincount(of[at] * FEATURES + slot, minlength=len(names) * FEATURES).reshape(len(names), FEATURES)
                for k, lang in enumerate(names):
                    tally.setdefault(lang, np.zeros(ORDERS * FEATURES, np.int64))[order * FEATURES : (order + 1) * FEATURES] += seen[k]
    for lang, n in sorted(tally.items()):
        slot = np.flatnonzero(n)
        yield pa.record_batch({"lang": pa.array([lang] * len(slot), pa.string()), "slot": slot.astype(np.int32), "n": n[slot]})


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from rows with a text and a language; at most about ``sample_docs`` of each language, whole texts.

    What reaches the driver is one count per language and feature.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.ones((0, 1)), np.zeros((ORDERS, FEATURES, 1)), np.ones(1), np.ones(1))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, sample_docs / sizes[k])])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) / (1 << 20)
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text").repartition(8)
    counts = sample.mapInArrow(_count_features, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    tally = np.zeros((len(langs), ORDERS * FEATURES))
    at = {x: i for i, x in enumerate(langs)}
    tally[[at[x] for x in counts.column("lang").to_pylist()], counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    by_order = tally.reshape(len(langs), ORDERS, FEATURES) + 0.05
    chance = (by_order / by_order.sum(axis=2, keepdims=True)).reshape(len(langs), -1)
    code = codewords(len(langs))
    plus, minus = np.maximum(code, 0), np.maximum(-code, 0)
    odds = np.log((plus.T @ chance + 1e-12) / plus.sum(axis=0)[:, None].clip(1)) - np.log((minus.T @ chance + 1e-12) / minus.sum(axis=0)[:, None].clip(1))
    usual = np.abs((chance @ odds.T) * code).mean(axis=0) / ORDERS  # margin per n-gram of a text of each language
    weakest = np.abs(chance @ odds.T).min(axis=0) / ORDERS
    scale = np.maximum(usual, 1e-9)
    bit_weight = np.maximum(weakest / scale, 0.05)
    return Model(langs, code, odds.T.reshape(ORDERS, FEATURES, -1).astype(np.float32), scale, bit_weight / bit_weight.sum())


def predict(docs: DataFrame, model: Model, text: str = "text", to: str = "language") -> DataFrame:
    """``docs`` with a struct ``to`` of lang_pred, score and ambiguous.

    A null text, one without a letter, and any text where nothing was learned
    give ``und`` with score 0. Only the text is looked at.
    """

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def languages(texts: pa.Array) -> pa.Array:
        pred, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for rows, data, ends in pieces(texts) if model.langs else ():
            best, how = model.decode(model.margins(data, ends))
            starts = np.concatenate(([0], ends[:-1]))
            for k, r in enumerate(rows):
                if _LETTER.search(data[starts[k] : ends[k]].tobytes().decode()):
                    pred[r], score[r], unsure[r] = model.langs[best[k]], how[k], how[k] < AMBIGUOUS
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(unsure)], ["lang_pred", "score", "ambiguous"])

    return docs.withColumn(to, languages(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    """Column: whether a document is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
