"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A state is a role at a turn's first line or inside a turn. A line shows a speaker
marker or none, its length, whether it asks, and its shape. Viterbi finds the
likeliest states of a conversation. A conversation is dealt to tasks in blocks
of lines: each block gives the best score from every entering to every leaving
state, a second pass over these small tables chooses the states at the block
edges, and a third fills every block in between. So no conversation is one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.written import written

ROLES = ("system", "user", "assistant", "tool")
#: Words that name a role in a marker, lower case.
SPEAKERS = {
    "system": "system",
    "developer": "system",
    "user": "user",
    "human": "user",
    "customer": "user",
    "assistant": "assistant",
    "ai": "assistant",
    "bot": "assistant",
    "model": "assistant",
    "tool": "tool",
    "function": "tool",
}
#: A marker: the speaker in any brackets or stars, then : or > or an end of line after brackets.
MARKER = r"^\s{0,3}(?:[*#_\[(<|]{0,4})\s?(" + "|".join(SPEAKERS) + r")\s?(?:[*_\])>|]{0,4}\s?[:>]|[\])>|]{1,4}\s*$)\s*"
#: Messages of one block.
BLOCK_TURNS = 64
N = 2 * len(ROLES)  # state 2r: first line of role r, 2r + 1: inside it
FEATURES = {"marker": len(ROLES) + 1, "length": 4, "asks": 2, "shape": 3}


@dataclass(frozen=True)
class Model:
    """Log chances: start (N), step (N x N), and per feature (N x values)."""

    start: np.ndarray
    step: np.ndarray
    emit: dict[str, np.ndarray]

    def scores(self, observed: dict[str, np.ndarray]) -> np.ndarray:
        """lines x N log chances of what the lines show."""
        return sum(self.emit[f][:, observed[f]].T for f in FEATURES)


def model(turn_counts: np.ndarray, lines_per_turn: np.ndarray, feature_counts: dict[str, np.ndarray], unmarked: float) -> Model:
    """From counts: (1 + roles) x roles of a role after a role (row 0: first), mean lines of a turn, states x values.

    A share ``unmarked`` of the turns opens without a marker; an inner line shows one in a thousand.
    """
    turns = turn_counts + 0.5
    follow = turns / turns.sum(axis=1, keepdims=True)
    start, step = np.full(N, 1e-9), np.full((N, N), 1e-9)
    start[0::2] = follow[0]
    end = 1 / np.maximum(lines_per_turn, 1.05)
    for r in range(len(ROLES)):
        for s in (2 * r, 2 * r + 1):
            step[s, 2 * r + 1] = 1 - end[r]
            step[s, 0::2] = end[r] * follow[r + 1]
    emit = {}
    for f, n in FEATURES.items():
        if f == "marker":
            seen = np.full((N, n), 1e-3 / len(ROLES))
            seen[1::2, 0] = 0.999
            for r in range(len(ROLES)):
                seen[2 * r, 0], seen[2 * r, r + 1] = unmarked, 0.999 - unmarked
        else:
            seen = feature_counts[f] + 1.0
            seen = seen / seen.sum(axis=1, keepdims=True)
        emit[f] = np.log(seen)
    return Model(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), emit)


def observed(line: Column) -> Column:
    """Struct of the features of a line, null as an empty one."""
    line = F.coalesce(line, F.lit(""))
    said = F.lower(F.regexp_extract(line, "(?i)" + MARKER, 1))
    who = F.coalesce(*[F.when(said == k, ROLES.index(v) + 1) for k, v in SPEAKERS.items()], F.lit(0))
    n = F.length(line)
    length = F.when(n == 0, 0).when(n < 40, 1).when(n < 160, 2).otherwise(3)
    shape = F.when(line.rlike(r"^\s*(```|    |[{}<])"), 2).when(line.rlike(r"^\s*([-*+]|\d+[.)])\s"), 1).otherwise(0)
    return F.struct(who.alias("marker"), length.alias("length"), line.rlike(r"\?\s*$").cast("int").alias("asks"), shape.alias("shape"))


def fit(turns: DataFrame, unmarked: float | None = None) -> Model:
    """A model from labelled turns (conv, turn, role, text): counts of all of them; a few hundred numbers reach the driver.

    ``unmarked`` is the share of turns that open without a marker; by default that of the turns of no known role.

    Rows of other or no roles and null texts are passed over.
    """
    known = turns.where(F.col("role").isin(*ROLES) & F.col("text").isNotNull()).select("conv", "turn", F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int").alias("r"), F.split("text", "\n").alias("lines"))
    earlier = known.select("conv", (F.col("turn") + 1).alias("turn"), F.col("r").alias("before"))
    pairs = known.select("conv", "turn", "r").join(earlier, ["conv", "turn"], "left").groupBy(F.coalesce("before", F.lit(0)).alias("before"), "r").agg(F.count("*").alias("n")).collect()
    follow = np.zeros((len(ROLES) + 1, len(ROLES)))
    for before, r, n in pairs:
        follow[before, r - 1] += n
    long = np.full(len(ROLES), 2.0)
    for r, mean in known.groupBy("r").agg(F.avg(F.size("lines"))).collect():
        long[r - 1] = mean
    lines = known.select("r", F.posexplode("lines").alias("at", "line")).select("r", (F.col("at") > 0).cast("int").alias("inner"), observed(F.col("line")).alias("o"))
    counts = {f: np.zeros((N, n)) for f, n in FEATURES.items()}
    for r, inner, marker, length, asks, shape, n in lines.groupBy("r", "inner", "o.marker", "o.length", "o.asks", "o.shape").agg(F.count("*").alias("n")).collect():
        for f, value in (("length", length), ("asks", asks), ("shape", shape)):
            counts[f][2 * (r - 1) + inner, value] += n
    if unmarked is None:
        unmarked = float(turns.agg(F.avg(F.when(F.col("role").isin(*ROLES), 0.0).otherwise(1.0))).first()[0] or 0.0)
    return model(follow, long, counts, min(max(unmarked, 1e-4), 0.9))


def block_table(first: np.ndarray, scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """N x N: best score from the state before the block, entered by ``first``, to the state of its last line."""
    best = first + scores[0]
    for s in scores[1:]:
        best = (best[:, :, None] + step[None]).max(axis=1) + s
    return best


def best_path(first: np.ndarray, scores: np.ndarray, step: np.ndarray, last: int | None = None) -> np.ndarray:
    """Likeliest states of lines; ``first`` holds the scores of entering each state, ``last`` fixes the last one. Ties go to the lower state."""
    best, back = first + scores[0], []
    for s in scores[1:]:
        way = best[:, None] + step
        back.append(way.argmax(axis=0))
        best = way.max(axis=0) + s
    state = int(best.argmax()) if last is None else last
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return np.array(out[::-1])


def edge_states(tables: list[np.ndarray], heads: np.ndarray) -> list[int]:
    """State of the last line of each block on the best path. ``heads``: the first block's scores by its last state; ``tables``: those of the others."""
    best, back = heads, []
    for t in tables:
        way = best[:, None] + t
        back.append(way.argmax(axis=0))
        best = way.max(axis=0)
    state = int(best.argmax())
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def _runs(batches, keys: int):
    """Rows of equal leading columns (the data comes sorted by them), as record batches put together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(i) for i in range(keys)]
        rows = list(zip(*(c.to_pylist() for c in cols)))
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and tuple(c[0].as_py() for c in held[-1].columns[:keys]) != rows[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _scores(m: Model, rows: pa.Table) -> np.ndarray:
    return m.scores({f: rows.column(f).to_numpy() for f in FEATURES})


def label_lines(lines: DataFrame, m: Model) -> DataFrame:
    """(conv, block, pos, line, role, begins) of lines (conv, block, pos, line); see ``format_chats``."""
    seen = lines.select("conv", F.col("block").cast("long").alias("block"), F.col("pos").cast("long").alias("pos"), "line", observed(F.col("line")).alias("o"))
    seen = seen.select("conv", "block", "pos", *[F.col(f"o.{f}").cast("int").alias(f) for f in FEATURES], "line")

    def tables(batches):
        for rows in _runs(batches, 2):
            scores = _scores(m, rows)
            # block 0 is entered from nowhere, so only its scores by last state are needed
            best = block_table(m.step, scores, m.step) if rows.column("block")[0].as_py() else np.zeros((0, 0))
            head = block_table(m.start[None], scores, m.step)[0]
            yield pa.record_batch([rows.column("conv")[:1].combine_chunks(), rows.column("block")[:1].combine_chunks(), pa.array([best.ravel().tolist()], pa.list_(pa.float64())), pa.array([head.tolist()])], names=["conv", "block", "best", "head"])

    def edges(batches):
        for rows in _runs(batches, 1):
            blocks = rows.column("block").to_pylist()
            last = edge_states([np.array(x).reshape(N, N) for x in rows.column("best").to_pylist()[1:]], np.array(rows.column("head")[0].as_py()))
            yield pa.record_batch([rows.column("conv").combine_chunks(), pa.array(blocks), pa.array([-1, *last[:-1]], pa.int32()), pa.array(last, pa.int32())], names=["conv", "block", "enters", "leaves"])

    kind = dict(lines.dtypes)["conv"]
    narrow = seen.drop("line").repartition("conv", "block").sortWithinPartitions("conv", "block", "pos", *FEATURES)
    scored = narrow.mapInArrow(tables, f"conv {kind}, block long, best array<double>, head array<double>")
    chosen = scored.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(edges, f"conv {kind}, block long, enters int, leaves int")

    def fill(batches):
        for rows in _runs(batches, 2):
            enters, leaves = rows.column("enters")[0].as_py(), rows.column("leaves")[0].as_py()
            states = best_path(m.start if enters < 0 else m.step[enters], _scores(m, rows), m.step, leaves)
            yield pa.record_batch([*(rows.column(c).combine_chunks() for c in ("conv", "block", "pos", "line")), pa.array([ROLES[s // 2] for s in states]), pa.array(states % 2 == 0)], names=["conv", "block", "pos", "line", "role", "begins"])

    both = seen.join(chosen, ["conv", "block"]).sortWithinPartitions("conv", "block", "pos", *FEATURES, "line")
    return both.mapInArrow(fill, f"conv {kind}, block long, pos long, line string, role string, begins boolean")


def turns(labelled: DataFrame) -> DataFrame:
    """(conv, turn, role, text, rendered): lines of a turn joined, its marker taken off, turns numbered from 0."""
    labelled = written(labelled, "labelled")  # counted and numbered
    begins = labelled.groupBy("conv", "block").agg(F.sum(F.col("begins").cast("long")).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    before = begins.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv", "block").orderBy("pos")
    numbered = labelled.withColumn("_n", F.sum(F.col("begins").cast("long")).over(inside)).join(before, ["conv", "block"]).withColumn("turn", F.col("before") + F.col("_n") - 1)
    clean = F.when(F.col("begins"), F.regexp_replace("line", "(?i)" + MARKER, "")).otherwise(F.col("line"))
    told = numbered.groupBy("conv", "turn").agg(F.min("role").alias("role"), F.array_sort(F.collect_list(F.struct("pos", clean.alias("line")))).alias("lines"))
    text = F.trim(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return told.select("conv", "turn", "role", text.alias("text"), F.concat(F.lit("<|"), "role", F.lit("|>\n"), text, F.lit("\n<|end|>\n")).alias("rendered"))


def format_chats(lines: DataFrame, m: Model) -> DataFrame:
    """Canonical turns of transcripts given as lines (conv, block, pos, line), one row per turn.

    ``pos`` orders a conversation's lines (gaps are fine, ties go by what the lines show);
    ``block``, from 0 on, cuts it into stretches in the same order, each of a task's size.
    Null lines are empty lines; lines of no conversation or without a place are left
    out, as nothing orders them. No lines: no turns. The lines of a turn are gathered,
    never a conversation.
    """
    return turns(label_lines(lines.where("conv is not null and block is not null and pos is not null"), m))


def transcript_lines(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", marked: Column | None = None) -> DataFrame:
    """Lines (conv, block, pos, line) of a table of messages: where ``marked`` holds (default: the role is known) the first line starts with the speaker.

    The lines of messages that share a turn number interleave.
    """
    shown = F.col(role).isin(*ROLES) if marked is None else marked
    body = F.concat(F.when(shown, F.concat(F.initcap(role), F.lit(": "))).otherwise(F.lit("")), F.coalesce(F.col(text), F.lit("")))
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), body.alias("body"))
    split = named.select("conv", "turn", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    return split.select("conv", F.greatest(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(0)).alias("block"), (F.shiftleft("turn", 32) + F.col("at")).alias("pos"), "line")
