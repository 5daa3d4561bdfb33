"""Transcript parsing: roles by a hidden Markov model over lines, then canonical turns.

States are the three roles, each beginning or continuing a turn. A line is observed as its speaker marker (of a role, ambiguous, or none), its shape (ends
as a question, is an instruction, is long) and whether a blank line or a recorded turn boundary precedes it. The most likely states are found by Viterbi.

A transcript may be of any length. Its lines are cut into blocks of bounded size; each block is reduced to a matrix of best scores
from its entry state to its exit state (max-plus products), the matrices of a transcript are streamed once forwards and once
backwards to fix every block's entry and exit, and the blocks are decoded on their own. A stream holds one vector, so a transcript
with a third of all lines costs one task only the small matrices.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import staged

ROLES = ("system", "user", "assistant")
#: Turns of a block.
BLOCK_TURNS = 64

# fixed values: names that speakers go by in transcripts
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "q", "question", "prompter"),
    "assistant": ("assistant", "ai", "bot", "model", "a", "answer", "agent"),
}
ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role]}
MARKER = re.compile(r"\s*(?:#+\s*|\[|<\|?|\*\*)?(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")\s*(?:\|?>|\]|\*\*)?\s*(?:[:：>]|$)(?:\*\*)?\s*", re.IGNORECASE)
INSTRUCTION = re.compile(r"\s*(?:you are|you must|always|never|answer as)\b", re.IGNORECASE)

# fixed values: log-probabilities of the model, set by hand
FIRST = np.log([0.25, 0.7, 0.05])  # who speaks first
NEXT = np.log([[0.02, 0.93, 0.05], [0.01, 0.07, 0.92], [0.01, 0.93, 0.06]])  # who follows whom
MARKED_BEGIN = np.log([0.80, 0.02, 0.18])  # a beginning has its own role's marker, another's, none
MARKED_WITHIN = np.log([0.005, 0.005, 0.99])
BOUNDARY = np.log([0.95, 0.05])  # a turn boundary in the source is a beginning, or not
NO_BOUNDARY = np.log([0.05, 0.95])
QUESTION = np.log([0.05, 0.45, 0.10])  # a role's line ends as a question
INSTRUCTS = np.log([0.5, 0.05, 0.02])
LONG = np.log([0.3, 0.25, 0.6])  # more than LONG_LINE characters
LONG_LINE = 200
NEVER = -1e18


def _not(p: np.ndarray) -> np.ndarray:
    return np.log1p(-np.exp(p))


def transitions() -> np.ndarray:
    """(6, 6) scores; state 2r begins a turn of role r, 2r + 1 continues it."""
    t = np.full((6, 6), NEVER)
    for r in range(3):
        for s in (2 * r, 2 * r + 1):
            t[s, 2 * r + 1] = 0.0  # what a line says about beginnings is in its emission
            t[s, 0::2] = NEXT[r]
    return t


STEP = transitions()
START = np.full(6, NEVER)
START[0::2] = FIRST


def observed(line: str) -> tuple[int, int]:
    """(role of the line's speaker marker or -1, length of the marker)."""
    m = MARKER.match(line)
    return (ROLE_OF[m[1].lower()], m.end()) if m else (-1, 0)


def emission(line: str, boundary: bool) -> np.ndarray:
    """Scores of the six states for one line."""
    role, _ = observed(line)
    out = np.empty(6)
    shape = np.where(line.rstrip().endswith("?"), QUESTION, _not(QUESTION))
    shape = shape + np.where(INSTRUCTION.match(line) is not None, INSTRUCTS, _not(INSTRUCTS)) + np.where(len(line) > LONG_LINE, LONG, _not(LONG))
    begin, within = BOUNDARY if boundary else NO_BOUNDARY
    for r in range(3):
        kind = 2 if role < 0 else 0 if role == r else 1
        out[2 * r] = shape[r] + begin + MARKED_BEGIN[kind]
        out[2 * r + 1] = shape[r] + within + MARKED_WITHIN[kind]
    return out


def block_matrix(emissions: np.ndarray, first: bool) -> np.ndarray:
    """Best score from each entry state to each exit state; the first block of a transcript is entered from START."""
    m = np.where(np.eye(6, dtype=bool), 0.0, NEVER)
    for k, e in enumerate(emissions):
        m = np.tile(START + e, (6, 1)) if first and k == 0 else (m[:, :, None] + STEP[None]).max(1) + e
    return np.maximum(m, NEVER)


def decode_block(emissions: np.ndarray, first: bool, entry: int, exit_: int) -> np.ndarray:
    """The best states of a block's lines between a given entry and exit; ties go to the lower state."""
    score, back = None, []
    for k, e in enumerate(emissions):
        if k == 0:
            score = (START if first else STEP[entry]) + e
        else:
            reach = score[:, None] + STEP
            back.append(reach.argmax(0))
            score = reach.max(0) + e
    states = [exit_]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return np.array(states[::-1])


def viterbi(lines: list[str], boundaries: list[bool]) -> np.ndarray:
    """States of a whole transcript in one piece."""
    e = np.array([emission(x, b) for x, b in zip(lines, boundaries)]).reshape(-1, 6)
    if not len(e):
        return np.zeros(0, int)
    return decode_block(e, True, 0, int(block_matrix(e, True)[0].argmax()))


def _lines(texts: list[str]) -> tuple[list[str], list[bool], list[int]]:
    """Lines of a block's turns, whether each begins a turn of the source, and the turn's number within the block."""
    lines, begins, of = [], [], []
    for i, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            lines.append(line)
            begins.append(k == 0)
            of.append(i)
    return lines, begins, of


def _emissions(texts: list[str]) -> np.ndarray:
    lines, begins, _ = _lines(texts)
    return np.array([emission(x, b) for x, b in zip(lines, begins)]).reshape(-1, 6)


def blocks_of(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, block, turns) of ``turns(conv_id, turn, text)``: identical rows become one, a null text is empty, a null turn comes first."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / block_turns).cast("long"))
    return rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))


def parsed(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per turn of the source: conv_id, turn, role, n_lines, n_begun, rendered.

    role is that of the turn's first line; n_begun counts the turns that begin in its lines; rendered is its canonical form, in which each
    beginning is a line ``<|role|>`` and speaker markers are cut off; a line that continues the turn before has no header. Turns that repeat a (conv_id, turn)
    with other texts are kept, in order of text. Null texts are one empty line; a null turn becomes -1 and comes first. A null conv_id is a
    transcript of its own. An empty table gives no rows; extra columns are ignored.
    """
    kept = staged(blocks_of(turns, block_turns), "transcript-blocks")
    firsts = kept.groupBy(F.col("conv_id").alias("c")).agg(F.min("block").alias("first"))
    rows = kept.join(firsts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "block", "turns", (F.col("block") == F.col("first")).alias("first"))

    def reduced(it):
        for b in it:
            out = [block_matrix(_emissions([t["text"] for t in ts]), f).ravel() for ts, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([x.tolist() for x in out], pa.list_(pa.float64()))], names=["conv_id", "block", "first", "m"])

    matrices = rows.mapInArrow(reduced, "conv_id long, block long, first boolean, m array<double>")

    def forwards(it):
        now = None
        for pdf in it:
            entries = []
            for first, m in zip(pdf["first"], pdf["m"]):
                now = np.zeros(6) if first else now
                entries.append(now.copy())
                now = (now[:, None] + np.asarray(m).reshape(6, 6)).max(0)
                now = now - now.max()
            yield pdf.assign(entry=entries)

    def backwards(it):
        exit_, of = 0, object()
        for pdf in it:
            ins, outs = [], []
            for conv, first, m, entry in zip(pdf["conv_id"].astype(object), pdf["first"], pdf["m"], pdf["entry"]):
                reach = np.asarray(entry)[:, None] + np.asarray(m).reshape(6, 6)
                conv = None if pd.isna(conv) else conv
                if conv != of:
                    exit_, of = int(reach.max(0).argmax()), conv
                outs.append(exit_)
                exit_ = int(reach[:, exit_].argmax())
                ins.append(exit_)
            yield pd.DataFrame({"c": pdf["conv_id"].astype("Int64"), "b": pdf["block"], "entry": ins, "exit": outs})

    ordered = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    ahead = ordered.mapInPandas(forwards, "conv_id long, block long, first boolean, m array<double>, entry array<double>")
    back = ahead.sortWithinPartitions("conv_id", F.desc("block")).mapInPandas(backwards, "c long, b long, entry int, exit int")
    fixed = rows.join(back, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "turns", "first", "entry", "exit")

    def rendered(it):
        for b in it:
            out = []
            for conv, ts, first, entry, exit_ in zip(*(c.to_pylist() for c in b.columns)):
                texts = [t["text"] for t in ts]
                lines, _, of = _lines(texts)
                states = decode_block(_emissions(texts), first, entry, exit_)
                parts: list[list[str]] = [[] for _ in ts]
                role, begun = [-1] * len(ts), [0] * len(ts)
                for line, i, s in zip(lines, of, states.tolist()):
                    if role[i] < 0:
                        role[i] = s // 2
                    marked, length = observed(line)
                    if s % 2 == 0:
                        parts[i].append(f"<|{ROLES[s // 2]}|>")
                        begun[i] += 1
                        line = line[length:] if marked == s // 2 else line
                    parts[i].append(line)
                out += [(conv, t["turn"], ROLES[r], texts[i].count("\n") + 1, n, "\n".join(p)) for i, (t, r, n, p) in enumerate(zip(ts, role, begun, parts))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "turn", "role", "n_lines", "n_begun", "rendered"])

    return fixed.mapInArrow(rendered, "conv_id long, turn long, role string, n_lines int, n_begun int, rendered string")


#: Ways of marking a speaker that transcripts are written in: (system, user, assistant).
STYLES = (("System: ", "User: ", "Assistant: "), ("Instruction: ", "Human: ", "AI: "), ("### System\n", "### User\n", "### Assistant\n"), ("[system] ", "[user]: ", "[assistant]: "))


def transcript(conversations: DataFrame, unmarked: int = 5) -> DataFrame:
    """``conversations`` as raw transcripts (conv_id, turn, text): markers in one of STYLES by conversation, none on one turn in ``unmarked`` and on unknown roles."""
    style = F.pmod(F.xxhash64("conv_id", F.lit("style")), F.lit(len(STYLES))).cast("int")
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int")
    marker = F.element_at(F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in STYLES]), style + 1), F.when(role > 0, role))
    silent = F.pmod(F.xxhash64("conv_id", "turn", F.lit("silent")), F.lit(unmarked)) == 0
    return conversations.select("conv_id", "turn", F.concat(F.when(~silent, F.coalesce(marker, F.lit(""))).otherwise(""), F.coalesce("text", F.lit(""))).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """Parsed turns with the CRC-32 of their canonical form in its place."""
    return rows.select("conv_id", "turn", "role", "n_lines", "n_begun", F.crc32(F.col("rendered").cast("binary")).alias("rendered_crc32"))
