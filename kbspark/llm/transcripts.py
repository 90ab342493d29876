"""Operator 4: transcripts into chat turns, by a hidden Markov model over lines.

States are (role, first or later line of a turn). A line is observed through its speaker marker (the class
of the label before a colon, bracket or dash) and through line features: the line before it is blank, its
length class, whether it asks, whether it is a list or code line, and whether a row of the transcript begins
with it. The model is counted from labelled conversations as they are (texts and roles, no marker is ever
made from a role); that a marker of a role's class opens a turn of this role is a prior of MARKER_PRIOR
counts. Scores are integers (log-probabilities scaled and rounded), so decoding is exact, and each block is told how the
line before it ends: the best turns do not depend on how a transcript is split (of equally good ones any may be
taken). Roles are never read when a transcript is parsed.

A transcript is decoded in blocks of consecutive lines, one max-plus transfer matrix for each block: blocks
of one transcript lie in different tasks, the matrices (one small row for each block) are chained to give
every block its entry and exit state, and each block is then decoded by itself. A conversation of any
length is thus never gathered, nor are the rows of one turn: crowded turns are cut into blocks of their own.

Defined cases: null texts are one blank line; rows with equal (conv_id, turn) are consecutive, in no particular
order; null conv_id and null turn are values of their own, first in order; an empty table gives an empty
result; extra columns are ignored; roles other than system, user and assistant are not learnt from; without
any labelled row every role is equally likely.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import discard, materialise, small_batches, to_batch

ROLES = ("system", "user", "assistant")
N = 2 * len(ROLES)
#: Turns (as numbered in the transcript) that share a block, and the rows of such a block from which it is cut up.
BLOCK, CROWDED = 64, 256
#: Counts that a marker of a role's class has in advance in that role's first lines; share of turns taken to begin within a row.
MARKER_PRIOR, WITHIN = 50, 0.02
_LOW = -(10**12)

#: Labels of speaker markers by class.
MARKERS = {
    "system": "system sys instructions context",
    "user": "user human customer question q prompt me",
    "assistant": "assistant ai bot model agent answer a response",
}
_CLASS = {w: role for role, words in MARKERS.items() for w in words.split()}
_MARKER = re.compile(r"\s*(?:#{1,4}\s*|\*{1,2}|<\|?|\[)?\s*([^\W\d_]{1,14})\s*(?:\*{1,2}\s*:|\|?>|\]\s*:?|:\*{1,2}|:)(?:\s+|$)")
_DASH = re.compile(r"\s*(?:[-–—]|>>)\s+(?=\S)")
_LIST = re.compile(r"\s*(?:[-*•]\s|\d{1,3}[.)]\s|```|    )")
CLASSES = (*ROLES, "other", "dash", "none")
#: Markers of first and later lines, in a thousand, where a transcript is a mere text: no such text is labelled.
TEXT_OWN, TEXT_FIRST, TEXT_LATER = 920, {"other": 20, "dash": 40, "none": 20}, {"other": 10, "dash": 10, "none": 980}


def observe(line: str, blank_before: bool) -> tuple[tuple[str, ...], str]:
    """(features, line without its marker). Features: marker class, and four line features."""
    marker, rest = "none", line
    if m := _MARKER.match(line):
        found = _CLASS.get(m[1].lower())
        if found:
            marker, rest = found, line[m.end() :]
        elif m[1][0].isupper() and m[0].rstrip().endswith(":"):
            marker = "other"
    elif m := _DASH.match(line):
        marker, rest = "dash", line[m.end() :]
    n = len(rest.strip())
    size = "0" if n == 0 else str(min(int(math.log2(n)), 10))
    return ("m:" + marker, "b:1" if blank_before else "b:0", "n:" + size, "q:1" if rest.rstrip().endswith("?") else "q:0", "l:1" if _LIST.match(rest) else "l:0"), rest


def states_of(role: str, lines: int) -> list[int]:
    at = 2 * ROLES.index(role)
    return [at] + [at + 1] * (lines - 1)


class Model:
    """Integer start, transition and emission scores."""

    def __init__(self, start: dict, moves: dict, emits: dict):
        emits = dict(emits)
        for r, role in enumerate(ROLES):
            emits[2 * r, f"m:{role}"] = emits.get((2 * r, f"m:{role}"), 0) + MARKER_PRIOR
            emits[2 * r, "r:0"] = emits.get((2 * r, "r:0"), 0) + WITHIN * emits.get((2 * r, "r:1"), 0)
            # In a mere text markers are what opens turns.
            emits |= {(2 * r, f"t:{c}"): n for c, n in TEXT_FIRST.items()} | {(2 * r, f"t:{role}"): TEXT_OWN} | {(2 * r + 1, f"t:{c}"): n for c, n in TEXT_LATER.items()}
        score = lambda c, total, kinds: round(1000 * math.log((c + 0.5) / (total + 0.5 * kinds)))
        legal = np.zeros((N, N), dtype=bool)
        for s in range(N):
            for t in range(N):
                # A later line follows a line of its own turn; a turn may begin after any line.
                legal[s, t] = t % 2 == 0 or t // 2 == s // 2
        self.start = np.asarray([score(start.get(s, 0), sum(start.values()), 3) if s % 2 == 0 else _LOW for s in range(N)], dtype=np.int64)
        self.moves = np.full((N, N), _LOW, dtype=np.int64)
        for s in range(N):
            total = sum(c for (a, _), c in moves.items() if a == s)
            for t in range(N):
                if legal[s, t]:
                    self.moves[s, t] = score(moves.get((s, t), 0), total, int(legal[s].sum()))
        kinds: dict[str, set] = {}
        for f in [f"{k}:{c}" for k in "mt" for c in CLASSES] + [f"{k}:{v}" for k in "bqlr" for v in "01"] + [f"n:{i}" for i in range(11)]:
            kinds.setdefault(f[0], set()).add(f)
        self.emits = {}
        for kind, values in kinds.items():
            for s in range(N):
                total = sum(emits.get((s, v), 0) for v in values)
                for v in values:
                    self.emits[s, v] = score(emits.get((s, v), 0), total, len(values))
        self.line = functools.lru_cache(maxsize=20_000)(self._line)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "line"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.line = functools.lru_cache(maxsize=20_000)(self._line)

    def _line(self, features: tuple[str, ...]) -> np.ndarray:
        return np.asarray([sum(self.emits[s, f] for f in features) for s in range(N)], dtype=np.int64)


def transfer(model: Model, observed: list[np.ndarray]) -> np.ndarray:
    """Best scores from the state before a block (rows) to the state of its last line (columns)."""
    out = np.full((N, N), _LOW, dtype=np.int64)
    np.fill_diagonal(out, 0)
    for e in observed:
        out = np.maximum((out[:, :, None] + model.moves[None, :, :]).max(axis=1) + e[None, :], _LOW)
    return out


def viterbi(model: Model, observed: list[np.ndarray], entry: int | None, exit: int | None) -> list[int]:
    """Best states of a block's lines, given the state before it (None: it begins the transcript) and its last state."""
    back, now = [], None
    for at, e in enumerate(observed):
        if at == 0:
            came = np.zeros(N, dtype=np.int64)
            now = (model.start if entry is None else model.moves[entry]) + e
        else:
            step = now[:, None] + model.moves
            came = step.argmax(axis=0)
            now = step.max(axis=0) + e
        back.append(came)
    state = int(now.argmax()) if exit is None else exit
    out = [state]
    for came in back[:0:-1]:
        state = int(came[state])
        out.append(state)
    return out[::-1]


def chain(model: Model, blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int | None, int]]:
    """(entry state, exit state) of each block of a transcript, from its first line's scores and transfer matrices.

    ``blocks``: for the first block the row of scores after it in the first place; for the others its matrix.
    """
    now, back = None, []
    for first, matrix in blocks:
        if now is None:
            now = first
        else:
            step = now[:, None] + matrix
            back.append(step.argmax(axis=0))
            now = step.max(axis=0)
    states = [int(now.argmax())]
    for came in reversed(back):
        states.append(int(came[states[-1]]))
    states.reverse()
    return [(states[i - 1] if i else None, s) for i, s in enumerate(states)]


def first_scores(model: Model, observed: list[np.ndarray]) -> np.ndarray:
    """Best score of each last state of a block that begins a transcript."""
    now = model.start + observed[0]
    for e in observed[1:]:
        now = (now[:, None] + model.moves).max(axis=0) + e
    return now


_KEY = ("conv_id", "tb", "at", "sub")


def _runs(batches, keys: tuple[str, ...]):
    """Groups of consecutive rows with equal keys, as (key, list of row dicts)."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != last:
                yield last, rows
                rows = []
            last = key
            rows.append(row)
    if rows:
        yield last, rows


def _lines(rows: list[dict], rows_begin: bool) -> tuple[list[tuple[int, str]], list[tuple[str, ...]]]:
    """((row, text of a line) in order, features) of a block; ``rows_begin``: whether a line's place in its row is observed.

    The column ``blank`` says whether the line before the block is empty.
    """
    out, seen = [], []
    blank = bool(rows[0]["blank"])
    for i, row in enumerate(rows):
        for at, line in enumerate((row["text"] or "").split("\n")):
            features, rest = observe(line, blank)
            out.append((i, rest))
            seen.append((*features, "r:1" if at == 0 else "r:0") if rows_begin else ("t" + features[0][1:], *features[1:]))
            blank = not line.strip()
    return out, seen


def _count_events(batches):
    """Counts of starts, moves and emissions of a partition of labelled rows, sorted within their blocks."""
    counts: dict[tuple, int] = {}
    for _, rows in _runs(batches, _KEY):
        last = None
        lines, seen = _lines(rows, True)
        sizes, at = Counter(i for i, _ in lines), 0
        for i, row in enumerate(rows):
            own, at = seen[at : at + sizes[i]], at + sizes[i]
            if row["role"] not in ROLES:
                last = None
                continue
            for s, features in zip(states_of(row["role"], len(own)), own):
                key = ("move", last, s, "") if last is not None else ("start", s, s, "") if row["first"] else None
                if key:
                    counts[key] = counts.get(key, 0) + 1
                for f in features:
                    counts["emit", s, s, f] = counts.get(("emit", s, s, f), 0) + 1
                last = s
    rows = [(*k, n) for k, n in counts.items()]
    kinds = pa.schema([("kind", pa.string()), ("s", pa.int32()), ("t", pa.int32()), ("f", pa.string()), ("n", pa.int64())])
    yield to_batch(dict(zip(kinds.names, map(list, zip(*rows)))) if rows else {c: [] for c in kinds.names}, kinds)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY, F.col("turn").asc_nulls_first(), "h")


def _blocked(transcripts: DataFrame) -> DataFrame:
    """Rows with the key of their block (_KEY), ``h`` (order within a turn), ``first`` (of the transcript's first block) and ``blank`` (the line before the block is empty), written.

    A block is BLOCK turns; where these have more than CROWDED rows, a turn is blocks of its own, by ranges of h.
    """
    same = lambda *names: functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"its_{n}")) for n in names])
    rows = transcripts.withColumn("tb", F.floor(F.coalesce("turn", F.lit(-BLOCK)) / BLOCK)).withColumn("h", F.xxhash64(F.monotonically_increasing_id()))
    rows = materialise(rows, "numbered")
    crowds = rows.groupBy(F.col("conv_id").alias("its_conv_id"), F.col("tb").alias("its_tb")).agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED)
    rows = rows.join(materialise(crowds, "crowds"), same("conv_id", "tb"), "left").drop("its_conv_id", "its_tb")
    least = F.lit(-(2**63))
    rows = rows.withColumn("at", F.when(F.col("n").isNull(), least).otherwise(F.coalesce("turn", least)))
    share = (F.shiftright("h", 32) + F.lit(2**31)) / F.lit(2.0**32)
    rows = rows.withColumn("sub", F.when(F.col("n").isNull(), 0).otherwise(F.floor(share * F.ceil(F.col("n") / CROWDED)))).drop("n")
    rows = materialise(rows.withColumn("sub", F.col("sub").cast("long")), "rows")
    # One row a block: how its last line ends, told to the next block of the transcript.
    ends = rows.groupBy(*_KEY).agg(F.max_by(_ends_blank(F.col("text")), F.struct(F.col("turn").isNotNull(), "turn", "h")).alias("blank"))
    before = F.lag("blank").over(Window.partitionBy("conv_id").orderBy("tb", "at", "sub"))
    ends = ends.select(*(F.col(k).alias(f"its_{k}") for k in _KEY), before.alias("blank"))
    rows = rows.join(materialise(ends, "lowest"), same(*_KEY)).drop(*(f"its_{k}" for k in _KEY))
    return materialise(rows.withColumn("first", F.col("blank").isNull()).withColumn("blank", F.coalesce("blank", F.lit(False))), "blocks")


def _ends_blank(text: Column) -> Column:
    """Whether the last line is white space only, as Python sees it."""
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", -1).rlike(r"(?U)^[\s\x1c-\x1f]*\z")


def fit(conversations: DataFrame) -> Model:
    """Count the model from all rows of ``conversations`` (conv_id, turn, text, role)."""
    rows = _blocked(conversations.select("conv_id", "turn", "text", "role"))
    counts = _in_order(rows).mapInArrow(_count_events, "kind string, s int, t int, f string, n long").groupBy("kind", "s", "t", "f").agg(F.sum("n").alias("n"))
    start, moves, emits = {}, {}, {}
    for r in counts.collect():  # at most N*N moves, N starts and N times the features
        if r.kind == "start":
            start[r.s] = r.n
        elif r.kind == "move":
            moves[r.s, r.t] = r.n
        else:
            emits[r.s, r.f] = r.n
    discard(rows)
    return Model(start, moves, emits)


_TURN = "conv_id long, turn long, part int, role string, n_lines int, opens boolean, text string"


def _gathered(kinds: pa.Schema, rows, size: int = 5000):
    """Record batches of at most about ``size`` of the tuples ``rows``."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(dict(zip(kinds.names, zip(*held))), kinds)
            held = []
    yield to_batch(dict(zip(kinds.names, zip(*held))) if held else {n: [] for n in kinds.names}, kinds)


_KEY_ARROW = [(k, pa.int64()) for k in _KEY]
_KEY_SQL = ", ".join(f"{k} long" for k in _KEY)


def parse(transcripts: DataFrame, model: Model, rows_begin: bool = True) -> DataFrame:
    """conv_id, turn, part, role, n_lines, opens, text of the turns found in ``transcripts`` (conv_id, turn, text).

    ``turn`` and ``part``: the row where the turn's lines lie, and their number within it; ``opens`` is false
    where the lines go on with the turn of the row before. ``rows_begin``: rows tell where turns are likely to
    begin, as in a chat log; without it rows are mere pieces of a text, and a transcript may be a single one.
    """
    small_batches(transcripts.sparkSession)
    held = transcripts.sparkSession.sparkContext.broadcast(model)
    rows = _blocked(transcripts.select("conv_id", "turn", "text"))

    def matrices(batches):
        def found():
            for key, own in _runs(batches, _KEY):
                observed = [held.value.line(f) for f in _lines(own, rows_begin)[1]]
                yield (*key, first_scores(held.value, observed) if own[0]["first"] else transfer(held.value, observed).reshape(-1))

        yield from _gathered(pa.schema([*_KEY_ARROW, ("scores", pa.list_(pa.int64()))]), found())

    def chained(batches):
        def found():
            for _, own in _runs(batches, ("conv_id",)):
                scores = [np.asarray(r["scores"], dtype=np.int64) for r in own]
                ends = chain(held.value, [(s, None) if i == 0 else (None, s.reshape(N, N)) for i, s in enumerate(scores)])
                for r, (entry, last) in zip(own, ends):
                    yield (*(r[k] for k in _KEY), entry, last)

        yield from _gathered(pa.schema([*_KEY_ARROW, ("entry", pa.int32()), ("exit", pa.int32())]), found())

    def decode(batches):
        def found():
            for (conv, *_), own in _runs(batches, _KEY):
                lines, seen = _lines(own, rows_begin)
                states = viterbi(held.value, [held.value.line(f) for f in seen], own[0]["entry"], own[0]["exit"])
                turns: list[list] = []
                for (row, text), s in zip(lines, states):
                    if turns and turns[-1][0] == row and s % 2:
                        turns[-1][3].append(text)
                    else:
                        part = turns[-1][1] + 1 if turns and turns[-1][0] == row else 0
                        turns.append([row, part, s, [text]])
                for row, part, s, texts in turns:
                    yield conv, own[row]["turn"], part, ROLES[s // 2], len(texts), s % 2 == 0, "\n".join(texts).strip()

        kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("n_lines", pa.int32()), ("opens", pa.bool_()), ("text", pa.string())])
        yield from _gathered(kinds, found())

    moved = materialise(_in_order(rows).mapInArrow(matrices, f"{_KEY_SQL}, scores array<long>"), "matrices")
    ends = moved.repartition("conv_id").sortWithinPartitions(*_KEY).mapInArrow(chained, f"{_KEY_SQL}, entry int, exit int")
    ends = materialise(ends.select(*(F.col(k).alias(f"its_{k}") for k in _KEY), "entry", "exit"), "ends")
    discard(moved)
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"its_{k}")) for k in _KEY])
    joined = rows.join(ends, same).drop(*(f"its_{k}" for k in _KEY))
    return _in_order(joined).mapInArrow(decode, _TURN)


def rendered(role: Column, text: Column) -> Column:
    """One canonical turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def held_out(conv_id: Column) -> Column:
    """Conversations that are not learnt from: crc32 of conv_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(conv_id.cast("string")) % 4 == 2, F.lit(False))


def format_chats(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """conv_id, turn, part, role, n_lines, opens, text, rendered, held_out: roles recovered from the texts of ``conversations`` as they are.

    Without a ``model`` one is counted from the conversations that are not held out; the roles of those that
    are held out are never read.
    """
    convs = conversations.selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "cast(role as string) as role", "cast(text as string) as text")
    out = held_out(F.col("conv_id"))
    turns = parse(convs, model or fit(convs.filter(~out)))
    return turns.withColumn("rendered", rendered(F.col("role"), F.col("text"))).withColumn("held_out", out)
