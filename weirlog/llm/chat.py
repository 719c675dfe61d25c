"""Chat formatting: a hidden Markov model recovers the roles of a transcript, which is then rendered in one form.

The observations are lines. A hidden state is a role, at the beginning of a turn or inside
it. A row of the table begins a turn; a line with a speaker marker ("User:",
"### Assistant", "<|im_start|>system") may begin one inside a row. Lengths, questions and the order
of roles are learned from labelled conversations, the trust in markers is fixed.

Conversations are cut into chunks of turn numbers. A chunk is summed up by one small matrix (the
best score from each state before it to each state at its end); matrices of a
conversation are chained to find the states at the chunks' borders, and each chunk is
then decoded between its borders. So no task holds a whole long conversation, and the
path is the best one for the whole of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Turn numbers of a chunk.
CHUNK = 256
#: Names that speakers go by in transcripts.
SPEAKERS = {
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "bot", "ai", "agent", "model", "answer", "a"),
    "system": ("system", "instruction", "instructions", "context"),
}
_KIND = {name: kind for kind, (_, names) in enumerate(SPEAKERS.items(), 1) for name in names}
_ROLE_OF_KIND = {kind: role for kind, role in enumerate(SPEAKERS, 1)}
_NAMES = "|".join(sorted(_KIND, key=len, reverse=True))
_MARKER = re.compile(
    rf"\s*(?:<\|im_start\|>\s*({_NAMES})\s*$|<\|({_NAMES})\|>|(?:\*\*|\#+\s*|\[)?({_NAMES})(?:\*\*|\])?\s*:(?:\*\*)?|\#+\s*({_NAMES})\s*$)",
    re.IGNORECASE,
)
_END = re.compile(r"\s*<\|(?:im_end|end)\|>\s*$")

#: Log probabilities of (no marker, the role's own, another's) at the beginning of a turn and inside one.
_AT_BEGIN, _INSIDE = np.log([0.5, 0.49, 0.005]), np.log([0.99, 0.005, 0.005])
#: Buckets of a line's length (by doubling), of a row's lines, and of the question mark.
_LENGTHS, _LINES, _QUESTIONS = 14, 5, 2
_NEVER = -1e18


def marker(line: str) -> tuple[int, int]:
    """(kind, end) of the speaker marker at the beginning of a line; kind 0 if there is none."""
    found = _MARKER.match(line)
    return (_KIND[next(g for g in found.groups() if g).lower()], found.end()) if found else (0, 0)


def line_codes(text: str | None) -> list[int]:
    """One number per line: kind of marker, beginning of the row, length, question, and lines of the row."""
    lines = (text or "").split("\n")
    codes = []
    for i, line in enumerate(lines):
        length = min(_LENGTHS - 1, len(line).bit_length())
        rows = min(_LINES - 1, len(lines).bit_length()) if i == 0 else 0
        question = int(line.rstrip().endswith("?"))
        codes.append((((marker(line)[0] * 2 + (i == 0)) * _LENGTHS + length) * _QUESTIONS + question) * _LINES + rows)
    return codes


def _parts(code: int) -> tuple[int, int, int, int, int]:
    code, rows = divmod(code, _LINES)
    code, question = divmod(code, _QUESTIONS)
    code, length = divmod(code, _LENGTHS)
    kind, begins = divmod(code, 2)
    return kind, begins, length, question, rows


class RoleModel:
    """Hidden states 0..R-1: a role at the beginning of a turn; R..2R-1: inside a turn; 2R: before the transcript."""

    def __init__(self, roles: list[str], first: np.ndarray, follow: np.ndarray, features: dict[str, np.ndarray]):
        """Counts: ``first`` by role, ``follow`` by role and next role, ``features`` by state and value."""
        self.roles, n = roles, len(roles)
        self.first = _log_shares(first[None, :])[0]
        self.follow = _log_shares(follow)
        self.features = {name: _log_shares(counts) for name, counts in features.items()}
        self.states = 2 * n + 1
        self._steps: dict[int, np.ndarray] = {}

    def step(self, code: int) -> np.ndarray:
        """Log probability of each state after each state, on a line of this code."""
        if code not in self._steps:
            kind, begins, length, question, rows = _parts(code)
            n = len(self.roles)
            step = np.full((self.states, self.states), _NEVER)
            if begins or kind:  # another turn
                said = np.array([self._marker(kind, role, _AT_BEGIN) for role in self.roles])
                said += self.features["length"][:n, length] + self.features["question"][:n, question]
                said += self.features["rows"][:n, rows] if begins else 0.0
                step[:n, :n] = step[n : 2 * n, :n] = self.follow + said
                step[2 * n, :n] = self.first + said
            if not begins:  # the turn goes on
                said = np.array([self._marker(kind, role, _INSIDE) for role in self.roles])
                said += self.features["length"][n:, length] + self.features["question"][n:, question]
                for role in range(n):
                    step[role, n + role] = step[n + role, n + role] = said[role]
            self._steps[code] = step
        return self._steps[code]

    def _marker(self, kind: int, role: str, odds: np.ndarray) -> float:
        return odds[0] if not kind else odds[1] if _ROLE_OF_KIND[kind] == role else odds[2]

    def chunk_matrix(self, codes: list[int]) -> np.ndarray:
        """The best score from each state before the lines to each state on the last."""
        matrix = np.where(np.eye(self.states, dtype=bool), 0.0, _NEVER)
        for code in codes:
            matrix = np.maximum((matrix[:, :, None] + self.step(code)[None, :, :]).max(axis=1), _NEVER)
        return matrix

    def borders(self, matrices: Iterator[np.ndarray]) -> list[tuple[int, int]]:
        """The states before and at the end of each chunk on the best path through all of them."""
        scores = np.full(self.states, _NEVER)
        scores[-1] = 0.0
        came = []
        for matrix in matrices:
            reached = scores[:, None] + matrix
            came.append(reached.argmax(axis=0))
            scores = reached.max(axis=0)
            scores -= scores.max()
        at, result = int(scores.argmax()), []
        for before in reversed(came):
            result.append((int(before[at]), at))
            at = int(before[at])
        return result[::-1]

    def decode(self, codes: list[int], enter: int, leave: int) -> list[int]:
        """The best states of the lines between two border states."""
        scores = np.full(self.states, _NEVER)
        scores[enter] = 0.0
        came = []
        for code in codes:
            reached = scores[:, None] + self.step(code)
            came.append(reached.argmax(axis=0))
            scores = reached.max(axis=0)
        at, path = leave, []
        for before in reversed(came):
            path.append(at)
            at = int(before[at])
        return path[::-1]


def _log_shares(counts: np.ndarray) -> np.ndarray:
    counts = counts + 1.0
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def rendered(role: str, text: str) -> str:
    """One turn in the common form; what looks like a control mark in the text is broken up."""
    return f"<|{role}|>\n{text.strip().replace('<|', '< |')}\n<|end|>"


def turns_of(text: str | None, states: list[int], roles: list[str]) -> list[tuple[str, str]]:
    """(role, text) of the turns in a row's text, markers taken off."""
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip((text or "").split("\n"), states):
        if state < len(roles):
            kind, end = marker(line)
            turns.append((roles[state], []))
            line = line[end:] if kind else line
        turns[-1][1].append(_END.sub("", line) if "<|" in line else line)
    return [(role, "\n".join(lines).strip()) for role, lines in turns]


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn and text without repetitions, and chunk. A row with a null conv_id is a chunk of its own."""
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("text").cast("string").alias("text"))
    rows = rows.distinct()
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "text"))
    chunk = F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK)
    return rows.withColumn("chunk", F.coalesce(alone, chunk))


_ORDER = ("conv_id", "chunk", "turn", "text")


def _learning_rows(conversations: DataFrame) -> DataFrame:
    """Labelled rows of the three quarters of the conversations whose crc32(conv_id) mod 4 is not 2."""
    held_out = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2
    rows = conversations.where(F.col("role").isNotNull() & F.col("conv_id").isNotNull() & ~held_out)
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def learn(conversations: DataFrame) -> RoleModel:
    """Counts over all labelled conversations that are not held out; only counts come to the driver.

    Every role that occurs is learned: the model has two states a role, a chunk's matrix the square of that.
    """
    rows = _learning_rows(conversations)
    roles = sorted(r.role for r in rows.select("role").distinct().collect()) or ["user"]
    n = len(roles)
    rows = rows.withColumn("chunk", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK))
    before = F.lag("role").over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "text", "role"))
    first, follow = np.zeros(n), np.zeros((n, n))
    for row in rows.withColumn("before", before).groupBy("chunk", "before", "role").count().groupBy(
        (F.col("chunk") <= 0).alias("opens"), "before", "role"
    ).agg(F.sum("count").alias("count")).collect():
        if row.before is not None:
            follow[roles.index(row.before), roles.index(row.role)] += row["count"]
        elif row.opens:
            first[roles.index(row.role)] += row["count"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], int] = {}
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for c in line_codes(text):
                    found[role, c] = found.get((role, c), 0) + 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.int32()), pa.array(list(found.values()), pa.int64())],
                names=["role", "code", "n"],
            )

    codes = rows.select("role", "text").mapInArrow(code, "role string, code int, n bigint").groupBy("role", "code").agg(F.sum("n").alias("n"))
    features = {name: np.zeros((2 * n, size)) for name, size in (("length", _LENGTHS), ("question", _QUESTIONS), ("rows", _LINES))}
    for row in codes.collect():  # at most one row per role and code
        _, begins, length, question, lines = _parts(row.code)
        state = roles.index(row.role) + (0 if begins else n)
        features["length"][state, length] += row.n
        features["question"][state, question] += row.n
        if begins:
            features["rows"][state, lines] += row.n
    return RoleModel(roles, first, follow, features)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with equal first columns, which lie together."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)


def format_turns(conversations: DataFrame, model: RoleModel) -> DataFrame:
    """The turns of every conversation with recovered roles, in one form.

    Returns conv_id, turn (the row's), part (turns that one row holds are numbered
    from 0), role, text (without the speaker marker) and rendered. The given role
    column is not looked at. Rows are in order of turn (null first), of one turn number in order
    of text; rows that repeat conv_id, turn and text count once. A null text is an
    empty turn. Each row with a null conv_id is a conversation of its own. An empty
    table gives no rows; further columns are not read.
    """
    sent = conversations.sparkSession.sparkContext.broadcast(model)
    rows = stored(_rows(conversations), "chat-rows")
    key = rows.schema["conv_id"].dataType
    arrow_key = rows.select("conv_id").limit(0).toArrow().schema.field(0).type

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", arrow_key), ("chunk", pa.int64()), ("matrix", pa.list_(pa.float64()))])

        def found():
            for (conv, chunk), lines in _groups(batches, 2):
                codes = [code for _, text in lines for code in line_codes(text)]
                yield conv, chunk, sent.value.chunk_matrix(codes).ravel()

        return _batched(found(), schema)

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", arrow_key), ("chunk", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32())])
        n = sent.value.states

        def found():
            for (conv, _), chunks in _groups(batches, 2):
                borders = sent.value.borders(np.array(matrix).reshape(n, n) for _, matrix in chunks)
                yield from ((conv, chunk, *border) for (chunk, _), border in zip(chunks, borders))

        return _batched(found(), schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [(name, pa.string()) for name in ("role", "text", "rendered")]
        schema = pa.schema([("conv_id", arrow_key), ("turn", pa.int64()), ("part", pa.int32()), *texts])
        roles = sent.value.roles

        def found():
            for (conv, _), lines in _groups(batches, 2):
                codes = [line_codes(text) for _, text, _, _ in lines]
                states = sent.value.decode([c for row in codes for c in row], lines[0][2], lines[0][3])
                at = 0
                for (turn, text, _, _), row in zip(lines, codes):
                    for part, (role, said) in enumerate(turns_of(text, states[at : at + len(row)], roles)):
                        yield conv, turn, part, role, said, rendered(role, said)
                    at += len(row)

        return _batched(found(), schema)

    def fields(*more: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField("conv_id", key), *(T.StructField(*f) for f in more)])

    long, whole, string = T.LongType(), T.IntegerType(), T.StringType()
    sums = rows.select(*_ORDER).repartition("conv_id", "chunk").sortWithinPartitions(*_ORDER)
    sums = sums.mapInArrow(matrices, fields(("chunk", long), ("matrix", T.ArrayType(T.DoubleType()))))
    part = F.when(F.col("conv_id").isNull(), F.col("chunk")).otherwise(F.lit(0)).alias("part")
    chained = stored(sums, "chat-chunks").select("conv_id", part, "chunk", "matrix")
    chained = chained.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "chunk")
    borders = stored(chained.mapInArrow(chains, fields(("chunk", long), ("enter", whole), ("leave", whole))), "chat-borders")
    same = rows["conv_id"].eqNullSafe(borders["conv_id"]) & (rows["chunk"] == borders["chunk"])
    joined = rows.join(borders, same).select(*(rows[c] for c in _ORDER), "enter", "leave")
    joined = joined.repartition("conv_id", "chunk").sortWithinPartitions(*_ORDER)
    return joined.mapInArrow(decode, fields(("turn", long), ("part", whole), ("role", string), ("text", string), ("rendered", string)))
