"""Byte-level BPE: merges as a recursive query over token rows, run by DuckDB inside each task.

Spark deals out the texts. A task splits them into words, numbers the words and
keeps, in its worker's in-process database, what it has met. New words become rows
(word, pos, tok), one per byte. The recursive query joins neighbouring rows with the
merge table and contracts each word's leftmost pair of lowest rank until no pair is
left. Long words are cut first where no token of the vocabulary holds the two bytes
that meet, as no merge can cross such a place; in parts that stay long, the same pair
further right goes in the same step where that cannot change what comes next. Ordered
aggregation makes a word's ids of its rows, and decodes: tokens' bytes to words. A text's
ids and bytes are those of its words, one after the other.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim_worker, register_cache

#: Words that a worker keeps; beyond it forgets those that came once, and of the others keeps half as many at most.
CACHED = 250_000
#: Token rows that one recursion may make, and the steps that it may take.
ROWS, STEPS = 2_000_000, 24
#: Bytes of words that enter a recursion together, and texts and bytes that are put together by one query.
WORD_BYTES, TEXTS, TEXT_BYTES = 1 << 17, 500, 1 << 20
#: What a worker's database may take, and while it is at long words or texts.
MEMORY, MEMORY_LONG = "160MB", "600MB"
#: Characters of a word from which it is cut, and bytes from which all places of a pair are contracted in one step.
LONG = 64

#: White space as Unicode has it, which is what the splitting pattern means by it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts of these characters are split by a pattern with spelled-out classes, which is faster and finds the same.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ]*")
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"

#: A row is a pair of neighbours: its token, where the next row is (follow), the next token, and what the two merge into.
#: A step looks up only what the contracted pair has become part of; all other pairs are as they were.
#: The lowest pair is one number: 24 bits of rank, 28 of place and 11 of the bytes to the next row.
_MERGE = """
    CREATE OR REPLACE TEMP TABLE steps AS
    WITH RECURSIVE steps(word, pos, tok, follow, next, merged, depth) AS (
        SELECT word, pos, tok, follow, next, merged, 0
        FROM entering e LEFT JOIN merges m ON m.l = e.tok AND m.r = e.next
        UNION ALL
        (
            WITH lowest AS MATERIALIZED (
                SELECT word, (first >> 39)::INTEGER AS low, (first >> 11) & 268435455 AS pos,
                       ((first >> 11) & 268435455) + (first & 2047) AS follow
                FROM (SELECT word, min((merged::BIGINT << 39) | (pos << 11) | (follow - pos)) AS first
                      FROM steps WHERE merged IS NOT NULL AND depth < $steps GROUP BY word)
            ), kept AS (
                SELECT s.word, CASE WHEN s.pos = l.follow THEN l.pos ELSE s.pos END AS pos,
                       CASE WHEN s.pos = l.follow THEN l.low ELSE s.tok END AS tok, s.follow,
                       CASE WHEN s.follow = l.pos THEN l.low ELSE s.next END AS next, s.depth + 1 AS depth
                FROM steps s JOIN lowest l ON l.word = s.word WHERE s.pos <> l.pos
            )
            SELECT word, pos, tok, follow, next, merged, depth
            FROM kept k LEFT JOIN merges m ON m.l = k.tok AND m.r = k.next
        )
    )
    SELECT word, pos, tok, follow, next, depth FROM steps
"""
#: The same for long words: all places of the lowest pair in one step. Of overlapping ones (as in aaa) every second is contracted.
_MERGE_LONG = """
    CREATE OR REPLACE TEMP TABLE steps AS
    WITH RECURSIVE steps(word, pos, tok, follow, next, merged, alone, depth) AS (
        SELECT word, pos, tok, follow, next, merged, alone, 0
        FROM entering e LEFT JOIN merges m ON m.l = e.tok AND m.r = e.next
        UNION ALL
        (
            WITH lowest AS MATERIALIZED (
                SELECT word, min(merged) AS low, arg_min(pos, merged::HUGEINT << 40 | pos) AS first
                FROM steps WHERE merged IS NOT NULL AND depth < $steps GROUP BY word
            ), hits AS MATERIALIZED (
                SELECT s.word, s.pos, s.follow, l.low FROM steps s
                JOIN lowest l ON l.word = s.word AND l.low = s.merged AND (NOT s.alone OR s.pos = l.first)
            ), overlapping AS MATERIALIZED (
                SELECT DISTINCT a.word FROM hits a JOIN hits b ON a.word = b.word AND a.follow = b.pos
            ), ordered AS (
                SELECT *, row_number() OVER inside AS n, lag(follow) OVER inside IS NOT DISTINCT FROM pos AS joined
                FROM hits SEMI JOIN overlapping USING (word)
                WINDOW inside AS (PARTITION BY word ORDER BY pos)
            ), runs AS (
                SELECT *, n - max(CASE WHEN joined THEN 0 ELSE n END) OVER (
                    PARTITION BY word ORDER BY n ROWS UNBOUNDED PRECEDING) AS nth
                FROM ordered
            ), taken AS MATERIALIZED (
                SELECT word, pos, follow, low FROM hits ANTI JOIN overlapping USING (word)
                UNION ALL
                SELECT word, pos, follow, low FROM runs WHERE nth % 2 = 0
            ), kept AS (
                SELECT s.word, coalesce(l.pos, s.pos) AS pos, coalesce(l.low, s.tok) AS tok, s.follow,
                       coalesce(r.low, s.next) AS next, s.depth + 1 AS depth
                FROM steps s SEMI JOIN lowest a ON a.word = s.word
                ANTI JOIN taken t ON t.word = s.word AND t.pos = s.pos
                LEFT JOIN taken l ON l.word = s.word AND l.follow = s.pos
                LEFT JOIN taken r ON r.word = s.word AND r.pos = s.follow
            )
            SELECT word, pos, tok, follow, next, merged, alone, depth
            FROM kept k LEFT JOIN merges m ON m.l = k.tok AND m.r = k.next
        )
    )
    SELECT word, pos, tok, follow, next, depth FROM steps
"""
_LAST = "CREATE OR REPLACE TEMP TABLE last AS SELECT word, max(depth) AS depth FROM steps GROUP BY word"
#: The rows of words after so many steps and no more (finished), or after all steps of a recursion (to go on with).
_REACHED = "(SELECT word, pos, tok, follow, next FROM steps SEMI JOIN last USING (word, depth) WHERE depth {})"
_KEEP = """
    CREATE OR REPLACE TEMP TABLE learned AS
    SELECT word, list(tok ORDER BY pos) AS ids, unhex(string_agg(v.hex, '' ORDER BY pos)) AS said
    FROM {rows} JOIN vocabulary v ON v.token = tok GROUP BY word
"""
_DECODE = """
    SELECT text, string_agg(v.hex, '' ORDER BY pos) AS hex FROM places JOIN vocabulary v ON v.token = tok GROUP BY text
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines with a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def splitter(pattern: str):
    """A function that gives the matches of the splitting pattern in a text, in order."""
    general = regex.compile(pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))
    plain = pattern.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS)
    # Classes that stand alone in the pattern need brackets of their own.
    plain = re.compile(plain.replace(f" ?{_LETTERS}+", f" ?[{_LETTERS}]+").replace(f" ?{_NUMBERS}+", f" ?[{_NUMBERS}]+"))

    def split(text: str) -> list[str]:
        return (plain if _PLAIN.fullmatch(text) else general).findall(text)

    return split


def _merges(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left, right, merged) of all two tokens that make a third."""
    splits = ((t[:i], t[i:], rank) for t, rank in ranks.items() for i in range(1, len(t)))
    return [(ranks[a], ranks[b], rank) for a, b, rank in splits if a in ranks and b in ranks]


def _inside(ranks: dict[bytes, int]) -> np.ndarray:
    """For each two bytes whether some token holds them side by side."""
    found = np.zeros(1 << 16, bool)
    for token in ranks:
        text = np.frombuffer(token, np.uint8).astype(np.int64)
        found[text[:-1] << 8 | text[1:]] = True
    return found


class _Numbers(dict):
    """Words in the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Codec:
    """Encodes and decodes with one rank file; one per worker process."""

    _of: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        import duckdb

        ranks = load_ranks(path)
        merges = _merges(ranks)
        self.pieces = splitter(pattern)
        self.meets = _inside(ranks)
        self.tokens = np.fromiter(ranks.values(), np.int32, len(ranks))
        self.byte_tokens = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.database = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self._load("vocabulary", token=list(ranks.values()), hex=[t.hex() for t in ranks])
        left, right, merged = (list(c) for c in zip(*merges)) if merges else ([], [], [])
        self._load("merges", l=left, r=right, merged=merged, alone=[False] * len(merges))
        self.alone_known = False
        self.ranks = ranks
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.kept, self.used = _Numbers(), 0, 0
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.seen = np.zeros(0, np.int64)
        self.said: list[bytes] = []

    def _forget_rare(self) -> None:
        """Keep the words that came more than once lately, the most frequent first; all else is learned again if it comes."""
        often = np.flatnonzero(self.seen > 1)
        often = np.sort(often[np.argsort(-self.seen[often], kind="stable")[: CACHED // 2]])
        words = list(self.numbers)
        numbers = _Numbers((words[old], new) for new, old in enumerate(often.tolist()))
        self.ids, self.sizes, self.seen = self._ids(often), self.sizes[often], self.seen[often] // 2
        self.said = [self.said[old] for old in often.tolist()]
        self.numbers, self.kept, self.used = numbers, len(often), len(self.ids)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._of:
            cls._of[path, pattern] = cls(path, pattern)
        return cls._of[path, pattern]

    def _load(self, name: str, **columns: list) -> None:
        types = {"hex": pa.string(), "alone": pa.bool_()}
        source = pa.table({c: pa.array(values, types.get(c, pa.int32())) for c, values in columns.items()})
        self._register(source)
        self.database.execute(f"CREATE TABLE {name} AS SELECT * FROM given")

    def _register(self, given: pa.Table, name: str = "given") -> None:
        self.database.register(name, given)

    def split(self, text: str) -> list[str]:
        """The words of a text, long ones in parts that no merge joins."""
        words = self.pieces(text)
        if max(map(len, words), default=0) <= LONG:
            return words
        return list(itertools.chain.from_iterable((w,) if len(w) <= LONG else self._cut(w) for w in words))

    def _cut(self, word: str) -> list[str]:
        """Cut between characters whose neighbouring bytes no token of the vocabulary holds side by side."""
        text = np.frombuffer(data := word.encode(), np.uint8)
        apart = ~self.meets[text[:-1].astype(np.int64) << 8 | text[1:]] & (text[1:] & 0xC0 != 0x80)
        edges = [0, *(np.flatnonzero(apart) + 1).tolist(), len(data)]
        return [data[start:end].decode() for start, end in itertools.pairwise(edges)]

    def _rows(self, words: list[tuple[int, bytes]]) -> pa.Table:
        """A row per byte; follow and next are -1 at a word's end."""
        sizes = np.array([len(w) for _, w in words])
        tokens = self.byte_tokens[np.frombuffer(b"".join(w for _, w in words), np.uint8)]
        places, last = np.arange(len(tokens), dtype=np.int64), np.cumsum(sizes) - 1
        follow, following = places + 1, np.append(tokens[1:], np.int32(-1))
        follow[last] = following[last] = -1
        numbers = np.repeat(np.array([n for n, _ in words], np.int32), sizes)
        return pa.table({"word": numbers, "pos": places, "tok": tokens, "follow": follow, "next": following})

    def _mark_alone(self) -> None:
        """Find the pairs that have to be contracted one at a time: those whose token could form a pair of lower rank.

        If the bytes of a token M contract to M, then all pairs inside these bytes that come before M have been
        contracted when a higher pair's turn comes, so that one cannot become part of M. What is left are tokens
        that their own bytes do not contract to.
        """
        merges = _merges(self.ranks)
        below = {merged for *parts, merged in merges if max(parts) > merged}
        words = [(token, text) for text, token in self.ranks.items() if token in below]
        never: set[int] = set()
        for start in range(0, len(words), TEXTS * 16):
            self._register(self._rows(words[start : start + TEXTS * 16]))
            self.database.execute("CREATE OR REPLACE TEMP TABLE entering AS SELECT * FROM given")
            self.database.execute(_MERGE.replace("$steps", str(max(map(len, self.ranks)))))
            self.database.execute(_LAST)
            apart = "SELECT word FROM steps SEMI JOIN last USING (word, depth) GROUP BY word HAVING count(*) > 1"
            never.update(word for (word,) in self.database.sql(apart).fetchall())
        alone = {part for *parts, merged in merges if merged in never for part in parts if part > merged}
        self._register(pa.table({"token": pa.array(sorted(alone), pa.int32())}))
        self.database.execute("UPDATE merges SET alone = true WHERE merged IN (SELECT token FROM given)")
        self.alone_known = True

    def _merge(self, words: list[tuple[int, bytes]], query: str) -> None:
        """Ids of words that are no tokens themselves. Words that need more steps enter again."""
        if query == _MERGE_LONG and not self.alone_known:
            self._mark_alone()
        rows = self._rows(words)
        self._register(rows)
        self.database.execute("CREATE OR REPLACE TEMP TABLE entering AS SELECT * FROM given")
        left = rows.num_rows
        while left:
            steps = max(1, min(STEPS, ROWS // left))
            self.database.execute(query.replace("$steps", str(steps)))
            self.database.execute(_LAST)
            self._keep(_REACHED.format(f"< {steps}"))
            self.database.execute(f"CREATE OR REPLACE TEMP TABLE entering AS SELECT * FROM {_REACHED.format(f'= {steps}')}")
            left = self.database.sql("SELECT count(*) FROM entering").fetchall()[0][0]

    def _keep(self, rows: str) -> None:
        self.database.execute(_KEEP.format(rows=rows))
        found = self.database.sql("SELECT word, ids, said FROM learned").to_arrow_table()
        for batch in found.to_batches():
            numbers, ids = batch.column(0).to_numpy(), batch.column(1)
            sizes = ids.value_lengths().to_numpy()
            values = ids.flatten().to_numpy()
            while self.used + len(values) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(1 << 16, len(self.ids)), np.int32)])
            self.ids[self.used : self.used + len(values)] = values
            self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
            self.sizes[numbers] = sizes
            self.used += len(values)
            for number, value in zip(numbers.tolist(), batch.column(2).to_pylist()):
                self.said[number] = value

    def _learn(self) -> None:
        """Merge and decode the words numbered since the last time."""
        new = list(itertools.islice(self.numbers, self.kept, None))
        more = np.zeros(len(new), np.int64)
        self.starts, self.sizes = np.concatenate([self.starts, more]), np.concatenate([self.sizes, more])
        self.said += [b""] * len(new)
        pending, whole = {_MERGE: [], _MERGE_LONG: []}, []
        size = dict.fromkeys(pending, 0)
        for number, word in enumerate((w.encode() for w in new), self.kept):
            if (rank := self.ranks.get(word)) is not None:  # a word that is a token takes no merges
                whole.append((number, rank))
                continue
            query = _MERGE if len(word) <= LONG else _MERGE_LONG
            pending[query].append((number, word))
            size[query] += len(word)
            if size[query] >= WORD_BYTES:
                self._merge(pending[query], query)
                pending[query], size[query] = [], 0
        for query, words in pending.items():
            if words:
                self._merge(words, query)
        if whole:
            number, rank = (np.array(c, np.int32) for c in zip(*whole))
            self._register(pa.table({"word": number, "pos": np.zeros(len(whole), np.int64), "tok": rank}))
            self._keep("given")
        self.kept = len(self.numbers)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """The ids of each text, and the bytes that they decode to."""
        if self.kept > CACHED:
            self._forget_rare()
        if max(map(len, texts), default=0) <= TEXT_BYTES // 8:
            return self._encode(texts)
        self.database.execute(f"SET memory_limit = '{MEMORY_LONG}'")
        try:
            return self._encode(texts)
        finally:
            for table in ("steps", "entering", "last", "learned"):
                self.database.execute(f"DROP TABLE IF EXISTS {table}")
            self.database.execute(f"SET memory_limit = '{MEMORY}'")

    def _encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        words = [list(map(self.numbers.__getitem__, part)) for part in map(self.split, texts)]
        self._learn()
        said = [b"".join(map(self.said.__getitem__, part)) for part in words]
        words = [np.array(part, np.int32) for part in words]
        if words:
            self.seen = np.concatenate([self.seen, np.zeros(self.kept - len(self.seen), np.int64)])
            self.seen += np.bincount(np.concatenate(words), minlength=self.kept)
        return [(self._ids(w), value) for w, value in zip(words, said)]

    def _ids(self, words: np.ndarray) -> np.ndarray:
        sizes = self.sizes[words]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.ids[np.repeat(self.starts[words], sizes) + inside]

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes that ids stand for; an id that the vocabulary lacks is an error."""
        text = np.repeat(np.arange(len(ids), dtype=np.int32), [len(i) for i in ids])
        tokens = np.fromiter(itertools.chain.from_iterable(ids), np.int32, len(text))
        if len(tokens) and not np.isin(tokens, self.tokens).all():
            raise ValueError("an id is not in the vocabulary")
        result = [b""] * len(ids)
        self._register(pa.table({"text": text, "pos": np.arange(len(text), dtype=np.int64), "tok": tokens}), "places")
        for number, value in self.database.sql(_DECODE).fetchall():
            result[number] = bytes.fromhex(value)
        return result


register_cache("bpe", Codec._of.clear)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of texts that are encoded together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, own in enumerate(sizes.tolist()):
        size += own
        if size >= TEXT_BYTES or i + 1 - start >= TEXTS:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[tuple[pa.Array, list]]:
    claim_worker("bpe")
    codec = Codec.of(path, pattern)
    for batch in batches:
        for part in _parts(batch):
            yield part.column(0), codec.encode([text or "" for text in part.column(1).to_pylist()])


def _inputs(docs: DataFrame) -> tuple[DataFrame, T.StructField]:
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows, rows.schema[0]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array) and decoded (the bytes that the ids stand for) of every whole text.

    ``path`` is a rank file that every worker can read, ``pattern`` splits a text
    into words that are encoded separately; special tokens are ordinary text. A null
    text counts as empty and has no ids. Each row gives one row, repeated ones too; an
    empty table gives none; further columns of ``docs`` are not read.
    """
    rows, key = _inputs(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in _encoded(batches, path, pattern):
            ids = pa.array([ids for ids, _ in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, ids, pa.array([d for _, d in found], pa.binary())], names=names)

    schema = T.StructType([key, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    names = schema.names
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded (bytes) of rows with doc_id and ids; null ids decode to no bytes."""
    rows = encoded.select("doc_id", F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    schema = T.StructType([rows.schema[0], T.StructField("decoded", T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                said = codec.decode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.binary())], names=names)

    return rows.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of ids (little-endian, 32 bits each) and of the decoded bytes.

    What ``encode`` gives, taken together where it is made, so that ids need not travel.
    """
    rows, key = _inputs(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in _encoded(batches, path, pattern):
            columns = [
                pa.array([len(ids) for ids, _ in found], pa.int64()),
                pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids, _ in found], pa.string()),
                pa.array([hashlib.sha256(decoded).hexdigest() for _, decoded in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([keys, *columns], names=names)

    text = [T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")]
    schema = T.StructType([key, T.StructField("n_tokens", T.LongType()), *text])
    names = schema.names
    return rows.mapInArrow(run, schema)
