"""Token counts by a two-tier table of pre-token lengths.

The tokenizer merges within pre-tokens only, so the count of a text is the sum of its
pre-tokens' counts. Frequent pre-tokens are looked up in a small broadcast table; what
it misses is encoded once per worker and kept in the worker's bounded cache.
Texts never leave their partition, and no pre-token is shuffled: to find the frequent
ones each map task sends the counts of its own most frequent words only.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim_worker, register_cache

#: Entries of the broadcast table.
FREQUENT = 32_768
#: Most frequent words that one task reports.
REPORTED = 4_096
#: Words that one task counts before it forgets those seen once.
COUNTED = 500_000
#: Pre-tokens that a worker keeps; beyond it starts anew.
CACHED = 400_000
#: Texts with more tokens are over the limit.
LIMIT = 2_048

#: Characters whose case, normal form and classes are the same in every library: a text of others is encoded whole.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ]*")
#: The tokenizer's own splitting pattern, after lower-casing.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Lengths:
    """Token counts of whole texts; one per worker process and vocabulary file."""

    _by_path: dict[str, Lengths] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.cache: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Lengths:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        """Tokens of each text; special strings inside texts are one token each, as the library has them."""
        result = [0] * len(texts)
        pieces: list[list[str]] = [[]] * len(texts)
        for i, text in enumerate(texts):
            if _PLAIN.fullmatch(text) and not self.special.search(text):
                pieces[i] = _PRE_TOKEN.findall(text.lower())
            else:
                result[i] = self.encoded([text])[0]
        missing = set().union(*pieces).difference(frequent)
        if len(self.cache) > CACHED:
            self.cache.clear()
        new = list(missing.difference(self.cache))
        self.cache.update(zip(new, self.encoded(new)))
        known = {**frequent, **{piece: self.cache[piece] for piece in missing}}
        return [n + sum(map(known.__getitem__, p)) for n, p in zip(result, pieces)]


register_cache("token_counts", Lengths._by_path.clear)


def frequent_words(docs: DataFrame, reported: int = REPORTED, frequent: int = FREQUENT) -> list[str]:
    """The words that all documents use most, as far as each task's most frequent words tell.

    They only fill the broadcast table, so a word too many or too few costs time and
    never changes a count.
    """
    marks = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counter.update((text.as_py() or b"").translate(marks).split())
                if len(counter) > COUNTED:
                    counter = Counter({word: n for word, n in counter.items() if n > 1})
        top = counter.most_common(reported)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"]
        )

    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    counts = texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
    return [bytes(row.word).decode(errors="ignore") for row in top]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every whole text.

    ``path`` names the tokenizer's file, which every worker reads. Counts are those of
    the library without added begin or end tokens. A null text counts as empty: no bytes, no
    tokens. Each row gives one row, repeated ones too; an empty table gives none;
    further columns of ``docs`` are not read.
    """
    words = [w for w in frequent_words(docs) if w]
    lengths = Lengths.of(path)
    plain = [w for w in words if _PRE_TOKEN.fullmatch(w)]
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(plain, lengths.encoded(plain))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("token_counts")
        lengths, frequent = Lengths.of(path), table.value
        for batch in batches:
            for start in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(start, _TEXTS)
                texts = [text or "" for text in part.column(1).to_pylist()]
                n = lengths.counts(texts, frequent)
                columns = [
                    pa.array([len(text.encode()) for text in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *_RESULT.names])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *_RESULT]))


#: Texts that are split and looked up together.
_TEXTS = 500
_RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
)
