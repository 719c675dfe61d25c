"""Ranked lexical search: no-random-access top-k over impact-sorted posting lists.

Two passes over the documents. The first counts documents, terms, and how many documents hold
each term of the items. The second deals with documents in blocks inside the tasks: a block's
postings of the items' terms become lists in falling order of impact, and for each
item these are read from the top, a longer stretch each round. A document's lower bound is what was
read of it; its upper bound adds, for each list where it was not met, the next impact of that list.
Reading ends when no document outside can come up to the k-th lower bound, and every
document that can is fully known, ties included. A task hands on its best k per item, and
two rounds of ranking, first within parts of each item, put these together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim_worker, stored

#: Documents returned per item.
TOP = 10
#: Fixed values of the score: weights are floor(1000 * ln(...)), a document's length counts for 90 %.
SCALE, LENGTH_SHARE, SATURATION, UNIT = 1000, 90, 8, 1_000_000_000
#: A block ends at so many documents or words of the items in them.
BLOCK_DOCUMENTS, BLOCK_WORDS = 32_768, 4_000_000
#: Entries of each list that the first round reads; each further one reads up to twice as far.
FIRST_READ = 64
#: Bytes of item texts that are searched together; more items take further passes over the documents.
ITEM_BYTES = 16 << 20
#: Parts of an item that are ranked apart before the last ranking.
PARTS = 32

#: Bytes 0-9, a-z and all beyond ASCII are part of terms, A-Z in lower case; everything else separates.
_TERM_BYTES = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in their order."""
    return (text or "").encode().translate(_TERM_BYTES).split()


class _Statistics:
    """N, L, and the weight of every term of the items; terms are numbered."""

    def __init__(self, numbers: dict[bytes, int], documents: int, words: int, held: dict[int, int]):
        self.numbers, self.documents, self.words = numbers, documents, words
        weights = (math.floor(SCALE * math.log((2 * documents + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(numbers)))
        self.weights = np.fromiter(weights, np.int64, len(numbers))

    def impacts(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        share = np.array([LENGTH_SHARE * int(n) * self.documents // self.words for n in np.unique(sizes)], np.int64)
        lengths = 100 - LENGTH_SHARE + share[np.searchsorted(np.unique(sizes), sizes)]
        return self.weights[terms] * (UNIT * counts // (SCALE * counts + SATURATION * lengths))


class _Block:
    """Impact-sorted lists of a block of documents."""

    def __init__(self, ids: np.ndarray, texts: list[np.ndarray], sizes: np.ndarray, statistics: _Statistics):
        self.ids = ids
        places = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
        found, counts = np.unique(np.concatenate(texts).astype(np.int64) << 32 | places, return_counts=True)
        terms, docs = found >> 32, found & 0xFFFFFFFF
        impacts = statistics.impacts(terms, counts, sizes[docs]) if len(found) else counts
        order = np.lexsort((-impacts, terms))
        self.docs, self.impacts = docs[order], impacts[order]
        self.starts = np.searchsorted(terms, np.arange(len(statistics.numbers) + 1))
        self.lower = np.zeros(len(ids), np.int64)

    def best(self, terms: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the documents that may be among the ``top`` of the item, all exact; ``least``: the score to reach."""
        lists = [(self.starts[t], self.starts[t + 1]) for t in terms if self.starts[t] < self.starts[t + 1]]
        lower, seen = self.lower, np.zeros((len(lists), len(self.ids)), bool)
        lower[:] = 0
        read, depth = 0, FIRST_READ
        while True:
            bounds = np.zeros(len(lists), np.int64)
            for n, (start, end) in enumerate(lists):
                part = slice(start + read, min(start + depth, end))
                if part.start < end:
                    docs = self.docs[part]
                    lower[docs] += self.impacts[part]
                    seen[n, docs] = True
                if start + depth < end:
                    bounds[n] = self.impacts[start + depth]
            outside = bounds.sum()
            reached = np.partition(lower, len(lower) - top)[len(lower) - top] if len(lower) > top else 0
            least = max(least, int(reached), 1)
            near = np.flatnonzero(lower + outside >= least)
            upper = lower[near] + bounds @ ~seen[:, near] if len(lists) else lower[near]
            near, upper = near[upper >= least], upper[upper >= least]
            if outside < least and (upper == lower[near]).all():
                return self.ids[near], lower[near].copy()
            read, depth = depth, 2 * depth


_NO_ID = np.iinfo(np.int64).max


def _blocks(batches: Iterator[pa.RecordBatch], statistics: _Statistics) -> Iterator[_Block]:
    ids, texts, sizes, words = [], [], [], 0
    get = statistics.numbers.get
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            terms = terms_of(text.as_py())
            found = np.fromiter(map(get, terms, repeat(-1)), np.int32, len(terms))
            found = found[found >= 0]
            if not len(found):
                continue
            ids.append(_NO_ID if doc_id is None else doc_id)
            texts.append(found)
            sizes.append(len(terms))
            words += len(found)
            if len(ids) >= BLOCK_DOCUMENTS or words >= BLOCK_WORDS:
                yield _Block(np.array(ids, np.int64), texts, np.array(sizes, np.int64), statistics)
                ids, texts, sizes, words = [], [], [], 0
    if ids:
        yield _Block(np.array(ids, np.int64), texts, np.array(sizes, np.int64), statistics)


def _merged(kept: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = (np.concatenate(pair) for pair in zip(kept, more))
    order = np.lexsort((ids, -scores))[:top]
    return ids[order], scores[order]


def _statistics(rows: DataFrame, numbers: dict[bytes, int]) -> _Statistics:
    """Counts over all documents; the driver gets one row per term of the items and two more."""
    shared = rows.sparkSession.sparkContext.broadcast(numbers)
    n = len(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("lexical_search")
        get, held = shared.value.get, np.zeros(n + 2, np.int64)
        for batch in batches:
            for text in batch.column(1):
                terms = terms_of(text.as_py())
                if terms:
                    held[n] += 1
                    held[n + 1] += len(terms)
                    numbered = np.fromiter(map(get, set(terms), repeat(-1)), np.int32)
                    held[numbered[numbered >= 0]] += 1
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used])], names=["term", "held"])

    sums = rows.mapInArrow(count, "term int, held bigint").groupBy("term").agg(F.sum("held").alias("held"))
    found = {r.term: r.held for r in sums.collect()}
    return _Statistics(numbers, found.get(n, 0), found.get(n + 1, 0), found)


def _search(rows: DataFrame, items: list[tuple], top: int) -> DataFrame:
    """item_id, doc_id and score: the best of each task, of every item."""
    terms: dict = {}
    for item_id, text in items:
        terms.setdefault(item_id, set()).update(terms_of(text))
    numbers = {t: n for n, t in enumerate(sorted(set().union(*terms.values())))}
    wanted = [(item_id, np.array(sorted(numbers[t] for t in own), np.int64)) for item_id, own in terms.items() if own]
    shared = rows.sparkSession.sparkContext.broadcast((_statistics(rows, numbers), wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("lexical_search")
        statistics, wanted = shared.value
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kept = [nothing] * len(wanted)
        for block in _blocks(batches, statistics):
            for n, (_, own) in enumerate(wanted):
                least = int(kept[n][1][-1]) if len(kept[n][1]) == top else 0
                kept[n] = _merged(kept[n], block.best(own, top, least), top)
        sizes = [len(ids) for ids, _ in kept]
        ids, scores = (np.concatenate([nothing[0], *part]) for part in zip(*kept)) if kept else nothing
        items = pa.array(np.repeat(np.array([i for i, _ in wanted], np.int64), sizes), pa.int64())
        columns = [items, pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(scores, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of each item with a score above 0.

    Scores are exact; equal ones are ranked by doc_id, a null doc_id last. Every row of
    ``docs`` is a document, also one that repeats a doc_id; one without terms (null and empty
    texts) counts nowhere. Rows that repeat an item_id are one item with the terms
    of all; a null item_id names no item. An item without terms, or whose terms no document
    holds, gives no rows, as do empty tables. Further columns are not read. Items are read to the
    driver in parts of some ITEM_BYTES, each part by passes of its own.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.where("item_id IS NOT NULL AND text IS NOT NULL")
    asked = asked.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = stored(asked, "search-items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("size")).first()["size"]
    parts = -(-size // ITEM_BYTES)
    found = None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        best = _search(rows, [tuple(r) for r in own], top) if own else None
        found = best if found is None else found.unionByName(best) if best is not None else found
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    own_part = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    near = found.withColumn("place", F.row_number().over(own_part)).where(F.col("place") <= top).drop("place")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
