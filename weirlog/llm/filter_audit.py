"""Filter interaction audit: what each order of the filters removes, and which filter removes what others would.

Four filters look at one text, the fifth at copies. Copies are found by radix tries over whole
texts. A trie in each map task collapses the copies of an Arrow batch first, so a text copied into a
third of all rows leaves a task once per batch, not once per row. The different texts are dealt out in
ranges of their prefixes, which are made longer where one prefix holds too many texts; a
task inserts the texts of its range into compressed tries whose terminals hold the smallest id, and
walks these for the duplicate flags. Texts leave the tries as bit masks of failed filters, with counts;
all orders are then worked out from the 32 masks of each part.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import size_checked
from .common import claim_worker, stored, text_or_empty

FILTERS = "ABCDE"
SHORT, REPEATED, CAPITALS, MARKED, COPIED = (1 << n for n in range(5))
#: Fixed values of the filters: words of a short text, and shares in percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
#: Code points of the prefixes that part the texts.
PREFIXES = (8, 64, 512)
#: Bytes of texts from which a prefix is made longer: a share of what a task gets, between these bounds.
HEAVY_SHARE, LEAST_HEAVY_BYTES, MOST_HEAVY_BYTES = 1 / 8, 256 << 10, 32 << 20
#: Bytes of texts after which a task walks its trie and starts a new one (between prefixes), and kinds of masks that it counts at once.
TRIE_BYTES, KINDS = 8 << 20, 100_000

_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_ROW = "text binary, part string, quality boolean, toxic boolean, mask int, n bigint, low bigint, n_low bigint"


def failed_filters(text: bytes) -> int:
    """The mask of the filters on one text that this text (UTF-8) fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _UPPER))
    code_points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _CONTINUED)))
    return (
        SHORT * (len(words) < LEAST_WORDS)
        | REPEATED * (100 * len(set(words)) < LEAST_DISTINCT * len(words))
        | CAPITALS * (100 * capitals > MOST_CAPITALS * code_points)
        | MARKED * (len(text.translate(None, MARKS)) < len(text))
    )


class Node:
    """A place in a compressed trie. ``edges``: by first byte, the bytes down to the next node, and this node."""

    __slots__ = ("edges", "kinds")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Node]] = {}
        #: Where a text ends: for each (part, quality, toxic) its rows, the smallest id among them, and the rows that have it.
        self.kinds: dict[tuple, tuple[int, int | None, int]] | None = None

    def add(self, kind: tuple, n: int, low: int | None, n_low: int) -> None:
        if self.kinds is None:
            self.kinds = {}
        if kind in self.kinds:
            had, had_low, had_n = self.kinds[kind]
            n += had
            if low == had_low:
                n_low += had_n
            elif low is None or had_low is not None and had_low < low:
                low, n_low = had_low, had_n
        self.kinds[kind] = n, low, n_low


def _common(label: bytes, text: bytes, at: int) -> int:
    """How many first bytes of ``label`` the text has at ``at``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    def __init__(self) -> None:
        self.root = Node()

    def terminal(self, text: bytes) -> Node:
        """The node at which ``text`` ends; made if it is not there."""
        node, at = self.root, 0
        while at < len(text):
            if text[at] not in node.edges:
                end = Node()
                node.edges[text[at]] = text[at:], end
                return end
            label, below = node.edges[text[at]]
            if not text.startswith(label, at):
                same = _common(label, text, at)
                between = Node()
                between.edges[label[same]] = label[same:], below
                node.edges[text[at]] = label[:same], between
                label, below = label[:same], between
            node, at = below, at + len(label)
        return node

    def texts(self) -> Iterator[tuple[bytes, Node]]:
        """Each text with its terminal."""
        waiting = [(b"", self.root)]
        while waiting:
            text, node = waiting.pop()
            if node.kinds is not None:
                yield text, node
            waiting.extend((text + label, below) for label, below in node.edges.values())

    def terminals(self) -> Iterator[Node]:
        waiting = [self.root]
        while waiting:
            node = waiting.pop()
            if node.kinds is not None:
                yield node
            waiting.extend(below for _, below in node.edges.values())


def _collapsed(rows: DataFrame) -> DataFrame:
    """One row per different text and kind of each Arrow batch; rows without a doc_id have a null ``low``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("filter_audit")
        for batch in batches:
            trie = Trie()
            kinds = zip(*(batch.column(c).to_pylist() for c in ("part", "quality", "toxic")))
            for doc_id, text, kind in zip(batch.column("doc_id").to_pylist(), batch.column("text"), kinds):
                trie.terminal(text.as_py()).add(kind, 1, doc_id, 1)
            found = []
            for text, node in trie.texts():
                mask = failed_filters(text)
                found.extend((text, *kind, mask, *counts) for kind, counts in node.kinds.items())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    bools, longs = pa.bool_(), pa.int64()
    types = [pa.binary(), pa.string(), bools, bools, pa.int32(), longs, longs, longs]
    names = [field.split()[0] for field in _ROW.split(", ")]
    return rows.mapInArrow(run, _ROW)


def _heavy_bytes(texts: DataFrame) -> int:
    """So that a range of prefixes is a small part of a task's texts, and the heavy prefixes stay few."""
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_HEAVY_BYTES, max(LEAST_HEAVY_BYTES, int(HEAVY_SHARE * total / tasks)))


def _cells(texts: DataFrame, prefixes: tuple[int, ...], heavy_bytes: int) -> DataFrame:
    """Adds cell: the shortest prefix that does not hold too many bytes of texts.

    Where even the longest one does, a hash of the whole text follows it, so equal texts
    are in one cell at any rate.
    """
    text = F.col("text").cast("string")
    hashes = F.array(*(F.xxhash64(F.lit(n), F.left(text, F.lit(n))) for n in prefixes))
    sizes = texts.select(F.octet_length("text").alias("size"), F.explode(hashes).alias("prefix"))
    heavy = sizes.groupBy("prefix").agg(F.sum("size").alias("size")).where(F.col("size") > heavy_bytes)
    heavy = size_checked(heavy.select("prefix"))
    cell: Column = F.concat(F.left(text, F.lit(prefixes[-1])), F.md5("text"))
    for n in reversed(prefixes):
        own = heavy.select(F.col("prefix").alias(f"heavy_{n}"))
        texts = texts.join(own, F.xxhash64(F.lit(n), F.left(text, F.lit(n))) == own[f"heavy_{n}"], "left")
        cell = F.when(F.col(f"heavy_{n}").isNull(), F.left(text, F.lit(n))).otherwise(cell)
    return texts.withColumn("cell", cell).drop(*(f"heavy_{n}" for n in prefixes))


def _masks(texts: DataFrame) -> DataFrame:
    """part, quality, toxic, mask (all five filters) and n of the rows, as each task counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("filter_audit")
        counts: Counter = Counter()
        trie, masks, size, last = Trie(), {}, 0, None

        def walked() -> None:
            for node in trie.terminals():
                low = min((low for _, low, _ in node.kinds.values() if low is not None), default=None)
                for kind, (n, own, n_own) in node.kinds.items():
                    first = n_own if own == low else 0
                    counts[(*kind, masks[node])] += first
                    counts[(*kind, masks[node] | COPIED)] += n - first

        def given() -> pa.RecordBatch:
            rows = [(*key, n) for key, n in counts.items() if n]
            counts.clear()
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "text", "part", "quality", "toxic", "mask", "n", "low", "n_low")]
            for cell, text, part, quality, toxic, mask, n, low, n_low in zip(*columns):
                if cell != last and size >= TRIE_BYTES:
                    walked()
                    trie, masks, size = Trie(), {}, 0
                    if len(counts) >= KINDS:
                        yield given()
                node = trie.terminal(text)
                node.add((part, quality, toxic), n, low, n_low)
                masks[node] = mask
                size, last = size + len(text), cell
        walked()
        yield given()

    types = [pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64()]
    names = ["part", "quality", "toxic", "mask", "n"]
    return texts.mapInArrow(run, "part string, quality boolean, toxic boolean, mask int, n bigint")


def failure_masks(
    docs: DataFrame, labels: DataFrame, prefixes: tuple[int, ...] = PREFIXES, heavy_bytes: int | None = None
) -> DataFrame:
    """part, mask, n, good and toxic: the documents of each part by the filters they fail, and how many are labelled so.

    Bit 0 of a mask is filter A, bit 4 filter E. ``part`` is the source (null: empty string). A null text
    counts as empty. Every row of ``docs`` is a document. A doc_id is a copy if a smaller one has
    the same text; rows that repeat a doc_id are no copies of each other, and a null doc_id is larger
    than any other. Labels without a doc_id name nothing; of several for one doc_id each counts. Further columns are
    not read; an empty table gives no rows.
    """
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").alias("labelled"))
    marked = size_checked(
        marks.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")))
    )
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_or_empty().cast("binary").alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
    )
    joined = rows.join(marked, rows["doc_id"] == marked["labelled"], "left").drop("labelled")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})
    texts = stored(_collapsed(joined), "audit-texts")
    heavy_bytes = _heavy_bytes(texts) if heavy_bytes is None else heavy_bytes
    ranges = _cells(texts, prefixes, heavy_bytes).repartitionByRange("cell").sortWithinPartitions("cell")
    own = [F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic")))]
    return _masks(ranges).groupBy("part", "mask").agg(*own)


def _total(condition: str, count: str = "m.n") -> Column:
    """The sum of a count over the masks ``m`` of a part that fulfil a condition."""
    return F.expr(f"aggregate(filter(masks, m -> {condition}), 0L, (total, m) -> total + {count})")


def audit(docs: DataFrame, labels: DataFrame, prefixes: tuple[int, ...] = PREFIXES, heavy_bytes: int | None = None) -> DataFrame:
    """A row for each part, order of the five filters, and step: what the filter of this step does after those before it.

    kept: documents after the step; removed: by it; redundant: fail its filter but were removed before;
    unique_fails: fail its filter only; good_lost, toxic_lost: removed here and labelled so; shapley: removed by
    this filter, summed over all orders, which its place among the filters that a document fails decides
    alone. Cases are those of ``failure_masks``; a part without rows has no rows here.
    """
    masks = failure_masks(docs, labels, prefixes, heavy_bytes)
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders = [*map("".join, itertools.permutations(FILTERS))]
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {{}}, 1)) - 1)"
    steps = steps.withColumns(
        {
            "own": F.expr(bit.format("step")),
            "through": F.expr(f"aggregate(sequence(1, step), 0, (bits, at) -> bits | {bit.format('at')})"),
        }
    )
    before = "(through & ~own)"
    here = f"m.mask & own <> 0 AND m.mask & {before} = 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        _total("m.mask & through = 0").alias("kept"),
        _total(here).alias("removed"),
        _total(f"m.mask & own <> 0 AND m.mask & {before} <> 0").alias("redundant"),
        _total("m.mask = own").alias("unique_fails"),
        _total(here, "m.good").alias("good_lost"),
        _total(here, "m.toxic").alias("toxic_lost"),
        _total("m.mask & own <> 0", f"m.n * ({len(orders)} div bit_count(m.mask))").alias("shapley"),
    )
