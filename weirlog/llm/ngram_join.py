"""N-gram Jaccard join: prefix filters under several global token orders, then verification.

Tokens are 64-bit hashes of word shingles. If two sets are similar enough, then under any
one order of all tokens they share a token among their first few (their prefixes). So
pairs are found by joining on prefix tokens under the first order, must share a prefix
token under each further order too, and what is left is verified on the whole sets.
The first order puts rare tokens first: passages that many documents share come late and
hardly ever lie in a prefix. How rare a token is, a table of counters tells, to which
all documents are counted and whose size follows the number of tokens, so that what
is common stands out as well in a large corpus; any such table gives a valid order. The
further orders go by hashes alone, so they are independent of it and of each other.

Hot groups never become pairs. Documents with one set are one node. Then nodes
with common minima under some hashes are compared with one of them, the bucket's leader,
which joins most of a large group of near copies. Only tokens that reach more than one
component go on. Where these would still make many pairs, nodes outside a token's largest
component are compared with a few nodes inside it, however many tokens they share with it, which
leaves few outside. Nodes that still have such a token in common with many are written as
differences from one document of that component, the center: what the group shares is in
none of them, and linked sets share the rare tokens of theirs. At last all other pairs
across components are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import size_checked
from .common import claim_worker, register_cache, stored
from .components import components

#: Words of a shingle, and the similarity of a link as a fraction.
WIDTH, NUMERATOR, DENOMINATOR = 3, 90, 100
#: Tokens that a counter should hold, and the fewest and most counters as powers of two (a byte each where they are sent).
LOAD, LEAST_BITS, MOST_BITS = 32, 16, 24
#: Bytes of text for each token, for the number of counters, and counters that travel in one row.
TOKEN_BYTES, BLOCK_BITS = 6, 14
#: Further orders that a pair must pass.
FURTHER_ORDERS = 2
#: Leaders are found by common minima under hashes: so many bands, each of so many hashes.
BANDS, BAND_HASHES = 2, 3
#: Where tokens could make more pairs than so many a row, nodes with a token that could are first tried with so many nodes
#: of the token's main component, those still outside with more and other ones, as long as there is a link for so many of their rows.
#: Few turns pay: what they leave is paired by its differences from a center.
MOST_PAIRS, STARS, MORE_STARS, LEAST_FRUIT = 16, 4, 32, 4
#: Texts whose sets a worker holds at once.
TEXTS = 500
#: Words whose hashes a worker keeps.
CACHED = 200_000
#: The multipliers of the splitmix64 finalizer, and the odd numbers that tell places and orders apart.
_FINALIZER = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(values: np.ndarray) -> np.ndarray:
    first, second = (np.uint64(m) for m in _FINALIZER)
    values = (values ^ (values >> np.uint64(30))) * first
    values = (values ^ (values >> np.uint64(27))) * second
    return values ^ (values >> np.uint64(31))


def _ordered(tokens: np.ndarray, order: int) -> np.ndarray:
    """Another hash of each token for each order."""
    return _mixed(tokens + np.uint64((order + 1) * _GOLDEN % 2**64))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()
register_cache("ngram_join", _words.clear)


def tokens_of(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a text of fewer words is one shingle, of none has none."""
    words = text.lower().split()
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    if not width:
        return hashes
    n = len(hashes) - width + 1
    joined = np.full(n, width, np.uint64)
    for place in range(width):
        joined = _mixed(joined * np.uint64(_GOLDEN) + hashes[place : place + n])
    return np.unique(joined)


def prefix_size(n: int, numerator: int, denominator: int) -> int:
    """A linked set shares at least ceil(n * t) tokens, so one of any n - ceil(n * t) + 1 is shared."""
    return n - -(-n * numerator // denominator) + 1


def _prefix(tokens: np.ndarray, ranks: np.ndarray | None, order: int, share: tuple[int, int]) -> np.ndarray:
    """The first tokens of a set under an order: by commonness (where ranks are given), the order's hash, the token itself."""
    size = prefix_size(len(tokens), *share) if len(tokens) else 0
    key = _ordered(tokens, order)
    if ranks is not None:
        key = ranks[tokens >> np.uint64(65 - len(ranks).bit_length())].astype(np.uint64) << np.uint64(56) | (key >> np.uint64(8))
    if size < len(tokens):
        near = np.flatnonzero(key <= np.partition(key, size - 1)[size - 1])
        tokens, key = tokens[near], key[near]
    return tokens[np.lexsort((tokens, key))][:size]


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim_worker("ngram_join")
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS):
            yield batch.slice(start, TEXTS)


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))


def token_ranks(docs: DataFrame, width: int) -> np.ndarray:
    """For each counter how common its tokens are, on a scale of eight steps a doubling; all documents are counted.

    Tasks send their counts in blocks of counters, which are added up block by block; the driver gets a byte per counter.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // (TOKEN_BYTES * LOAD)).bit_length()))
    n, per_block = 1 << bits, 1 << BLOCK_BITS
    most_waiting = max(n, 1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size = np.zeros(n, np.int32), [], 0

        def add() -> None:
            found, times = np.unique(np.concatenate(waiting), return_counts=True)
            counts[found] += times.astype(np.int32)

        for batch in _parts(batches):
            for text in batch.column(1):
                waiting.append((tokens_of(text.as_py() or b"", width) >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(waiting[-1])
                if size > most_waiting:
                    add()
                    waiting, size = [], 0
        if waiting:
            add()
        for block in range(n // per_block):
            own = counts[block * per_block : (block + 1) * per_block]
            if own.any():
                sent = own.astype(np.uint8 if own.max() < 256 else np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sent], pa.binary())], names=["block", "counts"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = counts.as_py()
                own = np.frombuffer(data, np.uint8 if len(data) == per_block else np.int32)
                sums[block] = sums.get(block, 0) + own.astype(np.int64)
        for block, total in sums.items():
            ranks = np.minimum(np.rint(8 * np.log2(total.astype(np.float64) + 1)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], names=["block", "counts"])

    rows = _bytes(docs).mapInArrow(count, "block int, counts binary").repartition("block")
    ranks = np.zeros(n, np.uint8)
    for row in rows.mapInArrow(rank, "block int, counts binary").collect():  # a byte per counter in all
        ranks[row.block * per_block : (row.block + 1) * per_block] = np.frombuffer(row.counts, np.uint8)
    return ranks


def _bands(tokens: np.ndarray) -> np.ndarray:
    """One number per band: a hash of the set's minima under the band's hashes."""
    if not len(tokens):
        return tokens
    result = np.zeros(BANDS, np.uint64)
    for band in range(BANDS):
        minima = [_ordered(tokens, 100 + band * BAND_HASHES + k).min() for k in range(BAND_HASHES)]
        for value in minima:
            result[band] = _mixed(result[band : band + 1] * np.uint64(_GOLDEN) + value)[0]
    return result


def _signatures(docs: DataFrame, ranks, width: int, share: tuple[int, int]) -> DataFrame:
    """doc_id, n (set size), set_hash (128 bits), bands, and the prefix under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = [tokens_of(text.as_py() or b"", width) for text in batch.column(1)]
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                _longs([_bands(s) for s in sets]),
                _longs([_prefix(s, ranks.value, 0, share) for s in sets]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    rows = _bytes(docs)
    longs = T.ArrayType(T.LongType())
    fields = [("n", T.LongType()), ("set_hash", T.BinaryType()), ("bands", longs), ("prefix", longs)]
    schema = T.StructType([rows.schema[0], *(T.StructField(*f) for f in fields)])
    names = schema.names
    return rows.mapInArrow(run, schema)


def _sets(docs: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """doc_id, the whole set, and its prefix under each further order, which has no ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = [tokens_of(text.as_py() or b"", width) for text in batch.column(1)]
            further = [_longs([_prefix(s, None, k, share) for s in sets]) for k in range(1, FURTHER_ORDERS + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _longs(sets), *further], names=names)

    rows = _bytes(docs)
    longs = T.ArrayType(T.LongType())
    names = ["doc_id", "tokens", *(f"prefix_{k}" for k in range(1, FURTHER_ORDERS + 1))]
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *(T.StructField(n, longs) for n in names[1:])]))


def _similar(a: Column, b: Column, share: tuple[int, int]) -> Column:
    common = F.size(F.array_intersect(a, b)).cast("bigint")
    return common * share[1] >= (F.size(a) + F.size(b) - common) * share[0]


def _prefix_size(n: str, share: tuple[int, int]) -> Column:
    """``prefix_size`` of a column."""
    return F.col(n) - F.floor((F.col(n) * share[0] + share[1] - 1) / share[1]) + 1


def _least_common(n: str, other: str, share: tuple[int, int]) -> Column:
    """Tokens that linked sets of these sizes share at least."""
    numerator, whole = share[0], sum(share)
    return F.floor(((F.col(n) + F.col(other)) * numerator + whole - 1) / whole)


def _beside(pairs: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of both ends."""
    for end in ("a", "b"):
        side = table.select(F.col(key).alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
        pairs = pairs.join(side, end)
    return pairs


def _ends(pairs: DataFrame, key: str) -> DataFrame:
    return size_checked(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct())


def _sharing_prefixes(pairs: DataFrame, nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs whose prefixes under the first order share enough tokens.

    If x and y share o tokens in all, the c-th of these in the order has at most
    c + |x| - o - 1 tokens of x before it, so at least prefix(x) - (|x| - o) of them lie in
    the prefix of x, and likewise of y.
    """
    pairs = stored(pairs, "pairs")
    ends = stored(nodes.join(_ends(pairs, "node"), "node", "left_semi").select("node", "n", "prefix"), "prefixes")
    both = _beside(pairs, ends, "node", ["n", "prefix"])
    least = _least_common("a_n", "b_n", share)
    slack = F.least(*(_prefix_size(n, share) - F.col(n) + least for n in ("a_n", "b_n")))
    return both.where(F.size(F.array_intersect("a_prefix", "b_prefix")) >= slack).select("a", "b").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that pass the filters of all orders and then are similar on their whole sets."""
    pairs = stored(_sharing_prefixes(pairs, nodes, share), "pairs")
    sets = stored(_sets(docs.join(_ends(pairs, "doc_id"), "doc_id", "left_semi"), width, share), "sets")
    orders = [f"prefix_{k}" for k in range(1, FURTHER_ORDERS + 1)]
    filtered = _beside(pairs, sets, "doc_id", orders)
    for order in orders:
        filtered = filtered.where(F.arrays_overlap(f"a_{order}", f"b_{order}"))
    whole = _beside(filtered.select("a", "b"), sets, "doc_id", ["tokens"])
    return stored(whole.where(_similar(F.col("a_tokens"), F.col("b_tokens"), share)).select("a", "b"), "links")


def _fits(a: str, b: str, share: tuple[int, int]) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(a, b) * share[1] >= F.greatest(a, b) * share[0]


def _leader_pairs(nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Each node beside the smallest node with which it shares a band: at most BANDS pairs a node."""
    rows = nodes.select("node", "n", F.posexplode("bands").alias("which", "band"))
    leaders = rows.groupBy("which", "band").agg(
        F.min("node").alias("leader"), F.max("node").alias("last"), F.min_by("n", "node").alias("leader_n")
    )
    leaders = leaders.where("leader < last").drop("last")
    beside = rows.join(leaders, ["which", "band"]).where(F.col("node") != F.col("leader")).where(_fits("n", "leader_n", share))
    return beside.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()


def _prefix_rows(nodes: DataFrame) -> DataFrame:
    """token, node, n, component, at and main of each prefix token that reaches more than one component.

    main is the component with the most members of those that a token reaches.
    """
    rows = nodes.select("node", "n", "component", "members", F.posexplode("prefix").alias("at", "token"))
    reach = rows.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", "members").alias("main")
    )
    reach = reach.where("low < high").select("token", "main")
    return stored(rows.join(reach, "token").select("token", "node", "n", "component", "at", "main"), "prefix-rows")


def _token_sizes(rows: DataFrame) -> DataFrame:
    """token, all (its rows) and outer (those outside its main component)."""
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("component") != F.col("main")).alias("outer"))


def _pairs_ahead(rows: DataFrame) -> tuple[int, int, int]:
    """How many pairs the tokens of ``rows`` can make at most across components, the number of rows, and of those that stars are for."""
    hot = F.when(F.col("outer") > MOST_PAIRS, F.col("outer"))
    sums = [F.sum(F.col("all").cast("double") * F.col("outer")), F.sum("all"), F.sum(hot)]
    return tuple(int(total or 0) for total in _token_sizes(rows).agg(*sums).first())


def _star_pairs(rows: DataFrame, share: tuple[int, int], turn: int = 0, most: int | None = None) -> DataFrame:
    """Nodes outside the main component of a token with more than ``most`` such nodes, each beside a few nodes of that component.

    One link joins a node to a component, so a node that shares many tokens with it needs no more pairs than one that
    shares few: it meets at most STARS in the first turn, in which most nodes of a group find a link, and MORE_STARS
    in each later one. Every token has its own stars, by hashes of turn, token and node; a node takes those that most of its
    tokens have, of equals by a hash. So nodes meet different stars, and others each turn, and hardly any that is similar to a
    part of the group stays apart from it.
    """
    hot = _token_sizes(rows).where(F.col("outer") > (MOST_PAIRS if most is None else most)).select("token")
    rows = rows.join(hot, "token", "left_semi")
    chosen = [F.min_by(F.struct("node", "n"), F.xxhash64(F.lit(turn * STARS + k), "token", "node")) for k in range(STARS)]
    stars = rows.where("component = main").groupBy("token").agg(F.array_distinct(F.array(*chosen)).alias("stars"))
    beside = rows.where("component <> main").select("token", "node", "n", "main").join(stars, "token")
    beside = beside.select("node", "n", "main", F.explode("stars").alias("star"))
    beside = beside.select("node", "n", "main", F.col("star.node").alias("star"), F.col("star.n").alias("star_n"))
    beside = beside.where(_fits("n", "star_n", share)).groupBy("node", "main", "star").agg(F.count(F.lit(1)).alias("tokens"))
    best = Window.partitionBy("node", "main").orderBy(F.desc("tokens"), F.xxhash64(F.lit(turn), "node", "star"), "star")
    taken = beside.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= (MORE_STARS if turn else STARS))
    return taken.select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b")).distinct()


def _hosts(rows: DataFrame) -> DataFrame:
    """node and host: for nodes with tokens that many nodes outside the main component have, the main component of most of these."""
    hot = _token_sizes(rows).where(F.col("outer") > MOST_PAIRS).select("token")
    shared = rows.join(hot, "token", "left_semi").groupBy("node", "main").agg(F.count(F.lit(1)).alias("tokens"))
    best = shared.groupBy("node").agg(F.max(F.struct("tokens", F.col("main").alias("host"))).alias("best"))
    return stored(best.select("node", "best.host"), "hosts")


def _differences(hosts: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """row, node, host, n, center_n and difference: the tokens that either a node's set or its host's center has, but not both.

    The center is the document that gives the host component its name; of rows that repeat its id one counts.
    Any set would do: what it is like only decides how long the differences are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, center_text = tokens_of(b""), b""
        for batch in _parts(batches):
            sizes, differences = [], []
            for text, other in zip(batch.column(2), batch.column(3)):
                if (other := other.as_py() or b"") != center_text:
                    center, center_text = tokens_of(other, width), other
                own = tokens_of(text.as_py() or b"", width)
                sizes.append((len(own), len(center)))
                differences.append(np.setxor1d(own, center, assume_unique=True))
            counts = [pa.array([s[k] for s in sizes], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, _longs(differences)], names=names)

    texts = _bytes(docs)
    centers = texts.join(size_checked(hosts.select(F.col("host").alias("doc_id")).distinct()), "doc_id", "left_semi")
    centers = centers.groupBy(F.col("doc_id").alias("host")).agg(F.min("text").alias("center"))
    own = texts.withColumnRenamed("doc_id", "node").join(size_checked(hosts), "node")
    beside = own.join(centers, "host").select("node", "host", "text", "center")
    longs = T.ArrayType(T.LongType())
    fields = [("n", T.LongType()), ("center_n", T.LongType()), ("difference", longs)]
    schema = T.StructType([*beside.schema.fields[:2], *(T.StructField(*f) for f in fields)])
    names = schema.names
    found = beside.mapInArrow(run, schema).where("n > 0").withColumn("row", F.monotonically_increasing_id())
    return stored(found, "differences")


def _center_links(differences: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of a node and its center that are similar, of which the size of the difference tells."""
    both, apart = F.col("n") + F.col("center_n"), F.size("difference")
    linked = differences.where(((both - apart) * share[1] >= (both + apart) * share[0]) & (F.col("node") != F.col("host")))
    return linked.select(F.least("node", "host").alias("a"), F.greatest("node", "host").alias("b")).distinct()


def _difference_prefixes(differences: DataFrame, share: tuple[int, int]) -> DataFrame:
    """node, host, n, d (size of the difference), token and at: a difference's first tokens, those that few differences of the host have first.

    The differences of linked sets differ in size by as many tokens at most as the sets are apart, so no more than (1 / share - 1) * n
    tokens lie before the one that counts in ``_difference_pairs``. Tokens of a single difference keep their places but need no row.
    """
    columns = ["row", "node", "host", "n", F.size("difference").cast("bigint").alias("d"), F.explode("difference").alias("token")]
    rows = differences.select(*columns)
    times = rows.groupBy("host", "token").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    rows = rows.join(times, ["host", "token"], "left")
    rarest = Window.partitionBy("row").orderBy(F.coalesce("times", F.lit(1).cast("bigint")), "token")
    rows = rows.withColumn("at", F.row_number().over(rarest) - 1)
    first = F.col("at") * share[0] <= F.col("n") * (share[1] - share[0])
    rows = rows.where(F.col("times").isNotNull() & first).withColumn("token", F.struct("host", "token"))
    return stored(rows.select("node", "n", "d", "token", "at"), "difference-prefixes")


def _between_components(prefixes: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of the tokens that reach more than one component, with component and main (the one with the most of a token's rows)."""
    rows = prefixes.join(grouped.select("node", "component").distinct(), "node")
    sizes = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("rows"))
    most = F.max(F.struct("rows", "component")).alias("most")
    reach = sizes.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), most)
    return stored(rows.join(reach.where("low < high").select("token", F.col("most.component").alias("main")), "token"), "prefix-rows")


def _difference_pairs(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of nodes of one host and different components that can be linked by their differences from the center.

    Sets x and y are apart by |dx| + |dy| - 2 |dx and dy| tokens, where dx and dy are their differences from one
    center; linked ones by at most limit = (1 - share) / (1 + share) * (|x| + |y|). So dx and dy share least =
    (|dx| + |dy| - limit) / 2 tokens or more, of which the first under any order is one of the first |dx| - least + 1
    of dx and of the first |dy| - least + 1 of dy. What most of a group of near copies have is in no difference, what a
    copy has changed is. Without need of a shared token (least < 1) both are linked with the center already.
    """
    outer = rows.where("component <> main").select("token", *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "d", "component", "at")))
    once = (F.col("component") == F.col("main")) | (F.col("o_node") < F.col("node"))
    limit = F.floor((F.col("n") + F.col("o_n")) * (share[1] - share[0]) / sum(share))
    least = F.ceil((F.col("d") + F.col("o_d") - limit) / 2)
    early = (least >= 1) & (F.col("at") <= F.col("d") - least) & (F.col("o_at") <= F.col("o_d") - least)
    met = rows.join(outer, "token").where(once & (F.col("component") != F.col("o_component")) & early & _fits("n", "o_n", share))
    return met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def _linked_by_differences(pairs: DataFrame, differences: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes of one host that are similar, as their differences from the center tell of the whole sets."""
    beside = _beside(pairs, differences, "node", ["n", "difference"])
    both, sizes = F.col("a_n") + F.col("b_n"), F.size("a_difference") + F.size("b_difference")
    apart = sizes - 2 * F.size(F.array_intersect("a_difference", "b_difference"))
    return stored(beside.where((both - apart) * share[1] >= (both + apart) * share[0]).select("a", "b").distinct(), "links")


def _hosted(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Prefix rows with the bin of each, the nodes of one host or else those of one component, and as main the token's largest bin."""
    rows = rows.drop("main").join(hosts, "node", "left")
    rows = rows.withColumn("bin", F.struct(F.col("host").isNotNull().alias("hosted"), F.coalesce("host", "component").alias("of"))).drop("host")
    sizes = rows.groupBy("token", "bin").agg(F.count(F.lit(1)).alias("rows"))
    reach = sizes.groupBy("token").agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.max(F.struct("rows", "bin")).alias("most"))
    reach = reach.where("low < high").select("token", F.col("most.bin").alias("main"))
    return stored(rows.join(reach, "token"), "prefix-rows")


def _cross_pairs(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of nodes of different components and bins that share a token early enough under the first order.

    Of a token's rows, those outside its largest bin are joined with all: every pair across
    bins has such an end, and the largest one, often a group of near copies, makes no
    pairs with itself. Without a column ``bin`` every component is one.

    Linked sets x and y share at least o = share / (1 + share) * (|x| + |y|) tokens, so
    they share one of the first |x| - o + 1 of x that is one of the first |y| - o + 1 of y: a prefix
    cut to the pair, about half as long as the longest that a set may need.
    """
    if "bin" not in rows.columns:
        rows = rows.withColumn("bin", F.col("component"))
    columns = ["node", "n", "component", "at", "bin"]
    outer = rows.where("bin <> main").select("token", *(F.col(c).alias(f"o_{c}") for c in columns))
    once = (F.col("bin") == F.col("main")) | (F.col("o_node") < F.col("node"))
    apart = (F.col("component") != F.col("o_component")) & (F.col("bin") != F.col("o_bin"))
    least = _least_common("n", "o_n", share)
    early = (F.col("at") <= F.col("n") - least) & (F.col("o_at") <= F.col("o_n") - least)
    met = rows.join(outer, "token").where(once & apart & early)
    return met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def _with_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Adds component (a node without links is its own) and members (nodes of it)."""
    found = components(links)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    found = size_checked(found.join(sizes, "component"))
    joined = nodes.join(found, "node", "left")
    return joined.withColumns(
        {"component": F.coalesce("component", "node"), "members": F.coalesce("members", F.lit(1).cast("bigint"))}
    )


def similar_groups(
    docs: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of shingles is at least
    numerator / denominator; component_id is the smallest doc_id that links reach, the
    document itself included. A text of fewer words than a shingle is one shingle; a null
    text or one without words has none and links with nothing. Rows that repeat a doc_id
    count as one document. A null doc_id names no document: such a row links with
    nothing, but has the component of the documents with its own set, if any.
    An empty table gives no rows; further columns of ``docs`` are not read.
    """
    share = (numerator, denominator)
    ranks = docs.sparkSession.sparkContext.broadcast(token_ranks(docs, width))
    rows = stored(_signatures(docs, ranks, width, share), "signatures")
    sets = stored(rows.where("n > 0").groupBy("set_hash").agg(F.min("doc_id").alias("node")), "set-nodes")

    # A set's first document is its node; the others (copies) are taken out by their ids.
    firsts = rows.where("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "n", "set_hash", "bands", "prefix")
    same = rows.select("doc_id", "set_hash").where("doc_id IS NOT NULL").join(sets, "set_hash").where("doc_id <> node")
    copies = size_checked(same.select(F.col("doc_id").alias("node"), "set_hash").distinct())
    nodes = firsts.join(copies, ["node", "set_hash"], "left_anti").drop("set_hash")

    links, fruitful, turn = _verified(_leader_pairs(nodes, share), nodes, docs, width, share), True, 0
    while True:
        met = _prefix_rows(_with_components(nodes, links))
        ahead, size, outer = _pairs_ahead(met)
        if not (fruitful and outer > 0 and ahead > MOST_PAIRS * size):
            break
        found = _verified(_star_pairs(met, share, turn), nodes, docs, width, share)
        links = links.unionByName(found)
        fruitful, turn = found.count() * LEAST_FRUIT > outer, turn + 1

    if outer > 0:
        hosts = _hosts(met)
        differences = _differences(hosts, docs, width)
        prefixes = _difference_prefixes(differences, share)
        links = links.unionByName(_center_links(differences, share))
        beside = _star_pairs(_between_components(prefixes, _with_components(nodes, links)), share, most=0)
        links = links.unionByName(_linked_by_differences(beside, differences, share))
        inside = _difference_pairs(_between_components(prefixes, _with_components(nodes, links)), share)
        links = links.unionByName(_linked_by_differences(inside, differences, share))
        met = _hosted(_prefix_rows(_with_components(nodes, links)), hosts)
    links = links.unionByName(_verified(_cross_pairs(met, share), nodes, docs, width, share))

    found = size_checked(components(links))
    named = sets.join(found, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    result = rows.select("doc_id", "n", "set_hash").join(named, "set_hash", "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_per_group(
    docs: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR
) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; all columns stay."""
    groups = similar_groups(docs, width, numerator, denominator).where("doc_id <> component_id")
    dropped = size_checked(groups.select("doc_id").distinct())
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
