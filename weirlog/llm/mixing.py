"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

A slot of the mix is one block of words. Slot k draws the point frac((k + 1/2) * phi)
(phi: the golden ratio's fraction), which falls into one source's part of the
cumulative weights; so every stretch of the schedule follows the weights closely. The
slots of a source are ranked, and rank r takes block r of the source's words in
shuffled document order, starting again after the last block.

No window runs over a whole source: documents are shuffled by a hash whose first
bits deal them into buckets, and slots are ranked in chunks; sums per bucket and counts per
chunk give the offsets.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import size_checked
from .common import n_words, stored, text_or_empty

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words that the mix takes, as a share of all words.
TOTAL = 1.5
#: A source gives its words at most so many times.
MOST = 2.0
#: Words of a block.
BLOCK_WORDS = 512
#: The golden ratio's fraction.
GOLDEN = "0.618033988749894848204586834365638118"
#: Parts of the unit interval; slots and sources meet by part.
CELLS = 1024
#: Slots whose ranks are counted together.
CHUNK = 65_536


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of every row; a null text has none."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text_or_empty()).alias("size"))


def _stratum(within: str, table: str = "") -> Column:
    """One string for each source and value of the column ``within``; nulls have their own."""
    names = {"source": "source", "within": within}
    return F.to_json(F.struct(*(F.col(f"{table}`{column}`").cast("string").alias(name) for name, column in names.items())))


def _strata(docs: DataFrame, within: str) -> tuple[DataFrame, DataFrame]:
    """``word_counts`` and ``source_targets`` with strata for sources: a source's target is shared by its strata as its words are."""
    columns = ["doc_id", F.col("source").cast("string").alias("whole"), _stratum(within).alias("source"), n_words(text_or_empty()).alias("size")]
    counts = stored(docs.select(*columns), "mix-counts")
    sizes = counts.groupBy("whole", "source").agg(F.sum("size").alias("size"))
    wholes = source_targets(sizes.select(F.col("whole").alias("source"), "size"))
    wholes = wholes.select(F.col("source").alias("w"), F.col("source_size").alias("whole_size"), "target")
    sizes = sizes.join(size_checked(wholes), F.col("whole").eqNullSafe(F.col("w")))
    target = F.col("target") * F.col("size") / F.greatest("whole_size", F.lit(1))
    return counts.drop("whole"), stored(sizes.select("source", F.col("size").alias("source_size"), target.alias("target")), "mix-targets")


def source_targets(counts: DataFrame) -> DataFrame:
    """source, source_size and target of each source.

    Sources in code point order (null last) weigh 5, 2, 1, repeating. A target is
    min(cap, level * weight): what the capped sources cannot give is shared by weight
    among the others. The level follows from running sums over the sources in the order
    in which they reach their caps.
    """
    sizes = counts.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighed = sizes.select("source", "source_size", F.element_at(weights, place + 1).alias("weight"))
    weighed = weighed.withColumn("cap", MOST * F.col("source_size"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = TOTAL * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    levels = weighed.withColumn("level", left / weight_left).withColumn("place", F.row_number().over(filling))
    # The first source whose cap the level does not pass sets the level for all.
    open_ = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("place", "level"))
    levels = levels.withColumn("level", F.min(open_).over(everything)["level"])
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap")
    return levels.select("source", "source_size", target.alias("target"))


def _plan(targets: DataFrame, block_words: int) -> DataFrame:
    """Adds blocks (of the source; the last may be short), words (the target in whole words) and slots (needed for it)."""
    planned = targets.withColumn("words", F.floor(F.col("target") + 0.5).cast("bigint"))
    size = F.greatest("source_size", F.lit(1))
    planned = planned.withColumn("blocks", F.ceil(size / F.lit(block_words)).cast("bigint"))
    whole = F.floor(F.col("words") / size).cast("bigint")
    rest = F.ceil((F.col("words") - whole * size) / F.lit(block_words)).cast("bigint")
    return planned.withColumn("slots", whole * F.col("blocks") + rest)


def _fraction(value: Column) -> Column:
    return value - F.floor(value)


def _point(slot: Column) -> Column:
    """frac((slot + 1/2) * phi), by chunk and place in it, so that large slot numbers keep their precision."""
    per_chunk = float((Decimal(CHUNK) * Decimal(GOLDEN)) % 1)
    whole, rest = F.floor(slot / CHUNK), slot % CHUNK
    return _fraction(_fraction(whole * F.lit(per_chunk)) + (rest + F.lit(0.5)) * F.lit(float(GOLDEN)))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, rank: which source fills each slot of the mix.

    Slots that a source draws beyond its need are dropped, and the few that the points
    did not give it (their number is bounded by the discrepancy) follow at the end,
    so that every source comes to its target.
    """
    spark = targets.sparkSession
    planned = _plan(targets, block_words).where("slots > 0").select("source", "slots")
    total = planned.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    high = F.sum("slots").over(by_name) / F.lit(float(max(total, 1)))
    ranges = planned.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0.0)))
    cells = F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))
    ranges = size_checked(ranges.withColumn("cell", F.explode(cells)))

    slots = spark.range(total).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS))
    drawn = slots.join(ranges, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    drawn = drawn.select("slot", "source", "slots", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("chunk", "source").orderBy("slot")))

    counts = drawn.groupBy("chunk", "source").count()
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    offsets = offsets.withColumnsRenamed({"chunk": "c", "source": "s"})
    same = (F.col("chunk") == F.col("c")) & F.col("source").eqNullSafe(F.col("s"))
    ranked = ranked.join(offsets, same).withColumn("rank", F.col("offset") + F.col("place") - 1)
    ranked = ranked.where(F.col("rank") < F.col("slots")).select("slot", "source", "rank")

    reached = counts.groupBy(F.col("source").alias("s")).agg(F.sum("count").alias("drawn"))
    short = planned.join(reached, F.col("source").eqNullSafe(F.col("s")), "left")
    short = short.withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < slots")
    late = short.select("source", F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)).alias("rank"))
    return ranked.unionByName(late.select(F.lit(total).cast("bigint").alias("slot"), "source", "rank"))


def _shuffled(counts: DataFrame, seed: str) -> DataFrame:
    """Adds start: the words of the source that lie before the row in shuffled order; row: unique with source and bucket."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = counts.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 4))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("row", F.row_number().over(inside))
    keyed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    same = (F.col("bucket") == F.col("b")) & F.col("source").eqNullSafe(F.col("s"))
    placed = keyed.join(offsets, same).withColumn("start", F.col("offset") + F.col("inside"))
    return placed.select("doc_id", "source", "size", "bucket", "row", "start")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: str = "mix", within: str | None = None) -> DataFrame:
    """The mix: which words of which document each slot takes.

    Returns one row per slot and document that shares words: slot, rank, doc_id, source,
    size, source_size, target, bucket and row (with source they tell apart rows that
    repeat a doc_id), first (word of the document, from 0), n (words) and round (0 or
    1: the how manieth time the source's words are gone through). Documents of which
    nothing is taken have one row with null slot and n = 0. The order of documents
    depends on their ids, ties on their sizes, and on nothing else, so reruns agree.
    A null text has no words; a null source is a source of its own; an empty table gives
    no rows; further columns of ``docs`` are not read. With ``within``, a column of ``docs``, what
    is said of sources holds for strata (``_strata``), and source names the stratum.
    """
    if within is None:
        counts = stored(word_counts(docs), "mix-counts")
        targets = stored(source_targets(counts), "mix-targets")
    else:
        counts, targets = _strata(docs, within)
    planned = size_checked(_plan(targets, block_words).select(F.col("source").alias("p"), "source_size", "target", "blocks", "words"))
    of_plan = F.col("source").eqNullSafe(F.col("p"))

    slots = schedule(targets, block_words).join(planned, of_plan).withColumnsRenamed({"source": "s", "words": "wanted"})
    block = F.col("rank") % F.col("blocks")
    slots = slots.withColumn("block", block).withColumn("round", F.expr("rank div blocks"))
    # A round's last block is cut where the target is reached.
    slots = slots.withColumn("end", F.col("wanted") - F.col("round") * F.col("source_size"))
    slots = slots.select("slot", "rank", "round", "s", F.col("block").alias("b"), "end")

    placed = _shuffled(counts, seed).join(planned, of_plan)
    last = F.greatest(F.col("start") + F.col("size") - 1, F.col("start"))
    blocks = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"last div {block_words}"))
    pieces = placed.withColumn("last", last).withColumn("block", F.explode_outer(F.when(F.col("size") > 0, blocks)))
    pieces = pieces.withColumn("from", F.greatest(F.col("block") * block_words, F.col("start")))
    pieces = pieces.withColumn("to", F.least((F.col("block") + 1) * block_words, F.col("last") + 1))

    same = (F.col("block") == F.col("b")) & F.col("source").eqNullSafe(F.col("s"))
    n = F.when(F.col("slot").isNull(), F.lit(0)).otherwise(F.greatest(F.least("to", "end") - F.col("from"), F.lit(0)))
    return pieces.join(slots, same, "left").select(
        "slot", "rank", "doc_id", "source", "size", "source_size", "target", "bucket", "row",
        (F.col("from") - F.col("start")).alias("first"), n.alias("n"), "round",
    )


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and n_slots of every document.

    first_slot is the first slot of the schedule that takes words of the document (null: none does), n_slots how many do.
    """
    keys = ["source", "bucket", "row", "doc_id", "size", "source_size", "target"]
    of_slot = F.when(F.col("n") > 0, F.col("slot"))
    sums = [F.sum("n").alias("taken"), F.min(of_slot).alias("first_slot"), F.count(of_slot).alias("n_slots")]
    return mix(docs).groupBy(*keys).agg(*sums).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def mixed_documents(docs: DataFrame, within: str | None = None) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: one row per document and round that takes words of it.

    Where a round takes only some words of a document, text holds just those, with the
    white space between them. Of rows that repeat doc_id, source and size each gets the
    words that one of them gets. With ``within``, a column, each of its values has the share
    of a source's words in the mix that it has in the source.
    """
    rounds = mix(docs, within=within).where("n > 0").groupBy("source", "bucket", "row", "doc_id", "size", "round")
    rounds = rounds.agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    rounds = rounds.groupBy("doc_id", "source", "size", "round").agg(F.max(F.struct("n", "first")).alias("part"))
    rounds = rounds.select(*(F.col(c).alias(f"mix_{c}") for c in ("doc_id", "source", "size")), "part.n", "part.first")
    rounds = rounds.withColumnsRenamed({"n": "mix_n", "first": "mix_first"})

    d, r = docs.alias("d"), rounds.alias("r")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.mix_doc_id"))
    source = F.col("d.source").cast("string") if within is None else _stratum(within, "d.")
    same = same & source.eqNullSafe(F.col("r.mix_source"))
    same = same & (n_words(text_or_empty("d.text")) == F.col("r.mix_size"))
    words = F.split(F.regexp_replace("d.text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    some = F.array_join(F.slice(words, F.col("r.mix_first").cast("int") + 1, F.col("r.mix_n").cast("int")), "")
    whole = F.col("r.mix_n") == F.col("r.mix_size")
    text = F.when(whole, F.col("d.text")).otherwise(some).alias("text")
    return d.join(r, same).select(*(text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))
