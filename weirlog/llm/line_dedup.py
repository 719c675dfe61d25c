"""Line dedup: a line that many documents hold stays in one of them.

Texts are exploded into lines. A line's key is the line without white space at both ends, A-Z
in lower case; keys travel as 128-bit hashes. Documents are counted in two steps: one row per
(hash, document), dealt out by both, then partial counts per hash in the tasks. So a line of
a third of all documents is spread over all tasks and then crosses the network once per task. What is
over the threshold is joined with the lines again, the places that a document loses are put
together, and the document is reassembled from the places that stay, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import size_checked
from .common import stored, text_or_empty
from .exact_dedup import md5_bytes

#: Code points that a key has at least, and documents that hold it at least, for its lines to go.
LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5
_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    """The lines between line feeds; an empty text is one empty line."""
    return F.split(text, "\n", -1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and content: with doc_id it tells a row from others that differ from it in what is decided here."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.withColumn("content", md5_bytes(F.col("text")))


def _lines(rows: DataFrame, least_length: int) -> DataFrame:
    """The place and the key's hash of each line whose key is long enough."""
    lines = rows.select("doc_id", "content", F.posexplode(split_lines(F.col("text"))).alias("place", "line"))
    keys = lines.select("doc_id", "content", "place", F.btrim("line", F.lit(_WHITE)).alias("key"))
    keys = keys.where(F.length("key") >= least_length)
    return keys.select("doc_id", "content", "place", md5_bytes(lower_ascii(F.col("key"))).alias("hash"))


def shared_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """hash (of the key), n_documents and keep_id (the largest doc_id that holds it) of the keys over the threshold."""
    held = _lines(_rows(docs), least_length).where("doc_id IS NOT NULL").select("hash", "doc_id").distinct()
    counted = held.groupBy("hash").agg(F.count(F.lit(1)).alias("n_documents"), F.max("doc_id").alias("keep_id"))
    return counted.where(F.col("n_documents") >= least_documents)


def _dropped_places(docs: DataFrame, least_length: int, least_documents: int) -> DataFrame:
    """For each (doc_id, content) that loses lines, their places."""
    shared = size_checked(shared_lines(docs, least_length, least_documents).select("hash", "keep_id"))
    lost = _lines(_rows(docs), least_length).join(shared, "hash").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    places = lost.groupBy("doc_id", "content").agg(F.collect_set("place").alias("places"))
    return places.select(F.col("doc_id").alias("lost_id"), F.col("content").alias("lost_content"), "places")


def _reassembled(docs: DataFrame, least_length: int, least_documents: int) -> DataFrame:
    """row (all columns of ``docs``), lines, n_dropped, and kept (null where no line goes) of every row."""
    places = stored(_dropped_places(docs, least_length, least_documents), "line-places")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("content", md5_bytes(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("content") == F.col("lost_content"))
    joined = rows.join(places, same, "left").withColumn("lines", split_lines(F.col("text")))
    # array_except and transform keep the order and take time in proportion to the lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.array_join(F.transform(stay, lambda place: F.get("lines", place)), "\n")
    dropped = F.when(F.col("places").isNull(), 0).otherwise(F.size("places"))
    return joined.select("row", "text", F.size("lines").alias("n_lines"), dropped.alias("n_dropped"), kept.alias("kept"))


def drop_shared_lines(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """``docs`` with the lines taken out that many documents share; all rows and columns stay.

    Lines lie between line feeds. Those whose key (white space cut off at both ends, A-Z in lower
    case) has at least ``least_length`` code points and is found in at least ``least_documents``
    documents go, except from the largest doc_id that holds the key; there, and in every row
    that repeats this doc_id, all of them stay. A null text counts as one empty line and stays null.
    Rows that repeat a doc_id count as one document. A null doc_id names no document:
    its lines do not count, and it loses the lines that go. A text that loses all lines becomes empty.
    """
    kept = _reassembled(docs, least_length, least_documents)
    columns = [F.coalesce("kept", F.col("row.text").cast("string")).alias(c) if c == "text" else f"row.{c}" for c in docs.columns]
    return kept.select(*columns)


def line_digests(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and the SHA-256 of the text that ``drop_shared_lines`` leaves, of every row."""
    kept = _reassembled(docs.select("doc_id", "text"), least_length, least_documents)
    return kept.select(
        "row.doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.col("n_dropped").cast("bigint").alias("n_dropped"),
        F.sha2(F.coalesce("kept", "text").cast("binary"), 256).alias("kept_sha256"),
    )
