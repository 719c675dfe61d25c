"""Exact dedup: 128-bit content hash, byte comparison inside each hash, one row stays.

Built from DataFrame functions only. The aggregation key is (hash, text): the hash
deals the rows out, the text in the key compares all bytes, and copies collapse in
the map tasks, so that a text copied into a third of all rows crosses the network
once per task. Only hashes and ids are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import size_checked
from .common import stored, text_or_empty

Digest = Callable[[Column], Column]


def md5_bytes(text: Column) -> Column:
    """The 128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = md5_bytes) -> DataFrame:
    """Every row of ``docs`` with the group of rows whose text has the same bytes.

    Returns ``id_col``, keep_id (the largest id of the group), group_size (rows),
    kept (this row's id is keep_id) and text_sha256. A null text counts as empty. A null
    id is smaller than any other; a group of null ids keeps null and kept is true. Rows
    that repeat an id and its text are the same document: each is returned, and each
    is kept if its id is. Other columns of ``docs`` are not read; an empty table
    gives no rows. ``digest`` decides only how rows are dealt out, never the result:
    different texts with one hash are told apart by their bytes.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    hashed = rows.select("id", digest(F.col("text")).alias("hash"), "text")
    classes = stored(_classes(hashed).drop("text"), "exact-classes")
    collided = stored(classes.groupBy("hash").count().where("count > 1").select("hash"), "exact-collided")
    if collided.isEmpty():
        joined = hashed.drop("text").join(classes, "hash")
    else:  # the few texts that share a hash are matched by their bytes
        few = size_checked(collided)
        apart = classes.join(few, "hash", "left_anti")
        joined = hashed.drop("text").join(apart, "hash").unionByName(_by_bytes(hashed.join(few, "hash", "left_semi")))
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _classes(hashed: DataFrame) -> DataFrame:
    """One row per different text, whatever the hash says."""
    groups = hashed.groupBy("hash", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _by_bytes(hashed: DataFrame) -> DataFrame:
    return hashed.join(_classes(hashed), ["hash", "text"]).drop("text")


def _sha(docs_text: Column) -> Column:
    return F.unhex(F.sha2(docs_text.cast("binary"), 256))


def _without(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` without the rows of the (doc_id, sha) in ``groups``."""
    dropped = size_checked(groups.select(F.col("doc_id").alias("dropped_id"), F.col("sha").alias("dropped_sha")).distinct())
    same = docs["doc_id"].eqNullSafe(dropped["dropped_id"])
    return docs.join(dropped, same & (_sha(text_or_empty()) == dropped["dropped_sha"]), "left_anti")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with only the kept document of each group of equal texts; all columns stay."""
    return _without(docs, exact_groups(docs).where(~F.col("kept")).select("doc_id", F.unhex("text_sha256").alias("sha")))


def one_per_text(docs: DataFrame) -> DataFrame:
    """Like ``drop_copies``, but one row a text: of rows that repeat the kept id, or have none, the first by all columns."""
    groups = exact_groups(docs).select("doc_id", "kept", F.unhex("text_sha256").alias("sha"))
    groups = stored(groups, "exact-groups")
    kept = _without(docs, groups.where(~F.col("kept")))
    repeated = groups.where("kept").groupBy("sha").count().where("count > 1").select(F.col("sha").alias("repeated_sha"))
    repeated = size_checked(repeated)
    if repeated.isEmpty():
        return kept
    same = _sha(text_or_empty()) == repeated["repeated_sha"]
    row = F.struct(*docs.columns)
    several = kept.join(repeated, same, "left_semi").select(_sha(text_or_empty()).alias("sha"), row.alias("row"))
    firsts = several.groupBy("sha").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return kept.join(repeated, same, "left_anti").unionByName(firsts)
