"""Raw request logs from CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LOG_COLUMNS

# Field texts that mean "missing".
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


class MissingColumnsError(ValueError):
    """A CSV file lacks required columns."""


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = False, file_name: str | None = None) -> DataFrame:
    """The seven log columns as text, with missing-value tokens as null.

    The header is read for the column names only; the files are then read with that
    all-text schema, and every file's own header has to agree with it. Files split
    over many tasks unless ``multi_line`` is set, which is needed only if quoted
    fields contain line breaks. ``file_name``: a column of this name says which file a row is from.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    header = spark.read.options(**options).csv(path).columns
    missing = [c for c in LOG_COLUMNS if c not in header]
    if missing:
        raise MissingColumnsError(f"CSV is missing required columns: {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.options(**options, enforceSchema=False).schema(schema).csv(path)
    file = [F.col("_metadata.file_name").alias(file_name)] if file_name else []
    return rows.select(*[F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)).alias(c) for c in LOG_COLUMNS], *file)


def line_hashes() -> dict[str, Column]:
    """Two hashes of a raw line, by column name; null fields and empty ones count as different."""
    fields = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in LOG_COLUMNS]
    return {f"line_hash_{seed}": F.xxhash64(F.lit(seed), F.concat(*fields)) for seed in range(2)}


def digest_of_hashes() -> Column:
    """Aggregate: a digest of lines whatever their order, from their number and the sums of their hashes."""
    sums = [F.coalesce(F.sum(F.col(name).cast("decimal(38,0)")), F.lit(0)).cast("string") for name in line_hashes()]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256)


def content_digests(rows: DataFrame, *by: str) -> DataFrame:
    """A digest of the raw rows of each group; repeated rows count as often as they occur."""
    return rows.withColumns(line_hashes()).groupBy(*by).agg(digest_of_hashes().alias("digest"))


def write_raw_csv(raw: DataFrame, path: str, mode: str = "error") -> None:
    """Write raw rows as they are: the writer's default of trimming fields is off."""
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw.select(*LOG_COLUMNS).write.mode(mode).options(header=True, escape='"', **keep_spaces).csv(path)
