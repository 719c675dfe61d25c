"""Small tables with the awkward cases that every operator has to take."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))


def make(spark, rows):
    """Documents from (doc_id, text, source) or (doc_id, text, source, lang)."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2], len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    """Nulls, empty and white texts, a very long one, copies, repeated rows and ids."""
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, "  \n\t ", "a"),
        (4, LONG, "b"),
        (5, "one two three four five", "b"),
        (6, "one two three four five", None),
        (6, "one two three four five", None),
        (7, "ONE two three four five", None),
        (8, "É ⅷ 漢字 😀 ² _x 'S don't   end", "c"),
        (None, "no id here", "c"),
        (None, "one two three four five", "c"),
        (9, "1234 5678 --- !!!", "c"),
    ]
    return make(spark, rows)


def clashing(docs):
    """The same rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = "hash id n node component size keep_id kept score token cell block row start words text_sha256 slot".split()
    return docs.withColumns({name: F.lit("x") for name in names})


def words(text):
    """Words between ASCII white space."""
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
