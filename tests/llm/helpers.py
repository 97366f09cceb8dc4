"""Small document tables with the awkward cases every operator must take."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
LABELS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]
)
ENGLISH = "The quick brown fox jumps over the lazy dog and then the dog sleeps in the sun. "
GERMAN = "Der schnelle braune Fuchs springt über den faulen Hund und dann schläft der Hund. "


def documents(spark, rows):
    """Rows of (doc_id, text[, lang])."""
    full = [
        (r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1]))
        for r in rows
    ]
    return spark.createDataFrame(full, DOCUMENTS)


def awkward(spark):
    """Null and empty texts, null ids and languages, a very long text, repeated rows."""
    rows = [(i, ENGLISH * (1 + i % 3) + f"Number {i}.", "en") for i in range(20)]
    rows += [(20 + i, GERMAN * (1 + i % 3) + f"Nummer {i}.", "de") for i in range(20)]
    rows += [
        (100, None, "en"),
        (101, "", "en"),
        (102, " \n\t ", None),
        (103, "12345 !!! ...", "de"),
        (104, ENGLISH * 4_000, "en"),
        (None, ENGLISH, None),
        (105, ENGLISH, "en"),
        (105, ENGLISH, "en"),
        (106, "x", None),
    ]
    return documents(spark, rows)


def labels(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def with_clashes(df, *names):
    """The same rows with further columns, named like results or internals."""
    for name in names:
        df = df.selectExpr("*", f"cast(null as string) as `{name}`")
    return df
