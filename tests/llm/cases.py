"""Small inputs with everything that real tables hold: NULLs, empty and long texts, ties, repeated rows, clashing names."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Names that operators use for columns of their own.
CLASHES = ("key", "text_hash", "fp", "node", "part", "place", "rank", "size", "shard", "score", "word", "n", "component", "mix_kept")

LONG = "lorem ipsum dolor sit amet " * 20_000

ROWS = [
    (1, "the cat sat on the mat and looked at the moon", "en", "a", 45),
    (2, "the cat sat on the mat and looked at the moon", "en", "b", 45),
    (2, "the cat sat on the mat and looked at the moon", "en", "b", 45),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (None, "no key here at all", "de", "a", 18),
    (None, None, None, "b", None),
    (5, LONG, "fr", "a", len(LONG)),
    (6, " \t\n ", "fr", "c", 4),
    (7, "Ünïcödé ça và 漢字 😀 done", "es", "a", 22),
]


def docs(spark, rows=ROWS, clashes=CLASHES):
    """Rows as a documents table with further columns of clashing names."""
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in clashes])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    kinds = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "quality", "toxic")])
    return spark.createDataFrame(rows, kinds)


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))
