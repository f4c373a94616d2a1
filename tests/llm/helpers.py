"""Small documents with every awkward case."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = "the of and to in that for with was this from are not have they which one you were all".split()


def prose(n, seed=0):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4))) if r.random() < 0.7 else r.choice(WORDS) for _ in range(n))


TEXTS = [
    prose(60, 1), prose(60, 1), prose(300, 2) + ", x.", None, "", " \n\t ", "word", "It's <|endoftext|> DON'T stop… “ok,” é. Ünï, a.b,c. 漢字, x≠y \x1c z\x0b!",
    "<|EndOfText|> A. B, C.\n", "same line\nsame line\n\nother # $ %\nsame line\n", prose(20000, 3), "a b c d e f " * 40, "İstanbul ΣΑΣ ǅ, ﬁ. K.",
    "Licensed under CC BY-NC 4.0. All rights reserved.\n" + prose(30, 4), "Das ist ein, „schöner“ Satz. " * 3,
]


def docs(spark, texts=None, ids=None):
    texts = TEXTS if texts is None else texts
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(df):
    """The same rows with null and repeated ids, a repeated row and extra columns with common names."""
    from pyspark.sql import functions as F

    more = df.union(df.limit(2)).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    return more.selectExpr("*", "1 AS n_words", "'x' AS row", "2 AS k1", "3 AS freq", "4 AS bits", "5 AS n", "6 AS h", "'y' AS item_id", "7 AS pos", "8 AS conv_id", "9 AS start")
