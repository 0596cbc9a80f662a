import pytest
from pyspark.sql import functions as F

WORDS = "the of and river stone light paper green market window travel seven garden yellow simple carry winter bridge".split()


def prose(n, seed=0):
    """n words that follow from the seed."""
    out, state = [], seed * 7919 + 17
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + str((state >> 4) % 7))
    return " ".join(out)


ODD_TEXTS = [None, "", "   \n\t ", "one", "two words", prose(60, 1), prose(60, 1), prose(60, 2), prose(60, 2) + " end", prose(30_000, 3), "é" * 200, "日本 語 テキスト　x"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names operators may use inside."""
    rows = [(i if i % 5 else None, t, ("en", "de", None)[i % 3], ("src0", None)[i % 2], len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[6], rows[6]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("node", "digest", "key", "words", "gram", "shard", "kept", "n_words", "ids", "decoded", "row", "c0", "a.b")
    return docs.select("*", *[F.lit(1).alias(c) for c in clashing])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
