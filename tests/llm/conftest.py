import pytest
from pyspark.sql import functions as F

#: Texts every operator must take: nothing, white space, ties, long words, odd characters.
ODD = [None, "", " ", "\n\n", "a", "a", "A b  c\n\nd ", "\x1cfoo\x1d bar", "É́ ́a Σας ΟΔΟΣ", "<|endoftext|> x", "w" * 70_000,
       "one two three " * 4000, "\x85a\xa0b × ÷ ǅ ɏ\n\n  c ", "ﬀ ½ ٣ 漢字 🙂 x\u0000y", "it's we'LL\tno\r\nyes no", "password = hunter2hunter2 AKIA" + "B" * 16]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with a null id, equal ids, repeated rows, and extra columns whose names clash with the operators' own."""
    rows = [(None if k == 3 else k // 2, text, ("en", "de", None)[k % 3], ("s", None)[k % 2], k, "x", "y")
            for k, text in enumerate(ODD + [ODD[6]] * 3)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_words int, row string, h string")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where(F.lit(False))


@pytest.fixture(scope="session")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
