import random

import pytest
from pyspark.sql import functions as F

NAMES = "doc_id long, text string, lang string, source string, n_chars long, tag int, words string, id string, bucket int, fp int"
#: Names that operators use for results or on the way.
CLASHES = "quality_score double, score double, __words string, n_words int, found string, left string, k1 int, key string, row string, label int, bin int, term string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = prose(80)
    texts = [prose(rng.randint(1, 120)) + rng.choice(["", ".\n", "\n\n"]) for _ in range(30)]
    texts += [prose(10) + " " + shared + " " + prose(12), shared, shared + " tail", None, "", " \n ", "a", "a b", "x" * 5000, "ab " * 3000, prose(6000)]
    texts += [texts[0], texts[0].upper(), texts[3] + " extra", "Ünï Éa", "!!! ??? ###", "\x00\x01 z"]
    rows = [(i, t, "en", "s", len(t or ""), 1, "w", "q", 2, 3) for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "s", 9, 1, "w", "q", 2, 3), (7, "same id, other text", None, None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None, None), (None, shared, "en", None, None, 1, None, None, 2, 3)]
    return spark.createDataFrame(rows, NAMES)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="session")
def odd_table(odd_docs):
    """The odd documents with string ids, one text of a million characters and more clashing names."""
    clashing = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in CLASHES.split(", ")]
    text = F.when(F.col("doc_id") == 31, F.repeat(F.lit("a long text of some words 日本語。\n"), 40_000)).otherwise(F.col("text"))
    return odd_docs.select(F.concat(F.lit("d-"), "doc_id").alias("doc_id"), text.alias("text"), *odd_docs.columns[2:], *clashing)
