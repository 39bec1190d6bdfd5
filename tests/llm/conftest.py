import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, k0 string, row long"


def words(seed: int, n: int) -> str:
    import numpy as np

    rng = np.random.default_rng(seed)
    parts = ["ban", "tor", "mel", "sin", "dak", "ovo", "ule", "gri", "pex", "hum"]
    return " ".join("".join(rng.choice(parts, 2 + i % 2)) for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty, blank and long texts, repeated rows, clashing extra columns."""
    base, other = words(1, 120), words(2, 90)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, other), (5, None), (6, ""), (7, " \n\t "), (None, base), (None, None),
        (8, "one two"), (9, "One, TWO!"), (10, words(3, 4000)), (11, "!!! ### 123 %%%"), (12, "Été naïve Ünder " + other),
        (13, "x" * 3000), (14, "ab" * 900), (15, "İstanbul ΣΣ   \x1c end <|endoftext|> tail"), (16, base.upper()), (17, "\0zero\0"),
    ]
    made = [(i, t, None if i in (4, None) else "en" if i and i % 3 else "fr", "s1" if i and i % 2 else None, None, "clash", 7) for i, t in rows]
    return spark.createDataFrame(made, DOC)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where(F.lit(False))
