import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone light under carries slowly window garden letter morning silver quiet paper".split()


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "."]) for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, nulls, empty, odd characters and a long text."""
    passage = prose(99, 60)
    rows = [prose(i, 40 + i) for i in range(12)]
    rows += [rows[0], rows[0].replace(" ", "\n\t "), rows[1] + " end", prose(50, 20) + " " + passage, passage + " " + prose(51, 20)]
    rows += [None, "", "   ", "é日本 😀 ñandú", "a" * 700, "12345 !!", prose(77, 9000), "x<|endoftext|>y", "one two"]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """All columns with nulls, and names that the operators use themselves."""
    rows = [(i, t, ["en", None, "xx"][i % 3], None if i % 4 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[2], "en", "s", 1), (None, None, None, None, None), rows[3], rows[3]]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    extra = {c: "x" for c in ("t", "key", "digest", "fp", "keep_id", "score", "lang_pred", "block", "spans", "id", "c0", "k0")}
    from pyspark.sql import functions as F

    return frame.select("*", *[F.lit(v).alias(k) for k, v in extra.items()]).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
