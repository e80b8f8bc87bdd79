import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("size", T.LongType())])


def corpus(seed=3, n=60):
    """Small documents with copies, near copies, shared passages, blanks, odd white space and one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(150)]
    passage = [r.choice(vocab) for _ in range(70)]
    out = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(1, 160))]
        if i % 5 == 0:
            at = r.randint(0, len(words))
            words[at:at] = passage
        out.append(" ".join(words))
    out += [out[0], out[5].replace(" ", "\n", 3), out[7].replace(" ", " \t ", 2), out[11] + " tail", out[12].upper(), "", " \n ", None, None, "x", "x", "日本   text", " "]
    w = out[13].split()
    out += [" ".join([*w[:5], "changed", *w[6:]]), " ".join([*passage, *passage, *passage]), "a" * 3000, "ab " * 2500]
    out.append(" ".join(r.choice(vocab) for _ in range(6000)))
    return out


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The corpus as documents, with extra columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 3 else "de", [None, "b", "a", "ä"][i % 4], len(t or ""), "r", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(docs, tmp_path_factory):
    """A data folder with the corpus as documents.parquet."""
    path = tmp_path_factory.mktemp("data")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)
