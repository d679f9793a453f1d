import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, ids string, size string, key string, shard string"


def edge_rows():
    rnd = random.Random(3)
    words = ["alpha", "beta", "Gamma", "délta", "ε", "zz9", "it's", "x" * 40, "日本語", "don't", "...", "1234567"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    copy = make(60)
    texts = [None, "", " ", "\t\n", "one", "one  two", "one\ttwo", "One two", copy, copy, copy + " tail", copy.replace(" ", "  ", 3), "a" * 3000, make(6000), "\x1c\x1d x y z \x85 w᠎", "🙂🙂 é ́", *[make(rnd.randrange(1, 120)) for _ in range(40)]]
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "b", "a", "é", "B"][i % 5], len(t or ""), "d", "i", "s", "k", "h") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "null key", None, None, None, None, None, None, None, None), (77, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """A folder with an odd documents table: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    top = tmp_path_factory.mktemp("edge")
    spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    return str(top)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return str(top)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
