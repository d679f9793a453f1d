import math

import numpy as np
import pytest

from tapeloom.llm import maxscore, queries


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])}
    return out


def vectors(spark, folder):
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]


@pytest.mark.parametrize("which", ["small", "empty"])
def test_op7(spark, request, which):
    folder = request.getfixturevalue(which)
    assert {tuple(r) for r in queries.op7_maxscore(spark, folder).collect()} == brute(vectors(spark, folder))


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)], "clash") for i in range(130)]
    rows += [(200, None, "x"), (201, [], "x"), (202, [1.0, None], "x"), (203, [float("nan")], "x"), (204, [float("inf")], "x"), (None, [1.0] * 6, "x"), (250, [0.5], "x"), (300, [30000.0, -30000.0], "x")]
    rows += [(400 + i, rows[0][1], "tie") for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    from pyspark.sql import functions as F

    got = {tuple(r) for r in maxscore.search(frame, F.col("vec_id") % 50 == 0).collect()}
    f32 = [(r[0], r[1] and [None if x is None else float(np.float32(x)) for x in r[1]]) for r in rows]
    assert {(q, int(r), j, s) for q, r, j, s in got} == brute(f32)


def test_one_vector_alone(spark):
    frame = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")
    from pyspark.sql import functions as F

    assert maxscore.search(frame, F.col("vec_id") % 50 == 0).collect() == []


def test_wide_values_stay_exact():
    big = np.array([[2**28, 1], [2**28, 3], [-(2**30), 7]], np.int64)
    assert maxscore.exact_type(big, big) is np.int64
    assert maxscore.top(np.array([0]), big[:1], np.arange(3), big, 2) == [(0, 1, int(big[0] @ big[1])), (0, 2, int(big[0] @ big[2]))]


def test_the_essential_part_follows_the_bounds():
    bounds = np.array([5.0, 1.0, 3.0, 1.0])
    order, n = maxscore.essential(bounds, -np.inf)
    assert n == 4 and order.tolist() == [0, 2, 1, 3]
    assert [maxscore.essential(bounds, t)[1] for t in (0, 1, 1.5, 2, 4.9, 5, 9.9, 10, 11)] == [4, 3, 3, 2, 2, 1, 1, 0, 0]


def test_a_rising_threshold_skips_postings(monkeypatch):
    """Against brute force, with blocks that can't compete, rows that leave early, and ties."""
    from collections import Counter

    monkeypatch.setattr(maxscore, "ROWS", 64)
    rng = np.random.default_rng(3)
    vectors = rng.integers(-9, 10, (1000, 16)) * np.array([40, 30, 20, 10, 8, 6, 4, 3, 2, 2, 1, 1, 1, 1, 1, 1])
    vectors[500:] //= 8  # whole blocks of small rows
    vectors[100:110] = vectors[90]
    ids, tally = rng.permutation(1000) * 3, Counter()
    got = maxscore.top(ids[:40], vectors[:40], ids, vectors, 5, tally)
    want = []
    for own, q in zip(ids[:40], vectors[:40], strict=True):
        scores = sorted((-int(q @ v), int(i)) for i, v in zip(ids, vectors, strict=True) if i != own)[:5]
        want += [(int(own), i, -s) for s, i in scores]
    assert got == want
    assert tally["essential"] + tally["probed"] + tally["skipped"] < tally["all"]


def test_repeated_ids_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 2.0], 1, 1, 1), (0, [2.0, 1.0], 2, 2, 2), (0, [2.0, 1.0], 2, 2, 2), (7, [1.0, 1.0], 3, 3, 3), (8, [1.0, 1.0], 3, 3, 3), (8, [1.0, 1.0], 3, 3, 3), (9, [1e30, 0.0], 0, 0, 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int, id int, v int")
    got = [tuple(r) for r in maxscore.search(frame.where("vec_id < 9"), F.col("vec_id") % 50 == 0, k=2).orderBy("query_id", "rank", "score").collect()]
    assert got == [(0, 1, 7, 3 * 256 * 256), (0, 2, 7, 3 * 256 * 256)]
    assert maxscore.search(frame, F.col("vec_id") % 50 == 0, k=1).count() == 1
