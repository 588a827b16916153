import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwatch.llm import exact, vectors

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k):
    out = set()
    for q, v in queries:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("blocks", [(7, 3), (64, 64)])
def test_top_k_equals_brute_force_with_ties_and_copies(spark, blocks):
    r = np.random.default_rng(1)
    data = [(i, r.integers(-40, 40, 20).tolist()) for i in range(90)] + [(i, [3] * 20) for i in range(90, 140)]
    df = spark.createDataFrame(data, "vec_id long, vector array<long>")
    got = vectors.top_k(df, df.where("vec_id % 10 = 0"), 5, *blocks)
    assert {tuple(x) for x in got.collect()} == brute(data, [x for x in data if x[0] % 10 == 0], 5)


def test_vectors_with_nulls_and_other_lengths(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.001]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, None), (None, [1.0, 1.0]), (6, [1.0]), (7, [0.25, 2.0])]
    df = vectors.integer_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), "vec_id", "embedding")
    assert {(r.vec_id, tuple(r.vector)) for r in df.collect()} == {(1, (512, -2)), (6, (1024,)), (7, (256, 2048))}
    got = vectors.top_k(df, df.where("vec_id = 1"), 3).collect()
    assert [tuple(r) for r in got] == [(1, 1, 7, 512 * 256 - 2 * 2048)]
    assert vectors.top_k(df.limit(0), df.limit(0), 3).count() == 0


def test_large_integers_stay_exact():
    ids, big = np.array([1, 2, 3]), np.array([[2**28, 1], [2**28, 2], [5, 5]], np.int64)
    (_, found, score), = vectors.search_block(ids, big, np.array([9]), np.array([[2**28, 1]]), 2)
    assert found.tolist() == [2, 1] and score.tolist() == [2**56 + 2, 2**56 + 1]


def test_exact_copies(spark):
    rows = [(5, "a  b", "x"), (3, "a\tb", "y"), (9, None, "z"), (4, "", "z"), (None, "a b", "w"), (7, "A b", "q"), (7, "A b", "q"), (8, " ", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in exact.exact_copies(df).collect())
    want = [((True, 0), 3, 3, False), ((False, 5), 3, 3, False), ((False, 3), 3, 3, True), ((False, 9), 4, 2, False), ((False, 4), 4, 2, True), ((False, 7), 7, 2, True), ((False, 7), 7, 2, True), ((False, 8), 8, 1, True)]
    assert got == sorted(want)
    assert exact.exact_copies(df.limit(0)).count() == 0


def test_exact_copies_of_one_hot_text(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = exact.exact_copies(df.repartition(4))
    assert got.where("kept").count() == 201 and got.where("group_size = 100").count() == 100
