import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymill.llm.kdtree import KDTree, top_k


def brute(rows, is_query, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for p, (q, v) in enumerate(ok):
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for r, (i, w) in enumerate(ok) if r != p and len(w) == len(v))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shard_rows", [7, 50, 10_000])
def test_like_brute_force(spark, shard_rows):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 1, 6)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2050, [float("nan")] * 6), (2100, [float("inf")] * 6), (None, [1.0] * 6), (2150, [1.0, 2.0]), (2200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "shard": F.lit(2), "label": F.lit(3)})
    got = {(x.query_id, x.rank, x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, block_queries=3).collect()}
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (7, [3.0])], "vec_id long, embedding array<float>")
    assert {(x.query_id, x.rank, x.vec_id) for x in top_k(df, F.col("vec_id") % 50 == 0).collect()} == {(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)}
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert top_k(df.where("vec_id = 7"), F.col("vec_id") % 50 == 0).collect() == []
    with pytest.raises(Exception, match="2\\^53"):
        top_k(spark.createDataFrame([(0, [1e9]), (50, [1e9])], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()


def test_tree_opens_few_leaves():
    r = np.random.default_rng(2)
    rows = np.floor(r.normal(0, 40, (40, 3))[r.integers(0, 40, 4000)] * 10 + r.normal(0, 3, (4000, 3)))
    tree = KDTree(np.arange(4000), rows, 50)
    leaves = [m for m in tree.members if m is not None]
    assert sum(map(len, leaves)) == 4000 and max(map(len, leaves)) <= 50
    for node, kids in enumerate(tree.kids):
        for kid in kids or ():
            assert (tree.lo[kid] >= tree.lo[node]).all() and (tree.hi[kid] <= tree.hi[node]).all()
    query = rows[:1]
    (best,) = tree.search(query, np.array([-1]), 5, np.full(1, -np.inf))
    scores = rows @ query[0]
    expected = np.lexsort((np.arange(4000), -scores))[:5]
    assert [i for _, i in best] == expected.tolist()


def test_repeated_ids(spark):
    """Each query row is answered on its own; other rows of its id, equal ones too, are candidates."""
    r = np.random.default_rng(4)
    rows = [(i % 60, [float(np.float32(x)) for x in r.normal(0, 1, 3)]) for i in range(200)] + [(50, [1.0, 1.0, 1.0])] * 3 + [(0, [2.0, 0.0, 0.0])] * 2
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    expected = []
    for p, (q, v) in enumerate(ok):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for n, (i, w) in enumerate(ok) if n != p)
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for options in ({}, {"shard_rows": 20, "block_queries": 2}):
        got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 50 == 0, **options).collect())
        assert got == sorted(expected)


def test_only_the_query_itself_is_left_out():
    rows = np.array([[10.0, 0.0]] * 3 + [[float(i % 7), 1.0] for i in range(20)])
    tree = KDTree(np.r_[np.full(3, 5), np.arange(100, 120)], rows, 2)
    found = tree.search(np.array([[10.0, 0.0]]), np.array([5]), 5, np.array([-np.inf]))[0]
    assert found == [(100.0, 5), (100.0, 5), (60.0, 106), (60.0, 113), (50.0, 105)]
