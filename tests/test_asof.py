import random

import pytest

from tickerloom.operators.asof import as_of_join


@pytest.mark.parametrize("strict", [False, True])
def test_equals_a_plain_search(spark, strict):
    rng = random.Random(6)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    left = [(key(), rng.choice([None, *range(60)]), i) for i in range(400)]
    right = [(key(), rng.choice([None, *range(0, 60, 3)]), float(rng.randrange(9))) for _ in range(150)]
    left += [left[0], left[0], (9, 5, 1000)]
    l = spark.createDataFrame(left, "k int, at int, n int").selectExpr("*", "'x' AS _stretch")
    r = spark.createDataFrame(right, "k int, t int, v double").selectExpr("*", "1 AS n")
    got = sorted((tuple(x) for x in as_of_join(l, r, ["k"], "at", "t", ["v"], strict, stretches=7).collect()), key=repr)
    want = []
    for k, at, n in left:
        hits = [(t, v) for rk, t, v in right if rk == k and t is not None and at is not None and (t < at or t == at and not strict)]
        want.append((k, at, n, "x", *(max(hits) if hits else (None, None))))
    assert got == sorted(want, key=repr)


def test_a_key_lies_in_many_stretches_and_empty_sides(spark):
    left = spark.range(2000).selectExpr("1 AS k", "id AS at")
    right = spark.range(5).selectExpr("1 AS k", "id * 400 + 1 AS t", "id AS v")
    rows = as_of_join(left, right, ["k"], "at", "t", ["v"], stretches=8).orderBy("at").collect()
    assert [r.v for r in rows] == [None if i == 0 else (i - 1) // 400 for i in range(2000)]
    assert [r.v for r in as_of_join(left.limit(2), right.limit(0), ["k"], "at", "t", ["v"]).collect()] == [None, None]
    assert as_of_join(left.limit(0), right, ["k"], "at", "t", ["v"]).count() == 0
    with pytest.raises(ValueError):
        as_of_join(left, right, ["k"], "at", "t", ["k"])
