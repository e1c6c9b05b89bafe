import math
import random

from canopyspark.llm.mtree import top_inner_products


def brute(rows, top=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 7 == 0:
            ranked = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked[:top])]
    return sorted(out)


def run(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int" if rows and len(rows[0]) == 3 else "vec_id long, embedding array<float>")
    return sorted(map(tuple, top_inner_products(frame, "vec_id", "embedding", lambda i: i % 7 == 0).collect()))


def test_against_brute_force(spark):
    draw = random.Random(5)
    f = lambda: math.floor(draw.gauss(0, 1) * 64) / 64  # noqa: E731  exact as float
    centres = [[f() for _ in range(16)] for _ in range(6)]
    rows = [(i, [c + f() / 8 for c in centres[i % 6]]) for i in range(1500)]
    rows += [(i, centres[0]) for i in range(1500, 2100)]  # many equal vectors, ties by id
    rows = [(i, [math.floor(x * 512) / 512 for x in v]) for i, v in rows]
    draw.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (7, [0.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, []), (8, [-3.0, 0.5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert [r[:2] for r in run(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0])])] == [(0, 1), (0, 2)]


def test_large_values_and_clashing_names(spark):
    rows = [(i, [6e5 * (i % 5), -1.5e5 * (i % 3)]) for i in range(30)]
    assert run(spark, rows) == brute(rows)
    frame = spark.createDataFrame([(*r, 9, 8, 7) for r in rows], "vec_id long, embedding array<float>, score int, rank int, id int")
    assert sorted(map(tuple, top_inner_products(frame, "vec_id", "embedding", lambda i: i % 7 == 0).collect())) == brute(rows)
    huge = run(spark, [(0, [3e38]), (1, [3e38]), (2, [-3e38]), (3, [1.0])])
    assert [(r[2], r[3]) for r in huge] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_blocks_and_trees_meet_without_a_broadcast(spark):
    frame = spark.range(40).selectExpr("id AS vec_id", "array(CAST(id AS FLOAT), 1F) AS embedding")
    text = top_inner_products(frame, "vec_id", "embedding", lambda i: i % 7 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in text and "Broadcast" not in text
