import random

import pytest

from canopyspark.operators.nearest import nearest


@pytest.mark.parametrize("spread", [300, 20000])
def test_nearest_by_brute_force(spark, spread):
    draw = random.Random(spread)
    points = [(i, draw.randrange(spread) * 10, draw.randrange(spread) * 10) for i in range(300)]
    points += [(300 + i, 40, 40) for i in range(9)] + [(400, None, 3), (401, 10**7, 10**7)]
    wanted = []
    for i, x, y in points:
        if x is not None:
            near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in points if u is not None and j != i)
            wanted += [(i, j, d2, n + 1) for n, (d2, j) in enumerate([p for p in near if p[0] <= 5000**2][:3])]
    found = nearest(spark.createDataFrame(points, "id long, x long, y long"), 3, 5000)
    assert sorted((r.id, r.other, r.d2, r.place) for r in found.collect()) == sorted(wanted)
