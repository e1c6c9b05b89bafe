"""What must hold at any size: nothing that grows is broadcast, few rows that become many are spread first."""

import pytest

from canopyspark.operators import rules
from canopyspark.plans import layers, queries, reports
from canopyspark.sources import synthetic


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("suppliers")
    spark.range(60).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    spark.range(90).selectExpr("id AS c_custkey").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_growing_table_is_broadcast(spark, suppliers):
    for df in (synthetic.scenes(spark, suppliers), queries.evaluate4(spark, suppliers), layers.points_sample(spark, suppliers), layers.points_near11(spark, suppliers), layers.calibrate_intensity(spark, suppliers)):
        text = plan(df)
        assert "BroadcastHashJoin [r" not in text and "BroadcastHashJoin [k" not in text and "BroadcastHashJoin [pid" not in text


def test_labels_are_spread_before_they_are_exploded(spark, suppliers):
    n = synthetic.height(spark, suppliers) // 256
    assert synthetic._tasks(n) == n and synthetic._tasks(12858) == 1607
    assert "hashpartitioning(r0#" in plan(synthetic.labels(spark, suppliers)) and "REPARTITION_BY_NUM" in plan(synthetic.labels(spark, suppliers))


def test_patches_are_not_broadcast(spark, suppliers):
    cells = spark.range(400).selectExpr("id DIV 20 AS r", "id % 20 AS c")
    for df in (rules.patches(cells), queries.patch_stats(spark, suppliers)):
        assert "BroadcastHashJoin" not in plan(df) and "BroadcastExchange" not in plan(df)


def test_pixels_are_made_from_rows_without_a_group(spark, suppliers):
    made = rules.of_stack(synthetic.stack(spark, suppliers))
    grouped = rules.pixels(synthetic.scenes(spark, suppliers))
    assert made.count() == 768 * 256 and made.exceptAll(grouped).isEmpty() and grouped.exceptAll(made).isEmpty()
    for df in (queries.confidence_map(spark, suppliers), queries.rule_change_idx(spark, suppliers)):
        text = plan(df)
        assert "HashAggregate(keys=[r#" not in text.replace("ObjectHashAggregate", "") and "BroadcastHashJoin" not in text


def test_label_cells_are_grouped_where_they_are_made(spark, suppliers):
    text = plan(synthetic.labels(spark, suppliers))
    cells = text[: text.index("explode(sequence((c0#")]
    assert "HashAggregate(keys=[r#" in cells and "Exchange" not in cells  # no cell is shuffled


def test_layers_are_added_up_before_they_meet_their_names(spark, suppliers):
    found = reports.helper_layers(spark, suppliers)
    text = plan(found)
    assert "HashAggregate(keys=[name" in text[text.index("Join") :]  # two names hold all pixels
    rows = {r.name: (r.present, r.total, r.forest_px, r.any_positive) for r in found.collect()}
    assert rows["buffer"] == rows["dist_road"] == (False, 0.0, 0, False)
    assert rows["worldcover"] == (True, 768 * (200 * 10.0 + 56 * 60.0), 768 * 200, True) and rows["slope"][0] and rows["slope"][2:] == (0, True)


def test_features_are_made_without_a_shuffle_of_pixels(spark, suppliers):
    px = layers.classes(spark, suppliers, layers.texture_by_row(spark, suppliers))
    text = plan(px)
    made = text.index("BroadcastNestedLoopJoin")  # rows become pixels; nothing above it deals them out
    assert "Exchange hash" not in text[:made] and "SortMergeJoin [r#" not in text[:made].replace(" ", "") and "c#" not in "".join(x for x in text.splitlines() if "SortMergeJoin [r" in x)
    assert px.count() == 768 * 256


def test_bands_of_rows_by_brute_force(spark):
    import numpy as np

    from canopyspark.operators import kernels

    draw = np.random.default_rng(3)
    height, width = 150, 40  # two bands and a part of one
    for seeds in ({(int(r), int(c)) for r, c in zip(draw.integers(0, height, 9), draw.integers(0, 20, 9), strict=True)}, {(149, 39)}, {(70, 0), (70, 39), (3, 5)}):
        marked = spark.createDataFrame([(r, c, 2000 + r) for r, c in seeds], "r long, c long, year long")
        found = kernels.distance_rows(marked, height, width, "year").collect()
        assert sorted(row.r for row in found) == list(range(height))
        for row in found:
            assert row.d2 == [min((row.r - r) ** 2 + (c - k) ** 2 for r, k in seeds) for c in range(width)]
            assert row.year == [2000 + row.r if (row.r, c) in seeds else None for c in range(width)]
    empty = spark.createDataFrame([], "r long, c long, year long")
    assert all(set(row.d2) == {None} for row in kernels.distance_rows(empty, height, width, "year").collect())
    v = draw.normal(0, 50, (height, width)).round()
    cells = [(b, r, c, float(v[r, c]) if (r + c) % 7 else None) for b in range(3) for r in range(max(0, b * 64 - 2), min(height, b * 64 + 66)) for c in range(width)]
    filled = np.pad(np.where(np.add.outer(np.arange(height), np.arange(width)) % 7 == 0, 3.0, v), 2, "symmetric")
    rows = kernels.texture_rows(spark.createDataFrame(cells, "band long, r long, c long, v double"), 2, height, width, 3.0).collect()
    assert sorted(row.r for row in rows) == list(range(height))
    for row in rows:
        wanted = [filled[row.r : row.r + 5, c : c + 5].std() for c in range(width)]
        assert np.allclose(np.array(row.texture) / 100, wanted, atol=0.00501)
    assert kernels._hundredths(np.array([0.125, 0.375, 1.005, 2.675, 7.0, 0.0])).tolist() == [13, 38, 101, 268, 700, 0]
