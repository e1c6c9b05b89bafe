import random
from pathlib import Path

import pytest

from canopyspark.operators import forest
from canopyspark.plans import model

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "r long, c long, a double, b double, noise double, mining int"


@pytest.fixture(scope="module")
def px(spark):
    """Mining where a is low, and, in half the places, where b is high; a alone knows half."""
    draw = random.Random(1)
    rows = []
    for r in range(120):
        for c in range(60):
            kind = draw.randrange(4)
            a = draw.gauss(-15 if kind == 0 else -7, 1)
            b = draw.gauss(9 if kind == 1 else 2, 1)
            mining = None if draw.random() < 0.1 else int(kind < 2)
            rows.append((r, c, a, b, draw.random(), mining))
    return forest.with_block(spark.createDataFrame(rows, SCHEMA), 60, 20).cache()


def test_blocks_held_out(spark, px):
    assert {(r.r, r.c): r.block for r in px.collect()}[119, 59] == 17
    held = [r.block for r in forest.held_out_blocks(px).collect()]
    assert len(held) == 4 and len(set(held)) == 4
    assert sorted(held) == sorted(r.block for r in forest.held_out_blocks(px.repartition(7)).collect())
    assert forest.held_out_blocks(px.where("block < 2")).count() == 1
    labelled = px.where("block < 2 OR mining IS NULL")
    assert {r.block for r in forest.held_out_blocks(labelled).collect()} < {0, 1}
    with pytest.raises(ValueError, match="two blocks"):
        forest.held_out_blocks(px.where("block = 3"))


def test_balanced_sample(px):
    n = px.where("mining = 1").count()
    for cap, want in ((50_000, min(n, px.where("mining = 0").count())), (100, 100)):
        found = forest.balanced(px, cap).groupBy("mining").count().collect()
        assert {r["mining"]: r["count"] for r in found} == {0: want, 1: want}
    with pytest.raises(ValueError, match="no mining"):
        forest.balanced(px.where("mining = 0"))
    with pytest.raises(ValueError, match="a class"):
        forest.balanced(px.where("mining = 1"))


def test_planted_truth_and_the_better_variant(spark, px):
    variants = {"plain": ["a", "noise"], "with b": ["a", "noise", "b"], "again": ["b", "noise", "a"]}
    best, forests, table, held = forest.selected(px, variants, trees=20)
    rows = {r.model: r for r in table.collect()}
    assert best in ("with b", "again") and [r.model for r in rows.values() if r.chosen] == [best]
    assert rows["with b"].f1 > 0.97 and rows["plain"].f1 < 0.85
    held = {r.block for r in held.collect()}
    test = px.where(px.block.isin(held) & px.mining.isNotNull())
    own = rows["with b"]
    assert own.hits + own.misses == test.where("mining = 1").count()
    found = {(r.r, r.c): (r.mining, r.p) for r in forests["with b"].probability(test).collect()}
    assert own.hits == sum(m == 1 and p >= 0.5 for m, p in found.values()) and own.false_alarms == sum(m == 0 and p >= 0.5 for m, p in found.values())


def test_training_never_sees_the_blocks_held_out(spark, px):
    held = forest.held_out_blocks(px)
    wrong = px.join(held.withColumn("own", px.block * 0 == 0), "block", "left").withColumn("mining", forest.F.when(forest.F.col("own"), 1 - forest.F.col("mining")).otherwise(forest.F.col("mining"))).drop("own")
    trees = [forest.fitted(x, ["a", "b"], held, trees=5).model.toDebugString.split("\n", 1)[1] for x in (px, wrong.select(px.columns))]
    assert trees[0] == trees[1]


def test_rows_without_a_feature_have_no_probability(spark, px):
    made = forest.fitted(px, ["a", "b"], forest.held_out_blocks(px), trees=3)
    rows = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 2.0), (3, -15.0, 2.0)], "k int, a double, b double")
    assert {r.k: r.p is not None for r in made.probability(rows).collect()} == {1: False, 2: False, 3: True}


def test_score_of_nothing(spark, px):
    row = forest.score(px.limit(0), px.mining == 1, px.mining == 1).first()
    assert tuple(row) == (0, 0, 0, None, None, 0.0)


@pytest.mark.skipif(not DATA.exists(), reason="needs the generated tables")
def test_the_detector_on_the_small_raster(spark):
    rows = {r.model: r for r in model.model_selection(spark, str(DATA), 40).collect()}
    assert set(rows) == set(model.VARIANTS) and sum(r.chosen for r in rows.values()) == 1
    assert max(r.f1 for r in rows.values()) > 0.6
    conf = model.confidence_model(spark, str(DATA), 40)
    assert {r.conf for r in conf.select("conf").distinct().collect()} <= {1, 2} and conf.count() > 1000


def test_probabilities_are_those_of_the_model(spark, px):
    from pyspark.ml.functions import vector_to_array

    made = forest.fitted(px, ["a", "noise", "b"], forest.held_out_blocks(px), trees=30)
    rows = forest._assembled(px, made.features, "keep")
    own = {(r.r, r.c): r.p for r in made.model.transform(rows).select("r", "c", vector_to_array("probability")[1].alias("p")).collect()}
    scored = made.probability(px)
    assert {(r.r, r.c): r.p for r in scored.collect()} == own and len(set(own.values())) > 100
    text = scored.where("p > 0.5").select("r", "p")._jdf.queryExecution().executedPlan().toString()
    assert "transform" not in text and text.count("ArrowEvalPython") == 1  # a batch at once, and once


def test_a_sample_sorts_few_rows(spark, monkeypatch):
    sizes, own = {}, forest.written

    def noted(df, prefix):
        found = own(df, prefix)
        sizes[prefix] = found.count()
        return found

    monkeypatch.setattr(forest, "written", noted)
    rows = spark.range(40_000).selectExpr("id DIV 100 AS r", "id % 100 AS c", "CAST(id % 4 = 0 AS INT) AS mining")
    order = forest.F.xxhash64("r", "c", forest.F.lit(forest.SEED))
    for cap in (500, 50_000):
        size = min(cap, 10_000)
        wanted = {(r.r, r.c) for m in (0, 1) for r in rows.where(rows.mining == m).orderBy(order, "r", "c").limit(size).collect()}
        assert {(r.r, r.c) for r in forest.balanced(rows, cap).collect()} == wanted
        assert 2 * size <= sizes["sample-candidates"] < 2.5 * size + 400
    monkeypatch.setattr(forest, "_bound", lambda size, there: -(2**63))  # too few below it: all rows are sorted
    assert forest.balanced(rows, 500).count() == 1000
