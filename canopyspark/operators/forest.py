"""Random forests under a spatial hold-out: blocks of pixels kept for testing, variants of features, the best by F1."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopyspark.operators.scratch import shared_dir, written

#: Fixed values of the published method: block of 2 km in pixels, share of blocks held out, pixels of a class, trees, pixels of a leaf, probability that fires.
BLOCK, TEST_SHARE, MAX_SAMPLES, TREES, LEAF, FIRES = 200, 0.25, 50_000, 200, 5, 0.5
DEPTH = 5
SEED = 0
#: Parts of a training sample, rows that are scored at once.
PARTS, ROWS = 16, 256


def with_block(px: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    across = -(-width // block)
    return px.withColumn("block", F.floor(F.col("r") / block) * across + F.floor(F.col("c") / block))


def held_out_blocks(px: DataFrame, share: float = TEST_SHARE) -> DataFrame:
    """block of the blocks held out: a share of those with a labelled pixel (mining not NULL), one at least and never all, by a fixed hash.

    An error if fewer than two blocks have one. The table has a row for each block.
    """
    blocks = px.where(F.col("mining").isNotNull()).select("block").distinct()
    n = blocks.count()
    if n < 2:
        raise ValueError("need labelled pixels in at least two blocks to split train and test")
    size = min(n - 1, max(1, round(share * n)))
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.xxhash64("block", F.lit(SEED)), "block"))).where(F.col("place") <= size).select("block")


def balanced(px: DataFrame, cap: int = MAX_SAMPLES) -> DataFrame:
    """As many rows of either class, cap at most, by a fixed hash of the place; an error if a class is empty."""
    n = px.agg(F.count_if(F.col("mining") == 1).alias("p"), F.count_if(F.col("mining") == 0).alias("n")).first()
    size = min(n["p"], n["n"], cap)
    if not size:
        raise ValueError("no mining pixels" if not n["p"] else "a class has no training pixels after the block split")
    order = F.xxhash64("r", "c", F.lit(SEED))
    near = F.lit(False)
    for m, there in ((1, n["p"]), (0, n["n"])):
        near = near | (F.col("mining") == m) & (order <= _bound(size, there))
    # the first of a class lie below its bound, if it holds enough of them; else all rows are sorted
    first = written(px.where(near), "sample-candidates")
    held = {r["mining"]: r["count"] for r in first.groupBy("mining").count().collect()}
    source = first if all(held.get(m, 0) >= size for m in (1, 0)) else px
    picked = [source.where(F.col("mining") == m).orderBy(order, "r", "c").limit(size) for m in (1, 0)]
    return picked[0].unionByName(picked[1])


def _bound(size: int, there: int) -> int:
    """A hash below which the first size of so many evenly spread hashes lie, but for a chance in millions."""
    share = min(1.0, (size + 6 * size**0.5 + 20) / there)
    return min(2**63 - 1, -(2**63) + int(share * 2**64))


@dataclass
class Nodes:
    """A forest's trees as tables: for every feature its thresholds, and for a value's place among them the leaves of each tree that it leaves open; the shares of both classes at the leaves.

    Leaves are numbered from left to right; a node whose condition fails closes those on its left, so the first open leaf is the one that a row comes to.
    """

    thresholds: list[np.ndarray]
    open: list[np.ndarray]
    shares: np.ndarray


def _nodes(model: RandomForestClassificationModel, features: int) -> Nodes:
    spark = SparkSession.getActiveSession()
    path = shared_dir(spark, "forest")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # 2 ** DEPTH leaves of each tree at most
    trees: dict[int, dict] = {}
    for row in rows:
        trees.setdefault(row["treeID"], {})[row["id"]] = row
    conditions: list[list[tuple[float, int, int]]] = [[] for _ in range(features)]  # threshold, tree, leaves it closes
    shares = np.zeros((2, len(trees), 1 << model.getMaxDepth()))
    for t, nodes in enumerate(trees.values()):
        count = 0

        def walk(at: int, t: int = t, nodes: dict = nodes) -> int:
            """Numbers the leaves below a node; how many those are."""
            nonlocal count
            node = nodes[at]
            if node["leftChild"] < 0:
                stats = np.array(node["impurityStats"])
                shares[:, t, count] = stats / stats.sum() if stats.sum() else 0
                count += 1
                return 1
            first = count
            left = walk(node["leftChild"])
            conditions[node["split"]["featureIndex"]].append((node["split"]["leftCategoriesOrThreshold"][0], t, ((1 << left) - 1) << first))
            return left + walk(node["rightChild"])

        walk(0)
    every = (1 << shares.shape[2]) - 1
    thresholds, tables = [], []
    for found in conditions:
        values = np.unique([value for value, _, _ in found])
        table = np.full((len(values) + 1, len(trees)), every, np.uint64)
        for value, t, closed in found:
            table[np.searchsorted(values, value) + 1 :, t] &= np.uint64(every & ~closed)
        thresholds.append(values)
        tables.append(table.astype(np.uint32) if shares.shape[2] <= 32 else table)
    return Nodes(thresholds, tables, shares)


def shares_of(nodes: Nodes, columns: list[np.ndarray]) -> np.ndarray:
    """The share of the second class, on the mean over the trees, of rows given by columns without gaps."""
    n, (_, trees, leaves) = len(columns[0]), nodes.shares.shape
    out = np.empty(n)
    first = (np.arange(trees) * leaves)[:, None]
    places = [np.searchsorted(values, column, side="left") for values, column in zip(nodes.thresholds, columns, strict=True)]
    both = (nodes.shares[0] + 1j * nodes.shares[1]).reshape(-1)  # one look-up and one sum for both classes
    for k in range(0, n, ROWS):
        part = slice(k, k + ROWS)
        left = nodes.open[0].take(places[0][part], axis=0)
        for table, place in zip(nodes.open[1:], places[1:], strict=True):
            left &= table.take(place[part], axis=0)
        left &= ~left + left.dtype.type(1)  # its lowest bit, a power of two, whose exponent is the leaf
        leaf = (left.astype(np.float32).view(np.int32) >> 23) - 127
        votes = np.add.reduce(both.take(leaf.T + first, mode="clip"), axis=0)  # one tree after the other
        out[part] = votes.imag / (votes.real + votes.imag)
    return out


def _scored(*columns: pa.Array, nodes: Nodes) -> pa.Array:
    values = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]  # NULL is NaN
    known = ~np.isnan(np.stack(values)).any(axis=0)
    out = np.full(len(known), np.nan)
    out[known] = shares_of(nodes, [v[known] for v in values])
    return pa.array(out, mask=~known)


@dataclass
class Forest:
    features: list[str]
    model: RandomForestClassificationModel

    def probability(self, px: DataFrame) -> DataFrame:
        """px with p, the probability of mining as the model's transform gives it; rows where a feature is NULL have none."""
        scored = partial(_scored, nodes=_nodes(self.model, len(self.features)))

        def score_rows(*columns: pa.Array) -> pa.Array:
            return scored(*columns)

        # not deterministic to the planner only, so that a condition on p does not make it twice
        p = F.arrow_udf(score_rows, "double").asNondeterministic()
        return px.withColumn("p", p(*[F.col(f).cast("double") for f in self.features]))


def _assembled(px: DataFrame, features: list[str], invalid: str) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid=invalid).transform(px)


def training_rows(px: DataFrame, held: DataFrame, cap: int = MAX_SAMPLES) -> DataFrame:
    """A balanced sample of px (r, c, block, mining) outside the blocks held out, in parts and an order that do not depend on the tasks that made them."""
    found = balanced(px.join(F.broadcast(held), "block", "left_anti").where(F.col("mining").isNotNull()), cap)
    return written(found, "training").repartition(PARTS, "r", "c").sortWithinPartitions("r", "c")


def fitted(px: DataFrame, features: list[str], held: DataFrame, trees: int = TREES, cap: int = MAX_SAMPLES) -> Forest:
    """A forest on a balanced sample of px (r, c, block, mining, features) outside the blocks held out."""
    return grown(training_rows(px, held, cap), features, trees)


def grown(train: DataFrame, features: list[str], trees: int = TREES) -> Forest:
    """A forest on training rows."""
    rows = _assembled(train, features, "skip").select(F.col("mining").cast("double").alias("label"), "features")
    return Forest(features, RandomForestClassifier(numTrees=trees, minInstancesPerNode=LEAF, maxDepth=DEPTH, maxMemoryInMB=1024, seed=SEED).fit(rows))


def score(px: DataFrame, truth, fired) -> DataFrame:
    """hits, misses, false_alarms, precision, recall and f1 (0 where a part is undefined) over the rows of px."""
    t, f = F.coalesce(truth, F.lit(False)), F.coalesce(fired, F.lit(False))
    n = px.agg(F.count_if(t & f).alias("hits"), F.count_if(t & ~f).alias("misses"), F.count_if(~t & f).alias("false_alarms"))
    n = n.withColumns({"precision": F.try_divide("hits", F.col("hits") + F.col("false_alarms")), "recall": F.try_divide("hits", F.col("hits") + F.col("misses"))})
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    return n.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def selected(px: DataFrame, variants: dict[str, list[str]], trees: int = TREES, cap: int = MAX_SAMPLES) -> tuple[str, dict[str, Forest], DataFrame, DataFrame]:
    """The variant with the highest F1 on the blocks held out (the first among equals), all forests, the scores (model and score's columns, chosen), and the blocks.

    px is read several times: a written table.
    """
    held = written(held_out_blocks(px), "held-blocks")
    train = training_rows(px, held, cap)
    test = px.join(F.broadcast(held), "block", "left_semi").where(F.col("mining").isNotNull())
    forests, rows = {}, []
    for name, features in variants.items():
        forests[name] = grown(train, features, trees)
        rows.append((name, *score(forests[name].probability(test), F.col("mining") == 1, F.col("p") >= FIRES).first()))
    best = max(rows, key=lambda row: row[-1])[0]
    table = px.sparkSession.createDataFrame([(*row, row[0] == best) for row in rows], "model string, hits long, misses long, false_alarms long, precision double, recall double, f1 double, chosen boolean")
    return best, forests, table, held
