"""Exact top-k inner-product search with M-trees.

Vectors of whole numbers are lifted by one coordinate, sqrt(M - |x|^2) with M the largest squared
norm, so that the Euclidean distance to a query (lifted by 0) falls as the inner product rises.
Each partition builds paged M-trees of bounded size over the lifted vectors: a node has a routing
vector, a covering radius and its distance to the parent's routing vector; a leaf page keeps every
vector's distance to the page's routing vector. A query visits nodes best first. The stored
distances and the triangle inequality rule out children and vectors before their own distance is
computed. Distances only prune, with slack for rounding; scores are exact whole numbers, kept within
the range of a long where squared norms reach 2 ** 62.

The query set is cut into blocks; each block meets each tree once, in a product of partitions that
neither shuffles nor broadcasts the copies of either. Every tree gives a query k
candidates at most, and a short window per query merges them.

Defined results: a vector that is null, or holds a null or a component that is not finite, takes no
part, nor does a row with a null id; shorter vectors count as padded with zeros; rows that repeat a
query's id are not its candidates; equal scores go to the smaller id; an empty table gives none.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.llm.common import table, written

SCALE = 1024
TOP = 10
TREE_VECTORS = 8192
PAGE_VECTORS = 128
FANOUT = 8
QUERY_BLOCK = 256


def _lift(vectors: np.ndarray, norm2: float) -> np.ndarray:
    own = (vectors.astype(float) ** 2).sum(1)
    return np.column_stack([vectors.astype(float), np.sqrt(np.maximum(norm2 - own, 0))])


class MTree:
    """Arrays of a tree. Nodes are numbered parents first; node 0 is the root.

    route: row of the routing vector; radius; up: distance to the parent's route; low: smallest id
    below; kids: (first, last) child node, or the page's slice of order for a leaf.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm2: float):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.norm2 = ids[by_id], vectors[by_id], norm2
        points = _lift(self.vectors, norm2)
        self.route, self.radius, self.up, self.low, self.first, self.last, self.leaf = [], [], [], [], [], [], []
        self.order, self.entry_up = [], []
        self._new(points, np.arange(len(ids)), 0, 0.0)
        queue = [(0, np.arange(len(ids)))]
        while queue:
            node, rows = queue.pop(0)
            parts = [rows[:0]] if len(rows) <= PAGE_VECTORS else self._split(points, rows, self.radius[node])
            if len(parts) == 1:
                self.leaf[node] = True
                self.first[node] = sum(map(len, self.order))
                self.last[node] = self.first[node] + len(rows)
                self.order.append(rows)
                self.entry_up.append(np.sqrt(((points[rows] - points[self.route[node]]) ** 2).sum(1)))
                continue
            self.first[node] = len(self.route)
            for part in parts:
                route = int(part[0])
                self._new(points, part, route, float(np.sqrt(((points[route] - points[self.route[node]]) ** 2).sum())))
                queue.append((len(self.route) - 1, part))
            self.last[node] = len(self.route)
        self.order = np.concatenate(self.order)
        self.entry_up = np.concatenate(self.entry_up)
        for name in ("route", "first", "last", "low"):
            setattr(self, name, np.array(getattr(self, name), np.int64))
        self.radius, self.up, self.leaf = np.array(self.radius), np.array(self.up), np.array(self.leaf)

    def _new(self, points, rows, route, up):
        self.route.append(route)
        self.radius.append(float(np.sqrt(((points[rows] - points[route]) ** 2).sum(1).max())))
        self.up.append(up)
        self.low.append(int(self.ids[rows].min()))
        self.first.append(0)
        self.last.append(0)
        self.leaf.append(False)

    def _split(self, points, rows, radius):
        """Parts around routing vectors that lie far apart; equal vectors are cut by id instead."""
        if radius == 0:
            return np.array_split(rows, min(FANOUT, -(-len(rows) // PAGE_VECTORS)))
        near = np.full(len(rows), np.inf)
        part = np.zeros(len(rows), np.int64)
        heads, pick = [], 0
        for k in range(FANOUT):
            far = ((points[rows] - points[rows[pick]]) ** 2).sum(1)
            part[far < near] = k
            near = np.minimum(near, far)
            heads.append(pick)
            pick = int(near.argmax())
            if near[pick] == 0:
                break
        parts = []
        for k, head in enumerate(heads):
            mine = rows[part == k]
            if len(mine):
                parts.append(np.concatenate([[rows[head]], mine[mine != rows[head]]]))
        return parts

    def products(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.norm2 < 2.0**62:
            return self.vectors[rows] @ query
        wide = [sum(x * y for x, y in zip(v, query.tolist(), strict=True)) for v in self.vectors[rows].tolist()]
        return np.array([max(-(2**63), min(2**63 - 1, s)) for s in wide], np.int64)

    def search(self, query_id: int, query: np.ndarray, top: int) -> list[tuple[int, int]]:
        """The top (score, id) pairs other than query_id's own, best first, ties to the smaller id."""
        own2 = float((query.astype(float) ** 2).sum())
        total = own2 + self.norm2
        slack = 1e-9 * (total + 1)
        found: list[tuple[int, int]] = []  # heap of (score, -id): the worst first

        def bound(distance):
            """The highest score at this distance or beyond."""
            return np.floor((total - np.maximum(distance, 0) ** 2) / 2 + slack)

        def hopeless(score, low):
            if len(found) < top:
                return np.zeros(np.shape(score), bool)
            worst, last = found[0][0], -found[0][1]
            return (score < worst) | ((score == worst) & (low > last))

        def distance(rows):
            return np.sqrt(np.maximum(total - 2.0 * (self.vectors[rows].astype(float) @ query.astype(float)), 0))

        to_root = float(distance(self.route[:1])[0])
        heap = [(-float(bound(to_root - self.radius[0])), int(self.low[0]), 0, to_root)]
        while heap:
            best, low, node, gap = heapq.heappop(heap)
            if hopeless(np.float64(-best), low):
                continue
            a, b = int(self.first[node]), int(self.last[node])
            if self.leaf[node]:
                rows = self.order[a:b]
                rows = rows[~hopeless(bound(np.abs(gap - self.entry_up[a:b]) - 1e-6), self.ids[rows])]
                scores = self.products(rows, query)
                if len(found) == top:
                    good = scores >= found[0][0]
                    rows, scores = rows[good], scores[good]
                for i in np.lexsort((self.ids[rows], -scores)).tolist():
                    if self.ids[rows[i]] == query_id:
                        continue
                    item = (int(scores[i]), -int(self.ids[rows[i]]))
                    if len(found) < top:
                        heapq.heappush(found, item)
                    elif item > found[0]:
                        heapq.heapreplace(found, item)
                    else:
                        break
                continue
            kids = np.arange(a, b)
            kids = kids[~hopeless(bound(np.abs(gap - self.up[a:b]) - self.radius[a:b] - 1e-6), self.low[a:b])]
            away = distance(self.route[kids])
            most = bound(away - self.radius[kids] - 1e-6)
            for k, far, score in zip(kids.tolist(), away.tolist(), most.tolist(), strict=True):
                heapq.heappush(heap, (-score, int(self.low[k]), k, far))
        return [(s, -i) for s, i in sorted(found, reverse=True)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out[np.arange(width) < lengths[:, None]] = values
    return out


def top_inner_products(vectors: DataFrame, id_col: str, vector_col: str, is_query, *, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the top other rows of each query row by whole-number inner product."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    # NaN and infinities are in no finite range; a null makes forall null
    finite = F.forall(F.col(vector_col), lambda x: (x.cast("double") > F.lit(float("-inf"))) & (x.cast("double") < F.lit(float("inf"))))
    valid = vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    size = valid.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm2"), F.count_if(is_query(F.col("id"))).alias("queries")).first()
    width, norm2 = max(1, size["width"] or 1), float(size["norm2"] or 0)
    parts = max(1, -(-size["n"] // TREE_VECTORS))
    blocks = max(1, -(-size["queries"] // QUERY_BLOCK))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tree per part; the rows come sorted by part, and a part that grew too large gives several."""
        part, ids, rows = None, [], []

        def tree():
            made = MTree(np.concatenate(ids), np.concatenate(rows), norm2)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "tree": pa.array([pickle.dumps(made)], pa.binary())})

        for batch in batches:
            parts_of = batch["part"].to_numpy()
            cuts = np.flatnonzero(parts_of[1:] != parts_of[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if part is not None and (parts_of[a] != part or sum(map(len, ids)) >= 2 * TREE_VECTORS):
                    yield tree()
                    ids, rows = [], []
                part = int(parts_of[a])
                ids.append(batch["id"].to_numpy()[a:b])
                rows.append(_matrix(batch["v"].slice(a, b - a), width))
        if part is not None:
            yield tree()

    dealt = valid.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    built = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(build, "part int, tree binary")
    asked = valid.where(is_query(F.col("id"))).withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int"))
    grouped = asked.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    # all pairs, by partitions read from the shared folder: a join on a key would send every block once for each tree, or broadcast them
    pairs = written(built.select("tree"), "trees").hint("shuffle_replicate_nl").crossJoin(written(grouped.select("asked"), "questions"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree: MTree = pickle.loads(batch["tree"][i].as_buffer())
                asked = batch["asked"][i].values
                rows = _matrix(asked.field("v"), width)
                found = [(q, v, s) for q, row in zip(asked.field("id").to_pylist(), rows, strict=True) for s, v in tree.search(q, row, top)]
                yield pa.RecordBatch.from_pydict({n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate(("query_id", "vec_id", "score"))})

    candidates = pairs.select("tree", "asked").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op2_mtree(spark, sf_dir):
    return top_inner_products(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
