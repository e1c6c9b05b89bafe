"""SimHash near-duplicates: a self-join of binary tries of fingerprints.

A document's fingerprint has a bit set where over half the 64-bit hashes of its word shingles have it set.
Documents with equal fingerprints are one node; two nodes link where at most MAX_BITS bits differ.

The distinct fingerprints stand in binary tries over three bit orders, each beginning with another
third of the bits: two fingerprints that differ in at most two bits have one third in common, so
in that order they lie below one node, and only pairs of equal top nodes are ever met. A pair of nodes is traversed
together: the bits in which the two sides differ are added up on the way down, and a pair whose sum
is over the budget is pruned. Chains of only children are passed at once.

Spark deals top nodes to groups of bounded size. A node with more than NODE_ROWS fingerprints is not one
group: it is replaced by the pairs of its descendants STEP bits lower whose paths are within the budget,
and so on for as long as a pair is too large. A group gives the edges of a spanning forest of its links, never
all pairs; connected components of these edges are those of all links.

Defined results: null or blank texts have fingerprint zero and link like any other; repeated rows are
separate documents that share an id; a null doc_id is never a component's name, unless all of its
members have none; an empty table gives an empty result. Only doc_id and text are read, so further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.llm.common import table, written
from canopyspark.operators.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: The thirds of a fingerprint that the three orders begin with: rotation, bits.
ORDERS = ((0, 22), (22, 21), (43, 21))
#: A pair of nodes with more fingerprints than this is split, STEP bits at a time.
NODE_ROWS = 50_000
STEP = 4
GROUP_ROWS = 200_000
#: Shingles hashed, and pairs of nodes expanded, at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    total = max(1, len(words) - n + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + n - 1]
        lists = [part[k:] for k in range(n)] if len(words) >= n else None
        grams = map(b" ".join, zip(*lists, strict=False)) if lists else [b" ".join(words)]
        digests = b"".join([xxhash.xxh64_digest(g, SEED) for g in grams])  # highest bit first
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a signed long) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), n) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of highest bits that a and b share."""
    x = a ^ b
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return 64 - np.bitwise_count(x).astype(np.int64)


def _below(depth: np.ndarray) -> np.ndarray:
    """A mask of the bits below the depth highest ones."""
    return np.where(depth >= 64, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(depth, 63).astype(np.uint64))


class Forest:
    """Labels of the components of the links seen so far; the label is the smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.label[a], self.label[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def join_nodes(keys: np.ndarray, depth: np.ndarray, left: np.ndarray, right: np.ndarray, budget: int = MAX_BITS) -> np.ndarray:
    """Each key's smallest linked key, as places in keys, over all node pairs (left, right: paths of depth bits).

    keys are sorted and distinct; a node is the range of keys below it. errors: bits that differ above depth.
    """
    forest = Forest(len(keys))
    shift = (64 - depth).astype(np.uint64)

    def ends(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = path << shift
        return np.searchsorted(keys, low), np.searchsorted(keys, low | _below(depth), side="right")

    errors = np.bitwise_count(left ^ right).astype(np.int64)
    first = (*ends(left), *ends(right), depth.astype(np.int64), errors)
    stack = [tuple(x[at : at + CHUNK] for x in first) for at in range(0, len(depth), CHUNK)]
    while stack:
        a0, a1, b0, b1, depth, errors = stack.pop()
        some = (a1 > a0) & (b1 > b0) & ((a0 != b0) | (a1 - a0 > 1)) & (errors <= budget)
        if not some.any():
            continue
        a0, a1, b0, b1, depth, errors = (x[some] for x in (a0, a1, b0, b1, depth, errors))
        # down to where either side forks; every bit on the way is the same for all of a side
        fork = np.minimum(_common(keys[a0], keys[a1 - 1]), _common(keys[b0], keys[b1 - 1]))
        errors = errors + np.bitwise_count((keys[a0] ^ keys[b0]) & _below(depth) & ~_below(fork)).astype(np.int64)
        met = (fork == 64) & (errors <= budget)
        forest.add(a0[met], b0[met])
        down = (fork < 64) & (errors <= budget)
        a0, a1, b0, b1, fork, errors = (x[down] for x in (a0, a1, b0, b1, fork, errors))
        if not len(a0):
            continue
        bit = np.uint64(1) << (63 - fork).astype(np.uint64)

        def middle(low: np.ndarray, fork=fork, bit=bit) -> np.ndarray:
            return np.searchsorted(keys, (keys[low] & ~_below(fork)) | bit)

        am, bm = np.clip(middle(a0), a0, a1), np.clip(middle(b0), b0, b1)
        same = (a0 == b0) & (a1 == b1)
        lower, other = fork + 1, ~same
        for parts in (
            (a0, am, b0, bm, lower, errors),
            (am, a1, bm, b1, lower, errors),
            (a0, am, bm, b1, lower, errors + 1),
            tuple(x[other] for x in (am, a1, b0, bm, lower, errors + 1)),
        ):
            stack += [tuple(x[at : at + CHUNK] for x in parts) for at in range(0, len(parts[0]), CHUNK)]
    return forest.label


def _turned(x, bits: int):
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def _node_pairs(distinct: DataFrame, budget: int, node_rows: int) -> DataFrame:
    """turn, depth, a, b, side, key: each fingerprint at every pair of nodes it stands below; side 1: below a, 2: b, 3: both."""
    orders = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(d).alias("depth"), _turned(F.col("fingerprint"), t).alias("key"), F.shiftrightunsigned(_turned(F.col("fingerprint"), t), 64 - d).alias("a")) for t, d in ORDERS]))
    at = ["turn", "depth", "a", "b"]
    deep = F.col("depth") > 64 - STEP  # a pair of nodes so low has a few fingerprints at most
    now = distinct.select(orders.alias("o")).select("o.turn", "o.depth", "o.a", F.col("o.a").alias("b"), F.lit(3).alias("side"), "o.key")
    done = None
    while True:
        large = written(now.groupBy(*at).agg(F.count("*").alias("n"), F.bit_or("side").alias("sides")).where((F.col("n") > node_rows) & ~deep).drop("n"), "simhash-large")
        if large.isEmpty():
            return now if done is None else done.unionByName(now)
        small = now.join(large, at, "left_anti")
        done = small if done is None else done.unionByName(small)
        own = F.expr(f"shiftrightunsigned(key, {64 - STEP} - depth) & {(1 << STEP) - 1}")
        others = F.explode(F.array(*[F.lit(y).cast("long") for y in range(1 << STEP)]))
        met = now.join(large.where("sides = 3").drop("sides"), at).select(*at, "side", "key", F.shiftleft("a", STEP).alias("a4"), F.shiftleft("b", STEP).alias("b4"), own.alias("x"), others.alias("y"))
        met = met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) + F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= budget)
        both = F.col("side") == 3
        above = F.when(both, F.least("x", "y")).when(F.col("side") == 1, F.col("x")).otherwise(F.col("y"))
        below = F.when(both, F.greatest("x", "y")).when(F.col("side") == 1, F.col("y")).otherwise(F.col("x"))
        side = F.when(both, F.when(F.col("x") == F.col("y"), 3).when(F.col("x") < F.col("y"), 1).otherwise(2)).otherwise(F.col("side"))
        now = written(met.select("turn", (F.col("depth") + STEP).alias("depth"), (F.col("a4") + above).alias("a"), (F.col("b4") + below).alias("b"), side.alias("side"), "key"), "simhash-nodes")


def linked(distinct: DataFrame, budget: int = MAX_BITS, node_rows: int = NODE_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints at most budget (two or fewer) bits apart."""
    nodes = _node_pairs(distinct, budget, node_rows)
    groups = distinct.count() * len(ORDERS) // group_rows + 1

    def traverse(group: pa.Table) -> pa.Table:
        turn = group["turn"].to_numpy()
        ends = [[], []]
        for t, _ in ORDERS:
            here = turn == t
            keys = np.unique(group["key"].to_numpy()[here].view(np.uint64))
            pairs = np.unique(np.stack([group[c].to_numpy()[here].astype(np.int64) for c in ("depth", "a", "b")], axis=1), axis=0)
            label = join_nodes(keys, pairs[:, 0], pairs[:, 1].astype(np.uint64), pairs[:, 2].astype(np.uint64), budget)
            plain = (keys >> np.uint64(t)) | (keys << np.uint64(64 - t)) if t else keys
            own = np.flatnonzero(label != np.arange(len(keys)))
            ends[0].append(plain[own])
            ends[1].append(plain[label[own]])
        return pa.table({n: pa.array(np.concatenate(e).view(np.int64), pa.int64()) for n, e in zip("ab", ends, strict=True)})

    group = F.pmod(F.xxhash64("turn", "depth", "a", "b"), F.lit(groups)).alias("group")
    return nodes.select(group, "turn", "depth", "a", "b", "key").groupBy("group").applyInArrow(traverse, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, budget: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs."""
    rows = written(fingerprints(docs, n), "simhash-rows")
    distinct = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    edges = written(linked(distinct.select("fingerprint"), budget), "simhash-edges")
    components = connected_components(edges).select(F.col("node").alias("fingerprint"), "component")
    members = written(distinct.join(components, "fingerprint").select("fingerprint", "component", "first"), "simhash-members")
    smallest = members.groupBy("component").agg(F.min("first").alias("least"))
    moved = members.join(smallest, "component").select("fingerprint", "least")
    named = distinct.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("component_id"))
    return rows.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
