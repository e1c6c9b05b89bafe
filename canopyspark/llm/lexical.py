"""Ranked lexical search: a tiered index of postings, high-impact ones first.

One pass over the texts counts their terms and keeps those that some query may ask for: a bitmap of hashes of the
query terms, FILTER_BITS bits at any size, rules out the others, so the postings kept are a small table. Its
counts give the collection's statistics, and these the weight of every query term.

The index has a row for every SHARD_DOCS documents and a column for each tier. A posting's impact is what it adds to
a score; a shard's postings fall into tiers by impact (TIERS: shares of all), and each tier states, for every
term, the largest impact still below it. A search has two kinds of pass, both without a shuffle of postings:

- for each tier but the last, one that reads only the columns of the tiers so far: the TOP largest partial scores of each
  query, over all shards, bound the score that a result needs from below;
- one that answers: in each shard, a query reads the first tier and adds up what the terms may still bring. If
  no document beyond those seen can reach the bound, only seen documents that can reach it are completed, by lookup in the
  lower tiers. A query without that proof falls through to the next tier; the last tier has everything.

Tasks keep TOP results a query, so a pass sends on TOP rows a query and task. Queries are worked in blocks of about
BLOCK_PAIRS terms, which bounds what is sent to executors.

Defined results: null texts and texts without a term match nothing and count for no statistics; repeated rows are
documents (or queries) of their own; equal scores are ordered by doc_id, a null id last; empty tables give an empty result. Only the ids and texts are read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.llm.common import discard, table, written

TOP = 10
FILTER_BITS = 1 << 20
BLOCK_PAIRS = 1 << 20
SHARD_BITS = 12
SHARD_DOCS = 1 << SHARD_BITS
#: Each tier has the postings of a shard beyond the former ones, up to this share of all.
TIERS = (1 / 8, 1 / 2, 1.0)
#: ASCII letters and digits and all other characters beyond ASCII are in terms; A-Z count as a-z.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_TIER = "struct<codes: array<long>, impacts: array<long>, rest_terms: array<int>, rest: array<long>>"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _lists(flat: list[bytes], sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.binary()).cast(pa.string()))


def query_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """item (a row's number), id and term: the distinct terms of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(dict.fromkeys(terms(t.as_py()))) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["item"], batch["id"], _lists([w for f in found for w in f], [len(f) for f in found])], ["item", "id", "terms"])

    kind = items.schema[id].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(id).alias("id"), F.col(text).alias("text"))
    return numbered.mapInArrow(each, f"item long, id {kind}, terms array<string>").select("item", "id", F.explode("terms").alias("term"))


def postings(docs: DataFrame, id: str, text: str, bits: bytes) -> DataFrame:
    """id, n (terms with repeats), terms and counts of every row with a term; only terms whose hash is set in bits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = len(bits) * 8 - 1
        for batch in batches:
            n, sizes, flat, counts = [], [], [], []
            for t in batch["text"]:
                words = terms(t.as_py())
                had = len(flat)
                for word, many in Counter(words).items():
                    at = zlib.crc32(word) & mask
                    if bits[at >> 3] >> (at & 7) & 1:
                        flat.append(word)
                        counts.append(many)
                n.append(len(words))
                sizes.append(len(flat) - had)
            lists = _lists(flat, sizes)
            tf = pa.ListArray.from_arrays(lists.offsets, pa.array(counts, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), lists, tf], ["id", "n", "terms", "counts"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(each, f"id {kind}, n long, terms array<string>, counts array<long>").where("n > 0")


def _bitmap(pairs: DataFrame) -> bytes:
    """FILTER_BITS bits, those of the query terms' hashes set."""
    found = pairs.select((F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(FILTER_BITS - 1))).alias("at")).distinct().toArrow()["at"].to_numpy()
    out = np.zeros(FILTER_BITS, np.uint8)
    out[found] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _tiers(count: int) -> list[str]:
    return [f"tier{k + 1}" for k in range(count)]


def tiered_index(held: DataFrame, words: list[str], weights: list[int], documents: int, total: int, shares: tuple[float, ...] = TIERS) -> DataFrame:
    """A row for every SHARD_DOCS documents: their ids and a column for each tier. A code is term << SHARD_BITS | document."""

    def split(code: np.ndarray, impact: np.ndarray) -> list[dict]:
        ranked = np.sort(impact)[::-1]
        lowest = [ranked[min(len(ranked) - 1, int(len(ranked) * share))] for share in shares[:-1]] if len(ranked) else [0] * (len(shares) - 1)
        out, above = [], None
        for least in [*lowest, -1]:
            here = impact >= least if above is None else (impact >= least) & (impact < above)
            under = impact < least
            rest_terms, place = np.unique(code[under] >> SHARD_BITS, return_inverse=True)
            rest = np.zeros(len(rest_terms), np.int64)
            np.maximum.at(rest, place, impact[under])
            out.append({"codes": code[here], "impacts": impact[here], "rest_terms": rest_terms.astype(np.int32), "rest": rest})
            above = least
        return out

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = pa.array(words, pa.string()), np.array(weights, np.int64)
        for batch in batches:
            for at in range(0, len(batch), SHARD_DOCS):
                part = batch.slice(at, SHARD_DOCS)
                sizes = pc.list_value_length(part["terms"]).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(part)), sizes)
                term = pc.fill_null(pc.index_in(part["terms"].flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part["counts"].flatten().to_numpy(zero_copy_only=False)
                length = np.array([10 + 90 * n * documents // total for n in part["n"].to_pylist()], np.int64)
                own = term >= 0
                doc, term, tf = doc[own], term[own], tf[own]
                impact = weight[term] * ((1000000000 * tf) // (1000 * tf + 8 * length[doc]))
                code = (term << SHARD_BITS) | doc
                order = np.argsort(code)
                tiers = split(code[order], impact[order])
                kinds = {"codes": pa.int64(), "impacts": pa.int64(), "rest_terms": pa.int32(), "rest": pa.int64()}
                row = [pa.array([part["id"].to_pylist()], pa.list_(part["id"].type))]
                row += [pa.array([t], pa.struct([(k, pa.list_(v)) for k, v in kinds.items()])) for t in tiers]
                yield pa.RecordBatch.from_arrays(row, ["ids", *_tiers(len(shares))])

    kind = held.schema["id"].dataType.simpleString()
    return held.mapInArrow(build, f"ids array<{kind}>, " + ", ".join(f"{t} {_TIER}" for t in _tiers(len(shares))))


class Shard:
    """The tiers of a shard that are at hand."""

    def __init__(self, batch: pa.RecordBatch, row: int, size: int, count: int):
        flat = lambda x: x.values.to_numpy(zero_copy_only=False)
        self.size = size
        self.tiers = [{k: flat(batch[t][row][k]) for k in ("codes", "impacts", "rest_terms", "rest")} for t in _tiers(count)]

    def found(self, tier: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, impacts and places in query of the tier's postings of the query's terms."""
        codes = self.tiers[tier]["codes"]
        first, last = np.searchsorted(codes, query << SHARD_BITS), np.searchsorted(codes, (query + 1) << SHARD_BITS)
        many = last - first
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return codes[at] & (SHARD_DOCS - 1), self.tiers[tier]["impacts"][at], np.repeat(np.arange(len(query)), many)

    def left(self, tier: int, query: np.ndarray) -> np.ndarray:
        """For each term the largest impact below the tier."""
        known, rest = self.tiers[tier]["rest_terms"], self.tiers[tier]["rest"]
        if not len(known):
            return np.zeros(len(query), np.int64)
        at = np.minimum(np.searchsorted(known, query), len(known) - 1)
        return np.where(known[at] == query, rest[at], 0)

    def partial(self, query: np.ndarray, tiers: int) -> np.ndarray:
        score = np.zeros(self.size, np.int64)
        for k in range(tiers):
            doc, impact, _ = self.found(k, query)
            np.add.at(score, doc, impact)
        return score

    def candidates(self, query: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may reach the score needed, with their scores, and the number of tiers it took to prove that no others can."""
        score, seen = np.zeros(self.size, np.int64), []
        for k in range(len(self.tiers)):
            doc, impact, place = self.found(k, query)
            np.add.at(score, doc, impact)
            seen.append((doc, impact, place))
            left = self.left(k, query)
            beyond = int(left.sum())
            if beyond >= needed:
                continue  # an unseen document might do: no proof, on to the next tier
            best = score + beyond
            for doc, _, place in seen:
                np.subtract.at(best, doc, left[place])
            able = np.flatnonzero((best >= needed) & (score > 0))
            for tier in self.tiers[k + 1 :] if len(able) else ():  # complete them
                wanted = (query[:, None] << SHARD_BITS | able[None, :]).reshape(-1)
                at = np.searchsorted(tier["codes"], wanted)
                there = np.flatnonzero(tier["codes"][np.minimum(at, len(tier["codes"]) - 1)] == wanted) if len(tier["codes"]) else np.zeros(0, int)
                np.add.at(score, able[there % len(able)], tier["impacts"][at[there]])
            return able, score[able], k + 1
        raise AssertionError("the last tier leaves nothing")


def _best(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _bounds(index: DataFrame, queries: dict[int, np.ndarray], tiers: int, top: int) -> dict[int, int]:
    """For each query the top-th largest partial score by the first tiers, over all shards; none if fewer score."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {q: np.zeros(0, np.int64) for q in queries}
        for batch in batches:
            for row in range(len(batch)):
                shard = Shard(batch, row, batch["size"][row].as_py(), tiers)
                for q, query in queries.items():
                    score = np.concatenate([kept[q], shard.partial(query, tiers)])
                    kept[q] = np.partition(score, len(score) - top)[-top:] if len(score) > top else score
        item = np.repeat(np.array(list(kept), np.int64), [len(v) for v in kept.values()])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate([*kept.values(), np.zeros(0, np.int64)]))], ["item", "score"])

    read = index.select(F.size("ids").alias("size"), *_tiers(tiers))
    rows = read.mapInArrow(each, "item long, score long").where("score > 0").withColumn("id", F.lit(None).cast("long"))
    return {r.item: r.score for r in _best(rows, top).where(F.col("rank") == top).collect()}


def _answers(index: DataFrame, queries: dict[int, np.ndarray], needed: dict[int, int], tiers: int, top: int) -> DataFrame:
    """item, id, score and tier (the deepest that an answer of its task needed) of each task's best documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {q: [] for q in queries}
        deepest = dict.fromkeys(queries, 0)
        kind = None
        for batch in batches:
            kind = batch["ids"].type.value_type
            for row in range(len(batch)):
                ids = batch["ids"][row].as_py()
                shard = Shard(batch, row, len(ids), tiers)
                for q, query in queries.items():
                    own = kept[q]
                    docs, scores, tier = shard.candidates(query, max(needed.get(q, 1), -own[-1][0] if len(own) == top else 1))
                    deepest[q] = max(deepest[q], tier)
                    if len(docs):
                        more = ((-s, ids[d] is None, ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True))
                        kept[q] = heapq.nsmallest(top, [*own, *more], key=lambda x: x if not x[1] else (x[0], True, 0))
        if kind is not None:
            flat = [(q, -s, i, deepest[q]) for q, rows in kept.items() for s, _, i in rows]
            kinds = (pa.int64(), pa.int64(), kind, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], t) for k, t in enumerate(kinds)], ["item", "score", "id", "tier"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.select("ids", *_tiers(tiers)).mapInArrow(each, f"item long, score long, id {kind}, tier int")


def search(items: DataFrame, docs: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", top: int = TOP, block_pairs: int = BLOCK_PAIRS, shares: tuple[float, ...] = TIERS) -> DataFrame:
    """item_id, rank, doc_id, score and tier: the top highest-scoring documents of every row of items, scores above 0."""
    spark = items.sparkSession
    pairs = written(query_terms(items, item_id, text), "lexical-queries")
    held = written(postings(docs, doc_id, text, _bitmap(pairs)), "lexical-postings")
    stats = held.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    often = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = written(pairs.join(often, "term"), "lexical-weights")
    blocks = asked.count() // block_pairs + 1
    doc_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long, tier int")
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # about block_pairs
        frequency = {r.term: r.df for r in rows}
        words = sorted(frequency)
        weights = [math.floor(1000 * math.log((2 * stats.documents + 2) / (2 * frequency[w] + 1))) for w in words]
        number = {w: k for k, w in enumerate(words)}
        queries, names = {}, {}
        for r in rows:
            queries.setdefault(r.item, []).append(number[r.term])
            names[r.item] = r.id
        queries = {q: np.array(sorted(v), np.int64) for q, v in queries.items()}
        if not queries:
            continue
        index = written(tiered_index(held, words, weights, stats.documents, stats.total, shares), "lexical-index")
        needed: dict[int, int] = {}
        for tiers in range(1, len(shares)):
            found = _bounds(index, queries, tiers, top)
            needed = {q: max(needed.get(q, 1), found.get(q, 1)) for q in queries}
        best = _best(_answers(index, queries, needed, len(shares), top), top)
        called = spark.createDataFrame(list(names.items()), f"item long, item_id {item_kind}")
        answer = written(best.join(called, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score", "tier"), "lexical-answers")
        discard(index)
        out = out.unionByName(answer)
    return out


def op13_lexical(spark, sf_dir):
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")).drop("tier")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n),
m AS (SELECT doc_id, 10 + (90 * n * nn) // l AS m FROM n, s),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
w AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s WHERE t IN (SELECT t FROM q) GROUP BY t),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
