"""N-gram Jaccard self-join by vertical partitioning.

The global n-gram order is cut into fragments (ranges of the n-gram's hash). Every document's set of
n-grams is split into segments, one per fragment, and each fragment is worked on by itself: it
finds which of its n-grams occur in more than one document, and how often. A document's segments
are then put together again in the global order, rare n-grams first. Only documents of which so
many n-grams occur elsewhere that a partner can exist stay active; most texts end here.

Active documents with equal sets are one class with one representative. Representatives that share
an n-gram of their prefixes and pass the length and position filters are candidates. For each
candidate pair every fragment counts its partial overlap separately; the sum per pair decides.

Groups of copies are not expanded into all pairs. A prefix n-gram's list is first compared with
its first document only. Lists whose documents are then in one component are done; the others
take their next documents as hubs, a few at a time, against members of other components, until
every list is one component or every pair of different components has been compared. This loses
no link that joins components, and the result is exact.

Defined results: null or blank text has no n-grams, is linked with nothing and is its own
component; fewer words than n give one n-gram; repeated rows are separate documents that share
an id (a row each, linked if their texts are); a null doc_id is never a component's name, unless all of
its members have none; an empty table gives an empty result. N-grams are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.llm.bpe import runs
from canopyspark.llm.common import table, written
from canopyspark.operators.components import connected_components

NGRAM = 5
MIN_PERCENT = 80
CHUNK_CHARS = 1 << 20
CHUNK_DOCS = 1 << 16
FRAGMENT_GRAMS = 2 << 20
PARTIAL_FRAGMENTS = 4
HUBS = 256
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, out=out)


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and each text's number of words.

    Words are runs of bytes that are no ASCII white space; A-Z are lower-cased.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    joined = b" ".join(raw) + b" "
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)  # bytes.lower() knows A-Z only
    del raw, joined
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    power = powers(_R, len(data))
    power *= _BYTE_CODE[data]
    np.cumsum(power, out=total[1:])
    del power
    code = (total[end] - total[start]) * powers(_R_INVERSE, len(data) + 1)[start]
    del total
    firsts = np.cumsum(sizes + 1) - (sizes + 1)
    counts = np.diff(np.append(np.searchsorted(start, firsts), len(start)))
    return mix(code + (end - start).astype(np.uint64)), counts


def shingles(texts: list[str | None], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' n-grams with the text each belongs to; sorted by hash, distinct per text."""
    word, counts = word_hashes(texts)
    grams = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), grams)
    first = np.cumsum(counts) - counts
    at = first[owner] + np.arange(len(owner)) - (np.cumsum(grams) - grams)[owner]
    code = np.zeros(len(owner), np.uint64)
    length = np.minimum(counts, n)[owner]
    for j in range(n):
        here = j < length
        code[here] = code[here] * np.uint64(_R) + word[at[here] + j]
    code = mix(code + length.astype(np.uint64))
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return code[keep], owner[keep]


def _seven(code: np.ndarray) -> bytes:
    return np.ascontiguousarray(code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _eight(raw: bytes, top: int) -> np.ndarray:
    """The hashes of _seven, whose top byte the fragment knows."""
    wide = np.zeros((len(raw) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    wide[:, 7] = top
    return wide.reshape(-1).view("<u8")


_SEGMENT = "fragment long, chunk long, codes binary, owners binary, counts binary, doc_ids array<{kind}>"


def prefix_length(n: int) -> int:
    """A set of n n-grams shares one of its first so many with every partner."""
    return n - -(-MIN_PERCENT * n // 100) + 1


def active_sets(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """row_id, doc_id, n_grams of every row; grams (those that occur elsewhere, in global order) and
    signature (of sets that occur elsewhere as a whole) of active rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else None
    chars = docs.agg(F.sum(F.length("text")).alias("c")).first()["c"] or 0
    bits = max(8, int(np.ceil(np.log2(max(1, chars / 6 / FRAGMENT_GRAMS)))))
    segment = _SEGMENT.format(kind=kind)

    def schema_of(ids: pa.Array) -> pa.Schema:
        return pa.schema([("fragment", pa.int64()), ("chunk", pa.int64()), ("codes", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary()), ("doc_ids", pa.list_(id_type or ids.type))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, at = batch["doc_id"], 0
            for texts in runs(batch["text"].to_pylist(), CHUNK_CHARS):
                for lo in range(0, len(texts), CHUNK_DOCS):
                    some = texts[lo : lo + CHUNK_DOCS]
                    code, owner = shingles(some, n)
                    chunk = (part << 32) | seq
                    seq += 1
                    own = ids.slice(at, len(some))
                    at += len(some)
                    sizes = np.bincount(owner, minlength=len(some))
                    rows = [{"fragment": -1 - chunk, "chunk": chunk, "codes": b"", "owners": b"", "counts": sizes.astype("<i8").tobytes(), "doc_ids": own.to_pylist()}]
                    fragment = (code >> np.uint64(64 - bits)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(fragment)) + 1
                    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)], strict=True):
                        if a < b:
                            rows.append({"fragment": int(fragment[a]), "chunk": chunk, "codes": _seven(code[a:b]), "owners": owner[a:b].astype("<u2").tobytes(), "counts": None, "doc_ids": None})
                    yield pa.RecordBatch.from_pylist(rows, schema_of(ids))

    def shared_grams(group: pa.Table) -> pa.Table:
        """A fragment's n-grams that occur in two documents or more, by chunk, with their counts."""
        fragment = group["fragment"][0].as_py()
        if fragment < 0:
            return group
        chunks = group["chunk"].to_numpy()
        top = fragment >> (bits - 8)
        codes = [_eight(c.as_py(), top) for c in group["codes"]]
        owners = [np.frombuffer(o.as_py(), "<u2") for o in group["owners"]]
        which = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        code, owner = np.concatenate(codes), np.concatenate(owners)
        order = np.argsort(code, kind="stable")
        sorted_code = code[order]
        first = np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]])
        size = np.diff(np.append(np.flatnonzero(first), len(code)))
        per_entry = np.repeat(size, size)
        keep = order[per_entry > 1]
        count = per_entry[per_entry > 1]
        back = np.argsort(keep, kind="stable")
        keep, count = keep[back], count[back]
        bounds = np.searchsorted(which[keep], np.arange(len(codes) + 1))
        rows = []
        for k in range(len(codes)):
            a, b = bounds[k], bounds[k + 1]
            if a < b:
                rows.append({"fragment": fragment, "chunk": int(chunks[k]), "codes": code[keep[a:b]].astype("<u8").tobytes(), "owners": owner[keep[a:b]].tobytes(), "counts": count[a:b].astype("<i8").tobytes(), "doc_ids": None})
        return pa.Table.from_pylist(rows, group.schema)

    def assemble(group: pa.Table) -> pa.Table:
        """The rows of a chunk with their shared n-grams in global order."""
        fragments = group["fragment"].to_numpy()
        meta = int(np.flatnonzero(fragments < 0)[0])
        chunk = int(group["chunk"][0].as_py())
        ids = group["doc_ids"].chunk(0)[meta].values if group["doc_ids"].num_chunks == 1 else group["doc_ids"].combine_chunks()[meta].values
        sizes = np.frombuffer(group["counts"][meta].as_py(), "<i8")
        some = [i for i in range(len(fragments)) if i != meta]
        code = np.concatenate([np.empty(0, "<u8"), *[np.frombuffer(group["codes"][i].as_py(), "<u8") for i in some]])
        owner = np.concatenate([np.empty(0, "<u2"), *[np.frombuffer(group["owners"][i].as_py(), "<u2") for i in some]]).astype(np.int64)
        count = np.concatenate([np.empty(0, "<i8"), *[np.frombuffer(group["counts"][i].as_py(), "<i8") for i in some]])
        shared = np.bincount(owner, minlength=len(sizes))
        need = sizes + 1 + (-MIN_PERCENT * sizes // 100)  # prefix_length
        active = (sizes > 0) & (sizes - shared < need)
        mine = active[owner]
        code, owner, count = code[mine], owner[mine], count[mine]
        order = np.lexsort((code, count, owner))
        code = code[order].astype(np.uint64).view(np.int64)
        ends = np.cumsum(np.where(active, shared, 0))
        starts = ends - np.where(active, shared, 0)
        grams, signatures = [], []
        for i in range(len(sizes)):
            own = code[starts[i] : ends[i]]
            grams.append(own if active[i] else None)
            signatures.append(hashlib.blake2b(np.sort(own).tobytes(), digest_size=16).digest() if active[i] and shared[i] == sizes[i] else None)
        row_id = (np.int64(chunk >> 32) << np.int64(38)) + (np.int64(chunk & 0xFFFFFFFF) << np.int64(16)) + np.arange(len(sizes))
        return pa.table({"row_id": pa.array(row_id), "doc_id": ids, "n_grams": pa.array(sizes), "grams": pa.array(grams, pa.list_(pa.int64())), "signature": pa.array(signatures, pa.binary())})

    segments = docs.select("doc_id", "text").mapInArrow(cut, segment)
    shared = segments.groupBy("fragment").applyInArrow(shared_grams, segment)
    return shared.groupBy("chunk").applyInArrow(assemble, f"row_id long, doc_id {kind}, n_grams long, grams array<long>, signature binary")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough: partial overlaps per fragment, summed per pair."""
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTIAL_FRAGMENTS - 1)))
    cut = sets.select("row_id", "n_grams", "grams", part.alias("f")).select("row_id", "n_grams", "f", F.filter("grams", lambda g: F.pmod(g, F.lit(PARTIAL_FRAGMENTS)) == F.col("f")).alias("segment"))
    left = cut.select(F.col("row_id").alias("a"), F.col("n_grams").alias("na"), "f", F.col("segment").alias("sa"))
    right = cut.select(F.col("row_id").alias("b"), F.col("n_grams").alias("nb"), "f", F.col("segment").alias("sb"))
    partial = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("partial"))
    total = partial.groupBy("a", "b").agg(F.sum("partial").alias("overlap"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.where((100 + MIN_PERCENT) * F.col("overlap") >= MIN_PERCENT * (F.col("na") + F.col("nb"))).select("a", "b")


def similar_groups(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs, by links of MIN_PERCENT or more."""
    rows = written(active_sets(docs, n), "jaccard-rows")
    classes = rows.where(F.col("signature").isNotNull()).groupBy("signature").agg(F.min("row_id").alias("rep"))
    active = rows.where(F.col("grams").isNotNull()).join(classes, "signature", "left")
    members = written(active.select("row_id", F.coalesce("rep", "row_id").alias("rep"), "n_grams", F.when(F.coalesce("rep", "row_id") == F.col("row_id"), F.col("grams")).alias("grams")), "jaccard-members")
    sets = members.where(F.col("grams").isNotNull())
    alone = F.col("n_grams") - F.size("grams")  # n-grams found nowhere else come first in the order
    keep = F.col("n_grams") - F.ceil(F.col("n_grams") * MIN_PERCENT / 100).cast("long") + 1 - alone
    prefix = sets.select("row_id", "n_grams", alone.alias("alone"), F.posexplode(F.slice("grams", 1, keep.cast("int"))).alias("k", "gram")).select("gram", "row_id", "n_grams", (F.col("alone") + F.col("k")).alias("at"))
    by_gram = Window.partitionBy("gram").orderBy("row_id")
    lists = prefix.withColumn("place", F.row_number().over(by_gram))
    often = prefix.groupBy("gram").agg(F.count("*").alias("many")).where("many > 1").select("gram")
    lists = written(lists.join(often, "gram"), "jaccard-lists")
    components = None
    step = 0
    while True:
        # by place: 1 first, then HUBS at a time
        low, high = (0, 1) if step == 0 else (1 + HUBS * (step - 1), 1 + HUBS * step)
        if components is None:
            labelled = lists.withColumn("component", F.col("row_id"))
        else:
            known = components.select(F.col("node").alias("row_id"), "component")
            labelled = lists.join(known, "row_id", "left").withColumn("component", F.coalesce("component", "row_id"))
            mixed = labelled.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("place").alias("last")).where((F.col("lo") < F.col("hi")) & (F.col("last") > low)).select("gram")
            labelled = written(labelled.join(mixed, "gram"), "jaccard-open")
            if labelled.isEmpty():
                break
            # lists only close, so later rounds need the sets of what is open now and no others
            sets = written(sets.join(labelled.select("row_id").distinct(), "row_id", "left_semi"), "jaccard-sets")
        hub = labelled.where((F.col("place") > low) & (F.col("place") <= high)).select("gram", F.col("row_id").alias("a"), F.col("n_grams").alias("na"), F.col("at").alias("ta"), F.col("place").alias("pa"), F.col("component").alias("ca"))
        fits = MIN_PERCENT * F.greatest("na", "n_grams") <= 100 * F.least("na", "n_grams")
        room = (100 + MIN_PERCENT) * F.least(F.col("na") - F.col("ta"), F.col("n_grams") - F.col("at")) >= MIN_PERCENT * (F.col("na") + F.col("n_grams"))
        other = (labelled["gram"] == hub["gram"]) & (F.col("place") > F.col("pa")) & (F.col("component") != F.col("ca")) & fits & room
        pairs = labelled.join(hub, other).select("a", F.col("row_id").alias("b")).distinct()
        found = written(_overlaps(pairs, sets), "jaccard-links")
        if components is not None:
            found = found.unionByName(components.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        components = connected_components(found)
        step += 1
    known = components.select(F.col("node").alias("rep"), F.col("component").alias("group"))
    grouped = members.select("row_id", "rep").join(known, "rep", "left").select("row_id", F.coalesce("group", "rep").alias("group"))
    named = rows.select("row_id", "doc_id", "n_grams").join(grouped, "row_id", "left")
    named = named.withColumn("group", F.coalesce("group", "row_id"))
    smallest = grouped.join(rows.select("row_id", "doc_id"), "row_id").groupBy("group").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "group", "left").select("doc_id", F.col("n_grams").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def op5_jaccard(spark, sf_dir):
    return similar_groups(table(spark, sf_dir, "documents"))


def near_copy_stage(spark, docs, sf_dir):
    """One row of each group of near copies, that of the smallest doc_id (then text hash), with the columns of docs.

    Rows are told apart by doc_id and text, so rows that share an id stay or go by their own text; of rows
    that repeat both, one stays. Rows without an id stay and take no part.
    """
    columns = docs.columns
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("tie")).alias("row_key"), F.struct(*columns).alias("row"))
    own = rows.where("row_key.doc_id IS NOT NULL")
    groups = similar_groups(own.select(F.col("row_key").alias("doc_id"), "row.text"))
    drop = groups.groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count("*").alias("many"))
    drop = written(drop.where("first < doc_id OR many > 1").select(F.col("doc_id").alias("row_key"), (F.col("first") < F.col("doc_id")).alias("gone")), "jaccard-drop")
    kept = rows.join(drop.select("row_key"), "row_key", "left_anti")
    repeated = rows.join(drop.where("NOT gone").select("row_key"), "row_key", "left_semi").groupBy("row_key").agg(F.first("row").alias("row"))
    return kept.unionByName(repeated).select("row.*")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT a AS doc_id, b AS seen FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id) m USING (doc_id)
"""
