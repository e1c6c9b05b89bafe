"""Exact substring removal: 100-byte strings that start earlier, by two-stage suffix sorting.

Every 100-byte window of a text has a key, its smallest 16-byte hash; equal windows have equal keys.
Neighbouring windows of one key form a context (their bytes, WINDOW - 1 more than windows). Contexts
whose key occurs once are dropped, unless their smallest 16-byte string recurs in
them, as it does where a text of short period holds a window twice. Contexts are
dealt by key, and each task sorts the suffixes of its contexts, where contexts of equal bytes are one
string with several places: suffixes smaller than their successor
are sorted directly, the rest are induced by scanning the buckets of first bytes in ascending order.
Adjacent common prefixes of WINDOW bytes or more then give the groups of equal windows, and all but
the earliest place of a group are removed.

A key with more than HOT_BYTES of contexts is salted into buckets of about that size, each sorted by
itself. What is left of a bucket, its earliest windows, goes to a second sort by key; of a passage with
very many copies little is left. A key that still has more than HOT_BYTES (the edge of a passage that
very many documents share) is not left to one task: each of its windows is grouped by its own 128-bit
hash, with map-side combine, which has the same result.

Defined results: null text is the empty text; texts below WINDOW bytes stay whole; rows with a null
doc_id take no part and stay whole; rows that repeat a doc_id with other text are ordered by a hash of
the text, and with the same text do not outrank each other; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.llm.common import table, written

WINDOW = 100
GRAM = 16
MAX_RUN = 4096
CHUNK_BYTES = 1 << 20
HOT_BYTES = 1 << 21
TIE_SHIFT = 40
BATCH_ROWS = 20_000
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tie_of(data: bytes) -> int:
    """Orders rows of one doc_id that differ in text; in the upper bits of a position."""
    return (xxhash.xxh3_64_intdigest(data) & 0x3FFFFF) << TIE_SHIFT


def slide(pick: np.ufunc, values: np.ndarray, span: int) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every span of neighbours."""
    width = 1
    while 2 * width <= span:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def gram_hashes(data: bytes) -> np.ndarray:
    """The hash of every GRAM-byte string."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = (words[:n] * _MIX_A) ^ ((words[8 : 8 + n] + _MIX_A) * _MIX_B)
        h = (h ^ (h >> np.uint64(29))) * _MIX_B
    h ^= h >> np.uint64(32)
    return h


def contexts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, first window and number of windows of each context, and whether it may hold a window twice."""
    if len(data) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(bool)
    span = WINDOW - GRAM + 1
    h = gram_hashes(data)
    keys = slide(np.minimum, h, span)  # the key of every window: its smallest hash
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    start = np.append(0, cut)
    size = np.diff(np.append(start, len(keys)))
    if len(size) and size.max() > MAX_RUN:
        pieces = -(-size // MAX_RUN)
        owner = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size = start[owner] + nth * MAX_RUN, np.minimum(size[owner] - nth * MAX_RUN, MAX_RUN)
    # equal windows hold their smallest hash at equal places: without two places of it, no window recurs
    edge = np.zeros(span - 1, np.uint64)
    lowest = np.flatnonzero(h == slide(np.maximum, np.concatenate([edge, keys, edge]), span))
    begin, stop = np.searchsorted(lowest, start), np.searchsorted(lowest, start + size + span - 1)
    owner = np.repeat(np.arange(len(start)), stop - begin)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(stop - begin) - (stop - begin), stop - begin)
    own = owner[h[lowest[begin[owner] + nth]] == keys[start[owner]]]
    return keys[start].view(np.int64), start, size, np.bincount(own, minlength=len(start)) > 1


def suffix_order(text: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of text (uint8, 0 ends each string) in the order of their first WINDOW bytes.

    With starts (flags), only those suffixes and what inducing them needs: the suffixes that follow
    one of them up to the next that is sorted directly.
    """
    n = len(text)
    after = np.append(text[1:], 0)
    # a suffix is smaller than its successor if its first byte that differs from the next one is smaller
    change = np.where(text != after, np.arange(n), n)
    decides = np.minimum.accumulate(change[::-1])[::-1]
    smaller = np.ones(n, bool)
    known = decides < n
    smaller[known] = text[decides[known]] < after[decides[known]]
    smaller[text == 0] = True
    needed = np.ones(n, bool)
    if starts is not None:
        next_direct = np.minimum.accumulate(np.where(smaller, np.arange(n), n)[::-1])[::-1]
        begin, stop = _runs(starts)
        reach = np.zeros(n + 1, np.int32)
        reach[begin] += 1
        reach[next_direct[stop - 1] + 1] -= 1
        needed = np.cumsum(reach[:n]) > 0
    padded = np.concatenate([text, np.zeros(WINDOW, np.uint8)])
    heads = np.ndarray((n,), f"S{WINDOW}", padded.data, strides=(1,))
    direct = np.flatnonzero(smaller & needed & (text > 0))
    direct = direct[np.argsort(heads[direct], kind="stable")]
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: dict[int, list[np.ndarray]] = {}

    def hand_down(bucket: np.ndarray, value: int) -> None:
        """Put the larger predecessors of a sorted bucket into the buckets they belong to, in order."""
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & needed[before] & (text[before] > value)]
        if not len(before):
            return
        before = before[np.argsort(text[before], kind="stable")]
        kinds, at = np.unique(text[before], return_index=True)
        for k, part in zip(kinds.tolist(), np.split(before, at[1:]), strict=True):
            waiting.setdefault(k, []).append(part)

    ends = np.flatnonzero(needed & (text == 0))
    out = [ends]
    hand_down(ends, 0)
    for value in range(1, 256):
        larger = waiting.pop(value, [])
        frontier = np.concatenate(larger) if larger else ends[:0]
        found = [frontier]
        while len(frontier):  # runs of one byte: each round goes one byte further to the left
            before = frontier[frontier > 0] - 1
            frontier = before[~smaller[before] & needed[before] & (text[before] == value)]
            found.append(frontier)
        bucket = np.concatenate([*found, direct[bounds[value] : bounds[value + 1]]])
        if len(bucket):
            out.append(bucket)
            hand_down(bucket, value)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order, up to WINDOW."""
    padded = np.concatenate([text, np.zeros(WINDOW, np.uint8)])
    heads = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 17):
        b = min(a + (1 << 17), len(order))
        same = heads[order[a:b]] == heads[order[a - 1 : b - 1]]
        out[a:b] = np.where(same.all(axis=1), WINDOW, same.argmin(axis=1))
    return out


def later_windows(strings: list[bytes], which: np.ndarray) -> np.ndarray:
    """True per window that equals an earlier one: of strings[which[0]], strings[which[1]] and so on, in order."""
    lengths = np.array([len(s) for s in strings])
    text = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(1)  # UTF-8 has no 0xFF: it becomes 0
    owner = np.repeat(np.arange(len(strings)), lengths + 1)
    head = np.cumsum(lengths + 1) - lengths - 1
    starts = np.arange(len(text)) - head[owner] <= (lengths - WINDOW)[owner]
    order = suffix_order(text, starts)
    order = order[starts[order]]
    group = np.zeros(len(text), np.int64)
    group[order] = np.cumsum(common_prefixes(text, order) < WINDOW)
    sizes = (lengths - WINDOW + 1)[which]
    at = np.repeat(head[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    group = group[at]
    first = np.zeros(len(text) + 1, np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]  # the last to be written is the earliest
    return first[group] != np.arange(len(group))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(parts: list) -> pa.RecordBatch:
        key, doc, place, n, again = map(np.concatenate, zip(*parts, strict=True))
        return pa.RecordBatch.from_pydict({"key": pa.array(key), "doc_id": pa.array(doc), "place": pa.array(place), "n": pa.array(n), "again": pa.array(again)})

    for batch in batches:
        parts, held = [], 0
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            data = text.encode()
            key, start, size, again = contexts(data)
            parts.append((key, np.full(len(key), doc, np.int64), start + tie_of(data), size.astype(np.int32), again))
            held += len(key)
            if held >= BATCH_ROWS:
                yield rows(parts)
                parts, held = [], 0
        if held:
            yield rows(parts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts of each document."""

    def rows(parts: list, pieces: list[bytes]) -> pa.RecordBatch:
        key, bucket, doc, place = map(np.concatenate, zip(*parts, strict=True))
        return pa.RecordBatch.from_pydict({"key": pa.array(key), "bucket": pa.array(bucket), "doc_id": pa.array(doc), "place": pa.array(place), "data": pa.array(pieces, pa.binary())})

    for batch in batches:
        ends = batch["wanted"].offsets.to_numpy()
        key, place, about = (c.to_numpy(zero_copy_only=False) for c in batch["wanted"].values.flatten())
        bucket, n = about // (2 * MAX_RUN), about % (2 * MAX_RUN)
        parts, pieces = [], []
        for i, (doc, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)):
            data = text.encode()
            tie = tie_of(data)
            mine = np.arange(ends[i], ends[i + 1])
            mine = mine[place[mine] >> TIE_SHIFT == tie >> TIE_SHIFT]
            for at in np.split(mine, np.arange(BATCH_ROWS, len(mine), BATCH_ROWS)):
                start = place[at] - tie
                pieces += [data[a:b] for a, b in zip(start.tolist(), (start + n[at] + WINDOW - 1).tolist(), strict=True)]
                parts.append((key[at], bucket[at], np.full(len(at), doc, np.int64), place[at]))
                if len(pieces) >= BATCH_ROWS:
                    yield rows(parts, pieces)
                    parts, pieces = [], []
        if pieces:
            yield rows(parts, pieces)


_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("key", pa.int64()), ("data", pa.binary())])


def _sorted_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix-sort contexts, sorted by key and bucket, in chunks that end with a bucket.

    Gives the removed spans, and with key and data what is left of heavy keys' contexts.
    """

    def stretches(sizes: np.ndarray, flags: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """row, first and end of the runs of flagged windows in each row."""
        head = np.cumsum(sizes) - sizes
        edge = np.zeros(len(flags) + 1, bool)
        edge[head] = True
        edge = edge[:-1]
        first = np.flatnonzero(flags & (edge | ~np.append(False, flags[:-1])))
        last = np.flatnonzero(flags & (np.append(edge[1:], True) | ~np.append(flags[1:], False)))
        row = np.searchsorted(head, first, side="right") - 1
        return zip(row.tolist(), (first - head[row]).tolist(), (last - head[row] + 1).tolist(), strict=True)

    def solve(rows: list[tuple[int, int, bool, int, bytes]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[:2])  # a chunk may hold several buckets of a key
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(r[4], len(known)) for r in rows])
        later = later_windows(list(known), which)
        sizes = np.array([len(r[4]) - WINDOW + 1 for r in rows])
        out = [(rows[i][0], rows[i][1] + a, b - a + WINDOW - 1, None, None) for i, a, b in stretches(sizes, later)]
        left = ~later & np.repeat([r[2] for r in rows], sizes)
        out += [(rows[i][0], rows[i][1] + a, b - a + WINDOW - 1, rows[i][3], rows[i][4][a : b + WINDOW - 1]) for i, a, b in stretches(sizes, left)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_SPANS)], schema=_SPANS)

    rows, held, last = [], 0, None
    for batch in batches:
        for key, bucket, doc, place, data in zip(*(batch[c].to_pylist() for c in ("key", "bucket", "doc_id", "place", "data")), strict=True):
            if rows and last == (key, bucket) and rows[-1][:2] == (doc, place):  # from a repeated row
                continue
            if held >= CHUNK_BYTES and (key, bucket) != last:
                yield solve(rows)
                rows, held = [], 0
            rows.append((doc, place, bucket > 0, key, data))
            held, last = held + len(data), (key, bucket)
    if rows:
        yield solve(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, place and the two halves of the hash of every window of the contexts."""
    for batch in batches:
        docs, places = batch["doc_id"].to_numpy(), batch["place"].to_numpy()
        some, digests, held = [], [], 0
        for i, data in enumerate(batch["data"].to_pylist()):
            n = len(data) - WINDOW + 1
            digests += [xxhash.xxh3_128_digest(data[k : k + WINDOW]) for k in range(n)]
            some.append(i)
            held += n
            if held >= BATCH_ROWS or i + 1 == batch.num_rows:
                sizes = np.array([len(d) for d in (batch["data"].slice(some[0], len(some)).to_pylist())]) - WINDOW + 1
                owner = np.repeat(np.array(some), sizes)
                offset = np.arange(held) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(held, 2)
                yield pa.RecordBatch.from_pydict({"h1": pa.array(halves[:, 0].copy()), "h2": pa.array(halves[:, 1].copy()), "doc_id": pa.array(docs[owner]), "place": pa.array(places[owner] + offset)})
                some, digests, held = [], [], 0


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start (with the tie in the upper bits) and size of removed bytes; they may overlap."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"doc_id IS NOT NULL AND octet_length(text) >= {WINDOW}")
    found = texts.mapInArrow(_context_rows, "key long, doc_id long, place long, n int, again boolean")
    # the small sides are written, so that the joins deal out both sides anew and hot keys can be split
    size = F.sum(F.col("n") + F.lit(WINDOW - 1).cast("long"))
    often = found.groupBy("key").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("weight"), F.ceil(size / HOT_BYTES).alias("salts"))
    often = written(often.where("weight > 1").select("key", "salts"), "suffix-keys")
    bucket = F.pmod(F.xxhash64("doc_id", "place"), F.col("salts"))
    # n, at most MAX_RUN, and the bucket (from 1; 0 of a key with one) in one number
    wanted = found.join(often, "key").select("doc_id", F.struct("key", "place", (F.when(F.col("salts") > 1, bucket + 1).otherwise(0) * (2 * MAX_RUN) + F.col("n")).alias("about")).alias("wanted"))
    # written too: the rows that were dealt by key are off the disk before the pieces come
    lists = written(wanted.groupBy("doc_id").agg(F.collect_list("wanted").alias("wanted")), "suffix-wanted")
    pieces = texts.join(lists.hint("merge"), "doc_id").mapInArrow(_cut, "key long, bucket long, doc_id long, place long, data binary")
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sort(pieces: DataFrame) -> DataFrame:
        dealt = pieces.repartition(count, "key", "bucket").sortWithinPartitions("key", "bucket", "doc_id", "place")
        return dealt.mapInArrow(_sorted_chunks, "doc_id long, start long, size int, key long, data binary")

    first = written(sort(pieces), "suffix-sorted")
    left = first.where("data IS NOT NULL").select("key", "doc_id", F.col("start").alias("place"), "data")
    sizes = written(left.groupBy("key").agg(F.sum(F.length("data")).alias("size")), "suffix-left")
    left = left.join(sizes, "key")
    second = sort(left.where(F.col("size") <= HOT_BYTES).select("key", F.lit(0).cast("long").alias("bucket"), "doc_id", "place", "data"))
    windows = left.where(F.col("size") > HOT_BYTES).select("doc_id", "place", "data").mapInArrow(_windows, "h1 long, h2 long, doc_id long, place long")
    earliest = written(windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "place")).alias("f"), F.count("*").alias("many")).where("many > 1").select("h1", "h2", "f"), "suffix-windows")
    third = windows.join(earliest, ["h1", "h2"]).where(F.struct("doc_id", "place") > F.col("f")).select("doc_id", F.col("place").alias("start"), F.lit(WINDOW).alias("size"))
    spans = ("doc_id", "start", "size")
    return first.where("data IS NULL").select(*spans).unionByName(second.select(*spans)).unionByName(third)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            data = (row["text"] or "").encode()
            tie = tie_of(data)
            gone = np.zeros(len(data) + 1, np.int32)
            mine = np.array([(s["start"] - tie, s["start"] - tie + s["size"]) for s in row["spans"] or () if s["start"] >> TIE_SHIFT == tie >> TIE_SHIFT], np.int64).reshape(-1, 2)
            np.add.at(gone, mine[:, 0], 1)
            np.add.at(gone, mine[:, 1], -1)
            flags = np.cumsum(gone[:-1]) > 0
            a, b = _runs(flags)
            kept = np.frombuffer(data, np.uint8)[~flags].tobytes()
            out.append({"doc_id": row["doc_id"], "n_bytes": len(data), "n_removed": int((b - a).sum()), "n_spans": len(a), "kept": kept, "spans": [{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]})
        kind = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(kind))]))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and spans (start, stop) of every row of docs."""
    lists = removed_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(lists, "doc_id", "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,stop:long>>")


def op3_suffixdedup(spark, sf_dir):
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
