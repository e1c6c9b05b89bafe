"""Token ids in a word-aligned binary file format (Simple-8b), written and read back with Spark.

A segment holds the ids of some consecutive documents: a header, the documents' ids and lengths,
the id blocks and each block's word offset. A block of BLOCK ids is packed into 64-bit words: four
selector bits say how many ids share the other 60. An id of 60 bits or more is an escape: a
selector word of its own, then the id as a raw word. Blocks start at known words, so many blocks
are packed and unpacked side by side with array operations.

Documents are range-partitioned by doc_id and sorted, so the order of partitions, segments and
documents is ascending doc_id. Segments are written as binary rows of a Parquet table in the
shared folder (a store that only Spark reaches will do) and every result is made from what is read
back. Start positions are prefix sums in two levels: over partitions, then over segments.

Defined results: null text is the empty text (one end id); a null doc_id sorts first; repeated rows
are separate documents, in the order of their text; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopyspark.llm.bpe import TOKENIZER, Encoder, byte_letters, runs
from canopyspark.llm.common import shared_dir, table

MAGIC = b"TOKSEG01"
END_ID = 0
#: A multiple of nearly all of PER_WORD.
BLOCK = 240
#: Ids per word by selector; 60 // n bits each. Selector 15 is the escape.
PER_WORD = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
ESCAPE = 15
_PAYLOAD = np.uint64(60)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint64 ids to uint64 words, and the first word of each block."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.arange(n)
    left = np.minimum(BLOCK - at % BLOCK, n - at)  # ids from here to the block's end
    best = np.full(n, ESCAPE, np.int8)
    # bits of each id; ids from 2**53 on may count as one bit more
    bits = np.frexp(ids.astype(float))[1].astype(np.int8)
    for selector in range(len(PER_WORD) - 1, -1, -1):
        count = int(PER_WORD[selector])
        small = np.flatnonzero(bits <= 60 // count)
        runs_on = small[: len(small) - count + 1] if len(small) >= count else small[:0]
        runs_on = runs_on[small[count - 1 :][: len(runs_on)] - runs_on == count - 1]
        best[runs_on[left[runs_on] >= count]] = selector
    step = np.append(PER_WORD, [0, 1])[best]
    blocks = -(-n // BLOCK)
    at = np.arange(blocks) * BLOCK
    stop = np.minimum(at + BLOCK, n)
    starts, owner = [], []
    which = np.arange(blocks)
    while len(at):  # all blocks advance by a word at a time
        starts.append(at)
        owner.append(which)
        at = at + step[at]
        live = at < stop[which]
        at, which = at[live], which[live]
    start = np.sort(np.concatenate(starts))
    selector = best[start]
    size = np.where(selector == ESCAPE, 2, 1)
    word_at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        mine = selector == s
        at = start[mine]
        head = np.full(len(at), np.uint64(s) << _PAYLOAD, np.uint64)
        if s == ESCAPE:
            words[word_at[mine] + 1] = ids[at]
        else:
            count = int(PER_WORD[s])
            for j in range(count):
                head |= ids[at + j] << np.uint64(j * (60 // count))
        words[word_at[mine]] = head
    first = np.searchsorted(start, np.arange(blocks) * BLOCK)
    return words, word_at[first]


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids packed in words; offsets: the first word of each block."""
    out = np.empty(n, np.uint64)
    blocks = len(offsets)
    at, which = offsets.copy(), np.arange(blocks)
    stop = np.append(offsets[1:], len(words))
    fill = np.arange(blocks) * BLOCK
    while len(at):
        selector = (words[at] >> _PAYLOAD).astype(np.int64)
        step = np.append(PER_WORD, [0, 1])[selector]
        for s in np.unique(selector).tolist():
            mine = selector == s
            if s == ESCAPE:
                out[fill[mine]] = words[at[mine] + 1]
                continue
            count = int(PER_WORD[s])
            width = 60 // count
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                out[fill[mine] + j] = (words[at[mine]] >> np.uint64(j * width)) & mask
        at = at + 1 + (selector == ESCAPE)
        fill = fill + step
        live = at < stop[which]
        at, fill, which = at[live], fill[live], which[live]
    return out


def segment(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: MAGIC; documents, ids, words, blocks as int64; lengths; block offsets; words."""
    words, offsets = pack(ids)
    head = np.array([len(lengths), len(ids), len(words), len(offsets)], "<i8")
    return MAGIC + head.tobytes() + lengths.astype("<i8").tobytes() + offsets.astype("<i8").tobytes() + words.astype("<u8").tobytes()


def read_segment(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The lengths and the ids of a segment."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token segment")
    docs, n, words, blocks = np.frombuffer(blob, "<i8", 4, 8).tolist()
    lengths = np.frombuffer(blob, "<i8", docs, 40)
    offsets = np.frombuffer(blob, "<i8", blocks, 40 + 8 * docs)
    packed = np.frombuffer(blob, "<u8", words, 40 + 8 * (docs + blocks))
    return lengths, unpack(packed, offsets.astype(np.int64), n)


@functools.cache
def library_encoder(path: str) -> Encoder:
    """Words are encoded by the tokenizers library's model; a text's words are looked up after that.

    One encoder a worker process, so that its tasks share the words they have seen.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    specials = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    letters = str.maketrans({b: letter for letter, b in byte_letters().items()})
    model = library.model.tokenize

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the model takes a word's bytes as the letters that stand for them
        found = [[specials[w]] if w in specials else [t.id for t in model(w.encode("utf-8", "replace").decode("latin-1").translate(letters))] for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts

    return Encoder(encode_words, specials)


def write_tokens(docs: DataFrame, target: str, path: str | None = None, partitions: int | None = None) -> None:
    """Write the segments of docs below target: part (ascending in doc_id), seq, doc_ids, n_ids, data."""
    name = path or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seq = library_encoder(name), 0
        for batch in batches:
            part = batch["part"][0].as_py() if batch.num_rows else 0
            at = 0
            for texts in runs(batch["text"].to_pylist()):
                flat, counts = encoder.encode(texts)
                lengths = counts + 1
                ids = np.full(int(lengths.sum()), END_ID, np.uint64)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
                doc_ids = batch["doc_id"].slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), doc_ids),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "data": pa.array([segment(lengths, ids)], pa.binary()),
                })
                seq += 1

    out = ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(encode_all, f"part int, seq int, doc_ids array<{kind}>, n_ids long, data binary")
    out.write.option("compression", "zstd").parquet(target)


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the segments below target."""
    rows = spark.read.parquet(target)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_start = parts.select("part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("seq_start")).join(part_start, "part")
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()

    def decode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, ids = read_segment(batch["data"][i].as_py())
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                before = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(before.tolist(), ends.tolist(), strict=True)]
                k = len(lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_ids"][i].values,
                    "part": pa.array([batch["part"][i].as_py()] * k, pa.int32()),
                    "seq": pa.array([batch["seq"][i].as_py()] * k, pa.int32()),
                    "before": pa.array(before),
                    "n_tokens": pa.array(lengths.astype(np.int64)),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })

    decoded = rows.select("part", "seq", "doc_ids", "data").mapInArrow(decode_all, f"doc_id {kind}, part int, seq int, before long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("seq_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op7_tokenfile(spark, sf_dir):
    target = shared_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), target)
    return read_tokens(spark, target)
