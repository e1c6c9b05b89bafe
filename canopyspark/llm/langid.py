"""Language identification with bit-sliced Bloom filters over n-grams.

Training counts the byte 4-grams of words per language and keeps, for each language, those that
are frequent there and not much rarer than in the language that uses them most. One Bloom filter
per language holds its n-grams. The filters are stored bit-sliced: row j is a bitmask of all
languages whose filter has bit j, so the AND of an n-gram's rows is the set of all languages that
contain it. A document's hits are counted per language (popcount), each count is corrected for its
filter's false positives, and the largest corrected share decides.

The model is fitted on a bounded sample: about max_train_docs documents per language, whole texts.
It is a few MB at most (2**bits masks) and is broadcast. Prediction is one pass without a shuffle.

Defined results: null text or text without a letter gives "und" and 0.0; letters of which no
n-gram is known give the language with most training rows and 0.0; ties go to the smaller
language name; with no training rows every document is "und"; repeated rows are predicted one by
one; doc_id may be null (it counts as the empty text for the hold-out remainder).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.llm.common import table

GRAM = 4
HASHES = 3
CHUNK_CHARS = 1 << 20
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass
class Model:
    """languages by bit; masks: uint64 [2**bits, words]; rates: false-positive rate per language."""

    languages: list[str]
    masks: np.ndarray
    rates: np.ndarray
    fallback: str


def _letters_table() -> np.ndarray:
    """Bytes to themselves for a-z and all of UTF-8 beyond ASCII, 0 kept as the document mark, else a space."""
    keep = np.full(256, 32, np.uint8)
    keep[0] = 0
    keep[97:123] = np.arange(97, 123)
    keep[128:] = np.arange(128, 256)
    return keep


_KEEP = _letters_table()


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of all texts as integers, and the text each belongs to.

    Texts are lower-cased; what is no letter becomes a space; a gram has two letters at least and
    no two adjacent spaces, so it never spans more than one gap between words.
    """
    joined = "\0".join(" " + t.replace("\0", " ").lower() + " " for t in texts).encode("utf-8", "replace")
    data = _KEEP[np.frombuffer(joined, np.uint8)]
    if len(data) < GRAM:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    owner = np.cumsum(data == 0, dtype=np.int32)
    gap = data <= 32
    double = gap[1:] & gap[:-1]
    bad = double[:-2] | double[1:-1] | double[2:]
    for k in range(GRAM):
        bad |= data[k : len(data) - GRAM + 1 + k] == 0
    wide = data.astype(np.uint32)
    gram = wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24))
    good = ~bad
    return gram[good], owner[: len(gram)][good]


def _rows(gram: np.ndarray, k: int, bits: int) -> np.ndarray:
    mixed = (gram.astype(np.uint64) + np.uint64(k + 1)) * np.uint64(_MULTIPLIERS[k])
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, *, max_train_docs: int = 3000, min_docs: int = 3, max_grams: int = 30000, ratio: float = 0.5, bits: int = 20) -> Model:
    """Fit on the rows of docs that have text and lang.

    max_train_docs documents a language at most are expected in the sample (those with the smallest
    hash, by a threshold from the language's row count); max_grams n-grams a language are kept.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((1 << bits, 1), np.uint64), np.zeros(0), "und")
    languages = sorted(counts)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(v) for l in languages for v in (l, min(1.0, max_train_docs / counts[l]))]), F.col("lang"))
    sample = usable.where(draw < share).select("lang", "text")

    def document_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for texts in _chunks(part["text"].tolist()):
                    gram, owner = _grams(texts)
                    pairs = np.unique((owner.astype(np.uint64) << np.uint64(32)) | gram)
                    found, n = np.unique(pairs & np.uint64(0xFFFFFFFF), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": found.astype(np.int64), "n": n.astype(np.int64), "docs": len(texts)})

    part = sample.mapInPandas(document_grams, "lang string, gram long, n long, docs long")
    per_lang = part.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    sampled = {l: max(1.0, counts[l] * min(1.0, max_train_docs / counts[l])) for l in languages}
    size = F.element_at(F.create_map(*[F.lit(v) for l in languages for v in (l, float(sampled[l]))]), F.col("lang"))
    rated = per_lang.withColumn("rate", F.col("n") / size)
    top = rated.withColumn("best", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= ratio * F.col("best"))
    masks = np.zeros((1 << bits, -(-len(languages) // 64)), np.uint64)
    fill = np.zeros(len(languages))
    # one job for all languages; max_grams rows a language at most come to the driver
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = top.withColumn("place", place).where(F.col("place") <= max_grams).select("lang", "gram").toPandas()
    by_language = dict(tuple(kept.groupby("lang")["gram"]))
    for i, lang in enumerate(languages):
        gram = by_language[lang].to_numpy(np.int64).astype(np.uint32) if lang in by_language else np.empty(0, np.uint32)
        for k in range(HASHES):
            masks[_rows(gram, k, bits), i // 64] |= np.uint64(1 << (i % 64))
        fill[i] = ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
    fallback = max(languages, key=lambda l: (counts[l], [-ord(c) for c in l]))
    return Model(languages, masks, fill**HASHES, fallback)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about CHUNK_CHARS characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return text is not None and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    lettered = np.array([has_letter(t) for t in texts], bool)
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return names, scores
    bits = int(model.masks.shape[0]).bit_length() - 1
    at = np.flatnonzero(lettered)
    done = 0
    for run in _chunks([texts[i] for i in at]):
        gram, owner = _grams(run)
        rows = [_rows(gram, k, bits) for k in range(HASHES)]
        total = np.bincount(owner, minlength=len(run)).astype(float)
        share = np.zeros((len(run), len(model.languages)))
        for word in range(model.masks.shape[1]):
            column = model.masks[:, word]
            found = column[rows[0]]
            for r in rows[1:]:
                found &= column[r]
            for i in range(word * 64, min(len(model.languages), word * 64 + 64)):
                hit = (found >> np.uint64(i % 64)) & np.uint64(1)
                share[:, i] = np.bincount(owner, weights=hit, minlength=len(run))
        seen = share / np.maximum(total, 1)[:, None]
        corrected = np.clip((seen - model.rates) / np.maximum(1 - model.rates, 1e-9), 0, 1)
        best = corrected.argmax(1)
        for j in range(len(run)):
            top = corrected[j, best[j]]
            names[at[done + j]] = model.languages[best[j]] if top > 0 else model.fallback
            scores[at[done + j]] = top
        done += len(run)
    return names, scores


def identify(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """The columns named, and lang_pred and score from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        names, scores = classify(shared.value, [None if t is None else t for t in text])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.select(*columns, predict(F.col("text")).alias("found")).select(*columns, "found.*")


def op1_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, "doc_id", "held_out")


def language_stage(spark, docs, sf_dir, *, min_score: float = 0.05):
    """Documents whose language is recognised, with their columns as they were.

    Rejected: null text, no letter, or less than min_score of the n-grams in the best language.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        names, scores = classify(shared.value, list(text))
        return pd.Series([s if n != "und" else -1.0 for n, s in zip(names, scores, strict=True)], dtype=float)

    return docs.where(score(F.col("text")) >= min_score)
