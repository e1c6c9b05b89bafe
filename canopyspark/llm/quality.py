"""Quality rules and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

A text's tokens (runs of letters and digits, runs of other marks) give hashed uni- and bigrams. Two
multinomials over the hash buckets are counted: one over trusted documents, one over the whole raw
corpus. A document's verdict is its mean log-likelihood ratio per n-gram against a threshold, the
same for every document; nothing is drawn at random.

Counts of the raw corpus cover all rows with map-side combine into BUCKETS rows; these come to the
driver (BUCKETS doubles) and go back as one array constant, so that scoring needs no join and no
shuffle. Trusted documents and the threshold come from at most sample_docs labelled rows (those
with the smallest hash), whose ids are broadcast: sample_docs bounds them.

Defined results: null text has no words, fails the base rule and is not kept; labels that are null
or missing are no evidence; without trusted documents every document that passes the base rule is
kept; with trusted ones only, the threshold is below all of their scores; repeated rows are judged one by one;
a document without n-grams scores 0; five-word windows are compared by 64-bit hash within a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyspark.llm.common import WORD, table, tokens

SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 14
SAMPLE_DOCS = 20000
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"


def base_columns(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The columns in keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    whole = F.coalesce(text, F.lit(""))
    step = docs.select(*keep, whole.alias("whole_text"), tokens(text).alias("words"))
    lines = F.filter(F.split("whole_text", "\n"), lambda l: l.rlike(WORD))
    step = step.select("*", lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    step = step.select("*", _pairs(F.col("hashes"), F.col("hashes"), 1).alias("two")).select("*", _pairs(F.col("two"), F.col("two"), 2).alias("four"))
    step = step.select("*", _pairs(F.col("four"), F.col("hashes"), 4).alias("windows"))
    n_words = F.size("words").cast("long")
    step = step.select(
        *keep,
        "windows",
        n_words.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("whole_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    step = step.withColumn("repeated", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeated_starts(F.col("windows"))).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate(
        "repeated",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda s, p: F.struct((s["n"] + p + 5 - F.greatest(s["upto"], p)).alias("n"), (p + 5).alias("upto")),
        lambda s: s["n"],
    )
    step = step.withColumn("n_repeat_words", covered)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return step.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _pairs(left: Column, right: Column, gap: int) -> Column:
    """The hashes of each element of left and the element of right gap places on, as far as both exist."""
    n = F.greatest(F.size(right) - gap, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, gap + 1, n), lambda a, b: F.xxhash64(a, b))


def _repeated_starts(windows: Column) -> Column:
    """Ascending starts of the windows whose hash occurs twice or more: sort by hash, look at both neighbours."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda o: F.filter(F.transform(o, lambda x, k: F.when((x["h"] == F.get(o, k + 1)["h"]) | (x["h"] == F.get(o, k - 1)["h"]), x["i"])), lambda i: i.isNotNull())
    return F.array_sort(F.flatten(F.transform(F.array(ordered), same)))


def grams(text: Column) -> Column:
    """The 64-bit hashes of a text's uni- and bigrams."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    return F.flatten(F.transform(F.array(hashes), lambda h: F.concat(h, _pairs(h, h, 1))))


def bucket(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def labelled_sample(labels: DataFrame, sample_docs: int) -> DataFrame:
    """doc_id and trusted of at most sample_docs labelled documents, those with the smallest hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    per_doc = known.groupBy("doc_id").agg(F.min(F.col("quality") > 0).alias("trusted"))
    return per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)


class RatioModel:
    """ratio: log-likelihood ratio by bucket; threshold of the mean."""

    def __init__(self, ratio: list[float], threshold: float):
        self.ratio, self.threshold = ratio, threshold

    def score(self, text: Column) -> Column:
        table = F.split(F.lit(",".join(map(repr, self.ratio))), ",").cast("array<double>")
        total = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(table, bucket(b)))
        return F.coalesce(F.try_divide(total, F.size("grams")), F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> RatioModel:
    sample = F.broadcast(labelled_sample(labels, sample_docs))
    marked = docs.select("doc_id", "text").join(sample, "doc_id", "left")
    every = marked.select(F.coalesce("trusted", F.lit(False)).cast("int").alias("t"), F.explode(grams(F.col("text"))).alias("gram"))
    counted = every.select("t", bucket(F.col("gram")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()  # BUCKETS rows at most
    raw_all, target_all = sum(r["raw"] for r in counted), sum(r["target"] for r in counted)
    ratio = [0.0] * BUCKETS
    if not target_all:
        return RatioModel(ratio, -math.inf)
    for r in counted:
        ratio[r["bucket"]] = math.log((r["target"] + 1) / (target_all + BUCKETS)) - math.log((r["raw"] + 1) / (raw_all + BUCKETS))
    model = RatioModel(ratio, -math.inf)
    judged = docs.select("doc_id", "text").join(sample, "doc_id").select("trusted", grams(F.col("text")).alias("grams"))
    scores = sorted((r["score"], r["trusted"]) for r in judged.select("trusted", model.score(F.col("text")).alias("score")).collect())  # sample_docs rows at most
    model.threshold = cut(scores)
    return model


def cut(scores: list[tuple[float, bool]]) -> float:
    """The threshold with the fewest errors, a lost trusted document counting as fifty; the middle of the best gap."""
    kept_bad = sum(not trusted for _, trusted in scores)
    best, at, lost, i = 10**18, -math.inf, 0, 0
    edges = [-math.inf, *[s for s, _ in scores], math.inf]
    for i in range(len(scores) + 1):  # keep scores[i:]
        if i:
            lost += scores[i - 1][1]
            kept_bad -= not scores[i - 1][1]
            if i < len(scores) and scores[i][0] == scores[i - 1][0]:
                continue
        cost = 50 * lost + kept_bad
        if cost < best:
            best = cost
            at = (edges[i] + edges[i + 1]) / 2 if math.isfinite(edges[i]) and math.isfinite(edges[i + 1]) else edges[i] if math.isfinite(edges[i + 1]) else edges[i]
    return at


def judge(docs: DataFrame, model: RatioModel) -> DataFrame:
    """doc_id, the base columns, score and kept of every row."""
    step = docs.select("doc_id", "text", grams(F.col("text")).alias("grams"))
    step = step.select("doc_id", "text", model.score(F.col("text")).alias("score"))
    out = base_columns(step, F.col("text"), "doc_id", "score")
    threshold = F.lit(model.threshold)
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
