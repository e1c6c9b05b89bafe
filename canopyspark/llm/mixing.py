"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis).

Every document draws an exponential key whose rate is its quality weight; within a source,
documents are taken in key order until the source's token budget is spent. Whole epochs come
first: a budget of 2.4 times the source takes every document twice, then 0.4 of them by key.

The running sum is spread over many tasks: keys are cut into slices that preserve their order,
slices are summed with map-side combine, and each slice then runs its own short window. A source
with a third of all rows therefore never meets in one task.

Defined results: null or blank text has size 0 and takes 0; a null source is a source of its own
and sorts last; repeated rows are mixed as separate rows; an empty table gives an empty result;
a row with a null doc_id draws by its text; equal keys are ordered by doc_id, size and text hash, so
reruns agree whatever the partitioning. Slice sums are written when mix_sources is called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.llm.common import table, tokens, word_count, written

#: Fixed by the result contract: weights by source rank, repeating, and the cap on repeats.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SLICE_ROWS = 4096
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """1 for prose, towards 1/11 as symbols take over; in (0, 1]."""
    length = F.length(text).cast("double")
    symbols = F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("double")
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * F.try_divide(symbols, length)), F.lit(1.0))


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A fixed draw from (0, 1) per document, the same on every run; by the text where the id is null."""
    by_text = F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), by_text)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_EPOCHS) -> DataFrame:
    """(source_key, source, source_size) to the same plus target: shares by weight, capped, excess reshared.

    Resharing until none is above its cap ends at one level L with target = least(cap, L * weight);
    L follows from the sources ordered by cap / weight. One row per source, so one small window.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    fill = Window.orderBy("ratio", "source_key")
    every = Window.partitionBy()
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    sized = sizes.withColumn("weight", weight).withColumn("ceiling", F.lit(float(cap)) * F.col("source_size"))
    ranked = sized.withColumn("ratio", F.col("ceiling") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("level", level)
    # the first source that is not full fixes the level; all may be full only when all sizes are 0
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(every)["level"]
    return levelled.withColumn("target", F.least("ceiling", F.coalesce(final, F.lit(0.0)) * F.col("weight"))).select("source_key", "source", "source_size", "target")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_EPOCHS, seed: str = "mix:", weight: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs, and the columns named in carry."""
    slices = max(1, -(-docs.count() // SLICE_ROWS))
    text = F.col("text")
    rate = quality_weight(text) if weight is None else weight
    kept = docs.select(F.col("doc_id"), F.col("source"), word_count(text).alias("size"), rate.alias("rate"), uniform(F.col("doc_id"), text, seed).alias("draw"), F.xxhash64("text").alias("tie"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    keyed = kept.withColumn("sample_key", -F.log("draw") / F.col("rate")).withColumn("source_key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source")))
    # k / (1 + k) rises with k; for rates from 1/11 to 1 no slice gets over 7 times the mean
    sliced = keyed.withColumn("slice", F.least(F.lit(slices - 1), F.floor(F.lit(slices) * F.col("sample_key") / (1 + F.col("sample_key")))).cast("long"))
    sums = written(sliced.groupBy("source_key", "slice").agg(F.sum("size").alias("slice_size"), F.first("source").alias("source")), "mixing-slices")
    upto = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sums.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size"))
    targets = source_targets(sizes, weights, cap).drop("source")
    offsets = sums.select("source_key", "slice", F.coalesce(F.sum("slice_size").over(upto), F.lit(0)).alias("offset")).join(targets, "source_key")
    run = Window.partitionBy("source_key", "slice").orderBy("sample_key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.join(offsets, ["source_key", "slice"]).withColumn("ahead", F.col("offset") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    budget = F.round("target").cast("long")
    epochs = F.coalesce(F.expr("try_divide(cast(round(target) as long), source_size)"), F.lit(0.0)).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("ahead")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows the mix takes, with the columns of docs: whole copies, then the cut one of a source's last document.

    A row is repeated once per taken epoch. The one document per source that the budget cuts keeps
    its first words, joined by single spaces. n_chars follows the text where docs has that column.
    """
    columns = docs.columns
    plan = mix_sources(docs.select("doc_id", "source", "text", F.struct(*columns).alias("whole_row")), carry=("whole_row",), **options)
    whole = F.coalesce(F.try_divide("taken", "size"), F.lit(0.0)).cast("int")
    rest = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    whole_text = F.col("whole_row.text")
    head = F.array_join(F.slice(tokens(whole_text), 1, F.greatest(F.col("cut"), F.lit(1)).cast("int")), " ")
    rows = plan.select(F.explode(copies).alias("cut"), "whole_row").select("cut", "whole_row", F.when(F.col("cut") > 0, head).otherwise(whole_text).alias("new_text"))
    new = {"text": F.col("new_text"), "n_chars": F.when(F.col("cut") > 0, F.length("new_text").cast("long")).otherwise(F.col("whole_row.n_chars")) if "n_chars" in columns else None}
    return rows.select(*[new.get(c, F.col(f"whole_row.`{c}`")).alias(c) for c in columns])


def op6_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * ((length(text)::DOUBLE - length(translate(text, '#*$%&|<>', ''))::DOUBLE) / nullif(length(text)::DOUBLE, 0))), 1.0::DOUBLE) AS rate,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / rate AS sample_key, coalesce(sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / rate, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (3.0::DOUBLE * sum(size)) AS ceiling FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, ceiling / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(weight) OVER (ORDER BY ceiling / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(ceiling, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source LIMIT 1), 0.0::DOUBLE) * weight) AS target FROM l),
b AS (SELECT k.doc_id, k.size, k.ahead, t.source_size, t.target, round(t.target)::BIGINT AS budget, coalesce(floor(round(t.target)::BIGINT / nullif(t.source_size, 0)), 0)::BIGINT AS epochs FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)))::BIGINT AS taken FROM b
"""
