"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from canopyspark.llm.bpe import bpe_stage
from canopyspark.llm.common import written
from canopyspark.llm.jaccard import near_copy_stage
from canopyspark.llm.langid import language_stage
from canopyspark.llm.linededup import line_stage
from canopyspark.llm.mixing import mixed_documents


def mixing_stage(spark, docs, sf_dir):
    """The rows that the mix takes: whole copies per epoch, and the cut document of each source."""
    return mixed_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near copies", near_copy_stage),
    ("mixing", mixing_stage),
    ("BPE", bpe_stage),
]

#: Training a language model and running merges are not expressible in SQL; tests/llm compares
#: each stage with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
