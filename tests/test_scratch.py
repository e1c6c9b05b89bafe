import time
from pathlib import Path

from canopyspark.operators.scratch import written


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_written_frees_its_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(name)
    found = written(spark.range(5000).groupBy("id").count().repartition(3), "scratch-test")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert found.count() == 5000 and spark.conf.get(name) == setting
