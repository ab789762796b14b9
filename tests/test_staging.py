import os
import time

from pyspark.sql import functions as F

from corpusloom.staging import shuffles_removed, stage


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for top in folders for _, _, names in os.walk(top.getPath()) for name in names if name.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before = shuffle_files(spark)
    stored = stage(spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).count(), "counted")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert stored.agg(F.sum("count")).first()[0] == 20_000


def test_the_setting_is_put_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with shuffles_removed(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
