"""A stored table follows its input."""

from pyspark.sql import functions as F

from telarium.sources import telemetry as src


def test_stored_follows_its_input(spark, tmp_path):
    at, made = str(tmp_path), []
    for name in ("events", "documents"):
        spark.range(3).write.parquet(f"{at}/{name}.parquet")

    def build():
        made.append(1)
        return spark.read.parquet(f"{at}/events.parquet").withColumn("kind", F.lit("k"))

    count = lambda: src.stored(spark, "t", at, build).count()
    assert count() == 3 and count() == 3 and len(made) == 1
    spark.range(2).write.mode("append").parquet(f"{at}/events.parquet")
    assert count() == 5 and len(made) == 2
    path = [p for k, (p, _) in src._STORED.items() if k[2] == at][-1]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
    assert count() == 5 and len(made) == 3
