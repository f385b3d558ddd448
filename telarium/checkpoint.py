"""The shared folder in which lineage is cut and tables between jobs are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a folder in the warehouse, which a cluster shares too;
    a temporary one is taken only if driver and executors are one process.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            local = context.master.startswith("local") and not context.master.startswith("local-cluster")
            named = tempfile.mkdtemp(prefix="spark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and continue from there."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
