"""Cutting lineage with files that survive a lost executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is the one that the session names in ``spark.checkpoint.dir``. Only where none is named, one is set:
    a temporary folder for a local master, else a folder beside the warehouse, which is shared.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            local = sc.master == "local" or sc.master.startswith("local[")
            named = tempfile.mkdtemp(prefix="lineage") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_lineage"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
