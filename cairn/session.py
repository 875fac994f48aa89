"""What a session needs before the operators run on it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once an application, unless their path has it already."""
    sc = spark.sparkContext
    path = sc._jvm.System.getenv("PYTHONPATH") or ""
    if sc.applicationId in _SHIPPED or str(ROOT.parent) in path.split(os.pathsep):
        return spark
    target = os.path.join(tempfile.mkdtemp(prefix="cairn-"), "cairn.zip")  # the driver's file server hands it out
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written to the folder that the cluster names and read from there; a folder of one's own in local mode only."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A table of the folder. ``wide``: a file that can't be split for all cores is dealt to them, for work that is done
    row by row; a table of as many parts as there are cores is read as it is."""
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if wide and df.rdd.getNumPartitions() < cores else df
