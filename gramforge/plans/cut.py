"""Cut lineage in a way that survives the loss of executors.

Both ways write below the folder that the cluster names in
``spark.checkpoint.dir``, in a folder of this application that :func:`clean`
deletes.  A folder of our own is set only where a local session (tests, single
machine) names none; it is deleted when the program ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gramforge-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{checkpoint_dir(spark)}/gramforge-{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a Parquet table in the shared folder (columnar, so later reads prune columns)."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the tables that :func:`written` made in this application; no result that reads them may be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
