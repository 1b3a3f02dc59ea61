"""Session helpers: where shared scratch goes and how workers get this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

BATCH_ROWS = "1000"
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/sparkwave"
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Only where it is unset, as in tests on one machine, is a
    local folder used instead.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        warnings.warn(f"{_CHECKPOINT_KEY} is unset: scratch goes to {_LOCAL_CHECKPOINTS}, which only one machine sees", stacklevel=2)
        spark.sparkContext.setCheckpointDir(_LOCAL_CHECKPOINTS)
    return _LOCAL_CHECKPOINTS


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; nothing else ever writes to it."""
    return f"{shared_dir(spark)}/sparkwave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete every scratch folder of this application. DataFrames that still read them fail afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sparkwave-{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in shared scratch and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    out = scratch_dir(spark, name)
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def materialise_observed(df: DataFrame, name: str, *values: Column) -> tuple[DataFrame, dict]:
    """``materialise``, with named aggregates of all rows, which the tasks that write them gather: no further job.

    The names may be missing where there is no row, as Spark then may drop the part of the plan that gathers.
    """
    seen = Observation()
    return materialise(df.observe(seen, *values), name), seen.get


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, and have rows go there in smaller batches.

    Rows hold whole texts, blocks or blobs here, so 10,000 of them, Spark's default, take much of an executor's memory
    outside its heap. Another number that the session sets is kept.
    """
    if spark.conf.get(_BATCH_KEY) == "10000":
        spark.conf.set(_BATCH_KEY, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="sparkwave-"), "sparkwave_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
