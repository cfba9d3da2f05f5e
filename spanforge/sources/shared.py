"""Tables that a job writes for itself in the folder that the driver and all executors share.

Reading such a table back ends its lineage: it is computed once, plans stay short, and lost executors cost nothing that was written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a local session gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanforge-"))
        found = sc.getCheckpointDir()
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder. It stays until clear()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanforge-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """How many tables this application has written and not cleared; clear() takes it."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables written since mark() gave ``since``, but for the ``keep`` last ones. For the caller, once its results are stored: results read these tables until then."""
    sc, paths = spark.sparkContext, _written.get(spark.sparkContext.applicationId, [])
    gone = paths[since : len(paths) - keep]
    for path in gone:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    paths[since:] = paths[len(paths) - keep :] if keep else []
