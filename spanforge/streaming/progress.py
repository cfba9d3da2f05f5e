"""Resumable scans and rolling summaries with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def remaining(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a plan whose keys aren't done."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resume(plan: DataFrame, path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], fingerprint: str) -> DataFrame:
    """Does what is left of a plan and appends it to the table at ``path``; rows carry the plan's fingerprint, and another plan's rows there are refused."""
    spark = plan.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # the table doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    if done is not None:
        if not done.where(F.col("fingerprint") != fingerprint).isEmpty():
            raise ValueError("the table was made by another plan")
        plan = remaining(plan, done, keys)
    work(plan).withColumn("fingerprint", F.lit(fingerprint)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def rolling(events: DataFrame, keys: Sequence[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts, sums and means of ``value`` in windows of event time ``ts``; works on streams, where rows later than ``late`` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    found = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # it doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def refused(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The plan's conditions that were done under another fingerprint."""
    was = done.select(*keys, F.col("fingerprint").alias("_was"))
    return plan.join(was, list(keys)).where("fingerprint <> _was").select(*keys)


def left_over(plan: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The conditions of ``plan`` (keys, fingerprint) that resume_conditions() would do at ``path``; those done under another fingerprint are an error that names some of them."""
    done = _table(plan.sparkSession, f"{path}/done")
    if done is None:
        return plan
    stale = [", ".join(map(str, r)) for r in refused(plan, done, keys).limit(5).collect()]
    if stale:
        raise ValueError(f"conditions were done with other settings: {'; '.join(stale)}")
    return remaining(plan, done, keys)


def resume_conditions(plan: DataFrame, path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of all conditions of ``plan`` (keys, fingerprint), of which those that aren't done are worked on now.

    work gives rows with the keys. They are appended to results first, and the conditions to done last, under the run's name; so what a crash leaves between the two is never read, and a repeated run does
    nothing. A condition under another fingerprint is refused; conditions that a plan adds are the only ones worked on.
    """
    spark, run = plan.sparkSession, uuid.uuid4().hex
    left = left_over(plan, path, keys)
    if not left.isEmpty():
        work(left).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/results")
        left.select(*keys, "fingerprint", F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/done")
    done = spark.read.parquet(f"{path}/done").join(plan.select(*keys), list(keys), "left_semi")
    return spark.read.parquet(f"{path}/results").join(done.select(*keys, "run"), [*keys, "run"], "left_semi").drop("run")
