"""Writers of tables, BED and bedGraph. Spark's committer makes a result visible as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tsv(df: DataFrame, path: str, gz: bool = False, null: str = "") -> None:
    flat = df.select(*[F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", null).option("compression", "gzip" if gz else "none").csv(path)


def bed6(df: DataFrame, path: str, name: str, score: str | None = None, strand: str | None = None) -> None:
    out = df.select("chrom", "start0", "end0", F.col(name), F.col(score) if score else F.lit(0), F.col(strand) if strand else F.lit("."))
    out.repartitionByRange("chrom", "start0").sortWithinPartitions("chrom", "start0", "end0").write.mode("overwrite").option("sep", "\t").csv(path)


def bedgraph(df: DataFrame, path: str, value: str, digits: int = 9) -> None:
    out = df.where(F.col(value).isNotNull()).select("chrom", "start0", "end0", F.format_string(f"%.{digits}g", F.col(value).cast("double")))
    out.repartitionByRange("chrom", "start0").sortWithinPartitions("chrom", "start0", "end0").write.mode("overwrite").option("sep", "\t").csv(path)


def by_class(df: DataFrame, path: str, column: str) -> None:
    """One folder for each level of a class; levels that are gone go."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)
