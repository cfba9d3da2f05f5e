"""Masked backgrounds: which windows a mask is scored on, knockout effects, null conditions, ensembles and haplotypes, checks of a scorer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanforge.operators import cumulated
from spanforge.operators.intervals import BIN, merge, overlap_bp, range_join

CONTROL = "CONTROL"


def mask_targets(masks: DataFrame, windows: DataFrame, controls: DataFrame, keys: Sequence[str] = ("gene_id", "chrom"), width: int = BIN) -> DataFrame:
    """(keys, mask_id, target_id, start0, end0): for each mask the windows that overlap another mask of its key, and the key's control windows under the name CONTROL.

    masks: (keys, region_id, start0, end0); windows, controls: (keys, start0, end0).
    """
    keys = list(keys)
    held = range_join(windows.select(*keys, "start0", "end0"), masks.select(*keys, "region_id", "start0", "end0"), keys, width)
    targets = held.select(*keys, F.col("r_region_id").alias("target_id"), "start0", "end0").distinct()
    both = targets.unionByName(controls.select(*keys, F.lit(CONTROL).alias("target_id"), "start0", "end0"))
    return masks.select(*keys, F.col("region_id").alias("mask_id")).join(both, keys).where("mask_id <> target_id")


def knockout_effects(scores: DataFrame, keys: Sequence[str], delta: str = "delta") -> DataFrame:
    """A mask's knockout effect is minus the change that its intact background shows; mean and sd (n - 1) over repeats."""
    effect = -F.col(delta)
    return scores.groupBy(*keys).agg(F.count(delta).alias("n_reps"), F.avg(effect).alias("knockout_mean"), F.stddev_samp(effect).alias("knockout_sd"))


def pairing(scores: DataFrame, keys: Sequence[str], changed: str, overlapping: Column) -> DataFrame:
    """Per key: whether all repeats changed the same number of bp, or the window overlaps its mask."""
    same = F.min(changed).eqNullSafe(F.max(changed))
    return scores.groupBy(*keys).agg((same | F.bool_or(overlapping)).alias("paired"))


def null_conditions(hits: DataFrame, nulls: DataFrame, shuffles: int, id_: str = "region_id") -> DataFrame:
    """(kind, id, shuffle): every hit and every null with each of ``shuffles`` seeds."""
    rows = hits.select(F.lit("hit").alias("kind"), id_).unionByName(nulls.select(F.lit("null").alias("kind"), id_))
    return rows.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))


def ensemble(df: DataFrame, keys: Sequence[str], value: str, sd: str) -> DataFrame:
    """Over folds: their number, mean, sd (n), and the mean of the folds' own sds."""
    return df.groupBy(*keys).agg(F.count(value).alias("n_folds"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_folds"), F.avg(sd).alias("mean_sd"))


def diploid(df: DataFrame, keys: Sequence[str], haplotype: str, value: str) -> DataFrame:
    """Means over two haplotypes, of the keys that have both, and their log1p."""
    each = df.groupBy(*keys, haplotype).agg(F.avg(value).alias("_v"))
    both = each.groupBy(*keys).agg(F.count_distinct(haplotype).alias("_n"), F.avg("_v").alias("mean")).where("_n = 2").drop("_n")
    return both.withColumn("log1p_mean", F.when(F.col("mean") > -1, F.log1p("mean")))


def exon_fraction(windows: DataFrame, exons: DataFrame, id_: Sequence[str], keys: Sequence[str] = ("gene_id", "chrom"), width: int = BIN) -> DataFrame:
    """``windows`` with the bp that the exons' union covers, and the fraction."""
    id_ = list(id_)
    hits = range_join(windows, merge(exons, keys, width), keys, width)
    sums = hits.groupBy(*id_).agg(F.sum(overlap_bp()).alias("_bp"))
    found = windows.join(sums, id_, "left").withColumn("exonic_bp", F.coalesce("_bp", F.lit(0)).cast("long")).drop("_bp")
    return found.withColumn("exonic_fraction", F.try_divide(F.col("exonic_bp"), F.col("end0") - F.col("start0")))


def exon_coverage(signal: DataFrame, exons: DataFrame, gene: Sequence[str], on: Sequence[str] = ("chrom",), width: int = BIN) -> DataFrame:
    """Mean signal over a gene's exon positions (strand is one of ``on`` where the signal has strands); positions without signal count as zero."""
    gene, on = list(gene), list(on)
    keys = list(dict.fromkeys([*gene, *on]))
    union = merge(exons, keys, width)
    total = union.groupBy(*gene).agg(F.sum(F.col("end0") - F.col("start0")).alias("exon_bp"))
    signal = signal.select(*on, "start0", "end0", "value")
    if signal.schema["value"].dataType.typeName() in ("byte", "short", "integer", "long"):
        mass = cumulated.overlap_mass(union, signal, "value", on).groupBy(*gene).agg(F.sum("mass").alias("_mass"))
    else:  # running sums of fractions aren't exact
        mass = range_join(union, signal, on, width).groupBy(*gene).agg(F.sum(F.col("r_value") * overlap_bp()).alias("_mass"))
    return total.join(mass, gene, "left").withColumn("mean_coverage", F.coalesce("_mass", F.lit(0)) / F.col("exon_bp")).drop("_mass")


def in_window(features: DataFrame, start: int, end: int, pad: int = 0) -> DataFrame:
    """The features that reach into a window, clipped for display to it and ``pad`` beside it, at zero at least."""
    rows = features.where((F.col("start0") < end) & (F.col("end0") > start))
    return rows.withColumns({"shown_start0": F.greatest("start0", F.lit(max(0, start - pad)).cast("long")), "shown_end0": F.least("end0", F.lit(end + pad).cast("long"))})


def require_noop(df: DataFrame, delta: str, tolerance: float = 1e-6) -> DataFrame:
    """``df``, if a scorer's change on the unchanged reference is zero everywhere."""
    off = df.where(F.abs(F.col(delta)) > tolerance).count()
    if off:
        raise ValueError(f"{off} unchanged sequences have a change")
    return df


def require_reproduced(now: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-4) -> DataFrame:
    """``now``, if its values are those that were stored under the same keys."""
    both = now.select(*keys, F.col(value).alias("_now")).join(stored.select(*keys, F.col(value).alias("_was")), list(keys), "left")
    off = both.where(F.col("_was").isNull() | (F.abs(F.col("_now") - F.col("_was")) > tolerance)).count()
    if off:
        raise ValueError(f"{off} predictions differ from the stored ones")
    return now
