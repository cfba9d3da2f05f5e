"""Effects of perturbed windows: repeat statistics, transforms, paired differences of masked and intact scans, summaries by region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def direction(up: Column, down: Column) -> Column:
    return F.when(up & down, "mixed").when(up, "increase").when(down, "decrease").otherwise("zero")


def transforms(prediction: str, baseline: str) -> dict[str, Column]:
    """Raw, log1p and fractional effects; the fraction is null where the baseline isn't positive."""
    p, b = F.col(prediction), F.col(baseline)
    return {"raw_effect": p - b, "log1p_effect": F.log1p(p) - F.log1p(b), "fraction_effect": F.when(b > 0, (p - b) / b)}


def repeat_stats(scores: DataFrame, keys: Sequence[str], value: str = "delta", changed: str = "changed_bp", sd_of_one: float | None = None, eps: float = 1e-12) -> DataFrame:
    """Per window: repeats, mean, mean absolute, sd (n - 1), share of positive and negative repeats, mean changed bp, direction; null statistics without a changed repeat."""
    v = F.when(F.col(changed) > 0, F.col(value))
    sd = F.stddev_samp(v) if sd_of_one is None else F.coalesce(F.stddev_samp(v), F.lit(sd_of_one))
    up, down = F.max(F.when(v > eps, True).otherwise(False)), F.max(F.when(v < -eps, True).otherwise(False))
    found = scores.groupBy(*keys).agg(
        F.count("*").alias("n_repeats"), F.count(v).alias("n_changed"), F.avg(v).alias("mean_effect"), F.avg(F.abs(v)).alias("mean_abs_effect"), sd.alias("sd_effect"), F.avg((v > 0).cast("double")).alias("frac_positive"), F.avg((v < 0).cast("double")).alias("frac_negative"), F.avg(F.when(F.col(changed) > 0, F.col(changed))).alias("mean_changed_bp"), direction(up, down).alias("direction")
    )
    return found.withColumn("status", F.when(F.col("n_changed") > 0, "tested").otherwise("unchanged_all_repeats"))


def epsilon(reference: DataFrame, masked: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """Paired differences of differences: masked minus reference for each window and repeat."""
    return reference.select(*keys, F.col(value).alias("delta_ref"), *[c for c in reference.columns if c not in (*keys, value)]).join(masked.select(*keys, F.col(value).alias("delta_masked")), list(keys)).withColumn("epsilon", F.col("delta_masked") - F.col("delta_ref"))


def epsilon_shuffles(pairs: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Per window and reshuffle of its mask (rep): means over the window's own scrambles, epsilon's sd, and whether the mean absolute effect crosses the threshold up or down."""
    ref, masked = F.avg(F.abs("delta_ref")), F.avg(F.abs("delta_masked"))
    return pairs.groupBy(*keys, "rep").agg(
        F.avg("delta_ref").alias("delta_ref"),
        F.avg("delta_masked").alias("delta_masked"),
        F.avg("epsilon").alias("epsilon"),
        F.stddev_samp("epsilon").alias("epsilon_sd_scrambles"),
        ((masked > threshold) & (ref <= threshold)).alias("crosses_up"),
        ((masked <= threshold) & (ref > threshold)).alias("crosses_down"),
    )


def usable(shuffles: DataFrame) -> DataFrame:
    """The rows that may be summarised: windows tested on both backgrounds that don't overlap their own mask (where the columns valid and overlaps_mask say so)."""
    for c, keep in (("valid", F.col("valid")), ("overlaps_mask", ~F.col("overlaps_mask"))):
        shuffles = shuffles.where(keep) if c in shuffles.columns else shuffles
    return shuffles


def epsilon_windows(shuffles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per window, over its usable reshuffles: their number, means, sd and sign consistency of epsilon, and the fractions that cross up and down."""
    mean = F.avg("epsilon").over(W.partitionBy(*keys))
    rows = usable(shuffles).withColumn("_agree", (F.signum("epsilon") == F.signum(mean)).cast("double"))
    share = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count_distinct("rep").alias("n_reps"),
        F.avg("delta_ref").alias("delta_ref"),
        F.avg("delta_masked").alias("delta_masked"),
        F.avg("epsilon").alias("epsilon_mean"),
        F.stddev_samp("epsilon").alias("epsilon_sd"),
        F.avg("_agree").alias("sign_consistency"),
        share("crosses_up").alias("frac_reps_up"),
        share("crosses_down").alias("frac_reps_down"),
    )


def epsilon_regions(shuffles: DataFrame, keys: Sequence[str], window: Sequence[str] = ("window_id",)) -> DataFrame:
    """Per region: means of its usable windows within each reshuffle first, then mean and sd over the reshuffles."""
    rows = usable(shuffles)
    each = rows.groupBy(*keys, "rep").agg(F.avg("epsilon").alias("e"), F.avg("delta_ref").alias("r"), F.avg("delta_masked").alias("m"))
    windows = rows.groupBy(*keys).agg(F.count_distinct(*window).alias("n_windows"))
    mean = F.avg("e").over(W.partitionBy(*keys))
    found = each.withColumn("_agree", (F.signum("e") == F.signum(mean)).cast("double")).groupBy(*keys).agg(
        F.count("*").alias("n_reps"), F.avg("r").alias("delta_ref"), F.avg("m").alias("delta_masked"), F.avg("e").alias("epsilon_mean"), F.stddev_samp("e").alias("epsilon_sd_reps"), F.avg("_agree").alias("sign_consistency")
    )
    return windows.join(found, list(keys))


def against_nulls(regions: DataFrame, nulls: DataFrame, keys: Sequence[str], value: str = "epsilon_mean") -> DataFrame:
    """Regions with their matched nulls' count, mean and largest absolute value, and whether they exceed all of them (null without any)."""
    sums = nulls.groupBy(*keys).agg(F.count("*").alias("n_nulls"), F.avg(value).alias("null_mean"), F.max(F.abs(value)).alias("null_max_abs"))
    return regions.join(sums, list(keys), "left").withColumn("exceeds_all_nulls", F.abs(value) > F.col("null_max_abs"))
