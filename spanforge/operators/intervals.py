"""Interval algebra over relations (keys..., start0, end0), half-open and 0-based.

A key such as a chromosome may hold a third of all rows, so no window runs over a whole key: rows are cut into bins of the axis,
windows run within (key, bin), and what one bin hands to the next is a summary of one row for each bin, aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BIN = 1 << 20


def _bin(position: Column | str, width: int) -> Column:
    return F.floor((F.col(position) if isinstance(position, str) else position) / F.lit(width)).cast("long")


def merge(df: DataFrame, keys: Sequence[str] = ("chrom",), width: int = BIN) -> DataFrame:
    """Union of intervals for each key. Touching intervals become one block; empty ones are left out."""
    keys = list(keys)
    rows = df.where("end0 > start0").select(*keys, "start0", "end0").withColumn("_bin", _bin("start0", width))
    before = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy(*keys, "_bin").orderBy("start0", "end0")
    reach = rows.groupBy(*keys, "_bin").agg(F.max("end0").alias("_top")).withColumn("_carry", F.max("_top").over(before)).drop("_top")
    opened = (
        rows.join(reach, [*keys, "_bin"])
        .withColumn("_reach", F.greatest("_carry", F.max("end0").over(within.rowsBetween(W.unboundedPreceding, -1))))
        .withColumn("_open", F.when(F.col("_reach").isNull() | (F.col("start0") > F.col("_reach")), F.col("start0")))
    )
    last = opened.groupBy(*keys, "_bin").agg(F.max("_open").alias("_top")).withColumn("_from", F.max("_top").over(before)).drop("_top")
    block = F.coalesce(F.max("_open").over(within.rowsBetween(W.unboundedPreceding, 0)), "_from")
    return opened.join(last, [*keys, "_bin"]).withColumn("_block", block).groupBy(*keys, F.col("_block").alias("start0")).agg(F.max("end0").alias("end0"))


def coalesce_abutting(df: DataFrame, keys: Sequence[str] = ("chrom",), width: int = BIN) -> DataFrame:
    """Joins segments that abut exactly; for disjoint input this is merge()."""
    return merge(df, keys, width)


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("chrom",), width: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals with equal keys (touching is not overlapping), each once.

    Both sides go to every bin they reach into, so the join is an equi-join on (keys, bin) that Spark can split where it is skewed; a pair belongs to the bin in
    which its overlap begins. Right columns other than the keys are prefixed r_.
    """
    keys = list(keys)
    bins = lambda s, e: F.explode(F.sequence(_bin(s, width), _bin(F.col(e) - 1, width)))
    a = left.where("end0 > start0").withColumn("_bin", bins("start0", "end0"))
    b = right.where("end0 > start0").select(*keys, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys)).withColumn("_bin", bins("r_start0", "r_end0"))
    both = a.join(b, [*keys, "_bin"]).where("start0 < r_end0 AND r_start0 < end0")
    return both.where(_bin(F.greatest("start0", "r_start0"), width) == F.col("_bin")).drop("_bin")


def overlap_bp() -> Column:
    return F.least("end0", "r_end0") - F.greatest("start0", "r_start0")


def overlap_stats(query: DataFrame, target: DataFrame, id_: Sequence[str], keys: Sequence[str] = ("chrom",), width: int = BIN) -> DataFrame:
    """Every row of ``query`` with n_overlap, overlaps (any) and covered_bp (bp of it under ``target``, which is to be merged for that)."""
    id_ = list(id_)
    found = range_join(query.select(*dict.fromkeys([*id_, *keys, "start0", "end0"])), target.select(*dict.fromkeys([*keys, "start0", "end0"])), keys, width)
    sums = found.groupBy(*id_).agg(F.count("*").alias("_n"), F.sum(overlap_bp()).alias("_bp"))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return query.join(sums, id_, "left").withColumns({"n_overlap": n, "overlaps": n > 0, "covered_bp": F.coalesce("_bp", F.lit(0)).cast("long")}).drop("_n", "_bp")


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("chrom",), width: int = BIN) -> DataFrame:
    """The parts of each interval of ``a`` (distinct ones) that no interval of ``b`` covers; ``b`` needn't be merged."""
    keys = list(keys)
    a = a.select(*keys, "start0", "end0").where("end0 > start0").distinct()
    hits = range_join(a, merge(b, keys, width), keys, width).select(*keys, "start0", "end0", F.greatest("start0", "r_start0").alias("_s"), F.least("end0", "r_end0").alias("_e"))
    w = W.partitionBy(*keys, "start0", "end0").orderBy("_s")
    gaps = hits.select(*keys, "start0", "end0", F.coalesce(F.lag("_e").over(w), "start0").alias("_from"), F.col("_s").alias("_to"))
    tails = hits.groupBy(*keys, "start0", "end0").agg(F.max("_e").alias("_from")).select(*keys, "start0", "end0", "_from", F.col("end0").alias("_to"))
    free = a.join(hits.select(*keys, "start0", "end0").distinct(), [*keys, "start0", "end0"], "left_anti").select(*keys, "start0", "end0", F.col("start0").alias("_from"), F.col("end0").alias("_to"))
    return gaps.unionByName(tails).unionByName(free).where("_to > _from").select(*keys, F.col("_from").alias("start0"), F.col("_to").alias("end0"))


def tile(df: DataFrame, length: int, width: int, stride: int, start: str = "start0") -> DataFrame:
    """Windows of ``width`` every ``stride`` over ``length`` from each row's start; a last full window ends at the end."""
    if not 0 < width <= length or stride <= 0:
        raise ValueError("windows must fit the length and move forward")
    last = F.lit(length - width)
    spots = F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))))
    return df.withColumn("_o", F.explode(spots)).withColumns({"window_start0": F.col(start) + F.col("_o"), "window_end0": F.col(start) + F.col("_o") + width}).drop("_o")


def smooth(df: DataFrame, value: str = "value", size: int = 3, keys: Sequence[str] = ("gene_id", "chrom"), stride: int | None = None, beside: Sequence[str] = ()) -> DataFrame:
    """Centred mean of ``size`` windows, cut at the edges, never across a missing value or a gap; adds ``smoothed``, and ``smoothed_<name>`` for each column ``beside``, which is missing where the value is.

    A gap is a start beyond the end of the window before, or, with ``stride``, a step other than it.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError("size must be odd")
    order = W.partitionBy(*keys).orderBy("start0", "end0")
    before = F.col(value).isNull() | F.lag(value).over(order).isNull()
    apart = (F.col("start0") - F.lag("start0").over(order) != stride) if stride else (F.col("start0") > F.lag("end0").over(order))
    rows = df.withColumn("_new", F.when(before | apart, 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    near = W.partitionBy(*keys, "_island").orderBy("start0", "end0").rowsBetween(-(size // 2), size // 2)
    mean = lambda c: F.when(F.col(value).isNotNull(), F.avg(c).over(near))
    return rows.withColumns({"smoothed": mean(value), **{f"smoothed_{c}": mean(c) for c in beside}}).drop("_new", "_island")


def project(df: DataFrame, value: str = "value", keys: Sequence[str] = ("gene_id", "chrom"), width: int = BIN, beside: Sequence[str] = ()) -> DataFrame:
    """Overlapping windows as disjoint segments: value, and what stands ``beside`` it, is the mean of the windows that cover one; a missing value among them blanks it."""
    keys = list(keys)
    points = df.select(*keys, F.col("start0").alias("p")).unionByName(df.select(*keys, F.col("end0").alias("p"))).distinct()
    segments = points.select(*keys, F.col("p").alias("start0"), F.lead("p").over(W.partitionBy(*keys).orderBy("p")).alias("end0")).where("end0 IS NOT NULL")
    held = range_join(segments, df.select(*keys, "start0", "end0", F.col(value).alias("v"), *beside), keys, width)
    found = held.groupBy(*keys, "start0", "end0").agg(F.avg("r_v").alias(value), *[F.avg(f"r_{c}").alias(c) for c in beside], F.count("*").cast("long").alias("n_windows"), F.count("r_v").alias("_valid"))
    return found.where("n_windows = _valid").drop("_valid")


def call_regions(segments: DataFrame, threshold: float, min_bp: int, value: str = "value", keys: Sequence[str] = ("gene_id", "chrom"), eps: float = 1e-12, absolute: str | None = None) -> DataFrame:
    """Runs of abutting segments whose absolute effect is above ``threshold``, of ``min_bp`` at least, with bp-weighted summaries; directions and fractions are the signed ``value``'s.

    absolute: the column of the mean absolute effect, which isn't the absolute of the mean where repeats differ in sign; without it, the value's own.
    """
    order, size = W.partitionBy(*keys).orderBy("start0"), F.col(absolute) if absolute else F.abs(value)
    hits = segments.where(size > threshold)
    runs = hits.withColumn("_new", F.when(F.lag("end0").over(order) == F.col("start0"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    v, bp = F.col(value), F.col("end0") - F.col("start0")
    up, down = F.max(F.when(v > eps, 1).otherwise(0)), F.max(F.when(v < -eps, 1).otherwise(0))
    found = runs.groupBy(*keys, "_run").agg(
        F.min("start0").alias("start0"),
        F.max("end0").alias("end0"),
        F.sum(bp).cast("long").alias("length_bp"),
        (F.sum(size * bp) / F.sum(bp)).alias("mean_abs_effect"),
        F.max(size).alias("max_abs_effect"),
        (F.sum(v * bp) / F.sum(bp)).alias("mean_signed_effect"),
        F.when((up == 1) & (down == 1), "mixed").when(up == 1, "increase").when(down == 1, "decrease").otherwise("zero").alias("direction"),
        (F.sum(F.when(v > eps, bp).otherwise(0)) / F.sum(bp)).alias("positive_bp_fraction"),
        (F.sum(F.when(v < -eps, bp).otherwise(0)) / F.sum(bp)).alias("negative_bp_fraction"),
    )
    return found.where(F.col("length_bp") >= min_bp).drop("_run")


def tested_space(windows: DataFrame, value: str = "value", keys: Sequence[str] = ("gene_id", "chrom"), width: int = BIN) -> DataFrame:
    """Where valid windows support a segment (and no missing one blanks it), abutting parts joined."""
    return coalesce_abutting(project(windows.withColumn("_one", F.when(F.col(value).isNotNull(), 1.0)), "_one", keys, width), keys, width)


def near_hits(windows: DataFrame, hits: DataFrame, flank: int, keys: Sequence[str] = ("gene_id", "chrom"), width: int = BIN) -> DataFrame:
    """``windows`` with is_near: within ``flank`` of a hit."""
    wide = merge(hits.withColumns({"start0": F.col("start0") - flank, "end0": F.col("end0") + flank}), keys, width)
    ids = [*keys, "start0", "end0"]
    return overlap_stats(windows, wide, ids, keys, width).withColumn("is_near", F.col("overlaps")).drop("n_overlap", "overlaps", "covered_bp")


def territory(*parts: DataFrame, keys: Sequence[str] = ("gene_id", "chrom"), width: int = BIN) -> DataFrame:
    """Union of several relations' intervals for each key."""
    out = parts[0].select(*keys, "start0", "end0")
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys, "start0", "end0"))
    return merge(out, keys, width)


def unoverlapped(df: DataFrame, keys: Sequence[str] = ("chrom",), width: int = BIN) -> DataFrame:
    """Sorted signal rows without overlaps: a row begins no earlier than any row before it ends; rows left empty go."""
    keys = list(keys)
    rows = df.withColumn("_bin", _bin("start0", width))
    top = rows.groupBy(*keys, "_bin").agg(F.max("end0").alias("_top")).withColumn("_carry", F.max("_top").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))).drop("_top")
    within = W.partitionBy(*keys, "_bin").orderBy("start0", "end0").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(top, [*keys, "_bin"]).withColumn("start0", F.greatest("start0", "_carry", F.max("end0").over(within))).where("end0 > start0").drop("_bin", "_carry")


def pooled(df: DataFrame, keys: Sequence[str] = ("chrom",), width: int = BIN) -> DataFrame:
    """Merged intervals of all entities with names bg_1, bg_2, ... in the order of the keys and starts.

    Numbers follow from counts of bins, so no window holds all rows.
    """
    keys = list(keys)
    blocks = merge(df, keys, width).withColumn("_bin", _bin("start0", width))
    counts = blocks.groupBy(*keys, "_bin").agg(F.count("*").alias("_rows"))
    chroms = counts.groupBy(*keys).agg(F.sum("_rows").alias("_rows")).withColumn("_first", F.coalesce(F.sum("_rows").over(W.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(counts.withColumn("_before", before).drop("_rows"), [*keys, "_bin"]).join(chroms, keys)
    number = F.col("_first") + F.col("_before") + F.row_number().over(W.partitionBy(*keys, "_bin").orderBy("start0"))
    return placed.withColumn("name", F.concat(F.lit("bg_"), number.cast("string"))).select(*keys, "start0", "end0", "name")


def active_fraction(territory_: DataFrame, active: DataFrame, groups: Sequence[str], keys: Sequence[str] = ("gene_id", "chrom"), on: Sequence[str] = ("chrom",), width: int = BIN) -> DataFrame:
    """Per group of ``active``: bp of the territory, bp of it that is active, and the fraction."""
    keys, groups = list(keys), list(groups)
    total = territory_.agg(F.sum(F.col("end0") - F.col("start0")).alias("territory_bp"))
    hits = range_join(territory_.select(*keys, "start0", "end0"), merge(active, [*groups, *on], width), on, width)
    found = hits.groupBy(*(F.col(f"r_{g}").alias(g) for g in groups)).agg(F.sum(overlap_bp()).cast("long").alias("active_bp"))
    return found.join(F.broadcast(total)).withColumn("active_fraction", F.try_divide(F.col("active_bp"), F.col("territory_bp")))
