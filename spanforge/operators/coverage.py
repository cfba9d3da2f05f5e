"""Covered bp of very many intervals by two lookups each, instead of a join with every block they overlap.

The blocks' coverage as a function of the position is kept in pieces, by bins: from the start of a block, or of the bin, to the next one. An interval's
covered bp is the function at its end less the function at its start. Both are equi-joins on (keys, bin); the intervals themselves aren't shuffled where the
pieces are small enough for Spark to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

STEP = 1 << 11
LEAST, MOST = -(1 << 62), 1 << 62


def coverage_steps(blocks: DataFrame, by: str, keys: Sequence[str] = ("chrom",), step: int = STEP) -> DataFrame:
    """(keys, lo, hi, bin, by, first, past, s, e, upto) of disjoint ``blocks`` (keys, by, start0, end0): up to a position p in [first, past) they cover upto + max(0, min(p, e) - s).

    Each value of ``by`` has pieces in every bin from lo, before the keys' first block, to hi, beyond the last; these two reach to infinity.
    """
    keys = list(keys)
    bin_of = lambda p: F.floor(p / F.lit(step)).cast("long")
    cut = blocks.select(*keys, by, "start0", "end0").withColumn("bin", F.explode(F.sequence(bin_of(F.col("start0")), bin_of(F.col("end0") - 1))))
    cut = cut.select(*keys, by, "bin", F.greatest("start0", F.col("bin") * step).alias("s"), F.least("end0", (F.col("bin") + 1) * step).alias("e"))
    ends = cut.groupBy(*keys).agg((F.min("bin") - 1).alias("lo"), (F.max("bin") + 1).alias("hi"))
    grid = cut.select(*keys, by).distinct().join(ends, keys).withColumn("bin", F.explode(F.sequence("lo", "hi")))
    sums = cut.groupBy(*keys, by, "bin").agg(F.sum(F.col("e") - F.col("s")).alias("bp"))
    before = F.coalesce(F.sum("bp").over(W.partitionBy(*keys, by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over one row for each bin
    grid = grid.join(sums, [*keys, by, "bin"], "left").withColumn("before", before).drop("bp")
    rows = cut.unionByName(grid.select(*keys, by, "bin", (F.col("bin") * step).alias("s"), (F.col("bin") * step).alias("e")))
    within = W.partitionBy(*keys, by, "bin").orderBy("s", "e")
    rows = rows.withColumns({"past": F.lead("s").over(within), "inner": F.coalesce(F.sum(F.col("e") - F.col("s")).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    past = F.coalesce("past", F.when(F.col("bin") == F.col("hi"), F.lit(MOST)).otherwise((F.col("bin") + 1) * step))
    first = F.when((F.col("bin") == F.col("lo")) & (F.col("s") == F.col("bin") * step), F.lit(LEAST)).otherwise(F.col("s"))
    return rows.join(grid, [*keys, by, "bin"]).select(*keys, "lo", "hi", "bin", by, first.alias("first"), past.alias("past"), "s", "e", (F.col("before") + F.col("inner")).alias("upto")).where("first < past")


def covered(intervals: DataFrame, steps: DataFrame, by: str, keys: Sequence[str] = ("chrom",), step: int = STEP) -> DataFrame:
    """A row for each interval (keys, start0, end0, lo, hi) and each value of ``by`` that covers it, with the ``bp`` covered.

    lo and hi come from bounds(); join them before intervals are multiplied.
    """
    keys = list(keys)
    rows = intervals
    for i, p in enumerate(("start0", "end0")):
        on = [*keys, "_bin", *([by] if i else [])]
        side = steps.select(*keys, F.col("bin").alias("_bin"), by, *(F.col(c).alias(f"_{c}{i}") for c in ("first", "past", "s", "e", "upto")))
        rows = rows.withColumn("_bin", F.greatest("lo", F.least("hi", F.floor(F.col(p) / F.lit(step)).cast("long")))).join(side, on)
        rows = rows.where((F.col(f"_first{i}") <= F.col(p)) & (F.col(p) < F.col(f"_past{i}"))).withColumn(f"_c{i}", F.col(f"_upto{i}") + F.greatest(F.lit(0).cast("long"), F.least(f"_e{i}", p) - F.col(f"_s{i}")))
        rows = rows.drop("_bin", *(f"_{c}{i}" for c in ("first", "past", "s", "e", "upto")))
    return rows.withColumn("bp", F.col("_c1") - F.col("_c0")).where("bp > 0").drop("_c0", "_c1")


def bounds(steps: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """(keys, lo, hi) of steps."""
    return steps.select(*keys, "lo", "hi").distinct()


def areas(steps: DataFrame, by: str, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """coverage_steps() with ``area``: the sum of the coverage function over all positions below each piece's s."""
    keys = list(keys)
    span = F.when(F.col("past") == MOST, 0).otherwise(F.col("past") - F.col("s"))
    rows = steps.withColumn("_inc", F.when(span > 0, _below(F.col("past"))).otherwise(F.lit(0)).cast("long"))
    bins = rows.groupBy(*keys, by, "bin").agg(F.sum("_inc").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*keys, by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over one row for each bin
    within = W.partitionBy(*keys, by, "bin").orderBy("s", "past").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(bins.select(*keys, by, "bin", before.alias("_before")), [*keys, by, "bin"])
    return rows.withColumn("area", (F.col("_before") + F.coalesce(F.sum("_inc").over(within), F.lit(0))).cast("long")).drop("_inc", "_before")


def _below(p: Column) -> Column:
    """The sum of a piece's coverage over its positions from s to before ``p``; none below s."""
    n = F.greatest(F.lit(0).cast("long"), p - F.col("s"))
    ramp = F.least(n, F.col("e") - F.col("s") + 1)
    return F.col("upto") * n + F.floor(ramp * (ramp - 1) / 2).cast("long") + (n - ramp) * (F.col("e") - F.col("s"))


def expected(held: DataFrame, steps: DataFrame, by: str, id_: str = "region_id", keys: Sequence[str] = ("chrom",), step: int = STEP) -> DataFrame:
    """(id, by, expected_bp): the mean covered bp of each interval over all starts at which it fits its blocks, exactly and without a draw.

    held: rows of sampling.fitting_blocks(): id, keys, start0, end0, total, blocks. steps: areas(). The mean is a sum over starts of a difference of the coverage function, so four lookups of its
    own running sum for each block give it, whatever the number of starts and of blocks in between. Intervals without any have no row.
    """
    keys = list(keys)
    length = F.col("end0") - F.col("start0")
    rows = held.join(bounds(steps, keys), keys).select(id_, *keys, "lo", "hi", "total", length.alias("_l"), F.explode("blocks").alias("_b"))
    bs, cnt = F.col("_b.bs"), F.col("_b.cnt")
    points = F.array(*[F.struct(F.lit(sign).alias("sign"), p.alias("p")) for sign, p in ((1, bs + cnt + F.col("_l")), (-1, bs + F.col("_l")), (-1, bs + cnt), (1, bs))])
    spots = rows.select(id_, *keys, "lo", "hi", "total", F.explode(points).alias("_p")).select(id_, *keys, "total", "_p.*", F.greatest("lo", F.least("hi", F.floor(F.col("_p.p") / F.lit(step)).cast("long"))).alias("bin"))
    met = spots.join(steps.drop("lo", "hi"), [*keys, "bin"]).where("first <= p AND p < past")
    value = F.col("sign") * (F.col("area") + _below(F.col("p")))
    found = met.groupBy(id_, by, "total").agg(F.sum(value.cast("decimal(38,0)")).alias("_s"))
    return found.where("_s > 0").select(id_, by, (F.col("_s").cast("double") / F.col("total")).alias("expected_bp"))
