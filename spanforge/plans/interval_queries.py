"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanforge.operators import anchors, cumulated, intervals as I
from spanforge.plans.views import oracle, view

WIDTH = 1 << 17
GENE = ("gene_id", "chrom")


def _merged(by: str, source: str, name: str = "m") -> str:
    """SQL of merged blocks of ``source`` by the columns ``by``."""
    return f"""{name}_r AS (SELECT {by}, start0, end0, max(end0) OVER (PARTITION BY {by} ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE end0 > start0),
{name}_b AS (SELECT *, sum(CASE WHEN start0 <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS block FROM {name}_r),
{name} AS (SELECT {by}, min(start0) AS start0, max(end0) AS end0 FROM {name}_b GROUP BY {by}, block)"""


MERGED = _merged("track, chrom", "tracks")


def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return I.merge(view(spark, d, "tracks"), ("track", "chrom"), WIDTH)


def interval_subtract(spark: SparkSession, d: str) -> DataFrame:
    return I.subtract(view(spark, d, "tested"), view(spark, d, "regions"), GENE, WIDTH)


def _by_track(spark: SparkSession, d: str, target: DataFrame) -> DataFrame:
    """Regions x tracks with overlap statistics, zeros included."""
    names = view(spark, d, "tracks").select("track").distinct()
    query = view(spark, d, "regions").select("region_id", "chrom", "start0", "end0").crossJoin(F.broadcast(names))  # a handful of track names
    return I.overlap_stats(query, target, ["region_id", "track"], ["track", "chrom"], WIDTH)


def _counted(spark: SparkSession, d: str) -> DataFrame:
    tracks = view(spark, d, "tracks")
    return cumulated.overlap_counts(view(spark, d, "regions").select("region_id", "chrom", "start0", "end0"), tracks, "track", tracks.select("track").distinct())


def interval_overlap_flag(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).select("region_id", "track", (F.col("n_overlap") > 0).alias("overlaps"))


def interval_overlap_count(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).select("region_id", "track", "n_overlap")


def interval_coverage_bp(spark: SparkSession, d: str) -> DataFrame:
    return _by_track(spark, d, I.merge(view(spark, d, "tracks"), ("track", "chrom"), WIDTH)).select("region_id", "track", "covered_bp")


def coverage_by_gene(spark: SparkSession, d: str) -> DataFrame:
    found = _by_track(spark, d, I.merge(view(spark, d, "tracks"), ("track", "chrom"), WIDTH))
    return found.groupBy(F.substring_index("region_id", "|", 1).alias("gene_id"), "track").agg(F.sum("covered_bp").alias("covered_bp"), F.sum(F.col("end0") - F.col("start0")).alias("region_bp"), F.count_if(F.col("n_overlap") > 0).alias("n_hit"))


def signal_summary_by_region(spark: SparkSession, d: str) -> DataFrame:
    regions, signal = view(spark, d, "regions").select("region_id", "chrom", "start0", "end0"), view(spark, d, "tracks").select("chrom", "start0", "end0", "value")
    found = cumulated.overlap_extremes(cumulated.overlap_mass(regions, signal, "value"), signal, "value", "region_id")
    mean = F.round(F.try_divide(F.col("mass"), F.col("bp")) * 1e6) / 1e6  # as SQL rounds: a half of the last digit, after scaling
    return found.select("region_id", mean.alias("signal_mean"), F.col("most").alias("signal_max"), F.col("least").alias("signal_min"))


def tile_windows(spark: SparkSession, d: str) -> DataFrame:
    return I.tile(view(spark, d, "tss"), 10_500, 2_000, 1_000, "tss0").select("gene_id", "chrom", F.col("window_start0").alias("start0"), F.col("window_end0").alias("end0"))


def smooth_windows(spark: SparkSession, d: str) -> DataFrame:
    found = I.smooth(view(spark, d, "windows"), "value", 3, GENE, stride=50_000)
    return found.select("gene_id", "chrom", "start0", F.round("smoothed", 4).alias("smoothed"))


def project_segments(spark: SparkSession, d: str) -> DataFrame:
    found = I.project(view(spark, d, "windows"), "value", GENE, WIDTH)
    return found.select("gene_id", "chrom", "start0", "end0", F.round("value", 4).alias("value"), "n_windows")


def call_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions called on the mean absolute effect, whose windows' repeats may differ in sign."""
    found = I.call_regions(I.project(view(spark, d, "windows"), "value", GENE, WIDTH, ["size"]), 6000.3, 60_000, "value", GENE, absolute="size")
    rounded = [F.round(c, 3).alias(c) for c in ("mean_abs_effect", "max_abs_effect", "mean_signed_effect", "positive_bp_fraction", "negative_bp_fraction")]
    return found.select("gene_id", "chrom", "start0", "end0", "length_bp", "direction", *rounded)


def tested_space(spark: SparkSession, d: str) -> DataFrame:
    return I.tested_space(view(spark, d, "windows"), "value", GENE, WIDTH)


def near_hit_windows(spark: SparkSession, d: str) -> DataFrame:
    hits = view(spark, d, "regions").where("effect > 30000")
    return I.near_hits(view(spark, d, "windows"), hits, 20_000, GENE, WIDTH).select("gene_id", "chrom", "start0", "is_near")


def gene_territory(spark: SparkSession, d: str) -> DataFrame:
    return I.territory(view(spark, d, "tested"), view(spark, d, "regions"), keys=GENE, width=WIDTH)


def unoverlapped_signal(spark: SparkSession, d: str) -> DataFrame:
    signal = view(spark, d, "canon")
    return I.unoverlapped(signal, ("track", "chrom"), WIDTH)


def pooled_background(spark: SparkSession, d: str) -> DataFrame:
    return I.pooled(view(spark, d, "tested"), ("chrom",), WIDTH)


def background_fraction(spark: SparkSession, d: str) -> DataFrame:
    land = I.merge(view(spark, d, "tested"), GENE, WIDTH)
    found = I.active_fraction(land, view(spark, d, "tracks"), ("track",), GENE, ("chrom",), WIDTH)
    return found.withColumn("active_fraction", F.round("active_fraction", 6))


def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    """Windows' midpoints inside tested blocks."""
    points = view(spark, d, "windows").select("gene_id", "chrom", F.floor((F.col("start0") + F.col("end0")) / 2).cast("long").alias("mid"))
    return anchors.points_in(points, view(spark, d, "tested"), "mid", GENE, WIDTH).select("gene_id", "mid", "start0", "end0")


def tss_nearest(spark: SparkSession, d: str) -> DataFrame:
    return anchors.nearest_anchor(view(spark, d, "regions"), view(spark, d, "tss"), half=1_000).select("region_id", "signed_distance", "edge_distance", "tss_class")


def promoter_overlap(spark: SparkSession, d: str) -> DataFrame:
    both = view(spark, d, "regions").join(view(spark, d, "tss"), ["gene_id", "chrom"])
    return both.select("region_id", *anchors.promoter_columns("tss0", 100_000))


def feature_overlap_bp(spark: SparkSession, d: str) -> DataFrame:
    """bp and fraction of each tested block that lies under any track (union of all)."""
    union = I.merge(view(spark, d, "tracks"), ("chrom",), WIDTH)
    found = I.overlap_stats(view(spark, d, "tested").withColumn("block", F.concat_ws("|", "gene_id", "start0")), union, ["block"], ("chrom",), WIDTH)
    return found.select("block", "covered_bp", F.round(F.try_divide(F.col("covered_bp"), F.col("end0") - F.col("start0")), 6).alias("fraction"))


QUERIES = {f.__name__: f for f in (merge_intervals, interval_subtract, interval_overlap_flag, interval_overlap_count, interval_coverage_bp, coverage_by_gene, signal_summary_by_region, tile_windows, smooth_windows, project_segments, call_regions, tested_space, near_hit_windows, gene_territory, unoverlapped_signal, pooled_background, background_fraction, point_in_interval, tss_nearest, promoter_overlap, feature_overlap_bp)}

_COVER = MERGED + """, cov AS (SELECT region_id, m.track, sum(least(r.end0, m.end0) - greatest(r.start0, m.start0)) AS bp FROM regions r JOIN m ON r.chrom = m.chrom AND r.start0 < m.end0 AND m.start0 < r.end0 GROUP BY region_id, m.track),
grid AS (SELECT region_id, gene_id, length, track FROM regions CROSS JOIN (SELECT DISTINCT track FROM tracks) t), """
_COUNT = """n AS (SELECT region_id, t.track, count(*) AS n FROM regions r JOIN tracks t ON r.chrom = t.chrom AND r.start0 < t.end0 AND t.start0 < r.end0 GROUP BY region_id, t.track),
grid AS (SELECT region_id, track FROM regions CROSS JOIN (SELECT DISTINCT track FROM tracks) t) """
_SEGMENTS = """p AS (SELECT gene_id, chrom, start0 AS p FROM windows UNION SELECT gene_id, chrom, end0 FROM windows),
s AS (SELECT gene_id, chrom, p AS start0, lead(p) OVER (PARTITION BY gene_id, chrom ORDER BY p) AS end0 FROM p),
seg AS (SELECT s.gene_id, s.chrom, s.start0, s.end0, avg(value) AS value, avg(size) AS size, count(*) AS n_windows FROM s JOIN windows w ON s.gene_id = w.gene_id AND s.chrom = w.chrom AND s.start0 < w.end0 AND w.start0 < s.end0 WHERE s.end0 IS NOT NULL
  GROUP BY s.gene_id, s.chrom, s.start0, s.end0 HAVING count(*) = count(value))"""
ORACLE = {
    "merge_intervals": oracle(MERGED + " SELECT * FROM m", "tracks"),
    "interval_subtract": oracle(
        _merged("gene_id, chrom", "regions")
        + """, a AS (SELECT DISTINCT * FROM tested WHERE end0 > start0), h AS (SELECT a.*, greatest(a.start0, m.start0) AS s, least(a.end0, m.end0) AS e FROM a JOIN m ON a.gene_id = m.gene_id AND a.chrom = m.chrom AND a.start0 < m.end0 AND m.start0 < a.end0),
g AS (SELECT gene_id, chrom, coalesce(lag(e) OVER (PARTITION BY gene_id, start0, end0 ORDER BY s), start0) AS f, s AS t FROM h UNION ALL SELECT gene_id, chrom, max(e), end0 FROM h GROUP BY gene_id, chrom, start0, end0
  UNION ALL SELECT gene_id, chrom, start0, end0 FROM a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.gene_id = a.gene_id AND h.start0 = a.start0 AND h.end0 = a.end0))
SELECT gene_id, chrom, f AS start0, t AS end0 FROM g WHERE t > f""",
        "tested",
        "regions",
    ),
    "interval_overlap_flag": oracle(_COUNT + "SELECT region_id, track, coalesce(n, 0) > 0 AS overlaps FROM grid LEFT JOIN n USING (region_id, track)", "regions", "tracks"),
    "interval_overlap_count": oracle(_COUNT + "SELECT region_id, track, coalesce(n, 0) AS n_overlap FROM grid LEFT JOIN n USING (region_id, track)", "regions", "tracks"),
    "interval_coverage_bp": oracle(_COVER + "z AS (SELECT 1) SELECT region_id, track, CAST(coalesce(bp, 0) AS BIGINT) AS covered_bp FROM grid LEFT JOIN cov USING (region_id, track)", "regions", "tracks"),
    "coverage_by_gene": oracle(_COVER + "z AS (SELECT 1) SELECT gene_id, track, CAST(sum(coalesce(bp, 0)) AS BIGINT) AS covered_bp, CAST(sum(length) AS BIGINT) AS region_bp, count(bp) AS n_hit FROM grid LEFT JOIN cov USING (region_id, track) GROUP BY gene_id, track", "regions", "tracks"),
    "signal_summary_by_region": oracle(
        """h AS (SELECT region_id, value, least(r.end0, t.end0) - greatest(r.start0, t.start0) AS bp FROM regions r JOIN tracks t ON r.chrom = t.chrom AND r.start0 < t.end0 AND t.start0 < r.end0),
g AS (SELECT region_id, round(CAST(sum(value * bp) AS DOUBLE) / sum(bp), 6) AS signal_mean, max(value) AS signal_max, min(value) AS signal_min FROM h GROUP BY region_id) SELECT regions.region_id, signal_mean, signal_max, signal_min FROM regions LEFT JOIN g USING (region_id)""",
        "regions",
        "tracks",
    ),
    "tile_windows": oracle("SELECT gene_id, chrom, tss0 + o AS start0, tss0 + o + 2000 AS end0 FROM tss, (SELECT unnest(range(0, 8501, 1000)) AS o UNION SELECT 8500) t", "tss"),
    "smooth_windows": oracle(
        """a AS (SELECT *, CASE WHEN value IS NULL OR lag(value) OVER w IS NULL OR start0 - lag(start0) OVER w <> 50000 THEN 1 ELSE 0 END AS n FROM windows WINDOW w AS (PARTITION BY gene_id, chrom ORDER BY start0)),
i AS (SELECT *, sum(n) OVER (PARTITION BY gene_id, chrom ORDER BY start0 ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT gene_id, chrom, start0, round(CASE WHEN value IS NOT NULL THEN avg(value) OVER (PARTITION BY gene_id, chrom, island ORDER BY start0 ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 4) AS smoothed FROM i""",
        "windows",
    ),
    "project_segments": oracle(_SEGMENTS + " SELECT gene_id, chrom, start0, end0, round(value, 4) AS value, n_windows FROM seg", "windows"),
    "call_regions": oracle(
        _SEGMENTS
        + """, h AS (SELECT *, end0 - start0 AS bp, CASE WHEN lag(end0) OVER (PARTITION BY gene_id, chrom ORDER BY start0) = start0 THEN 0 ELSE 1 END AS n FROM seg WHERE size > 6000.3),
r AS (SELECT *, sum(n) OVER (PARTITION BY gene_id, chrom ORDER BY start0 ROWS UNBOUNDED PRECEDING) AS run FROM h)
SELECT gene_id, chrom, min(start0) AS start0, max(end0) AS end0, CAST(sum(bp) AS BIGINT) AS length_bp, CASE WHEN max(value) > 1e-12 AND min(value) < -1e-12 THEN 'mixed' WHEN max(value) > 1e-12 THEN 'increase' WHEN min(value) < -1e-12 THEN 'decrease' ELSE 'zero' END AS direction,
round(sum(size * bp) / sum(bp), 3) AS mean_abs_effect, round(max(size), 3) AS max_abs_effect, round(sum(value * bp) / sum(bp), 3) AS mean_signed_effect,
round(CAST(sum(CASE WHEN value > 1e-12 THEN bp ELSE 0 END) AS DOUBLE) / sum(bp), 3) AS positive_bp_fraction, round(CAST(sum(CASE WHEN value < -1e-12 THEN bp ELSE 0 END) AS DOUBLE) / sum(bp), 3) AS negative_bp_fraction
FROM r GROUP BY gene_id, chrom, run HAVING sum(bp) >= 60000""",
        "windows",
    ),
    "tested_space": oracle(_SEGMENTS + ", " + _merged("gene_id, chrom", "seg") + " SELECT * FROM m", "windows"),
    "near_hit_windows": oracle("SELECT gene_id, chrom, start0, EXISTS (SELECT 1 FROM regions r WHERE r.effect > 30000 AND r.gene_id = w.gene_id AND r.chrom = w.chrom AND w.start0 < r.end0 + 20000 AND r.start0 - 20000 < w.end0) AS is_near FROM windows w", "windows", "regions"),
    "gene_territory": oracle("u AS (SELECT gene_id, chrom, start0, end0 FROM tested UNION ALL SELECT gene_id, chrom, start0, end0 FROM regions), " + _merged("gene_id, chrom", "u") + " SELECT * FROM m", "tested", "regions"),
    "unoverlapped_signal": oracle("a AS (SELECT track, chrom, greatest(start0, max(end0) OVER (PARTITION BY track, chrom ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS start0, end0 FROM canon) SELECT * FROM a WHERE end0 > start0", "canon"),
    "pooled_background": oracle(_merged("chrom", "tested") + " SELECT chrom, start0, end0, concat('bg_', row_number() OVER (ORDER BY chrom, start0)) AS name FROM m", "tested"),
    "background_fraction": oracle(
        MERGED
        + ", "
        + _merged("gene_id, chrom", "tested", "land")
        + " SELECT track, CAST(sum(least(l.end0, m.end0) - greatest(l.start0, m.start0)) AS BIGINT) AS active_bp, (SELECT CAST(sum(end0 - start0) AS BIGINT) FROM land) AS territory_bp, round(CAST(sum(least(l.end0, m.end0) - greatest(l.start0, m.start0)) AS DOUBLE) / (SELECT sum(end0 - start0) FROM land), 6) AS active_fraction FROM land l JOIN m ON l.chrom = m.chrom AND l.start0 < m.end0 AND m.start0 < l.end0 GROUP BY track",
        "tracks",
        "tested",
    ),
    "point_in_interval": oracle("SELECT w.gene_id, CAST(floor((w.start0 + w.end0) / 2) AS BIGINT) AS mid, t.start0, t.end0 FROM windows w JOIN tested t ON w.gene_id = t.gene_id AND w.chrom = t.chrom AND t.start0 <= floor((w.start0 + w.end0) / 2) AND floor((w.start0 + w.end0) / 2) < t.end0", "windows", "tested"),
    "tss_nearest": oracle(
        """d AS (SELECT region_id, (CAST(floor((start0 + end0) / 2) AS BIGINT) - tss0) * CASE WHEN strand = '-' THEN -1 ELSE 1 END AS sd, least(abs(start0 - tss0), abs(end0 - tss0)) AS ed, start0 <= tss0 AND tss0 < end0 AS inside FROM regions JOIN tss USING (gene_id, chrom))
SELECT region_id, sd AS signed_distance, CASE WHEN inside THEN 0 ELSE ed END AS edge_distance, CASE WHEN inside THEN 'TSS_proximal' WHEN ed <= 1000 THEN 'TSS_boundary' ELSE 'distal' END AS tss_class FROM d""",
        "regions",
        "tss",
    ),
    "promoter_overlap": oracle(
        """o AS (SELECT region_id, length, greatest(0, least(end0, tss0 + 100000) - greatest(start0, tss0 - 100000)) AS bp FROM regions JOIN tss USING (gene_id, chrom))
SELECT region_id, bp AS promoter_overlap_bp, CASE WHEN bp = length THEN 'TSS_proximal' WHEN bp > 0 THEN 'TSS_boundary' ELSE 'distal' END AS promoter_class FROM o""",
        "regions",
        "tss",
    ),
    "feature_overlap_bp": oracle(
        _merged("chrom", "tracks")
        + """, c AS (SELECT gene_id, t.start0, t.end0, sum(CASE WHEN m.start0 IS NOT NULL THEN least(t.end0, m.end0) - greatest(t.start0, m.start0) END) AS bp FROM tested t LEFT JOIN m ON t.chrom = m.chrom AND t.start0 < m.end0 AND m.start0 < t.end0 GROUP BY gene_id, t.start0, t.end0)
SELECT concat_ws('|', gene_id, start0) AS block, CAST(coalesce(bp, 0) AS BIGINT) AS covered_bp, round(CAST(coalesce(bp, 0) AS DOUBLE) / (end0 - start0), 6) AS fraction FROM c""",
        "tested",
        "tracks",
    ),
}
