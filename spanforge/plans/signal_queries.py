"""Queries of effects, calibration and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from spanforge.operators import effects, intervals as I, reports, sampling, stats
from spanforge.plans.interval_queries import MERGED, WIDTH
from spanforge.plans.views import oracle, view

CELL = ("gene_id", "window_id")
#: The reference's default.
BINS = 200_000


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def window_repeat_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(effects.repeat_stats(view(spark, d, "scores").withColumn("changed_bp", F.when(F.col("rep") == 4, 0).otherwise(F.col("changed_bp"))), CELL))


def effect_transforms(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "scores").withColumns({"baseline": F.col("delta") + 3, "prediction": F.col("masked")})
    return _rounded(s.select(*CELL, "rep", *[c.alias(n) for n, c in effects.transforms("prediction", "baseline").items()]))


def calibrate_qvalue(spark: SparkSession, d: str) -> DataFrame:
    signal = view(spark, d, "tracks").withColumn("value", F.col("value") / 4.0)
    found = stats.qvalue_cutoff(stats.histogram(signal, ["track"], 0.5, 200), ["track"], 0.5, 0.0005)
    return _rounded(found)


def calibrate_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The bin edge at 97 % of a track's bp, over ``BINS`` bins from 0 to its largest value."""
    found = stats.quantile_cutoff(stats.scaled_histogram(view(spark, d, "tracks"), ["track"], BINS), ["track"], F.col("width"), 0.97)
    return _rounded(found)


def weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    return stats.weighted_quantile(view(spark, d, "tracks").withColumn("bp", F.col("end0") - F.col("start0")), ["track"], "value", "bp", 0.9)


def _shuffles(spark: SparkSession, d: str) -> DataFrame:
    """Scores as scrambles of two reshuffles of a mask; every eleventh window overlaps it, every thirteenth has no valid score."""
    s = view(spark, d, "scores")
    keys = [*CELL, "rep"]
    pairs = effects.epsilon(s.select(*keys, "delta"), s.select(*keys, F.col("masked").alias("delta")), keys)
    found = effects.epsilon_shuffles(pairs.withColumn("rep", F.col("rep") % 2), CELL, 5.0003)
    return found.withColumns({"overlaps_mask": F.col("window_id") % 11 == 0, "valid": (F.col("window_id") * 7 + 1) % 13 != 0})


def epistasis_epsilon(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(effects.epsilon_windows(_shuffles(spark, d), CELL))


def epistasis_region(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(effects.epsilon_regions(_shuffles(spark, d), ["gene_id"]), 9)


def epistasis_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Even windows as hits, odd ones as their nulls."""
    each = effects.epsilon_windows(_shuffles(spark, d), CELL).select("gene_id", "window_id", "epsilon_mean")
    hits, nulls = (each.where(F.col("window_id") % 2 == r).withColumn("target", F.floor(F.col("window_id") / 2).cast("long")) for r in (0, 1))
    return _rounded(effects.against_nulls(hits, nulls, ["gene_id", "target"]))


def effect_quartiles(spark: SparkSession, d: str) -> DataFrame:
    """Regions by quartile of effect within their direction: counts, bp and mean effect."""
    rows = stats.ranked(view(spark, d, "regions"), ["direction"], "effect", ["region_id"], 1024)
    rows = rows.withColumns({"quartile": stats.ntile("_row", "_all", 4), "rank": F.coalesce(F.try_divide(F.col("_rank") - 1, F.col("_all") - 1), F.lit(0.0))})
    return rows.groupBy("direction", "quartile").agg(F.count("*").alias("n"), F.sum("length").alias("total_bp"), F.round(F.avg("effect"), 4).alias("mean_effect"), F.count_if(F.col("rank") >= 0.9).alias("n_top_tenth"))


def track_support_sets(spark: SparkSession, d: str) -> DataFrame:
    """Regions by the list of tracks that touch them."""
    hits = I.range_join(view(spark, d, "regions").select("region_id", "chrom", "start0", "end0"), I.merge(view(spark, d, "tracks"), ("track", "chrom"), WIDTH), ("chrom",), WIDTH).select("region_id", F.col("r_track").alias("track")).distinct()
    lists = hits.groupBy("region_id").agg(F.array_join(F.array_sort(F.collect_list("track")), ";").alias("tracks"), F.count("*").alias("n_tracks"))
    both = view(spark, d, "regions").select("region_id").join(lists, "region_id", "left")
    return both.groupBy(F.coalesce("tracks", F.lit("")).alias("tracks"), F.coalesce("n_tracks", F.lit(0)).alias("n_tracks")).agg(F.count("*").alias("n_regions"))


def ks_distance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.ks(view(spark, d, "regions"), ["annotation"], "direction", ("increase", "decrease"), "effect"))


def spearman_effect(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.spearman(view(spark, d, "regions").select("direction", "effect", "start0"), ["direction"], "effect", "start0"))


def canonical_pick(spark: SparkSession, d: str) -> DataFrame:
    """One region for each gene: increase before decrease before mixed, first event first."""
    rank = F.when(F.col("direction") == "increase", 0).when(F.col("direction") == "decrease", 1).otherwise(2)
    # min_by aggregates before the shuffle, where a window would sort each gene's rows in one task
    best = view(spark, d, "regions").groupBy("gene_id").agg(F.min_by(F.struct("region_id", "direction", "event_id"), F.struct(rank, "event_id")).alias("b"))
    return best.select("gene_id", "b.*")


def keep_last(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "regions").groupBy("gene_id", "annotation").agg(F.max_by("region_id", "event_id").alias("region_id"), F.max("event_id").alias("event_id"))


def fill_forward(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("gene_id", "chrom").orderBy("start0")
    filled = F.last("value", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return view(spark, d, "windows").select("gene_id", "start0", F.round(filled, 4).alias("filled"), F.round(F.cume_dist().over(w), 6).alias("ecdf"))


def id_set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders, suppliers' nations, and their union, intersection and differences as labelled ids."""
    a = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id"))
    b = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "semi": b.distinct().join(a, "id", "left_semi"), "anti": b.distinct().join(a, "id", "left_anti")}
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("op"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "regions").groupBy("gene_id").pivot("direction", ["increase", "decrease", "mixed"]).agg(F.count(F.lit(1)).alias("n")).fillna(0)


def unpivot_long(spark: SparkSession, d: str) -> DataFrame:
    each = view(spark, d, "regions").groupBy("gene_id").agg(F.min("length").alias("min_bp"), F.max("length").alias("max_bp"))
    return each.unpivot(["gene_id"], ["min_bp", "max_bp"], "stat", "bp")


def knee_summary(spark: SparkSession, d: str) -> DataFrame:
    """Barcode-like counts: rows for each user with at least 2, then rank, maximum, median and counts above cutoffs."""
    counts = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 2")
    return counts.agg(F.count("*").alias("n_barcodes"), F.max("n").alias("max_n"), F.round(F.percentile("n", 0.5), 4).alias("median_n"), *(F.count_if(F.col("n") >= c).alias(f"n_ge_{c}") for c in (10, 50, 60, 80)))


def tolerance_match(spark: SparkSession, d: str) -> DataFrame:
    """Per region, how many other regions of its gene begin within 10 kb."""
    r = view(spark, d, "regions").select("region_id", "gene_id", "start0")
    b = lambda c: F.floor(F.col(c) / 10_000)
    left = r.withColumn("_bin", F.explode(F.array(b("start0") - 1, b("start0"), b("start0") + 1)))
    right = r.select("gene_id", F.col("region_id").alias("other"), F.col("start0").alias("s"), b("start0").alias("_bin"))
    near = left.join(right, ["gene_id", "_bin"]).where((F.abs(F.col("start0") - F.col("s")) <= 10_000) & (F.col("region_id") != F.col("other"))).groupBy("region_id").agg(F.count("*").alias("n"))
    return r.select("region_id").join(near, "region_id", "left").select("region_id", F.coalesce("n", F.lit(0)).alias("n_near"))


def json_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by a member of a JSON column, and distinct users."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return spark.read.parquet(f"{d}/events.parquet").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


def window_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of windows and the uniform draws from them."""
    w = view(spark, d, "windows")
    keys = (5, F.col("gene_id"), F.col("start0"), F.col("end0"), 0)
    return w.select("gene_id", "start0", F.substring(F.sha2(F.concat_ws("|", *[k.cast("string") if not isinstance(k, int) else F.lit(str(k)) for k in keys]), 256), 1, 16).alias("seed_hex"), F.round(sampling.uniform(*keys), 9).alias("u"))


def control_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hashed_sample(view(spark, d, "windows").select("gene_id", "start0"), 3, ["gene_id"], 5, ["gene_id", "start0"])


def sequence_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Documents' letters as sequences, permuted with pair counts kept."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lower("text").alias("sequence")).withColumn("seed", sampling.seed_of(5, F.col("doc_id")))
    return sampling.scrambled(docs, "sequence", "seed", True).select("doc_id", F.length("scrambled").alias("n"), F.sha2("scrambled", 256).alias("sha"))


def matched_null_regions(spark: SparkSession, d: str) -> DataFrame:
    """Two null spans for each of a gene's three strongest regions: as long, inside its tested space, with a like share of track A."""
    hits = reports.top_rows(view(spark, d, "regions").select("region_id", "gene_id", "chrom", "start0", "end0", "effect"), ["gene_id"], "effect", 3)
    return sampling.matched_nulls(hits, view(spark, d, "tested"), I.merge(view(spark, d, "tracks").where("track = 'A'"), ("chrom",), WIDTH), per_hit=2, seed=3, width=WIDTH)


QUERIES = {
    f.__name__: f
    for f in (window_repeat_stats, effect_transforms, calibrate_qvalue, calibrate_quantile, weighted_quantile, epistasis_epsilon, epistasis_region, epistasis_nulls, effect_quartiles, track_support_sets, ks_distance, spearman_effect, canonical_pick, keep_last, fill_forward, id_set_ops, pivot_wide, unpivot_long, knee_summary, tolerance_match, json_counts, window_seeds, control_sample, sequence_shuffle, matched_null_regions)
}

_HIST = "h AS (SELECT track, CAST(least(floor(greatest(CAST(value AS DOUBLE) / {div}, 0) / {w}), {nb}) AS BIGINT) AS bin, CAST(sum(end0 - start0) AS BIGINT) AS bp FROM tracks GROUP BY 1, 2)"
_EPS = """sh AS (SELECT gene_id, window_id, rep % 2 AS rep, avg(delta) AS r, avg(masked) AS m, avg(masked - delta) AS e, avg(abs(masked)) > 5.0003 AND avg(abs(delta)) <= 5.0003 AS up, avg(abs(masked)) <= 5.0003 AND avg(abs(delta)) > 5.0003 AS down
  FROM scores WHERE window_id % 11 <> 0 AND (window_id * 7 + 1) % 13 <> 0 GROUP BY 1, 2, 3),
a AS (SELECT *, CASE WHEN sign(e) = sign(avg(e) OVER (PARTITION BY gene_id, window_id)) THEN 1.0 ELSE 0.0 END AS agree FROM sh),
win AS (SELECT gene_id, window_id, count(DISTINCT rep) AS n_reps, avg(r) AS delta_ref, avg(m) AS delta_masked, avg(e) AS epsilon_mean, stddev_samp(e) AS epsilon_sd, avg(agree) AS sign_consistency, avg(CASE WHEN up THEN 1.0 ELSE 0.0 END) AS frac_reps_up, avg(CASE WHEN down THEN 1.0 ELSE 0.0 END) AS frac_reps_down FROM a GROUP BY 1, 2)"""
ORACLE = {
    "window_repeat_stats": oracle(
        """c AS (SELECT gene_id, window_id, CASE WHEN rep = 4 THEN 0 ELSE changed_bp END AS bp, delta FROM scores), x AS (SELECT *, CASE WHEN bp > 0 THEN delta END AS v FROM c)
SELECT gene_id, window_id, count(*) AS n_repeats, count(v) AS n_changed, round(avg(v), 6) AS mean_effect, round(avg(abs(v)), 6) AS mean_abs_effect, round(stddev_samp(v), 6) AS sd_effect, round(avg(CAST(v > 0 AS INTEGER)), 6) AS frac_positive, round(avg(CAST(v < 0 AS INTEGER)), 6) AS frac_negative, round(avg(CASE WHEN bp > 0 THEN bp END), 6) AS mean_changed_bp,
CASE WHEN max(v) > 1e-12 AND min(v) < -1e-12 THEN 'mixed' WHEN max(v) > 1e-12 THEN 'increase' WHEN min(v) < -1e-12 THEN 'decrease' ELSE 'zero' END AS direction, CASE WHEN count(v) > 0 THEN 'tested' ELSE 'unchanged_all_repeats' END AS status FROM x GROUP BY gene_id, window_id""",
        "scores",
    ),
    "effect_transforms": oracle("SELECT gene_id, window_id, rep, round(masked - (delta + 3), 6) AS raw_effect, round(CASE WHEN delta + 4 > 0 THEN ln(1 + masked) - ln(1 + delta + 3) END, 6) AS log1p_effect, round(CASE WHEN delta + 3 > 0 THEN (masked - (delta + 3)) / (delta + 3) END, 6) AS fraction_effect FROM scores", "scores"),
    "calibrate_qvalue": oracle(
        _HIST.format(div=4, w=0.5, nb=199)
        + """, c AS (SELECT track, bin * 0.5 AS edge, bp, sum(bp) OVER (PARTITION BY track) AS n, sum(bp) OVER (PARTITION BY track ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS beyond FROM h),
q AS (SELECT *, min(pow(10.0, -edge) * n / beyond) OVER (PARTITION BY track ORDER BY edge ROWS UNBOUNDED PRECEDING) AS q FROM c), t AS (SELECT track, coalesce(min(CASE WHEN q <= 0.0005 THEN edge END), CAST('inf' AS DOUBLE)) AS threshold, CAST(max(n) AS BIGINT) AS bp_total FROM q GROUP BY track)
SELECT track, CAST(threshold AS DOUBLE) AS threshold, bp_total, CAST(sum(CASE WHEN bin * 0.5 >= threshold THEN bp ELSE 0 END) AS BIGINT) AS bp_active FROM t JOIN h USING (track) GROUP BY 1, 2, 3""",
        "tracks",
    ),
    "calibrate_quantile": oracle(
        f"""x AS (SELECT track, greatest(CAST(value AS DOUBLE), 0) AS v, end0 - start0 AS bp, max(CAST(value AS DOUBLE)) OVER (PARTITION BY track) / {BINS} AS width FROM tracks),
h AS (SELECT track, width, CAST(least(floor(v / width), {BINS - 1}) AS BIGINT) AS bin, sum(bp) AS bp FROM x GROUP BY 1, 2, 3),
c AS (SELECT track, width, bin, sum(bp) OVER (PARTITION BY track) AS n, sum(bp) OVER (PARTITION BY track ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto FROM h)
SELECT track, round(min(CASE WHEN upto >= n * 0.97 THEN bin * width END), 6) AS threshold, CAST(max(n) AS BIGINT) AS bp_total FROM c GROUP BY track""",
        "tracks",
    ),
    "weighted_quantile": oracle("s AS (SELECT track, value, sum(end0 - start0) AS w FROM tracks GROUP BY 1, 2), c AS (SELECT track, value, sum(w) OVER (PARTITION BY track ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY track) AS n FROM s) SELECT track, min(CASE WHEN upto >= n * 0.9 THEN value END) AS quantile FROM c GROUP BY track", "tracks"),
    "epistasis_epsilon": oracle(
        _EPS + " SELECT gene_id, window_id, n_reps, round(delta_ref, 6) AS delta_ref, round(delta_masked, 6) AS delta_masked, round(epsilon_mean, 6) AS epsilon_mean, round(epsilon_sd, 6) AS epsilon_sd, round(sign_consistency, 6) AS sign_consistency, round(frac_reps_up, 6) AS frac_reps_up, round(frac_reps_down, 6) AS frac_reps_down FROM win",
        "scores",
    ),
    "epistasis_region": oracle(
        _EPS
        + """, n AS (SELECT gene_id, count(DISTINCT window_id) AS n_windows FROM sh GROUP BY 1), e1 AS (SELECT gene_id, rep, avg(e) AS e, avg(r) AS r, avg(m) AS m FROM sh GROUP BY 1, 2),
e2 AS (SELECT *, CASE WHEN sign(e) = sign(avg(e) OVER (PARTITION BY gene_id)) THEN 1.0 ELSE 0.0 END AS agree FROM e1)
SELECT gene_id, any_value(n_windows) AS n_windows, count(*) AS n_reps, round(avg(r), 9) AS delta_ref, round(avg(m), 9) AS delta_masked, round(avg(e), 9) AS epsilon_mean, round(stddev_samp(e), 9) AS epsilon_sd_reps, round(avg(agree), 9) AS sign_consistency FROM e2 JOIN n USING (gene_id) GROUP BY gene_id""",
        "scores",
    ),
    "epistasis_nulls": oracle(
        _EPS
        + """, t AS (SELECT gene_id, window_id, epsilon_mean, CAST(floor(window_id / 2) AS BIGINT) AS target FROM win), n AS (SELECT gene_id, target, count(*) AS n_nulls, avg(epsilon_mean) AS null_mean, max(abs(epsilon_mean)) AS null_max_abs FROM t WHERE window_id % 2 = 1 GROUP BY 1, 2)
SELECT t.gene_id, t.target, window_id, round(epsilon_mean, 6) AS epsilon_mean, n_nulls, round(null_mean, 6) AS null_mean, round(null_max_abs, 6) AS null_max_abs, abs(epsilon_mean) > null_max_abs AS exceeds_all_nulls FROM t LEFT JOIN n USING (gene_id, target) WHERE window_id % 2 = 0""",
        "scores",
    ),
    "effect_quartiles": oracle("q AS (SELECT *, ntile(4) OVER (PARTITION BY direction ORDER BY effect, region_id) AS quartile, percent_rank() OVER (PARTITION BY direction ORDER BY effect) AS pr FROM regions) SELECT direction, quartile, count(*) AS n, CAST(sum(length) AS BIGINT) AS total_bp, round(avg(effect), 4) AS mean_effect, count(*) FILTER (pr >= 0.9) AS n_top_tenth FROM q GROUP BY 1, 2", "regions"),
    "track_support_sets": oracle(
        MERGED + ", h AS (SELECT DISTINCT region_id, track FROM regions r JOIN m ON r.chrom = m.chrom AND r.start0 < m.end0 AND m.start0 < r.end0), l AS (SELECT region_id, string_agg(track, ';' ORDER BY track) AS tracks, count(*) AS n_tracks FROM h GROUP BY region_id) SELECT coalesce(tracks, '') AS tracks, coalesce(n_tracks, 0) AS n_tracks, count(*) AS n_regions FROM regions LEFT JOIN l USING (region_id) GROUP BY 1, 2",
        "regions",
        "tracks",
    ),
    "ks_distance": oracle(
        """c AS (SELECT annotation, effect, CAST(count(*) FILTER (direction = 'increase') AS DOUBLE) AS a, CAST(count(*) FILTER (direction = 'decrease') AS DOUBLE) AS b FROM regions GROUP BY 1, 2),
g AS (SELECT annotation, a, b, abs(sum(a) OVER w / nullif(sum(a) OVER v, 0) - sum(b) OVER w / nullif(sum(b) OVER v, 0)) AS gap FROM c WINDOW w AS (PARTITION BY annotation ORDER BY effect ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY annotation))
SELECT annotation, round(max(gap), 6) AS ks, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM g GROUP BY annotation""",
        "regions",
    ),
    "spearman_effect": oracle(
        """k AS (SELECT direction, rank() OVER (PARTITION BY direction ORDER BY effect) + (count(*) OVER (PARTITION BY direction, effect) - 1) / 2.0 AS x, rank() OVER (PARTITION BY direction ORDER BY start0) + (count(*) OVER (PARTITION BY direction, start0) - 1) / 2.0 AS y FROM regions)
SELECT direction, count(*) AS n, round(corr(x, y), 6) AS rho FROM k GROUP BY direction""",
        "regions",
    ),
    "canonical_pick": oracle("k AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY CASE direction WHEN 'increase' THEN 0 WHEN 'decrease' THEN 1 ELSE 2 END, event_id) AS rn FROM regions) SELECT gene_id, region_id, direction, event_id FROM k WHERE rn = 1", "regions"),
    "keep_last": oracle("k AS (SELECT *, row_number() OVER (PARTITION BY gene_id, annotation ORDER BY event_id DESC) AS rn FROM regions) SELECT gene_id, annotation, region_id, event_id FROM k WHERE rn = 1", "regions"),
    "fill_forward": oracle("SELECT gene_id, start0, round(last_value(value IGNORE NULLS) OVER (PARTITION BY gene_id, chrom ORDER BY start0 ROWS UNBOUNDED PRECEDING), 4) AS filled, round(cume_dist() OVER (PARTITION BY gene_id, chrom ORDER BY start0), 6) AS ecdf FROM windows", "windows"),
    "id_set_ops": """WITH a AS (SELECT o_custkey AS id FROM orders), b AS (SELECT user_id AS id FROM events) SELECT 'union' AS op, id FROM (SELECT id FROM a UNION SELECT id FROM b) u UNION ALL SELECT 'intersect', id FROM (SELECT id FROM a INTERSECT SELECT id FROM b) i
UNION ALL SELECT 'except', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b) e UNION ALL SELECT 'semi', id FROM (SELECT DISTINCT id FROM b WHERE id IN (SELECT id FROM a)) s UNION ALL SELECT 'anti', id FROM (SELECT DISTINCT id FROM b WHERE id NOT IN (SELECT id FROM a)) n""",
    "pivot_wide": oracle("SELECT gene_id, count(*) FILTER (direction = 'increase') AS increase, count(*) FILTER (direction = 'decrease') AS decrease, count(*) FILTER (direction = 'mixed') AS mixed FROM regions GROUP BY gene_id", "regions"),
    "unpivot_long": oracle("SELECT gene_id, 'min_bp' AS stat, min(length) AS bp FROM regions GROUP BY gene_id UNION ALL SELECT gene_id, 'max_bp', max(length) FROM regions GROUP BY gene_id", "regions"),
    "knee_summary": "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 2) SELECT count(*) AS n_barcodes, max(n) AS max_n, round(quantile_cont(n, 0.5), 4) AS median_n, count(*) FILTER (n >= 10) AS n_ge_10, count(*) FILTER (n >= 50) AS n_ge_50, count(*) FILTER (n >= 60) AS n_ge_60, count(*) FILTER (n >= 80) AS n_ge_80 FROM c",
    "tolerance_match": oracle("n AS (SELECT a.region_id, count(*) AS n FROM regions a JOIN regions b ON a.gene_id = b.gene_id AND a.region_id <> b.region_id AND abs(a.start0 - b.start0) <= 10000 GROUP BY a.region_id) SELECT region_id, coalesce(n, 0) AS n_near FROM regions LEFT JOIN n USING (region_id)", "regions"),
    "json_counts": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
    "window_seeds": oracle("SELECT gene_id, start0, substr(sha256(concat_ws('|', '5', gene_id, start0, end0, '0')), 1, 16) AS seed_hex, round(CAST(CAST('0x' || substr(sha256(concat_ws('|', '5', gene_id, start0, end0, '0')), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE), 9) AS u FROM windows", "windows"),
    "control_sample": oracle("u AS (SELECT gene_id, start0, row_number() OVER (PARTITION BY gene_id ORDER BY substr(sha256(concat_ws('|', '5', gene_id, start0)), 1, 13), gene_id, start0) AS rn FROM windows) SELECT gene_id, start0 FROM u WHERE rn <= 3", "windows"),
}
