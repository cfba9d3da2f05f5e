"""Queries of reports, masked backgrounds, ensembles and weighted statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanforge.operators import anchors, effects, intervals as I, knockouts, permutation, reports, sampling, stats
from spanforge.plans import enrichment_queries as E
from spanforge.plans.interval_queries import GENE, MERGED, WIDTH
from spanforge.plans.views import oracle, view
from spanforge.sources.shared import written

HALF, NEAR, DRAWS = 1_000_000, 5_000, 2_000
CELL = ("gene_id", "window_id")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _with_tss(spark: SparkSession, d: str, name: str = "regions") -> DataFrame:
    return view(spark, d, name).join(view(spark, d, "tss").select(*GENE, "tss0", "strand"), list(GENE))


def gene_report(spark: SparkSession, d: str) -> DataFrame:
    """Per customer as gene, those without regions too: regions, distinct tracks, nearest midpoint distance, share of region bp in regions that hold the TSS, median share covered by tracks."""
    names = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("gene_id"))
    rows = _with_tss(spark, d)
    blocks = I.merge(view(spark, d, "tracks").select("chrom", "start0", "end0"), ("chrom",), WIDTH)
    share = I.overlap_stats(rows.select("region_id", "chrom", "start0", "end0"), blocks, ["region_id"], ("chrom",), WIDTH).select("region_id", "covered_bp")
    rows = rows.join(share, "region_id").withColumns({"_far": F.abs(reports.midpoint_distance()), "_in": F.when((F.col("start0") <= F.col("tss0")) & (F.col("tss0") < F.col("end0")), F.col("length")).otherwise(0), "_share": F.col("covered_bp") / F.col("length")})
    sums = rows.groupBy("gene_id").agg(F.count_distinct("annotation").alias("n_classes"), F.min("_far").alias("min_distance"), (F.sum("_in") / F.sum("length")).alias("tss_bp_share"), F.percentile("_share", 0.5).alias("median_covered"))
    return _rounded(reports.counts_with_zeros(names, "gene_id", rows, "n_regions").join(sums, "gene_id", "left"))


def distance_profile(spark: SparkSession, d: str) -> DataFrame:
    """Regions in bins of 100 kb of midpoint distance: number, mean effect, share that increases; with the distal ones apart."""
    rows = _with_tss(spark, d).withColumn("distance", reports.midpoint_distance()).withColumn("is_distal", reports.distal("distance", HALF, NEAR))
    return _rounded(reports.binned_means(rows, ["is_distal"], "distance", 100_000.0, "effect", F.col("direction") == "increase"))


def window_offsets(spark: SparkSession, d: str) -> DataFrame:
    """A gene's first five windows with their centre relative to the TSS and the prediction rebuilt from baseline and change."""
    rows = reports.first_windows(view(spark, d, "windows"), GENE, 5).join(view(spark, d, "tss").select(*GENE, "tss0"), list(GENE))
    rows = rows.withColumns({"baseline": F.lit(3.0), "offset": reports.centre_offset()})
    return _rounded(rows.select("gene_id", "start0", "offset", reports.by_unit("adjusted", "value", "baseline").alias("effect"), reports.reconstructed("baseline", "value").alias("prediction")))


def block_support(spark: SparkSession, d: str) -> DataFrame:
    """Per gene, how many windows hold a repeat that is significant and rises."""
    s = view(spark, d, "scores").withColumns({"z": F.when(F.col("rep") < 4, F.col("delta") / 10), "sign": F.lit(1.0)})
    return reports.block_support(s, ["gene_id"], "window_id", "z", "sign")


def fraction_significant(spark: SparkSession, d: str) -> DataFrame:
    """Share of regions below a cut for each direction and each of three scaled values."""
    r = view(spark, d, "regions").select("direction", (F.col("effect") / 50_000).alias("by_effect"), F.when(F.col("length") > 5_000, F.col("length") / 80_000).alias("by_length"), ((F.col("start0") % 1000) / 1000).alias("by_start"))
    return _rounded(reports.fraction_significant(r, ["direction"], ["by_effect", "by_length", "by_start"], 0.5))


def effect_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reports.describe(view(spark, d, "regions"), ["annotation"], "effect"))


def top_regions(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_rows(view(spark, d, "regions").select("gene_id", "region_id", "start0", "effect"), ["gene_id"], "effect", 3)


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Regions in the top half, quarter, tenth and twentieth of effect within their direction."""
    rows = stats.ranked(view(spark, d, "regions").select("direction", "region_id", "effect", "length"), ["direction"], "effect", ["region_id"], 1024)
    rows = rows.withColumn("rank", F.coalesce(F.try_divide(F.col("_rank") - 1, F.col("_all") - 1), F.lit(0.0)))
    return _rounded(reports.sweep(rows, ["direction"], "rank", (0.5, 0.75, 0.9, 0.95), "length"), 4)


def weighted_jitter(spark: SparkSession, d: str) -> DataFrame:
    """Draws of regions with replacement, by length, with a jittered position inside."""
    r = view(spark, d, "regions")
    found = reports.weighted_draws(r, "region_id", "length", DRAWS, 11).join(r.select("region_id", "start0", "length"), "region_id")
    return found.select("draw", "region_id", F.floor(F.col("start0") + F.col("jitter") * F.col("length")).cast("long").alias("position"))


def json_seeds(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "windows").select("gene_id", "start0", sampling.json_seed(5, F.col("gene_id"), F.col("chrom"), F.col("start0"), F.col("end0"), 0).alias("seed_hex"))


def mask_targets(spark: SparkSession, d: str) -> DataFrame:
    """Masks are a gene's three strongest regions; targets the windows on the others, and its first two windows as controls."""
    masks = reports.top_rows(view(spark, d, "regions").select(*GENE, "region_id", "start0", "end0", "effect"), ["gene_id"], "effect", 3)
    windows = view(spark, d, "windows").select(*GENE, "start0", "end0")
    return knockouts.mask_targets(masks, windows, reports.first_windows(windows, GENE, 2), GENE, WIDTH).groupBy("gene_id", "mask_id", "target_id").agg(F.count("*").alias("n_windows"), F.min("start0").alias("first_start0"))


def knockout_effects(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(knockouts.knockout_effects(view(spark, d, "scores"), CELL))


def pairing_flags(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "scores").withColumn("over", (F.col("window_id") % 7) == 0)
    return knockouts.pairing(s, CELL, "changed_bp", F.col("over"))


def null_plan(spark: SparkSession, d: str) -> DataFrame:
    """The conditions to score: each gene's strongest region and its second as the null, ten seeds each; passes by gene."""
    top = reports.top_rows(view(spark, d, "regions").select("gene_id", "region_id", "start0", "effect"), ["gene_id"], "effect", 2)
    plan = knockouts.null_conditions(top.where("place = 1"), top.where("place = 2"), 10)
    return plan.groupBy("kind", F.substring_index("region_id", "|", 1).alias("gene_id")).agg(F.count("*").alias("n_passes"), F.max("shuffle").alias("last_shuffle"))


def ensemble_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(knockouts.ensemble(view(spark, d, "scores"), CELL, "delta", "masked"))


def diploid_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(knockouts.diploid(view(spark, d, "scores").where("rep < 2"), CELL, "rep", "masked"))


def unit_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Windows' mean and sd in three units; the sd of one repeat is zero."""
    s = view(spark, d, "scores").withColumns({"baseline": F.col("delta") + 12, "prediction": F.col("masked")})
    s = s.select(*CELL, *[c.alias(n) for n, c in effects.transforms("prediction", "baseline").items()])
    units = ("raw_effect", "log1p_effect", "fraction_effect")
    return _rounded(s.groupBy(*CELL).agg(*[f for u in units for f in (F.avg(u).alias(f"{u}_mean"), F.when(F.count(u) > 0, F.coalesce(F.stddev_samp(u), F.lit(0.0))).alias(f"{u}_sd"))]))


def exon_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Tested blocks as exons: their bp and share of each window."""
    w = view(spark, d, "windows").select(*GENE, "start0", "end0")
    return _rounded(knockouts.exon_fraction(w, view(spark, d, "tested"), [*GENE, "start0", "end0"], GENE, WIDTH))


def exon_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(knockouts.exon_coverage(view(spark, d, "tracks"), view(spark, d, "tested"), ["gene_id"], ["chrom"], WIDTH), 4)


def display_slice(spark: SparkSession, d: str) -> DataFrame:
    return knockouts.in_window(view(spark, d, "regions").select("region_id", "chrom", "start0", "end0"), 1_000_000, 1_500_000, 20_000)


def zero_mass_quantile(spark: SparkSession, d: str) -> DataFrame:
    """bp-weighted quantile of a track over whole chromosomes of 3 Mb: bp without signal count as zeros."""
    rows = view(spark, d, "tracks").where("chrom RLIKE '^(chr)?([0-9]+|X|Y)$'").withColumn("bp", F.col("end0") - F.col("start0"))
    return stats.weighted_quantile(stats.with_zero_mass(rows, ["track"], "value", "bp", 40_000_000), ["track"], "value", "bp", 0.97)


def edge_classes(spark: SparkSession, d: str) -> DataFrame:
    """Regions by the class of their edges' distance from the TSS, with the right edge exclusive and inclusive."""
    rows = _with_tss(spark, d).select("region_id", anchors.edge_class(half=20_000).alias("edge_class"), anchors.edge_class(half=20_000, inclusive_end=True).alias("inclusive_class"))
    return rows.groupBy("edge_class", "inclusive_class").agg(F.count("*").alias("n"))


def _gene_shares(spark: SparkSession, d: str) -> DataFrame:
    """(gene_id, track, num, den): regions' covered shares, observed and the mean of the null, summed by gene."""
    held = E.fitting(spark, d)
    each = permutation.by_region(held, E._blocks(spark, d), "track", E.PERMS, E.SEED, ["gene_id", "length"]).withColumnsRenamed({"cov_bp": "o", "null_bp": "n"})
    return written(each.groupBy("gene_id", "track").agg(F.sum(F.round(F.col("o") / F.col("length"), 9).cast("decimal(38,9)")).cast("double").alias("num"), F.sum(F.round(F.col("n") / F.col("length") / E.PERMS, 9).cast("decimal(38,9)")).cast("double").alias("den")), "shares")


def region_weighted_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Every region counts alike: sums of covered shares over their null means, with a bootstrap over genes; a confidence interval from five genes on."""
    found = stats.bootstrap_ratio(_gene_shares(spark, d), ["track"], "gene_id", "num", "den", E.REPLICATES, E.SEED)
    return _rounded(found.select("track", "ratio", "n_entities", *[F.when(F.col("n_entities") >= 5, F.col(c)).alias(c) for c in ("ci_lo", "ci_hi", "p_le1")]), 4)


QUERIES = {
    f.__name__: f
    for f in (gene_report, distance_profile, window_offsets, block_support, fraction_significant, effect_summary, top_regions, threshold_sweep, weighted_jitter, json_seeds, mask_targets, knockout_effects, pairing_flags, null_plan, ensemble_summary, diploid_summary, unit_statistics, exon_fraction, exon_coverage, display_slice, zero_mass_quantile, edge_classes, region_weighted_enrichment)
}

_TOP = "SELECT {cols}, row_number() OVER (PARTITION BY gene_id ORDER BY start0) AS place FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY effect DESC, start0) AS rn FROM regions) t WHERE rn <= {n}"


def _unit(*keys: str) -> str:
    """SQL of sampling.uniform()."""
    return f"(CAST(CAST('0x' || substr(sha256(concat_ws('|', {', '.join(keys)})), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE))"


ORACLE = {
    "gene_report": oracle(
        """blocks AS (SELECT chrom, min(start0) AS start0, max(end0) AS end0 FROM (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS b FROM
  (SELECT chrom, start0, end0, CASE WHEN start0 > max(end0) OVER (PARTITION BY chrom ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM tracks WHERE end0 > start0) x) y GROUP BY chrom, b),
c AS (SELECT region_id, sum(least(r.end0, b.end0) - greatest(r.start0, b.start0)) AS bp FROM regions r JOIN blocks b ON r.chrom = b.chrom AND r.start0 < b.end0 AND b.start0 < r.end0 GROUP BY region_id),
x AS (SELECT r.*, tss0, coalesce(bp, 0) / CAST(length AS DOUBLE) AS share FROM regions r JOIN tss t ON r.gene_id = t.gene_id AND r.chrom = t.chrom LEFT JOIN c USING (region_id)),
g AS (SELECT gene_id, count(*) AS n, count(DISTINCT annotation) AS n_classes, min(abs((start0 + end0) / 2.0 - tss0)) AS far, CAST(sum(CASE WHEN start0 <= tss0 AND tss0 < end0 THEN length ELSE 0 END) AS DOUBLE) / sum(length) AS tss_share, quantile_cont(share, 0.5) AS med FROM x GROUP BY gene_id)
SELECT k.gene_id, CAST(coalesce(n, 0) AS BIGINT) AS n_regions, n_classes, round(CAST(far AS DOUBLE), 6) AS min_distance, round(tss_share, 6) AS tss_bp_share, round(med, 6) AS median_covered FROM (SELECT DISTINCT 'g' || CAST(c_custkey AS VARCHAR) AS gene_id FROM customer) k LEFT JOIN g USING (gene_id)""",
        "regions",
        "tss",
        "tracks",
    ),
    "distance_profile": oracle(
        f"""x AS (SELECT r.*, (r.start0 + r.end0) / 2.0 - tss0 AS distance FROM regions r JOIN tss t ON r.gene_id = t.gene_id AND r.chrom = t.chrom)
SELECT abs(distance) > {NEAR} AND abs(distance) < {HALF} - 1000 AS is_distal, CAST(floor(distance / 100000) AS BIGINT) AS bin, count(*) AS n, round(avg(effect), 6) AS mean_value, round(avg(CASE WHEN direction = 'increase' THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM x GROUP BY 1, 2""",
        "regions",
        "tss",
    ),
    "window_offsets": oracle(
        """f AS (SELECT *, row_number() OVER (PARTITION BY gene_id, chrom ORDER BY start0) AS rn FROM windows)
SELECT f.gene_id, start0, CAST(floor((start0 + end0) / 2) AS BIGINT) - tss0 AS "offset", round(value, 6) AS effect, round(3.0 + value, 6) AS prediction FROM f JOIN tss t ON f.gene_id = t.gene_id AND f.chrom = t.chrom WHERE rn <= 5""",
        "windows",
        "tss",
    ),
    "block_support": oracle("b AS (SELECT gene_id, window_id, max(CASE WHEN rep < 4 AND delta / 10 > 1.96 THEN 1 ELSE 0 END) AS hit FROM scores GROUP BY 1, 2) SELECT gene_id, CAST(sum(hit) AS BIGINT) AS n_support, count(*) AS n_blocks FROM b GROUP BY gene_id", "scores"),
    "fraction_significant": oracle(
        """u AS (SELECT direction, 'by_effect' AS "set", effect / CAST(50000 AS DOUBLE) AS q FROM regions UNION ALL SELECT direction, 'by_length', CASE WHEN length > 5000 THEN length / CAST(80000 AS DOUBLE) END FROM regions UNION ALL SELECT direction, 'by_start', (start0 % 1000) / CAST(1000 AS DOUBLE) FROM regions)
SELECT direction, "set", count(q) AS n, round(avg(CASE WHEN q < 0.5 THEN 1.0 WHEN q IS NOT NULL THEN 0.0 END), 6) AS fraction FROM u GROUP BY 1, 2""",
        "regions",
    ),
    "effect_summary": oracle("SELECT annotation, count(effect) AS n, round(avg(effect), 6) AS mean, round(stddev_samp(effect), 6) AS sd, min(effect) AS min, max(effect) AS max, " + ", ".join(f"round(quantile_cont(effect, {q / 100}), 6) AS q{q:02d}" for q in (10, 25, 50, 75, 90)) + " FROM regions GROUP BY annotation", "regions"),
    "top_regions": oracle(_TOP.format(cols="gene_id, region_id, start0, effect", n=3), "regions"),
    "threshold_sweep": oracle("p AS (SELECT direction, length, percent_rank() OVER (PARTITION BY direction ORDER BY effect) AS pr FROM regions), c AS (SELECT unnest([0.5, 0.75, 0.9, 0.95]) AS cut) SELECT direction, CAST(cut AS DOUBLE) AS cut, count(*) AS n, round(avg(length), 4) AS mean_value FROM p JOIN c ON pr >= CAST(cut AS DOUBLE) GROUP BY 1, 2", "regions"),
    "weighted_jitter": oracle(
        f"""w AS (SELECT region_id, start0, length, sum(length) OVER (ORDER BY substr(sha256(region_id), 1, 3), region_id) - length AS upto, sum(length) OVER () AS total FROM regions),
u AS (SELECT draw, CAST(floor({_unit("'11'", "CAST(draw AS VARCHAR)")} * (SELECT max(total) FROM w)) AS BIGINT) AS at, {_unit("'11'", "CAST(draw AS VARCHAR)", "'jitter'")} AS jitter FROM (SELECT unnest(range(0, {DRAWS})) AS draw) t)
SELECT draw, region_id, CAST(floor(start0 + jitter * length) AS BIGINT) AS position FROM u ASOF JOIN w ON u.at >= w.upto""",
        "regions",
    ),
    "json_seeds": oracle("""SELECT gene_id, start0, sha256('[5, "' || gene_id || '", "' || chrom || '", ' || start0 || ', ' || end0 || ', 0]') AS seed_hex FROM windows""", "windows"),
    "mask_targets": oracle(
        f"""m AS ({_TOP.format(cols="gene_id, chrom, region_id, start0, end0", n=3)}),
t AS (SELECT DISTINCT w.gene_id, w.chrom, m.region_id AS target_id, w.start0, w.end0 FROM windows w JOIN m ON w.gene_id = m.gene_id AND w.chrom = m.chrom AND w.start0 < m.end0 AND m.start0 < w.end0
UNION ALL SELECT gene_id, chrom, 'CONTROL', start0, end0 FROM (SELECT *, row_number() OVER (PARTITION BY gene_id, chrom ORDER BY start0) AS rn FROM windows) f WHERE rn <= 2)
SELECT m.gene_id, m.region_id AS mask_id, target_id, count(*) AS n_windows, min(t.start0) AS first_start0 FROM m JOIN t ON m.gene_id = t.gene_id AND m.chrom = t.chrom WHERE m.region_id <> target_id GROUP BY 1, 2, 3""",
        "regions",
        "windows",
    ),
    "knockout_effects": oracle("SELECT gene_id, window_id, count(delta) AS n_reps, round(avg(-delta), 6) AS knockout_mean, round(stddev_samp(-delta), 6) AS knockout_sd FROM scores GROUP BY 1, 2", "scores"),
    "pairing_flags": oracle("SELECT gene_id, window_id, min(changed_bp) = max(changed_bp) OR window_id % 7 = 0 AS paired FROM scores GROUP BY 1, 2", "scores"),
    "null_plan": oracle(
        f"""t AS ({_TOP.format(cols="gene_id, region_id, start0", n=2)}), c AS (SELECT CASE place WHEN 1 THEN 'hit' ELSE 'null' END AS kind, gene_id, unnest(range(0, 10)) AS shuffle FROM t)
SELECT kind, gene_id, count(*) AS n_passes, CAST(max(shuffle) AS INTEGER) AS last_shuffle FROM c GROUP BY 1, 2""",
        "regions",
    ),
    "ensemble_summary": oracle("SELECT gene_id, window_id, count(delta) AS n_folds, round(avg(delta), 6) AS mean, round(stddev_pop(delta), 6) AS sd_folds, round(avg(masked), 6) AS mean_sd FROM scores GROUP BY 1, 2", "scores"),
    "diploid_summary": oracle("h AS (SELECT gene_id, window_id, rep, avg(masked) AS v FROM scores WHERE rep < 2 GROUP BY 1, 2, 3) SELECT gene_id, window_id, round(avg(v), 6) AS mean, round(CASE WHEN avg(v) > -1 THEN ln(1 + avg(v)) END, 6) AS log1p_mean FROM h GROUP BY 1, 2 HAVING count(DISTINCT rep) = 2", "scores"),
    "unit_statistics": oracle(
        "e AS (SELECT gene_id, window_id, masked - (delta + 12) AS raw_effect, CASE WHEN delta + 13 > 0 THEN ln(1 + masked) - ln(1 + delta + 12) END AS log1p_effect, CASE WHEN delta + 12 > 0 THEN (masked - (delta + 12)) / (delta + 12) END AS fraction_effect FROM scores) SELECT gene_id, window_id, "
        + ", ".join(f"round(avg({u}), 6) AS {u}_mean, round(CASE WHEN count({u}) > 0 THEN coalesce(stddev_samp({u}), 0.0) END, 6) AS {u}_sd" for u in ("raw_effect", "log1p_effect", "fraction_effect"))
        + " FROM e GROUP BY 1, 2",
        "scores",
    ),
    "exon_fraction": oracle(
        """c AS (SELECT w.gene_id, w.chrom, w.start0, w.end0, sum(least(w.end0, t.end0) - greatest(w.start0, t.start0)) AS bp FROM windows w JOIN tested t ON w.gene_id = t.gene_id AND w.chrom = t.chrom AND w.start0 < t.end0 AND t.start0 < w.end0 GROUP BY 1, 2, 3, 4)
SELECT gene_id, chrom, start0, end0, CAST(coalesce(bp, 0) AS BIGINT) AS exonic_bp, round(coalesce(bp, 0) / CAST(end0 - start0 AS DOUBLE), 6) AS exonic_fraction FROM (SELECT gene_id, chrom, start0, end0 FROM windows) w LEFT JOIN c USING (gene_id, chrom, start0, end0)""",
        "windows",
        "tested",
    ),
    "exon_coverage": oracle(
        """m AS (SELECT t.gene_id, sum(value * (least(t.end0, s.end0) - greatest(t.start0, s.start0))) AS mass FROM tested t JOIN tracks s ON t.chrom = s.chrom AND t.start0 < s.end0 AND s.start0 < t.end0 GROUP BY 1), n AS (SELECT gene_id, CAST(sum(end0 - start0) AS BIGINT) AS exon_bp FROM tested GROUP BY 1)
SELECT gene_id, exon_bp, round(CAST(coalesce(mass, 0) AS DOUBLE) / exon_bp, 4) AS mean_coverage FROM n LEFT JOIN m USING (gene_id)""",
        "tested",
        "tracks",
    ),
    "display_slice": oracle("SELECT region_id, chrom, start0, end0, greatest(start0, 980000) AS shown_start0, least(end0, 1520000) AS shown_end0 FROM regions WHERE start0 < 1500000 AND end0 > 1000000", "regions"),
    "zero_mass_quantile": oracle(
        """v AS (SELECT track, value, sum(end0 - start0) AS bp FROM tracks WHERE regexp_matches(chrom, '^(chr)?([0-9]+|X|Y)$') GROUP BY 1, 2 UNION ALL SELECT track, 0, greatest(0, 40000000 - sum(end0 - start0)) FROM tracks WHERE regexp_matches(chrom, '^(chr)?([0-9]+|X|Y)$') GROUP BY 1),
s AS (SELECT track, value, sum(bp) AS w FROM v GROUP BY 1, 2), c AS (SELECT track, value, sum(w) OVER (PARTITION BY track ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY track) AS n FROM s) SELECT track, min(CASE WHEN upto >= n * 0.97 THEN value END) AS quantile FROM c GROUP BY track""",
        "tracks",
    ),
    "edge_classes": oracle(
        """x AS (SELECT r.start0 AS s, r.end0 AS e, tss0 AS t FROM regions r JOIN tss t ON r.gene_id = t.gene_id AND r.chrom = t.chrom)
SELECT CASE WHEN s <= t AND t < e THEN 'TSS_proximal' WHEN least(abs(s - t), abs(e - t)) <= 20000 THEN 'TSS_boundary' ELSE 'distal' END AS edge_class, CASE WHEN s <= t AND t <= e - 1 THEN 'TSS_proximal' WHEN least(abs(s - t), abs(e - 1 - t)) <= 20000 THEN 'TSS_boundary' ELSE 'distal' END AS inclusive_class, count(*) AS n FROM x GROUP BY 1, 2""",
        "regions",
        "tss",
    ),
    "region_weighted_enrichment": oracle(
        f"""{E._BP}, e AS (SELECT split_part(region_id, '|', 1) AS gene_id, track, region_id, CAST(sum(CASE WHEN perm < 0 THEN bp ELSE 0 END) AS DOUBLE) AS o, CAST(sum(CASE WHEN perm >= 0 THEN bp ELSE 0 END) AS DOUBLE) AS n FROM bp GROUP BY 1, 2, 3),
g AS (SELECT gene_id, track, CAST(sum(CAST(round(o / length, 9) AS DECIMAL(38,9))) AS DOUBLE) AS num, CAST(sum(CAST(round(n / length / {E.PERMS}, 9) AS DECIMAL(38,9))) AS DOUBLE) AS den FROM e JOIN (SELECT region_id, length FROM regions) r USING (region_id) GROUP BY 1, 2),
ids AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS i FROM (SELECT DISTINCT gene_id FROM g) x), k AS (SELECT count(*) AS n FROM ids),
dr AS (SELECT rep, CAST(floor(CAST(CAST('0x' || substr(sha256(concat_ws('|', '{E.SEED}', CAST(rep AS VARCHAR), CAST(slot AS VARCHAR))), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE) * n) AS BIGINT) AS i FROM (SELECT unnest(range(0, {E.REPLICATES})) AS rep) a, (SELECT n, unnest(range(0, n)) AS slot FROM k) b),
t AS (SELECT rep, gene_id, count(*) AS times FROM dr JOIN ids USING (i) GROUP BY rep, gene_id), rr AS (SELECT track, rep, sum(num * times) / nullif(sum(den * times), 0) AS r FROM g JOIN t USING (gene_id) GROUP BY track, rep),
ci AS (SELECT track, count(r) AS ok, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi, count(*) FILTER (r <= 1) AS le FROM rr GROUP BY track), po AS (SELECT track, sum(num) / nullif(sum(den), 0) AS ratio, count(DISTINCT gene_id) AS n_entities FROM g GROUP BY track)
SELECT track, round(ratio, 4) AS ratio, n_entities, round(CASE WHEN ok >= 20 AND n_entities >= 5 THEN lo END, 4) AS ci_lo, round(CASE WHEN ok >= 20 AND n_entities >= 5 THEN hi END, 4) AS ci_hi, round(CASE WHEN ok >= 20 AND n_entities >= 5 THEN CAST(1 + le AS DOUBLE) / (1 + ok) END, 4) AS p_le1 FROM po LEFT JOIN ci USING (track)""",
        "regions",
        "tested",
        "tracks",
    ),
}
