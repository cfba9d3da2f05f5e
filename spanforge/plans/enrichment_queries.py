"""Queries of the permutation enrichment: placements, counts, tables of results, contrasts, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from spanforge.operators import coverage, intervals as I, permutation, sampling, stats
from spanforge.plans.interval_queries import GENE, MERGED, WIDTH
from spanforge.plans.views import oracle, view
from spanforge.sources.shared import written

#: The reference's defaults.
PERMS, REPLICATES, SEED = 1000, 2000, 7
STRATA = ("direction", "len_bin")
#: Placements in a task.
SHARE = 250_000


def fitting(spark: SparkSession, d: str) -> DataFrame:
    """The regions that fit somewhere, with their blocks and levels: a row for each region, written once for all that follows."""
    return written(sampling.fitting_blocks(view(spark, d, "regions"), view(spark, d, "tested"), GENE).withColumn("len_bin", stats.len_bin()).select("region_id", *GENE, "start0", "end0", "length", *STRATA, "total", "blocks"), "fitting")


def _multiplied(held: DataFrame, first: int) -> DataFrame:
    """Every row with each perm from ``first``, dealt so that a task makes about SHARE placements."""
    spark = held.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-held.count() * PERMS // SHARE))
    return held.repartition(parts, "region_id").withColumn("perm", F.explode(F.sequence(F.lit(first), F.lit(PERMS - 1))))


def null_placements(spark: SparkSession, d: str) -> DataFrame:
    return permutation.placement_rows(fitting(spark, d), PERMS, SEED)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return written(I.merge(view(spark, d, "tracks"), ("track", "chrom"), WIDTH), "blocks")


def _track_steps(spark: SparkSession, d: str) -> DataFrame:
    return written(coverage.coverage_steps(I.merge(view(spark, d, "tracks"), ("track", "chrom"), WIDTH), "track"), "steps")


def covered(held: DataFrame, steps: DataFrame, first: int = -1) -> DataFrame:
    """A row for each region of fitting(), observed (perm -1) and placed, and each track that covers it, with its bp."""
    return coverage.covered(sampling.placed(_multiplied(held.join(coverage.bounds(steps), "chrom"), first), SEED), steps, "track")


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(stratum, track, perm) with n_regions, total_bp, n_overlap and cov_bp; combinations without hits are zeros. A table of results, written once."""
    held = fitting(spark, d)
    leaves = permutation.totals(held, _blocks(spark, d), "track", STRATA, PERMS, SEED)
    return counted(held, leaves, view(spark, d, "tracks").select("track").distinct(), STRATA, PERMS)


def counted(held: DataFrame, leaves: DataFrame, names: DataFrame, strata: tuple[str, ...], perms: int) -> DataFrame:
    """counts() from the sums by combination of levels."""
    found = stats.with_strata(leaves, strata).groupBy("stratum", "track", "perm").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    totals = stats.with_strata(held, strata).groupBy("stratum").agg(F.count("*").alias("n_regions"), F.sum("length").alias("total_bp"))
    grid = totals.crossJoin(names).withColumn("perm", F.explode(F.sequence(F.lit(-1), F.lit(perms - 1))))  # strata x tracks x permutations, the rows of the result
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return written(grid.join(found, ["stratum", "track", "perm"], "left").select("stratum", "track", "perm", "n_regions", "total_bp", zero("n").alias("n_overlap"), zero("b").alias("cov_bp")), "counts")


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    all_ = counts(spark, d)
    return all_.where("perm = -1").drop("perm"), all_.where("perm >= 0")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def len_bin_strata(spark: SparkSession, d: str) -> DataFrame:
    """Regions and bp by grouping sets: all, direction, annotation, length bin."""
    regions = view(spark, d, "regions").withColumn("len_bin", stats.len_bin())
    by = regions.groupingSets([[], [F.col("direction")], [F.col("annotation")], [F.col("len_bin")]], "direction", "annotation", "len_bin")
    return by.agg(F.count("*").alias("n_regions"), F.sum("length").alias("total_bp"), F.count_distinct("gene_id").alias("n_genes"))


def null_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d)


def enrichment_by_set(spark: SparkSession, d: str) -> DataFrame:
    observed, null = _split(spark, d)
    found = stats.enrichment(observed.drop("total_bp", "cov_bp"), null, min_n=20)
    return _rounded(found)


def enrichment_cov_by_set(spark: SparkSession, d: str) -> DataFrame:
    observed, null = _split(spark, d)
    return _rounded(stats.coverage_enrichment(observed.drop("n_regions", "n_overlap"), null))


def _log2_by_perm(spark: SparkSession, d: str) -> DataFrame:
    """(stratum, track, perm, value): log2 of covered bp over the null's mean."""
    all_ = counts(spark, d)
    mean = all_.where("perm >= 0").groupBy("stratum", "track").agg(F.avg("cov_bp").alias("m"))
    return all_.join(mean, ["stratum", "track"]).select("stratum", "track", "perm", F.log2((F.col("cov_bp") + stats.PSEUDO_BP) / (F.col("m") + stats.PSEUDO_BP)).alias("value"))


def cov_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Differences of two tracks' covered fractions in a stratum, centred on the placements', which are paired by permutation; their log2 enrichments beside them."""
    return _rounded(stats.coverage_pairs(counts(spark, d)))


def stratum_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Differences of one track's log2 enrichment between two levels of a factor, paired by permutation."""
    values = _log2_by_perm(spark, d).where("stratum <> 'all'").withColumn("factor", F.substring_index("stratum", "=", 1))
    levels = values.select("factor", "stratum").distinct()
    pairs = levels.select("factor", F.col("stratum").alias("stratum_a")).join(levels.select("factor", F.col("stratum").alias("stratum_b")), "factor").where("stratum_a < stratum_b")
    left = values.drop("factor").join(F.broadcast(pairs), F.col("stratum") == F.col("stratum_a")).drop("stratum")
    right = values.drop("factor").join(F.broadcast(pairs), F.col("stratum") == F.col("stratum_b")).drop("stratum")
    found = stats.paired_difference(left, right, ["factor", "stratum_a", "stratum_b", "track"], "value")
    return _rounded(stats.bh(found, "p_two_sided", "q_two_sided", []))


def set_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Regions that two tracks both cover: joint count, Jaccard, null mean, fold, empirical p; with Fisher's exact p."""
    return _rounded(_joint(spark, d, True))


def set_pairwise_counts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_joint(spark, d, False))


def _joint(spark: SparkSession, d: str, exact: bool) -> DataFrame:
    held, steps = fitting(spark, d), _track_steps(spark, d)
    joint = permutation.joint_totals(held, _blocks(spark, d), "track", PERMS, SEED)
    if joint is None:
        rows = covered(held, steps).groupBy("region_id", "perm").agg(F.array_sort(F.collect_list("track")).alias("tracks"))  # a region's placements are in one task already
        pair = lambda x, i: F.transform(F.slice("tracks", i + 2, F.size("tracks")), lambda y: F.struct(x.alias("set_a"), y.alias("set_b")))
        pairs = rows.select("perm", F.explode(F.flatten(F.transform("tracks", pair))).alias("_p")).select("perm", "_p.*")
        joint = pairs.groupBy("set_a", "set_b", "perm").agg(F.count("*").alias("n_both"))
    names = view(spark, d, "tracks").select("track").distinct()
    grid = names.toDF("set_a").join(names.toDF("set_b"), F.expr("set_a < set_b")).withColumn("perm", F.explode(F.sequence(F.lit(-1), F.lit(PERMS - 1))))  # the rows of the result
    joint = written(grid.join(joint, ["set_a", "set_b", "perm"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0))), "joint")
    observed = coverage.covered(held.join(coverage.bounds(steps), "chrom"), steps, "track")
    single = written(observed.groupBy("track").agg(F.count("*").alias("n")), "single")
    n = held.count()
    found = stats.null_summary(joint.where("perm = -1").drop("perm"), joint.where("perm >= 0"), ["set_a", "set_b"], "n_both")
    found = found.join(single.toDF("set_a", "n_a"), "set_a", "left").join(single.toDF("set_b", "n_b"), "set_b", "left").withColumn("n_regions", F.lit(n).cast("long")).fillna(0, ["n_a", "n_b"])
    found = found.withColumns({"jaccard": F.try_divide(F.col("n_both"), F.col("n_a") + F.col("n_b") - F.col("n_both")), "fold_vs_null": F.try_divide(F.col("n_both"), F.col("null_mean"))})
    if not exact:
        return found
    found = found.withColumns({"_b": F.col("n_a") - F.col("n_both"), "_c": F.col("n_b") - F.col("n_both"), "_d": F.col("n_regions") - F.col("n_a") - F.col("n_b") + F.col("n_both")})
    return stats.fisher(found, "n_both", "_b", "_c", "_d").drop("_b", "_c", "_d")


def region_concordance_q(spark: SparkSession, d: str) -> DataFrame:
    """Per region and track: covered bp, its mean under the null, empirical p, q over all regions of a track."""
    held = fitting(spark, d)
    scored = permutation.by_region(held, _blocks(spark, d), "track", PERMS, SEED)
    names = view(spark, d, "tracks").select("track").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    # a track that never covers a region is reached by every placement
    found = held.select("region_id").crossJoin(names).join(scored, ["region_id", "track"], "left").select(  # the rows of the result
        "region_id", "track", zero("cov_bp").alias("cov_bp"), (zero("null_bp") / F.lit(float(PERMS))).alias("exp_cov_bp"), ((1 + F.coalesce("n_ge", F.lit(PERMS))) / F.lit(1.0 + PERMS)).alias("p_cov")
    )
    return _rounded(bh_by_counts(written(found, "concordance"), "p_cov", "q_cov", ["track"]))


def bh_by_counts(df: DataFrame, p: str, q: str, family: list[str]) -> DataFrame:
    """q values of long families: distinct p values are counted first, so windows run over those only."""
    sums = df.groupBy(*family, p).agg(F.count("*").alias("_n"))
    up = W.partitionBy(*family).orderBy(p)
    rows = sums.withColumn("_raw", F.col(p) * F.sum("_n").over(W.partitionBy(*family)) / F.sum("_n").over(up.rowsBetween(W.unboundedPreceding, 0)))
    return df.join(rows.withColumn(q, F.least(F.lit(1.0), F.min("_raw").over(up.rowsBetween(0, W.unboundedFollowing)))).drop("_n", "_raw"), [*family, p])


def length_summary(spark: SparkSession, d: str) -> DataFrame:
    s = stats.with_strata(view(spark, d, "regions").withColumn("len_bin", stats.len_bin()), STRATA)
    found = s.groupBy("stratum").agg(
        F.count("*").alias("n_regions"), F.count_distinct("gene_id").alias("n_genes"), F.sum("length").alias("total_bp"), F.avg("length").alias("mean_bp"), F.percentile("length", 0.5).alias("median_bp"), F.percentile("length", 0.1).alias("q10_bp"), F.percentile("length", 0.9).alias("q90_bp"), F.max("length").alias("max_bp")
    )
    all_bp = F.max(F.when(F.col("stratum") == "all", F.col("total_bp"))).over(_whole())
    return _rounded(found.withColumn("share", F.try_divide(F.col("total_bp"), all_bp)))


def _whole():
    return W.partitionBy(F.lit(0))  # over a table of results


def _gene_counts(spark: SparkSession, d: str) -> DataFrame:
    """(gene_id, track, cov_bp, null_bp): covered bp observed, and the null's sum over permutations; a row for each gene and track, written once."""
    each = permutation.by_region(fitting(spark, d), _blocks(spark, d), "track", PERMS, SEED, ["gene_id"])
    return written(each.groupBy("gene_id", "track").agg(F.sum("cov_bp").alias("cov_bp"), F.sum("null_bp").alias("null_bp")), "genes")


def gene_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    each = _gene_counts(spark, d).withColumns({"num": F.col("cov_bp") * PERMS, "den": F.col("null_bp")})
    return _rounded(stats.bootstrap_ratio(each, ["track"], "gene_id", "num", "den", REPLICATES, SEED))


def gene_signed_rank(spark: SparkSession, d: str) -> DataFrame:
    each = _gene_counts(spark, d).withColumn("log2", F.log2((F.col("cov_bp") + stats.PSEUDO_BP) / (F.col("null_bp") / PERMS + stats.PSEUDO_BP)))
    found = stats.signed_rank_by(each, ["track"], "log2")
    return stats.bh(found, "p_two_sided", "q_two_sided", [])


def gene_level_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Per track: pooled fold, median gene log2, share of genes above zero, genes with any coverage."""
    each = _gene_counts(spark, d).withColumn("log2", F.log2((F.col("cov_bp") + stats.PSEUDO_BP) / (F.col("null_bp") / PERMS + stats.PSEUDO_BP)))
    found = each.groupBy("track").agg(F.count("*").alias("n_genes"), (F.sum("cov_bp") * PERMS / F.sum("null_bp")).alias("fold"), F.percentile("log2", 0.5).alias("median_gene_log2"), F.avg(F.when(F.col("log2") > 0, 1.0).otherwise(0.0)).alias("frac_genes_enriched"), F.count_if(F.col("cov_bp") > 0).alias("n_genes_nonzero"))
    return _rounded(found)


QUERIES = {
    f.__name__: f
    for f in (len_bin_strata, length_summary, null_placements, null_overlap_counts, enrichment_by_set, enrichment_cov_by_set, cov_pairwise, stratum_contrasts, set_pairwise, set_pairwise_counts, region_concordance_q, gene_bootstrap_ci, gene_signed_rank, gene_level_enrichment)
}

_PLACED = f"""fit AS (SELECT r.region_id, r.gene_id, r.chrom, r.length, t.start0 AS bs, t.end0 - t.start0 - r.length + 1 AS cnt FROM regions r JOIN tested t ON r.gene_id = t.gene_id AND r.chrom = t.chrom WHERE t.end0 - t.start0 - r.length + 1 > 0),
cum AS (SELECT *, CAST(coalesce(sum(cnt) OVER (PARTITION BY region_id ORDER BY bs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bef, CAST(sum(cnt) OVER (PARTITION BY region_id) AS BIGINT) AS total FROM fit),
draw AS (SELECT region_id, perm, CAST(floor(CAST(CAST('0x' || substr(sha256(concat_ws('|', '{SEED}', region_id, CAST(perm AS VARCHAR))), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE) * total) AS BIGINT) AS u
  FROM (SELECT DISTINCT region_id, total FROM cum) c, (SELECT unnest(range(0, {PERMS})) AS perm) p),
placed AS (SELECT cum.region_id, gene_id, chrom, perm, bs + u - bef AS start0, bs + u - bef + length AS end0 FROM draw JOIN cum ON draw.region_id = cum.region_id AND bef <= u AND u < bef + cnt)"""
_LEN_BIN = "CASE WHEN length < 5000 THEN 'lt5kb' WHEN length < 20000 THEN '5to20kb' WHEN length < 50000 THEN '20to50kb' ELSE 'ge50kb' END"
#: Covered bp as the difference of the tracks' cumulated coverage at an interval's end and start.
_BP = f"""{_PLACED}, {MERGED}, alls AS (SELECT region_id, chrom, -1 AS perm, start0, end0 FROM regions WHERE region_id IN (SELECT region_id FROM fit) UNION ALL SELECT region_id, chrom, perm, start0, end0 FROM placed),
steps AS (SELECT track, chrom, start0 AS s, end0 AS e, sum(end0 - start0) OVER (PARTITION BY track, chrom ORDER BY start0) - (end0 - start0) AS upto FROM m),
lo AS (SELECT a.region_id, a.perm, t.track, a.chrom, a.end0, coalesce(s.upto + least(a.start0, s.e) - s.s, 0) AS c0 FROM (alls a CROSS JOIN (SELECT DISTINCT track FROM m) t) ASOF LEFT JOIN steps s ON t.track = s.track AND a.chrom = s.chrom AND a.start0 >= s.s),
bp AS (SELECT region_id, perm, track, CAST(bp AS BIGINT) AS bp FROM (SELECT l.region_id, l.perm, l.track, coalesce(s.upto + least(l.end0, s.e) - s.s, 0) - c0 AS bp FROM lo l ASOF LEFT JOIN steps s ON l.track = s.track AND l.chrom = s.chrom AND l.end0 >= s.s) x WHERE bp > 0)"""
_COUNTS = f"""{_BP}, st AS (SELECT region_id, length, unnest(['all', 'direction=' || direction, 'len_bin=' || {_LEN_BIN}]) AS stratum FROM regions WHERE region_id IN (SELECT region_id FROM fit)),
tot AS (SELECT stratum, count(*) AS n_regions, CAST(sum(length) AS BIGINT) AS total_bp FROM st GROUP BY stratum),
cnt AS (SELECT stratum, track, perm, count(*) AS n, sum(bp) AS b FROM bp JOIN st USING (region_id) GROUP BY stratum, track, perm),
counts AS (SELECT stratum, track, perm, n_regions, total_bp, CAST(coalesce(n, 0) AS BIGINT) AS n_overlap, CAST(coalesce(b, 0) AS BIGINT) AS cov_bp FROM tot CROSS JOIN (SELECT DISTINCT track FROM tracks) t CROSS JOIN (SELECT unnest(range(-1, {PERMS})) AS perm) p LEFT JOIN cnt USING (stratum, track, perm))"""
_VIEWS = ("regions", "tested", "tracks")


def _null(value: str, by: str = "stratum, track", source: str = "counts") -> str:
    return f"""o AS (SELECT * FROM {source} WHERE perm = -1), s AS (SELECT {", ".join("n." + c.strip() for c in by.split(","))}, avg(n.{value}) AS null_mean, stddev_samp(n.{value}) AS null_sd, count(*) AS n_perm, count(*) FILTER (n.{value} >= o.{value}) AS ge, count(*) FILTER (n.{value} <= o.{value}) AS le
FROM {source} n JOIN o ON {" AND ".join(f"n.{c.strip()} = o.{c.strip()}" for c in by.split(","))} WHERE n.perm >= 0 GROUP BY {", ".join("n." + c.strip() for c in by.split(","))})"""


def _q(p: str, family: str) -> str:
    """SQL of a q value; ``{p}_raw`` is p * n / rank."""
    part = f"PARTITION BY {family} " if family else ""
    return f"least(1.0, min({p}_raw) OVER ({part}ORDER BY {p} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def _raw(p: str, family: str) -> str:
    part = f"PARTITION BY {family}" if family else ""
    return f"{p} * count(*) OVER ({part}) / row_number() OVER ({part} ORDER BY {p}) AS {p}_raw"


_LOG2 = _COUNTS + ", mu AS (SELECT stratum, track, avg(cov_bp) AS m FROM counts WHERE perm >= 0 GROUP BY stratum, track), v AS (SELECT stratum, track, perm, log2((cov_bp + 0.5) / (m + 0.5)) AS value FROM counts JOIN mu USING (stratum, track))"


def _paired(pair: str, keys: str, family: str) -> str:
    return f"""{pair}, c AS (SELECT {keys}, avg(d) AS mean FROM dd WHERE perm >= 0 GROUP BY {keys}), ob AS (SELECT {keys}, d AS delta FROM dd WHERE perm = -1),
t AS (SELECT {keys}, delta, mean, count(*) AS n, count(*) FILTER (d >= delta) AS ge, count(*) FILTER (d = delta OR abs(d - mean) >= abs(delta - mean)) AS two FROM dd JOIN c USING ({keys}) JOIN ob USING ({keys}) WHERE perm >= 0 GROUP BY {keys}, delta, mean),
p AS (SELECT {keys}, delta, delta - mean AS delta_centred, (1.0 + ge) / (1 + n) AS p_a_greater, (1.0 + two) / (1 + n) AS p_two_sided FROM t), r AS (SELECT *, {_raw('p_two_sided', family)} FROM p)
SELECT {keys}, round(delta, 6) AS delta, round(delta_centred, 6) AS delta_centred, round(p_a_greater, 6) AS p_a_greater, round(p_two_sided, 6) AS p_two_sided, round({_q('p_two_sided', family)}, 6) AS q_two_sided FROM r"""


_GENE = _BP + ", g AS (SELECT split_part(region_id, '|', 1) AS gene_id, track, CAST(sum(CASE WHEN perm < 0 THEN bp ELSE 0 END) AS BIGINT) AS cov_bp, CAST(sum(CASE WHEN perm >= 0 THEN bp ELSE 0 END) AS BIGINT) AS null_bp FROM bp GROUP BY 1, 2)"
_JOINT = f"""{_BP}, names AS (SELECT DISTINCT track FROM tracks), jp AS (SELECT a.track AS set_a, b.track AS set_b, a.perm, count(*) AS n FROM bp a JOIN bp b ON a.region_id = b.region_id AND a.perm = b.perm AND a.track < b.track GROUP BY 1, 2, 3),
j AS (SELECT x.track AS set_a, y.track AS set_b, p.perm, coalesce(n, 0) AS n_both FROM names x JOIN names y ON x.track < y.track CROSS JOIN (SELECT unnest(range(-1, {PERMS})) AS perm) p LEFT JOIN jp ON jp.set_a = x.track AND jp.set_b = y.track AND jp.perm = p.perm),
{_null("n_both", "set_a, set_b", "j")}, one AS (SELECT track, count(*) AS n FROM bp WHERE perm = -1 GROUP BY track)
SELECT set_a, set_b, n_both, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, n_perm, round((1.0 + ge) / (1 + n_perm), 6) AS p_enrich, round((1.0 + le) / (1 + n_perm), 6) AS p_deplete, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, (SELECT count(DISTINCT region_id) FROM fit) AS n_regions,
round(CAST(n_both AS DOUBLE) / nullif(coalesce(a.n, 0) + coalesce(b.n, 0) - n_both, 0), 6) AS jaccard, round(n_both / nullif(null_mean, 0), 6) AS fold_vs_null FROM o JOIN s USING (set_a, set_b) LEFT JOIN one a ON a.track = set_a LEFT JOIN one b ON b.track = set_b"""

ORACLE = {
    "len_bin_strata": oracle(f"SELECT direction, annotation, len_bin, count(*) AS n_regions, CAST(sum(length) AS BIGINT) AS total_bp, count(DISTINCT gene_id) AS n_genes FROM (SELECT *, {_LEN_BIN} AS len_bin FROM regions) r GROUP BY GROUPING SETS ((), (direction), (annotation), (len_bin))", "regions"),
    "length_summary": oracle(
        f"""st AS (SELECT gene_id, length, unnest(['all', 'direction=' || direction, 'len_bin=' || {_LEN_BIN}]) AS stratum FROM regions)
SELECT stratum, count(*) AS n_regions, count(DISTINCT gene_id) AS n_genes, CAST(sum(length) AS BIGINT) AS total_bp, round(avg(length), 6) AS mean_bp, round(quantile_cont(length, 0.5), 6) AS median_bp, round(quantile_cont(length, 0.1), 6) AS q10_bp, round(quantile_cont(length, 0.9), 6) AS q90_bp, max(length) AS max_bp,
round(CAST(sum(length) AS DOUBLE) / (SELECT sum(length) FROM regions), 6) AS share FROM st GROUP BY stratum""",
        "regions",
    ),
    "null_placements": oracle(_PLACED + " SELECT region_id, perm, start0, end0 FROM placed", "regions", "tested"),
    "null_overlap_counts": oracle(_COUNTS + " SELECT * FROM counts", *_VIEWS),
    "enrichment_by_set": oracle(
        _COUNTS
        + ", "
        + _null("n_overlap")
        + f""", e AS (SELECT stratum, track, n_regions, n_overlap, null_mean, null_sd, n_perm, (1.0 + ge) / (1 + n_perm) AS p_enrich, (1.0 + le) / (1 + n_perm) AS p_deplete FROM o JOIN s USING (stratum, track) WHERE n_regions >= 20),
r AS (SELECT *, {_raw('p_enrich', 'stratum')}, {_raw('p_deplete', 'stratum')} FROM e)
SELECT stratum, track, n_regions, n_overlap, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, n_perm, round(p_enrich, 6) AS p_enrich, round(p_deplete, 6) AS p_deplete, round(CAST(n_overlap AS DOUBLE) / n_regions, 6) AS frac_overlap, round(null_mean / n_regions, 6) AS null_mean_frac, round(null_sd / n_regions, 6) AS null_sd_frac,
round(n_overlap / nullif(null_mean, 0), 6) AS fold_enrichment, round((n_overlap - null_mean) / nullif(null_sd, 0), 6) AS z, round({_q('p_enrich', 'stratum')}, 6) AS q_enrich, round({_q('p_deplete', 'stratum')}, 6) AS q_deplete FROM r""",
        *_VIEWS,
    ),
    "enrichment_cov_by_set": oracle(
        _COUNTS
        + ", "
        + _null("cov_bp")
        + f""", e AS (SELECT stratum, track, total_bp, cov_bp, null_mean, null_sd, n_perm, (1.0 + ge) / (1 + n_perm) AS p_enrich, (1.0 + le) / (1 + n_perm) AS p_deplete FROM o JOIN s USING (stratum, track)), r AS (SELECT *, {_raw('p_enrich', 'stratum')}, {_raw('p_deplete', 'stratum')} FROM e)
SELECT stratum, track, total_bp, cov_bp, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, n_perm, round(p_enrich, 6) AS p_enrich, round(p_deplete, 6) AS p_deplete, round(CAST(cov_bp AS DOUBLE) / total_bp, 6) AS frac_covered, round(null_mean / total_bp, 6) AS null_mean_frac, round(cov_bp / nullif(null_mean, 0), 6) AS fold_enrichment,
round(log2((cov_bp + 0.5) / (null_mean + 0.5)), 6) AS log2_enrichment, round({_q('p_enrich', 'stratum')}, 6) AS q_enrich, round({_q('p_deplete', 'stratum')}, 6) AS q_deplete FROM r""",
        *_VIEWS,
    ),
    "cov_pairwise": oracle(
        f"""{_COUNTS}, dd AS (SELECT a.stratum, a.track AS set_a, b.track AS set_b, a.perm, a.n_regions, a.total_bp, a.cov_bp AS ca, b.cov_bp AS cb, a.cov_bp - b.cov_bp AS d FROM counts a JOIN counts b ON a.stratum = b.stratum AND a.perm = b.perm AND a.track < b.track),
mu AS (SELECT stratum, set_a, set_b, avg(ca) AS ma, avg(cb) AS mb, CAST(sum(d) AS BIGINT) AS s, count(*) AS n FROM dd WHERE perm >= 0 GROUP BY 1, 2, 3), ob AS (SELECT stratum, set_a, set_b, n_regions, total_bp, ca, cb, d AS delta FROM dd WHERE perm = -1),
t AS (SELECT stratum, set_a, set_b, count(*) FILTER (d >= delta) AS ge, count(*) FILTER (abs(d * n - s) >= abs(delta * n - s)) AS two FROM dd JOIN mu USING (stratum, set_a, set_b) JOIN ob USING (stratum, set_a, set_b) WHERE perm >= 0 GROUP BY 1, 2, 3),
p AS (SELECT *, (1.0 + ge) / (1 + n) AS p_a_greater, (1.0 + two) / (1 + n) AS p_two_sided, log2((ca + 0.5) / (ma + 0.5)) AS la, log2((cb + 0.5) / (mb + 0.5)) AS lb FROM t JOIN mu USING (stratum, set_a, set_b) JOIN ob USING (stratum, set_a, set_b)),
r AS (SELECT *, {_raw('p_two_sided', 'stratum')} FROM p)
SELECT stratum, set_a, set_b, n_regions, round(CAST(ca AS DOUBLE) / total_bp, 6) AS frac_a, round(CAST(cb AS DOUBLE) / total_bp, 6) AS frac_b, round(ma / total_bp, 6) AS null_mean_frac_a, round(mb / total_bp, 6) AS null_mean_frac_b, round(la, 6) AS log2_enrichment_a, round(lb, 6) AS log2_enrichment_b,
round(la - lb, 6) AS delta_log2_enrichment, round((delta - CAST(s AS DOUBLE) / n) / total_bp, 6) AS diff_in_enrichment_frac, round(p_a_greater, 6) AS p_a_greater, round(p_two_sided, 6) AS p_two_sided, round({_q('p_two_sided', 'stratum')}, 6) AS q_two_sided FROM r""",
        *_VIEWS,
    ),
    "stratum_contrasts": oracle(
        _paired(
            _LOG2 + ", dd AS (SELECT split_part(a.stratum, '=', 1) AS factor, a.stratum AS stratum_a, b.stratum AS stratum_b, a.track, a.perm, a.value - b.value AS d FROM v a JOIN v b ON a.track = b.track AND a.perm = b.perm AND a.stratum < b.stratum AND split_part(a.stratum, '=', 1) = split_part(b.stratum, '=', 1))",
            "factor, stratum_a, stratum_b, track",
            "",
        ),
        *_VIEWS,
    ),
    "set_pairwise_counts": oracle(_JOINT, *_VIEWS),
    "set_pairwise": oracle(
        _JOINT.replace("\nSELECT set_a, set_b, n_both, round(", ",\nbase AS (SELECT set_a, set_b, n_both, round(", 1)
        + """), l AS (SELECT set_a, set_b, n_both, n_a, lgamma(n_a + 1) - lgamma(k + 1) - lgamma(n_a - k + 1) + lgamma(n_regions - n_a + 1) - lgamma(n_b - k + 1) - lgamma(n_regions - n_a - n_b + k + 1) - lgamma(n_regions + 1) + lgamma(n_b + 1) + lgamma(n_regions - n_b + 1) AS log_p, k
  FROM (SELECT *, unnest(range(greatest(0, n_a + n_b - n_regions), least(n_a, n_b) + 1)) AS k FROM base) t),
fp AS (SELECT l.set_a, l.set_b, least(1.0, sum(exp(l.log_p)) FILTER (l.log_p <= mine.log_p + 1e-7)) AS fisher_p FROM l JOIN l mine ON l.set_a = mine.set_a AND l.set_b = mine.set_b AND mine.k = mine.n_both GROUP BY 1, 2)
SELECT base.*, round(fisher_p, 6) AS fisher_p, round(CAST(n_both AS DOUBLE) * (n_regions - n_a - n_b + n_both) / nullif((n_a - n_both) * CAST(n_b - n_both AS DOUBLE), 0), 6) AS odds_ratio FROM base JOIN fp USING (set_a, set_b)""",
        *_VIEWS,
    ),
    "region_concordance_q": oracle(
        f"""{_BP}, g AS (SELECT region_id, track FROM (SELECT DISTINCT region_id FROM fit) f CROSS JOIN (SELECT DISTINCT track FROM tracks) t), ob AS (SELECT g.region_id, g.track, coalesce(bp, 0) AS cov_bp FROM g LEFT JOIN (SELECT * FROM bp WHERE perm = -1) b USING (region_id, track)),
n AS (SELECT ob.region_id, ob.track, ob.cov_bp, p.perm, coalesce(bp.bp, 0) AS nb FROM ob CROSS JOIN (SELECT unnest(range(0, {PERMS})) AS perm) p LEFT JOIN bp ON bp.region_id = ob.region_id AND bp.track = ob.track AND bp.perm = p.perm),
e AS (SELECT region_id, track, cov_bp, CAST(sum(nb) AS DOUBLE) / {PERMS} AS exp_cov_bp, (1.0 + count(*) FILTER (nb >= cov_bp)) / (1 + {PERMS}) AS p_cov FROM n GROUP BY region_id, track, cov_bp), r AS (SELECT *, {_raw('p_cov', 'track')} FROM e)
SELECT region_id, track, cov_bp, round(exp_cov_bp, 6) AS exp_cov_bp, round(p_cov, 6) AS p_cov, round({_q('p_cov', 'track')}, 6) AS q_cov FROM r""",
        *_VIEWS,
    ),
    "gene_bootstrap_ci": oracle(
        f"""{_GENE}, ids AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS i FROM (SELECT DISTINCT gene_id FROM g) x), k AS (SELECT count(*) AS n FROM ids),
dr AS (SELECT rep, CAST(floor(CAST(CAST('0x' || substr(sha256(concat_ws('|', '{SEED}', CAST(rep AS VARCHAR), CAST(slot AS VARCHAR))), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE) * n) AS BIGINT) AS i FROM (SELECT unnest(range(0, {REPLICATES})) AS rep) a, (SELECT n, unnest(range(0, n)) AS slot FROM k) b),
t AS (SELECT rep, gene_id, count(*) AS times FROM dr JOIN ids USING (i) GROUP BY rep, gene_id), rr AS (SELECT track, rep, CAST(sum(cov_bp * {PERMS} * times) AS DOUBLE) / nullif(sum(null_bp * times), 0) AS r FROM g JOIN t USING (gene_id) GROUP BY track, rep),
ci AS (SELECT track, count(r) AS ok, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi, count(*) FILTER (r <= 1) AS le FROM rr GROUP BY track),
po AS (SELECT track, CAST(sum(cov_bp * {PERMS}) AS DOUBLE) / nullif(sum(null_bp), 0) AS ratio, count(DISTINCT gene_id) AS n_entities FROM g GROUP BY track)
SELECT track, round(ratio, 6) AS ratio, n_entities, round(CASE WHEN ok >= 20 THEN lo END, 6) AS ci_lo, round(CASE WHEN ok >= 20 THEN hi END, 6) AS ci_hi, round(CASE WHEN ok >= 20 THEN CAST(1 + le AS DOUBLE) / (1 + ok) END, 6) AS p_le1 FROM po LEFT JOIN ci USING (track)""",
        *_VIEWS,
    ),
    "gene_level_enrichment": oracle(
        _GENE
        + f""", l AS (SELECT *, log2((cov_bp + 0.5) / (CAST(null_bp AS DOUBLE) / {PERMS} + 0.5)) AS x FROM g)
SELECT track, count(*) AS n_genes, round(CAST(sum(cov_bp) * {PERMS} AS DOUBLE) / sum(null_bp), 6) AS fold, round(quantile_cont(x, 0.5), 6) AS median_gene_log2, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS frac_genes_enriched, count(*) FILTER (cov_bp > 0) AS n_genes_nonzero FROM l GROUP BY track""",
        *_VIEWS,
    ),
}
