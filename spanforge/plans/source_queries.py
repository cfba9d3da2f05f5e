"""Queries of readers, writers and joins with promises: the driver's tables are written as files in the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanforge.functions import exprs
from spanforge.operators import anchors, intervals as I, joins
from spanforge.plans.interval_queries import GENE, WIDTH
from spanforge.plans.views import oracle, view
from spanforge.sources import readers, sinks
from spanforge.sources.shared import shared_dir, written


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanforge-{name}-{uuid.uuid4().hex}"


def _text(lines: DataFrame, name: str) -> str:
    path = _path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def tsv_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions as a gzipped TSV with a header, read by the region reader."""
    sinks.tsv(view(spark, d, "regions").select(*GENE, "start0", "end0", "direction", "effect"), path := _path(spark, "tsv"), gz=True, null="NA")
    return readers.regions(spark, path).select("region_id", *GENE, "start0", "end0", "length", "direction", F.col("effect").cast("bigint").alias("effect"))


def bed_tested_space(spark: SparkSession, d: str) -> DataFrame:
    """Tested blocks as a headerless four-column BED."""
    lines = view(spark, d, "tested").select(F.concat_ws("\t", "chrom", F.col("start0").cast("string"), F.col("end0").cast("string"), "gene_id").alias("value"))
    return readers.tested_space(spark, _text(lines, "bed"))


def bed6_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors as one-base BED6 by the strict reader, found for versioned targets."""
    tss = view(spark, d, "tss").withColumns({"start0": F.col("tss0"), "end0": F.col("tss0") + 1})
    sinks.bed6(tss, path := _path(spark, "bed6"), "gene_id", strand="strand")
    good, _ = readers.strict_anchors(spark, path)
    names = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("g"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".3").otherwise("")).alias("gene_id"))
    found, missing = readers.match_anchors(names, good)
    return found.select("gene_id", "chrom", "tss0", "strand", F.lit(None).cast("string").alias("reason")).unionByName(missing.select("gene_id", F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("bigint").alias("tss0"), F.lit(None).cast("string").alias("strand"), "reason"))


def bedgraph_signal(spark: SparkSession, d: str) -> DataFrame:
    """Track values as bedGraph, read within the tested space and from 10 on."""
    sinks.bedgraph(view(spark, d, "tracks"), path := _path(spark, "bedgraph"), "value")
    space = I.merge(view(spark, d, "tested").select("chrom", "start0", "end0"), ("chrom",), WIDTH)
    found = readers.bedgraph(spark, path, space, 10.0)
    return found.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("end0") - F.col("start0")).alias("bp"), F.round(F.sum(F.col("value") * (F.col("end0") - F.col("start0"))), 3).alias("mass"))


def class_folders(spark: SparkSession, d: str) -> DataFrame:
    """Regions in one folder for each class, counted from what the folders hold."""
    sinks.by_class(view(spark, d, "regions").select("region_id", "annotation", "length"), path := _path(spark, "classes"), "annotation")
    return spark.read.parquet(path).groupBy("annotation").agg(F.count("*").alias("n"), F.sum("length").alias("bp"))


def keyed_folders(spark: SparkSession, d: str) -> DataFrame:
    """Tables of several files read as one, their key taken from the path, with q values filtered."""
    base = _path(spark, "cells")
    rows = view(spark, d, "regions").select("region_id", "annotation", (F.col("effect") / 50_000).alias("qval"))
    for kind in ("click", "view", "purchase"):
        sinks.tsv(rows.where(F.col("annotation") == kind), f"{base}/cell_{kind}")
    found = readers.keyed_files(spark, f"{base}/cell_*", "cell_type", r"cell_([a-z]+)")
    return found.where(F.col("qval").cast("double") < 0.05).groupBy("cell_type").agg(F.count("*").alias("n"))


def gtf_genes(spark: SparkSession, d: str) -> DataFrame:
    """Regions as transcripts of a GTF: each gene's canonical one, its anchor, symbol and exon union."""
    attributes = F.concat(F.lit('gene_id "'), F.col("gene_id"), F.lit('"; gene_name "'), F.upper("gene_id"), F.lit('"; transcript_id "'), F.col("region_id"), F.lit('"'), F.when(F.col("event_id") % 11 == 0, '; tag "MANE_Select"').when(F.col("event_id") % 7 == 0, '; tag "Ensembl_canonical"').otherwise(""), F.lit(";"))
    row = lambda kind: F.concat_ws("\t", "chrom", F.lit("x"), F.lit(kind), (F.col("start0") + 1).cast("string"), F.col("end0").cast("string"), F.lit("."), F.when(F.substring("gene_id", -1, 1).isin("1", "3", "5"), "-").otherwise("+"), F.lit("."), attributes)
    regions = view(spark, d, "regions")
    # the files' lines in an order that SQL knows: of region_id
    path = _text(regions.select("region_id", F.explode(F.array(row("transcript"), row("exon"))).alias("value")).repartitionByRange(4, "region_id").sortWithinPartitions("region_id").select("value"), "gtf")
    best = readers.canonical_transcripts(readers.gtf(spark, path, "transcript"))
    exons = readers.exon_unions(readers.gtf(spark, path, "exon")).groupBy("gene_id").agg(F.sum(F.col("end0") - F.col("start0")).alias("exon_bp"), F.count("*").alias("n_exons"))
    return best.select("gene_id", "transcript_id", "tss0").join(exons, "gene_id").join(readers.gene_symbols(spark, path), "gene_id")


def fasta_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Documents as contigs of a FASTA file with 60 bases a line; the spans from 40 to 700 of each, padded with N beyond its end."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("s"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.length("s") / 60).cast("int")), lambda i: F.substring("s", i * 60 + 1, F.lit(60)))
    path = _text(docs.select(F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" text\r\n"), F.array_join(cuts, "\r\n")).alias("value")), "fasta")
    wanted = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"), F.lit(40).cast("bigint").alias("start0"), F.lit(700).cast("bigint").alias("end0"))
    found = readers.fetch(wanted, readers.fasta(spark, path, 256), 256)
    return found.select("chrom", F.sha2("sequence", 256).alias("sha"))


def symbol_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' names resolved to ids by a first mapping, then by aliases; where a name has several ids, those with regions are preferred."""
    names = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 40).cast("string")).alias("name")).distinct()
    ids = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("s"), (F.col("c_custkey") % 50).cast("string")).alias("name"), F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("gene_id"))
    first, second = ids.where("CAST(substring(gene_id, 2) AS INT) % 3 = 0"), ids.where("CAST(substring(gene_id, 2) AS INT) % 3 = 1")
    found = joins.resolved(joins.with_fallback(names, first, second, "name", "gene_id"), view(spark, d, "extent"), "name", "gene_id")
    return joins.membership(found, ids.withColumn("list", F.substring("gene_id", -1, 1)), "name", "list")


def promised_joins(spark: SparkSession, d: str) -> DataFrame:
    """Genes joined one to one with their anchors and audited against the customers; repeated positions counted; pairs of neighbours in both orders."""
    extent, tss = view(spark, d, "extent"), view(spark, d, "tss")
    both = joins.exactly_one(joins.one_to_one(extent, tss, GENE), GENE, "genes")
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("gene_id"))
    with_, without = joins.audited(customers, both, ["gene_id"], "no_regions")
    pairs = both.select(F.col("gene_id").alias("a"), F.concat(F.lit("x"), "gene_id").alias("b"), (F.col("hi") - F.col("tss0")).alias("gap"))
    turned = joins.symmetric(pairs, "a", "b", ["gap"])
    repeats = joins.duplicated(view(spark, d, "regions"), ["chrom", "start0"])
    part = lambda df, name, v: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum(v).cast("bigint").alias("total"))
    return part(with_, "with", F.lit(1)).unionByName(part(without, "without", F.length("reason"))).unionByName(part(turned, "pairs", F.when(F.col("a").startswith("x"), F.col("gap") * 3).otherwise(F.col("gap")))).unionByName(part(repeats, "repeats", F.col("n")))


def name_columns(spark: SparkSession, d: str) -> DataFrame:
    """Column expressions on parts' names and suppliers' spans."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_size")
    p = p.withColumns({"chrom": F.concat(F.when(F.col("p_partkey") % 2 == 0, "chr").otherwise(""), F.col("p_size").cast("string")), "versioned": F.concat("p_name", F.lit("."), F.col("p_size").cast("string"))})
    return p.select(
        "p_partkey", exprs.without_version("versioned").alias("bare"), exprs.without_version("versioned", True).alias("bare_last"), exprs.toggled_chrom("chrom").alias("toggled"), exprs.primary_contig("chrom").alias("contig"), exprs.is_main_chrom("chrom").alias("main"), exprs.safe_file_name("p_name").alias("file"),
        exprs.normalised("p_name").alias("key"), exprs.cut("p_size", [0, 10, 25, 50], ["small", "medium", "large"]).alias("size_left"), exprs.cut("p_size", [0, 10, 25, 50], ["small", "medium", "large"], True).alias("size_right"), exprs.alias_match("p_name", "chrom").alias("alias"), *[c.alias(n) for n, c in zip(("s", "e"), exprs.clipped("p_size", "p_partkey", 5, 900), strict=True)],
    )


def classes_of_edges(spark: SparkSession, d: str) -> DataFrame:
    """Regions written and read back, against the nearest anchor, by class."""
    held = written(view(spark, d, "regions").select("region_id", *GENE, "start0", "end0"), "regions")
    return anchors.nearest_anchor(held, view(spark, d, "tss")).groupBy("tss_class").agg(F.count("*").alias("n"), F.min("edge_distance").alias("nearest"))


QUERIES = {f.__name__: f for f in (tsv_regions, bed_tested_space, bed6_anchors, bedgraph_signal, class_folders, keyed_folders, gtf_genes, fasta_fetch, symbol_resolution, promised_joins, name_columns, classes_of_edges)}

_UNION = """o AS (SELECT *, CASE WHEN start0 > max(end0) OVER (PARTITION BY {k} ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM {t}),
u AS (SELECT {k}, min(start0) AS start0, max(end0) AS end0 FROM (SELECT *, sum(opens) OVER (PARTITION BY {k} ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS b FROM o) x GROUP BY {k}, b)"""
ORACLE = {
    "tsv_regions": oracle("SELECT region_id, gene_id, chrom, start0, end0, length, direction, effect FROM regions", "regions"),
    "bed_tested_space": oracle("SELECT chrom, start0, end0, gene_id FROM tested", "tested"),
    "bed6_anchors": oracle(
        "n AS (SELECT DISTINCT 'g' || c_custkey AS bare, 'g' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.3' ELSE '' END AS gene_id FROM customer) SELECT n.gene_id, chrom, tss0, strand, CASE WHEN t.gene_id IS NULL THEN 'missing_tss' END AS reason FROM n LEFT JOIN tss t ON n.bare = t.gene_id",
        "tss",
    ),
    "bedgraph_signal": oracle(
        _UNION.format(k="chrom", t="tested") + " SELECT t.chrom, count(*) AS n, CAST(sum(least(t.end0, u.end0) - greatest(t.start0, u.start0)) AS BIGINT) AS bp, round(CAST(sum(value * (least(t.end0, u.end0) - greatest(t.start0, u.start0))) AS DOUBLE), 3) AS mass FROM tracks t JOIN u ON t.chrom = u.chrom AND t.start0 < u.end0 AND u.start0 < t.end0 WHERE value >= 10 GROUP BY t.chrom",
        "tested",
        "tracks",
    ),
    "class_folders": oracle("SELECT annotation, count(*) AS n, CAST(sum(length) AS BIGINT) AS bp FROM regions GROUP BY annotation", "regions"),
    "keyed_folders": oracle("SELECT annotation AS cell_type, count(*) AS n FROM regions WHERE annotation IN ('click', 'view', 'purchase') AND effect / CAST(50000 AS DOUBLE) < 0.05 GROUP BY annotation", "regions"),
    "gtf_genes": oracle(
        _UNION.format(k="gene_id, chrom", t="regions")
        + """, c AS (SELECT gene_id, region_id AS transcript_id, CASE WHEN right(gene_id, 1) IN ('1', '3', '5') THEN end0 - 1 ELSE start0 END AS tss0, row_number() OVER (PARTITION BY gene_id ORDER BY CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END, region_id) AS rn FROM regions WHERE event_id % 11 = 0 OR event_id % 7 = 0),
e AS (SELECT gene_id, CAST(sum(end0 - start0) AS BIGINT) AS exon_bp, count(*) AS n_exons FROM u GROUP BY gene_id) SELECT c.gene_id, transcript_id, tss0, exon_bp, n_exons, upper(c.gene_id) AS gene_name FROM c JOIN e USING (gene_id) WHERE rn = 1""",
        "regions",
    ),
    "fasta_fetch": "WITH s AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents) SELECT 'doc' || doc_id AS chrom, sha256(rpad(substr(s, 41, 660), 660, 'N')) AS sha FROM s",
    "symbol_resolution": oracle(
        """n AS (SELECT DISTINCT 's' || (s_suppkey % 40) AS name FROM supplier), i AS (SELECT 's' || (c_custkey % 50) AS name, 'g' || c_custkey AS gene_id, c_custkey FROM customer),
f AS (SELECT n.name, gene_id FROM n JOIN i ON n.name = i.name WHERE c_custkey % 3 = 0 UNION ALL SELECT n.name, gene_id FROM n JOIN i ON n.name = i.name WHERE c_custkey % 3 = 1 AND n.name NOT IN (SELECT name FROM i WHERE c_custkey % 3 = 0)),
m AS (SELECT *, gene_id IN (SELECT gene_id FROM extent) AS known FROM f), r AS (SELECT *, max(CAST(known AS INT)) OVER (PARTITION BY name) AS any_known FROM m), l AS (SELECT name, count(DISTINCT right(gene_id, 1)) AS n_lists FROM i GROUP BY name)
SELECT r.name, gene_id, coalesce(n_lists, 0) AS n_lists FROM r LEFT JOIN l USING (name) WHERE known OR any_known = 0""",
        "extent",
    ),
    "promised_joins": oracle(
        """k AS (SELECT 'g' || c_custkey AS gene_id FROM customer), b AS (SELECT e.gene_id, hi - tss0 AS gap FROM extent e JOIN tss t ON e.gene_id = t.gene_id AND e.chrom = t.chrom), d AS (SELECT chrom, start0, count(*) AS n FROM regions GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'with' AS part, count(*) AS n, CAST(sum(1) AS BIGINT) AS total FROM k WHERE gene_id IN (SELECT gene_id FROM b) UNION ALL SELECT 'without', count(*), CAST(sum(10) AS BIGINT) FROM k WHERE gene_id NOT IN (SELECT gene_id FROM b)
UNION ALL SELECT 'pairs', 2 * count(*), CAST(-2 * sum(gap) AS BIGINT) FROM b UNION ALL SELECT 'repeats', count(*), CAST(sum(n) AS BIGINT) FROM d""",
        "extent",
        "tss",
        "regions",
    ),
    "name_columns": r"""WITH p AS (SELECT p_partkey, p_name, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'chr' ELSE '' END || p_size AS chrom, p_name || '.' || p_size AS versioned FROM part), k AS (SELECT *, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS x, upper(chrom) AS y FROM p)
SELECT p_partkey, split_part(versioned, '.', 1) AS bare, regexp_replace(versioned, '\.\d+$', '') AS bare_last, CASE WHEN chrom LIKE 'chr%' THEN substr(chrom, 4) ELSE 'chr' || chrom END AS toggled, CASE WHEN p_size BETWEEN 1 AND 22 THEN CAST(p_size AS VARCHAR) END AS contig, true AS main,
CASE WHEN regexp_matches(p_name, '[^A-Za-z0-9._-]') THEN regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') || '-' || substr(sha256(p_name), 1, 8) ELSE p_name END AS file, x AS key,
CASE WHEN p_size >= 0 AND p_size < 10 THEN 'small' WHEN p_size >= 10 AND p_size < 25 THEN 'medium' WHEN p_size >= 25 AND p_size < 50 THEN 'large' END AS size_left, CASE WHEN p_size >= 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 25 THEN 'medium' WHEN p_size > 25 AND p_size <= 50 THEN 'large' END AS size_right,
CASE WHEN least(length(x), length(y)) < 3 THEN x = y ELSE starts_with(x, y) OR starts_with(y, x) END AS alias, greatest(p_size, 5) AS s, least(p_partkey, 900) AS e FROM k""",
    "classes_of_edges": oracle(
        """x AS (SELECT r.start0 AS s, r.end0 AS e, tss0 AS t FROM regions r LEFT JOIN tss t ON r.gene_id = t.gene_id AND r.chrom = t.chrom), c AS (SELECT CASE WHEN s <= t AND t < e THEN 0 ELSE least(abs(s - t), abs(e - t)) END AS dist, s <= t AND t < e AS inside FROM x)
SELECT CASE WHEN inside THEN 'TSS_proximal' WHEN dist <= 1000 THEN 'TSS_boundary' ELSE 'distal' END AS tss_class, count(*) AS n, min(dist) AS nearest FROM c GROUP BY 1""",
        "regions",
        "tss",
    ),
}
