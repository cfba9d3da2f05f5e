"""Queries of names matched with names: motifs with groups of aliases, chromosomes with an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanforge.operators import motifs
from spanforge.plans.signal_queries import _rounded
from spanforge.sources import contigs

#: Heads of the motifs' names, by part, and the groups' aliases.
HEADS = ("GATA", "Gata4", "KLF4", "Sox2", "ETS1", "RUNX", "AP-1", "p53", "NFkB-p65", "E2", "E2F1", "Sp1")
GROUPS = (("GATA", "gata"), ("GATA", "GATA-6"), ("KLF/SP", "klf"), ("KLF/SP", "SP"), ("SOX", "sox2xyz"), ("AP1", "ap1"), ("AP1", "fos"), ("E2F", "e2f1"), ("E2", "e2"), ("NFKB", "NF-kB"), ("NONE", "zzz"))
CELLS = ("cell0", "cell1", "cell2")
INDEX = (("chr1", 1000), ("2", 900), ("chr3", 800), ("3", 801), ("chrX", 700), ("M", 16), ("scaffold1", 50), ("CHR7", 600))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Parts as motif results: a name of head, family and source; significance from the price."""
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("p_partkey") % len(HEADS) + 1).cast("int"))
    name = F.concat(head, F.lit("("), F.col("p_brand"), F.lit(")/s"), (F.col("p_size") % 4).cast("string"), F.lit("/known"))
    parts = spark.read.parquet(f"{d}/part.parquet")
    rows = parts.select(F.concat(F.lit("cell"), (F.floor(F.col("p_partkey") / len(HEADS)) % 3).cast("string")).alias("cell_type"), name.alias("motif"), F.floor(F.col("p_retailprice")).alias("price"))
    return rows.groupBy("cell_type", "motif").agg(F.max("price").alias("price")).select("cell_type", "motif", (F.col("price") / 10).alias("neglog10p"), (F.col("price") % 97).cast("double").alias("fold"))


def _groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GROUPS), "label string, alias string")


def motif_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every motif of a cell type with the groups that match it, and whether it stands for the group there."""
    return _rounded(motifs.matched(_results(spark, d), _groups(spark)))


def motif_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Groups by cell type: the fold of the most significant motif, in the order of the largest."""
    return _rounded(motifs.matrix(motifs.matched(_results(spark, d), _groups(spark)), "fold", list(CELLS)))


def motif_audit(spark: SparkSession, d: str) -> DataFrame:
    return motifs.audit(motifs.matched(_results(spark, d), _groups(spark)), _groups(spark))


def contig_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' chromosomes in many spellings, in each mode, by how they are resolved."""
    n = F.col("s_nationkey").cast("string")
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, F.concat(F.lit("chr"), n)).when(k == 1, n).when(k == 2, F.concat(F.lit("CHR0"), n)).when(k == 3, F.element_at(F.array(*map(F.lit, ("chrX", "x", "MT", "chrM", "scaffold1"))), (F.col("s_nationkey") % 5 + 1).cast("int"))).otherwise(F.concat(F.lit("Chr"), n))
    names = spark.read.parquet(f"{d}/supplier.parquet").select(name.alias("chrom"))
    index = spark.createDataFrame(list(INDEX), "contig string, length bigint")
    out = None
    for mode in contigs.MODES:
        found = contigs.outcomes(names, index, mode).withColumn("mode", F.lit(mode))
        out = found if out is None else out.unionByName(found)
    return out


QUERIES = {f.__name__: f for f in (motif_matches, motif_matrix, motif_audit, contig_outcomes)}

_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_N = "upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"
_MATCHED = f"""WITH r0 AS (SELECT 'cell' || CAST(floor(p_partkey / CAST({len(HEADS)} AS DOUBLE)) AS BIGINT) % 3 AS cell_type, {list(HEADS)}[p_partkey % {len(HEADS)} + 1] || '(' || p_brand || ')/s' || (p_size % 4) || '/known' AS motif, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part),
res AS (SELECT cell_type, motif, max(price) AS price FROM r0 GROUP BY 1, 2), grp AS (SELECT label, {_N.format("alias")} AS a, alias FROM (VALUES {_VALUES(GROUPS)}) v(label, alias)),
sy AS (SELECT *, price / CAST(10 AS DOUBLE) AS neglog10p, CAST(price % 97 AS DOUBLE) AS fold, {_N.format("regexp_extract(motif, '^[^/(]*')")} AS s FROM res),
mt AS (SELECT DISTINCT cell_type, motif, neglog10p, fold, label FROM sy JOIN grp ON s = a OR (length(s) >= 3 AND length(a) >= 3 AND (starts_with(s, a) OR starts_with(a, s)))),
lg AS (SELECT *, row_number() OVER (PARTITION BY label, cell_type ORDER BY neglog10p DESC, motif) = 1 AS is_representative FROM mt)"""
_BARE = "regexp_replace(upper(regexp_replace({0}, '^[Cc][Hh][Rr]', '')), '^0+([0-9]+)$', '\\1')"
_KEY = "CASE WHEN regexp_full_match({b}, '[1-9]|1[0-9]|2[0-2]|X|Y') THEN {b} WHEN {b} IN ('M', 'MT') THEN 'MT' END"
ORACLE = {
    "motif_matches": f"{_MATCHED} SELECT cell_type, motif, round(neglog10p, 6) AS neglog10p, fold, label, is_representative FROM lg",
    "motif_matrix": f"""{_MATCHED}, w AS (SELECT label, {", ".join(f"max(fold) FILTER (cell_type = '{c}') AS {c}" for c in CELLS)}, max(fold) AS top FROM lg WHERE is_representative GROUP BY label)
SELECT label, {", ".join(CELLS)}, CAST(row_number() OVER (ORDER BY top DESC, label) AS INTEGER) AS place FROM w""",
    "motif_audit": f"""{_MATCHED}, al AS (SELECT label, string_agg(DISTINCT a, ',' ORDER BY a) AS aliases FROM grp GROUP BY label), n AS (SELECT label, count(DISTINCT motif) AS n, string_agg(DISTINCT motif, '; ' ORDER BY motif) AS motifs FROM lg GROUP BY label)
SELECT label, aliases, n IS NOT NULL AS matched, coalesce(n, 0) AS n_motifs, coalesce(motifs, 'NONE') AS motifs FROM al LEFT JOIN n USING (label)""",
    "contig_outcomes": f"""WITH nm AS (SELECT DISTINCT CASE s_suppkey % 5 WHEN 0 THEN 'chr' || s_nationkey WHEN 1 THEN CAST(s_nationkey AS VARCHAR) WHEN 2 THEN 'CHR0' || s_nationkey WHEN 3 THEN ['chrX', 'x', 'MT', 'chrM', 'scaffold1'][s_nationkey % 5 + 1] ELSE 'Chr' || s_nationkey END AS chrom FROM supplier),
ix AS (SELECT * FROM (VALUES {_VALUES(INDEX)}) v(contig, length)), md AS (SELECT unnest(['auto', 'toggle', 'exact']) AS mode),
k AS (SELECT chrom, {_KEY.format(b=_BARE.format("chrom"))} AS pk, CASE WHEN starts_with(chrom, 'chr') THEN substr(chrom, 4) ELSE 'chr' || chrom END AS other FROM nm), ki AS (SELECT contig, length, {_KEY.format(b=_BARE.format("contig"))} AS pk FROM ix),
c AS (SELECT mode, chrom, contig, length, 0 AS rk, 'exact' AS kind FROM k JOIN ki ON contig = chrom, md UNION ALL SELECT 'toggle', chrom, contig, length, 1, 'toggled' FROM k JOIN ki ON contig = other UNION ALL SELECT 'auto', chrom, contig, length, 2, 'primary' FROM k JOIN ki USING (pk)),
b AS (SELECT mode, chrom, rk, kind, count(*) AS n, min(contig) AS contig, max(length) AS length, row_number() OVER (PARTITION BY mode, chrom ORDER BY rk) AS rn FROM c GROUP BY 1, 2, 3, 4)
SELECT mode, nm.chrom, CASE WHEN n = 1 THEN contig END AS contig, CAST(CASE WHEN n = 1 THEN length END AS BIGINT) AS length, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN kind ELSE 'ambiguous' END AS status FROM nm CROSS JOIN md LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (mode, chrom)""",
}
