"""Names of chromosomes in one file resolved to those of another's index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanforge.functions.exprs import primary_contig

MODES = ("auto", "toggle", "exact")


def outcomes(names: DataFrame, index: DataFrame, mode: str = "auto") -> DataFrame:
    """(chrom, contig, length, status) of each distinct name: ``exact`` where the index has it; else, by mode, ``toggled`` (with or without chr), ``primary`` (the one contig of the same chromosome 1 to 22, X, Y or M), ``ambiguous`` where several are, or ``missing``.

    Kinds of match are ranked and joined by their keys; the index (contig, length) isn't searched.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    names = names.select("chrom").where("chrom IS NOT NULL").distinct()
    other = F.when(F.startswith(F.col("chrom"), F.lit("chr")), F.substring("chrom", 4, 1 << 20)).otherwise(F.concat(F.lit("chr"), F.col("chrom")))
    kinds = [(0, "exact", F.col("chrom"), F.col("contig"))]
    if mode == "toggle":
        kinds.append((1, "toggled", other, F.col("contig")))
    if mode == "auto":
        kinds.append((2, "primary", primary_contig("chrom"), primary_contig("contig")))
    met = None
    for rank, kind, left, right in kinds:
        found = names.select("chrom", left.alias("_key")).join(index.select(right.alias("_key"), "contig", "length"), "_key").select("chrom", "contig", "length", F.lit(rank).alias("_rank"), F.lit(kind).alias("_kind"))
        met = found if met is None else met.unionByName(found)
    best = met.groupBy("chrom", "_rank", "_kind").agg(F.count("*").alias("_n"), F.min("contig").alias("contig"), F.max("length").alias("length"))
    best = best.groupBy("chrom").agg(F.min_by(F.struct("_kind", "_n", "contig", "length"), "_rank").alias("b"))
    one = F.col("b._n") == 1
    found = names.join(best, "chrom", "left")
    return found.select("chrom", F.when(one, F.col("b.contig")).alias("contig"), F.when(one, F.col("b.length")).alias("length"), F.when(F.col("b").isNull(), "missing").when(one, F.col("b._kind")).otherwise("ambiguous").alias("status"))


def resolved(df: DataFrame, index: DataFrame, mode: str = "auto") -> DataFrame:
    """``df`` with contig and contig_length; a name that isn't resolved is an error that tells some of them."""
    found = outcomes(df, index, mode)
    bad = [f"{r.chrom} ({r.status})" for r in found.where(F.col("status").isin("missing", "ambiguous")).orderBy("chrom").limit(5).collect()]
    if bad:
        raise ValueError(f"no contig for {', '.join(bad)}")
    return df.join(found.select("chrom", "contig", F.col("length").alias("contig_length")), "chrom")


def inside(df: DataFrame) -> DataFrame:
    """The intervals of resolved(), if all of them lie inside their contigs and hold a base."""
    bad = [f"{r.chrom}:{r.start0}-{r.end0}" for r in df.where("start0 < 0 OR end0 > contig_length OR end0 <= start0").limit(5).collect()]
    if bad:
        raise ValueError(f"intervals beyond their contigs: {', '.join(bad)}")
    return df
