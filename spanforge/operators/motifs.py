"""Motifs matched with named groups of aliases, and the matrix of motif groups by cell type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spanforge.functions.exprs import normalised

LEAST = 3  # letters of the shorter name of two that match by a prefix


def motif_symbol(name: str) -> Column:
    """The head of a motif's name, before its family and source, normalised."""
    return F.upper(F.regexp_replace(F.regexp_extract(name, r"^[^/(]*", 0), "[^A-Za-z0-9]", ""))


def prefix_matches(names: DataFrame, aliases: DataFrame, name: str, alias: str) -> DataFrame:
    """``names`` x ``aliases`` where either begins with the other, or where both are equal (the only match of names shorter than LEAST).

    An equi-join each way: one side is spelled out by its prefixes, so nothing is compared pair by pair. A name has as many rows as letters.
    """
    long_ = lambda c: F.length(c) >= LEAST
    spelled = lambda df, c, last: df.where(long_(c)).withColumn("_key", F.explode(F.transform(F.sequence(F.lit(LEAST), last), lambda n: F.substring(c, F.lit(1), n))))
    inside = spelled(names, name, F.length(name)).join(aliases.where(long_(alias)), F.col("_key") == F.col(alias)).drop("_key")
    longer = spelled(aliases.where(F.length(alias) > LEAST), alias, F.length(alias) - 1).join(names.where(long_(name)), F.col("_key") == F.col(name)).drop("_key")
    equal = names.where(~long_(name)).join(aliases, F.col(name) == F.col(alias))
    columns = [*names.columns, *aliases.columns]
    return inside.select(*columns).unionByName(longer.select(*columns)).unionByName(equal.select(*columns))


def matched(results: DataFrame, groups: DataFrame) -> DataFrame:
    """results (cell_type, motif, neglog10p and other metrics) x groups (label, alias): each motif of a cell type once for each group that one of its aliases matches, with is_representative for the group's most significant one (the first by name among equals)."""
    named = results.withColumn("_symbol", motif_symbol("motif"))
    aliases = groups.select("label", normalised("alias").alias("_alias")).distinct()
    met = prefix_matches(named.select("_symbol").distinct(), aliases, "_symbol", "_alias").select("_symbol", "label").distinct()
    rows = named.join(met, "_symbol").drop("_symbol")
    best = W.partitionBy("label", "cell_type").orderBy(F.desc("neglog10p"), "motif")
    return rows.withColumn("is_representative", F.row_number().over(best) == 1)


def matrix(long_: DataFrame, metric: str, cells: list[str]) -> DataFrame:
    """label by cell type: the representative's metric; and ``place``, by the largest value of a row, largest first."""
    wide = long_.where("is_representative").groupBy("label").pivot("cell_type", cells).agg(F.first(metric))
    top = F.greatest(*[F.coalesce(F.col(c), F.lit(float("-inf"))) for c in cells]) if len(cells) > 1 else F.col(cells[0])
    return wide.withColumn("_top", top).withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("_top"), "label"))).drop("_top")  # as many rows as groups


def audit(long_: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: its aliases, how many motifs they match anywhere, and their names."""
    found = long_.groupBy("label").agg(F.array_sort(F.collect_set("motif")).alias("_names"))
    rows = groups.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set(normalised("alias"))), ",").alias("aliases")).join(found, "label", "left")
    n = F.coalesce(F.size("_names"), F.lit(0))
    return rows.select("label", "aliases", (n > 0).alias("matched"), n.cast("long").alias("n_motifs"), F.when(n > 0, F.array_join("_names", "; ")).otherwise("NONE").alias("motifs"))
