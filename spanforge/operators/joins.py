"""Joins with promises: validated keys, fatal misses, audits, memberships, id resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join whose keys must be unique on both sides; columns that both have come from the left."""
    for side, df in (("left", left), ("right", right)):
        if not duplicated(df, keys).isEmpty():
            raise ValueError(f"keys repeat on the {side}")
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in keys]), list(keys), "left")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join to a table of settings; a key that it lacks is an error."""
    missing = df.select(*keys).distinct().join(table.select(*keys), list(keys), "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no values for {[tuple(r) for r in missing]}")
    return df.join(table.select(*keys, *values), list(keys), "left")


def audited(wanted: DataFrame, found: DataFrame, keys: Sequence[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``wanted`` with and without a match; the latter with a reason."""
    return wanted.join(found.select(*keys).distinct(), list(keys), "left_semi"), wanted.join(found.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit(reason).alias("reason"))


def membership(df: DataFrame, lists: DataFrame, key: str, list_name: str) -> DataFrame:
    """``df`` with n_lists: in how many lists each key stands."""
    n = lists.select(key, list_name).distinct().groupBy(key).agg(F.count("*").alias("n_lists"))
    return df.join(n, key, "left").withColumn("n_lists", F.coalesce("n_lists", F.lit(0)))


def resolved(ids: DataFrame, preferred: DataFrame, name: str, id_: str) -> DataFrame:
    """(name, id) rows; where a name has several ids and some are preferred, only those stay."""
    marked = ids.join(preferred.select(id_).distinct().withColumn("_in", F.lit(True)), id_, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    any_ = F.max("_in").over(W.partitionBy(name))
    return marked.withColumn("_any", any_).where(F.col("_in") | ~F.col("_any")).drop("_in", "_any")


def with_fallback(names: DataFrame, first: DataFrame, second: DataFrame, name: str, id_: str) -> DataFrame:
    """Ids by a first mapping, and by a second (aliases) for the names that it lacks."""
    known = names.join(first.select(name, id_), name)
    return known.unionByName(names.join(first.select(name).distinct(), name, "left_anti").join(second.select(name, id_), name))


def symmetric(pairs: DataFrame, a: str, b: str, signed: Sequence[str] = ()) -> DataFrame:
    """Pairs in both orders; signed columns change their sign with the order."""
    turned = pairs.select(*[F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else (-F.col(c)).alias(c) if c in signed else F.col(c) for c in pairs.columns])
    return pairs.unionByName(turned)


def exactly_one(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` if each key stands once, else an error."""
    if not duplicated(df, keys).isEmpty():
        raise ValueError(f"{what} must be unique")
    return df
