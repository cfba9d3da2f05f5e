"""Deterministic draws: hashes of keys instead of generators, so results don't depend on partitions and can be recomputed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from spanforge.operators.intervals import BIN, merge, range_join
from spanforge.sources.shared import written


def uniform(*keys) -> Column:
    """A number in [0, 1) from the SHA-256 of the keys, joined by |."""
    text = F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def seed_of(*keys) -> Column:
    """The first eight bytes of the keys' SHA-256, little-endian, as a decimal string (they may exceed 63 bits)."""
    text = F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    digest = F.sha2(text, 256)
    return F.conv(F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)]), 16, 10)


def masked_sequences(df: DataFrame, sequence: str, start: str, intervals: str, seed: int, pairs: bool = True, name: str | None = None, rep: str | None = None) -> DataFrame:
    """``df`` with its sequence overwritten: its intervals (an array of structs start0, end0) are clipped to the sequence, which begins at ``start``, and merged; each is scrambled once by a seed of ``name`` (a gene),
    its coordinates and ``rep``, so that a mask can be drawn again and again and no scramble of a window is like it.

    A letter other than A, C, G and T inside an interval, or an interval that scrambling leaves as it is, is an error. Adds ``masked`` and ``masked_bp``.
    """

    def one(text: str, begin: int, spans, gene: str, k: str) -> tuple[str, int]:
        merged: list[list[int]] = []
        for a, b in sorted((max(0, x["start0"] - begin), min(len(text), x["end0"] - begin)) for x in spans if x is not None):
            if b <= a:
                continue
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            old = text[a:b]
            if set(old) - set("ACGT"):
                raise ValueError(f"letters other than A, C, G and T between {begin + a} and {begin + b}")
            key = hashlib.sha256(f"{seed}|{gene}|{begin + a}|{begin + b}|mask{k}".encode()).digest()
            rng = np.random.default_rng(int.from_bytes(key[:8], "little"))
            new = _euler_shuffle(old, rng) if pairs else "".join(np.array(list(old))[rng.permutation(len(old))])
            if new == old:
                raise ValueError(f"scrambling changes nothing between {begin + a} and {begin + b}")
            text = text[:a] + new + text[b:]
        return text, sum(b - a for a, b in merged)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            genes, reps = (batch[c].astype(str) if c else [""] * len(batch) for c in (name, rep))
            found = [(None, None) if t is None else one(t, int(a), x if x is not None else (), g, k) for t, a, x, g, k in zip(batch[sequence], batch[start], batch[intervals], genes, reps, strict=True)]
            yield batch.assign(masked=[x[0] for x in found], masked_bp=pd.array([x[1] for x in found], "Int64"))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("masked", T.StringType()), T.StructField("masked_bp", T.LongType())]))


def fitting_blocks(regions: DataFrame, tested: DataFrame, keys: Sequence[str] = ("gene_id", "chrom")) -> DataFrame:
    """``regions`` that fit somewhere in their keys' tested blocks, with ``total`` (starts at which they fit) and ``blocks`` (before, cnt, bs), as many as its entity has."""
    keys = list(keys)
    fit = regions.select("region_id", *keys, (F.col("end0") - F.col("start0")).alias("length")).join(tested.select(*keys, F.col("start0").alias("bs"), F.col("end0").alias("be")), keys).withColumn("cnt", F.col("be") - F.col("bs") - F.col("length") + 1).where("cnt > 0")
    before = F.coalesce(F.sum("cnt").over(W.partitionBy("region_id").orderBy("bs").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = fit.withColumn("before", before).groupBy("region_id").agg(F.sum("cnt").alias("total"), F.collect_list(F.struct("before", "cnt", "bs")).alias("blocks"))
    return regions.join(blocks, "region_id")


def drawn_start(seed: int) -> tuple[Column, Column]:
    """The number that a row of fitting_blocks() and its ``perm`` draw (_u), a hash of (seed, region, perm), and the start it stands for: uniform over all starts at which the region fits."""
    u = F.floor(uniform(seed, F.col("region_id"), F.col("perm")) * F.col("total")).cast("long")
    block = F.filter("blocks", lambda b: (b["before"] <= F.col("_u")) & (F.col("_u") < b["before"] + b["cnt"]))[0]
    return u, block["bs"] + F.col("_u") - block["before"]


def placements(regions: DataFrame, tested: DataFrame, n_perm: int, seed: int, keys: Sequence[str] = ("gene_id", "chrom")) -> DataFrame:
    """(region_id, keys, perm, start0, end0): each region placed ``n_perm`` times, uniformly over all starts in its keys' tested blocks at which it fits.

    Regions that fit nowhere give no rows.
    """
    held = fitting_blocks(regions, tested, keys).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    return placed(held, seed).select("region_id", *keys, "perm", "start0", "end0")


def placed(held: DataFrame, seed: int) -> DataFrame:
    """Rows of fitting_blocks() with a ``perm``, moved to the start they draw; perm -1 stays where it is."""
    u, start = drawn_start(seed)
    length = F.col("end0") - F.col("start0")
    moved = held.withColumn("_u", u).withColumn("_length", length).withColumn("start0", F.when(F.col("perm") < 0, F.col("start0")).otherwise(start))
    return moved.withColumn("end0", F.col("start0") + F.col("_length")).drop("_u", "_length", "blocks", "total")


def hashed_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int, order: Sequence[str]) -> DataFrame:
    """``n`` rows for each key without replacement, by the hash of ``order``."""
    u = uniform(seed, *[F.col(c) for c in order])
    return df.withColumn("_u", u).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_u", *order))).where(F.col("_n") <= n).drop("_u", "_n")


def bootstrap_ids(entities: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(rep, slot, key): for each replicate as many entities as there are, drawn with replacement."""
    ranked = entities.select(key).distinct().withColumn("_i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key)) - 1)  # entities are a small list (genes)
    size = ranked.count()
    draws = entities.sparkSession.range(n).select(F.col("id").alias("rep")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(max(size, 1) - 1)))).withColumn("_i", F.floor(uniform(seed, F.col("rep"), F.col("slot")) * size).cast("int"))
    return draws.join(F.broadcast(ranked) if size <= 1_000_000 else ranked, "_i").select("rep", "slot", key)


def _euler_shuffle(text: str, rng: np.random.Generator) -> str:
    """A random sequence with the same counts of neighbouring pairs and the same ends: a uniform arborescence towards the last symbol, then a walk."""
    if len(text) < 3:
        return text
    last: dict[str, str] = {}
    exits: dict[str, list[str]] = {}
    for a, b in zip(text, text[1:], strict=False):
        exits.setdefault(a, []).append(b)
    end = text[-1]
    for start in sorted(set(text)):  # loop-erased random walks (Wilson)
        walk: dict[str, str] = {}
        here = start
        while here != end and here not in last:
            walk[here] = exits[here][int(rng.integers(len(exits[here])))]
            here = walk[here]
        here = start
        while here != end and here not in last:
            last[here] = walk[here]
            here = walk[here]
    for a, out in exits.items():
        rest = out.copy()
        if a != end:
            rest.remove(last[a])
        rng.shuffle(rest)
        exits[a] = rest + ([last[a]] if a != end else [])
    parts, at = [text[0]], dict.fromkeys(exits, 0)
    while at.get(parts[-1], 0) < len(exits.get(parts[-1], ())):
        here = parts[-1]
        parts.append(exits[here][at[here]])
        at[here] += 1
    return "".join(parts)


def scrambled(df: DataFrame, sequence: str, seed: str, pairs: bool) -> DataFrame:
    """Adds ``scrambled``: the sequence's symbols permuted (or, with ``pairs``, permuted with the counts of neighbouring pairs kept), seeded by the decimal string ``seed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, s in zip(batch[sequence], batch[seed], strict=True):
                if text is None:
                    out.append(None)
                    continue
                rng = np.random.default_rng(int(s))
                out.append(_euler_shuffle(text, rng) if pairs else "".join(np.array(list(text))[rng.permutation(len(text))]))
            yield batch.assign(scrambled=out)

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("scrambled", T.StringType())]))


def json_seed(*keys) -> Column:
    """The SHA-256, as hex, of a JSON list of the keys: strings are quoted, members parted by comma and space. Keys are columns or constants."""
    one = [F.to_json(F.array(k)) if isinstance(k, Column) else F.lit(json.dumps([k])) for k in keys]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *[F.substring(x, F.lit(2), F.length(x) - 2) for x in one]), F.lit("]")), 256)


def base_index(chunks: DataFrame, on: Sequence[str] = ("chrom",)) -> DataFrame:
    """(on, chunk, sequence) with gc_before and bad_before: how many G and C, and letters other than A, C, G and T, lie before each chunk.

    Counts are summed over runs of 1024 chunks first, so no window runs over a whole chromosome.
    """
    on = list(on)
    n = lambda keep: F.length(F.regexp_replace(F.upper("sequence"), keep, ""))
    rows = chunks.withColumns({"_gc": n("[^GC]"), "_bad": n("[ACGT]"), "_run": F.floor(F.col("chunk") / 1024)})
    runs = rows.groupBy(*on, "_run").agg(F.sum("_gc").alias("_g"), F.sum("_bad").alias("_b"))
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    outer, inner = W.partitionBy(*on).orderBy("_run"), W.partitionBy(*on, "_run").orderBy("chunk")
    runs = runs.select(*on, "_run", upto("_g", outer).alias("_g"), upto("_b", outer).alias("_b"))
    found = rows.withColumns({"_gi": upto("_gc", inner), "_bi": upto("_bad", inner)}).join(runs, [*on, "_run"])
    return found.select(*on, "chunk", "sequence", (F.col("_g") + F.col("_gi")).alias("gc_before"), (F.col("_b") + F.col("_bi")).alias("bad_before"))


def base_share(df: DataFrame, index: DataFrame, by: Sequence[str], on: Sequence[str] = ("chrom",), size: int = 1 << 16) -> DataFrame:
    """(by, gc, clear): the share of G and C of each span (by, on, start0, end0), and whether it holds A, C, G and T only; two lookups in base_index(), at its last base and before its first. A span beyond the sequence isn't clear."""
    by, on = list(by), list(on)
    ends = df.select(*by, *on, F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("start0").alias("p")), F.struct(F.lit(1).alias("sign"), F.col("end0").alias("p")))).alias("e"), (F.col("end0") - F.col("start0")).alias("_l")).select(*by, *on, "_l", "e.*")
    # position p counts the bases before it: those of the chunk that holds base p - 1
    ends = ends.withColumn("chunk", F.greatest(F.lit(0).cast("long"), F.floor((F.col("p") - 1) / size).cast("long")))
    met = ends.join(index, [*on, "chunk"], "left")
    inside = F.greatest(F.lit(0), F.col("p") - F.col("chunk") * size).cast("int")
    part = F.upper(F.substring("sequence", F.lit(1), inside))
    n = lambda keep, c: (F.col(c) + F.length(F.regexp_replace(part, keep, ""))) * F.col("sign")
    whole = F.col("sequence").isNotNull() & (F.length("sequence") >= inside) & (F.col("p") >= 0)
    found = met.groupBy(*by, "_l").agg(F.sum(n("[^GC]", "gc_before")).alias("_gc"), F.sum(n("[ACGT]", "bad_before")).alias("_bad"), F.bool_and(whole).alias("_whole"))
    return found.select(*by, F.try_divide("_gc", "_l").alias("gc"), (F.col("_whole") & (F.col("_bad") == 0)).alias("clear"))


def unmatched(hits: DataFrame, nulls: DataFrame, per_hit: int) -> DataFrame:
    """(region_id, wanted, found) of the hits that have fewer nulls than asked for."""
    n = nulls.groupBy(F.col("hit_id").alias("region_id")).agg(F.count("*").alias("found"))
    rows = hits.select("region_id").distinct().join(n, "region_id", "left").select("region_id", F.lit(per_hit).alias("wanted"), F.coalesce("found", F.lit(0)).alias("found"))
    return rows.where("found < wanted")


def matched_nulls(
    hits: DataFrame, space: DataFrame, composition: DataFrame, keys: Sequence[str] = ("gene_id", "chrom"), on: Sequence[str] = ("chrom",), per_hit: int = 1, seed: int = 1, tolerance: float = 0.05, tries: int = 5_000, width: int = BIN, forbidden: DataFrame | None = None, size: int | None = None
) -> DataFrame:
    """(keys, hit_id, rep, start0, end0): spans as long as each hit, inside ``space`` blocks, of like composition, that touch no hit and none another; fewer where ``tries`` draws don't suffice.

    composition: (on, start0, end0), disjoint, is what counts as G or C; a null's share of it is within ``tolerance`` of its hit's. Draws are hashes of (seed, hit, rep, try). In a round every
    null that is still wanted makes some draws and takes the first that fits and touches no hit and no null of an earlier round; of two that touch in one round, the later by hash goes on
    with its next draw. Rounds are joins, so a gene may hold any number of hits; they double their draws, and each is written.

    size: composition is base_index() of sequences in chunks of that many bases instead; then a null also holds no letter but A, C, G and T, and the share is of G and C. forbidden: more spans
    (keys, start0, end0) that no null may touch. unmatched() tells which nulls weren't found.
    """
    from spanforge.operators.coverage import bounds, coverage_steps
    from spanforge.operators.coverage import covered as covered_bp

    keys, on, id_ = list(keys), list(on), ["region_id", "rep"]
    steps = None if size else written(coverage_steps(composition.select(*on, F.lit(1).alias("_by"), "start0", "end0"), "_by", on), "composition")

    def share(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        if size:
            found = base_share(df.select(*by, *on, "start0", "end0"), composition, list(by), on, size).select(*by, F.col("gc").alias(name), "clear")
            return df.join(found, list(by), "left")
        found = covered_bp(df.join(bounds(steps, on), on), steps, "_by", on).select(*by, "bp")
        return df.join(found, list(by), "left").withColumn(name, F.coalesce("bp", F.lit(0)) / (F.col("end0") - F.col("start0"))).drop("bp")

    spans = hits.select(*keys, "start0", "end0")
    taken = written(merge(spans if forbidden is None else spans.unionByName(forbidden.select(*keys, "start0", "end0")), keys, width), "forbidden")
    fit = fitting_blocks(hits.select("region_id", *keys, "start0", "end0"), space, keys)
    wanted = share(fit, ["region_id"], "_share").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(per_hit - 1))))
    wanted = written(wanted.select(*id_, *keys, (F.col("end0") - F.col("start0")).alias("_length"), "_share", "total", "blocks", F.lit(0).alias("_next")), "wanted")
    out, more = None, 16
    while not wanted.isEmpty():
        drawn = wanted.withColumn("_try", F.explode(F.sequence("_next", F.least(F.col("_next") + more, F.lit(tries)) - 1)))
        drawn = drawn.withColumn("_u", F.floor(uniform(seed, F.col("region_id"), F.col("rep"), F.col("_try")) * F.col("total")).cast("long"))
        block = F.filter("blocks", lambda b: (b["before"] <= F.col("_u")) & (F.col("_u") < b["before"] + b["cnt"]))[0]
        drawn = drawn.withColumn("start0", block["bs"] + F.col("_u") - block["before"]).withColumn("end0", F.col("start0") + F.col("_length"))
        alike = share(drawn.select(*id_, "_try", *keys, "start0", "end0", "_share"), [*id_, "_try"], "_mine").where(F.abs(F.col("_mine") - F.col("_share")) <= tolerance)
        alike = alike.where("clear") if size else alike
        hit = range_join(alike.select(*id_, "_try", *keys, "start0", "end0"), taken, keys, width).select(*id_, "_try").distinct()
        free = alike.join(hit, [*id_, "_try"], "left_anti").groupBy(*id_, *keys).agg(F.min_by(F.struct("start0", "end0", "_try"), "_try").alias("b")).select(*id_, *keys, "b.*")
        free = written(free.withColumn("_order", F.xxhash64("region_id", "rep")), "free")
        later = range_join(free, free, keys, width).where("struct(r__order, r_region_id, r_rep) < struct(_order, region_id, rep)").select(*id_).distinct()
        fresh = written(free.join(later, id_, "left_anti").select(*keys, "region_id", "rep", "start0", "end0"), "nulls")
        out = fresh if out is None else out.unionByName(fresh)
        taken = written(taken.unionByName(fresh.select(*keys, "start0", "end0")), "taken")
        again = wanted.join(fresh.select(*id_), id_, "left_anti").drop("_next").join(free.select(*id_, F.col("_try").alias("_lost")), id_, "left")
        before = wanted.select(*id_, F.col("_next").alias("_was"))
        wanted = written(again.join(before, id_).withColumn("_next", F.coalesce(F.col("_lost") + 1, F.col("_was") + more)).drop("_lost", "_was").where(F.col("_next") < tries), "wanted")
        more *= 2
    if out is None:
        out = hits.select(*keys, "region_id", F.lit(0).alias("rep"), "start0", "end0").limit(0)
    return out.select(*keys, F.col("region_id").alias("hit_id"), "rep", "start0", "end0")


def available(tested: DataFrame, regions: DataFrame, keys: Sequence[str] = ("gene_id", "chrom"), exclude_perturbed: bool = False, width: int = BIN) -> DataFrame:
    """The blocks in which placements may lie: merged tested space, less the keys' own regions where these are excluded."""
    from spanforge.operators.intervals import subtract

    blocks = merge(tested, keys, width)
    return subtract(blocks, regions.select(*keys, "start0", "end0"), keys, width) if exclude_perturbed else blocks


def context_sample(df: DataFrame, n: int, seed: int, order: Sequence[str]) -> DataFrame:
    """``n`` rows of all (every row, where there are no more), those with the smallest hashes of ``order``: the same ones however the table is split. A top-n, which tasks cut before they send."""
    return df.withColumn("_u", uniform(seed, *[F.col(c) for c in order])).orderBy("_u", *order).limit(n).drop("_u")


def row_sample(df: DataFrame, most: int, seed: int, order: Sequence[str]) -> DataFrame:
    """About ``most`` rows of a larger table, each kept by its own hash, and every row of a smaller one: nothing is sorted or gathered."""
    rows = df.count()
    return df if rows <= most else df.where(uniform(seed, *[F.col(c) for c in order]) < most / rows)
