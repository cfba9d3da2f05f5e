"""Epistasis: a gene's called regions are masked one at a time, its windows are scanned again on each masked background, and every window's effect there is compared with its effect on the intact sequence.

A background (a gene's sequence with one mask reshuffled) is one row and is scored once. Conditions, windows and repeats fan out as short pieces, never as sequences: how a window is scrambled is drawn once for
each repeat, so that the same scramble is applied on every background, and only the window's bases travel. The pieces of one background come back together in bounded chunks, beside one copy of its
sequence, and the scorer's input is put together inside the task.

All scrambles are permutations by hashes, in DataFrame functions: no generator, the same on every executor and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanforge.operators import effects
from spanforge.operators.intervals import BIN, merge, overlap_stats, range_join
from spanforge.operators.knockouts import CONTROL
from spanforge.operators.sampling import hashed_sample
from spanforge.operators.scan import Scorer, scored
from spanforge.sources.shared import written

INTACT = "intact"
#: Pieces in a chunk, and sequences that a scorer gets at a time.
CHUNK, BATCH = 256, 64


def hashed_order(length: Column, *keys: Column | str | int) -> Column:
    """The numbers from 1 to ``length``, ordered by the SHA-256 of the keys and the number, joined by |."""
    text = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    pairs = F.transform(F.sequence(F.lit(1), length), lambda i: F.struct(F.sha2(F.concat_ws("|", *text, i.cast("string")), 256).alias("h"), i.alias("i")))
    return F.when(length > 0, F.transform(F.array_sort(pairs), lambda x: x["i"])).otherwise(F.array().cast("array<int>"))


def permuted(text: Column, order: Column) -> Column:
    """The letters of ``text`` in the given order of places: a shuffle that keeps its composition."""
    return F.array_join(F.transform(order, lambda i: F.substring(text, i, F.lit(1))), "")


def differing(a: Column, b: Column) -> Column:
    """At how many places two texts of one length differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))


def numbered_hits(regions: DataFrame, key: str = "gene_id") -> DataFrame:
    """``regions`` with region_id R01, R02 ... by start within their gene, whose regions are few."""
    from pyspark.sql import Window as W

    return regions.withColumn("region_id", F.format_string("R%02d", F.row_number().over(W.partitionBy(key).orderBy("start0", "end0"))))


def select_windows(windows: DataFrame, all_hits: DataFrame, hits: DataFrame, flank: int, n_controls: int, seed: int, everything: bool = False, width: int = BIN) -> DataFrame:
    """The tested windows to scan again, with is_control: those within ``flank`` of a selected hit, and per gene ``n_controls`` drawn from those near no hit at all; or every window, with the latter as controls."""
    keys, ids = ["gene_id", "chrom"], ["gene_id", "chrom", "start0", "end0"]

    def near(table: DataFrame) -> DataFrame:
        wide = merge(table.select(*keys, (F.col("start0") - flank).alias("start0"), (F.col("end0") + flank).alias("end0")), keys, width)
        return overlap_stats(windows.select(*ids), wide, ids, keys, width).select(*ids, "overlaps")

    marked = near(all_hits).withColumnRenamed("overlaps", "_any").join(near(hits).withColumnRenamed("overlaps", "_mine"), ids)
    if everything:
        return marked.select(*ids, (~F.col("_any")).alias("is_control"))
    controls = hashed_sample(marked.where("NOT _any"), n_controls, ["gene_id"], seed, ["gene_id", "start0"])
    return marked.where("_mine").select(*ids, F.lit(False).alias("is_control")).unionByName(controls.select(*ids, F.lit(True).alias("is_control")))


def conditions(hits: DataFrame, nulls: DataFrame | None, reshuffles: int) -> DataFrame:
    """(gene_id, cond_id, mask_id, kind, matched_to, rep, start0, end0): each hit, and each null matched to one (hit_id, number), with every reshuffle of its mask.

    A null's mask_id is its hit's with _null<number>, from 1.
    """
    rows = hits.select("gene_id", F.col("region_id").alias("mask_id"), F.lit("hit").alias("kind"), F.col("region_id").alias("matched_to"), "start0", "end0")
    if nulls is not None:
        name = F.concat(F.col("hit_id"), F.lit("_null"), F.col("number").cast("string"))
        rows = rows.unionByName(nulls.select("gene_id", name.alias("mask_id"), F.lit("null").alias("kind"), F.col("hit_id").alias("matched_to"), "start0", "end0"))
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reshuffles - 1))))
    return rows.select("gene_id", F.concat("mask_id", F.lit("_rep"), F.col("rep").cast("string")).alias("cond_id"), "mask_id", "kind", "matched_to", "rep", "start0", "end0")


def backgrounds(targets: DataFrame, conds: DataFrame, seed: int) -> DataFrame:
    """(gene_id, cond_id, input_start0, sequence, mask_start0, mask_end0): the sequence of each condition, its mask clipped to the input and reshuffled by a hash of gene, span and rep.

    A mask with letters other than A, C, G and T, or one that the reshuffle leaves as it is, is an error: it would look like no epistasis.
    """
    rows = conds.join(targets.select("gene_id", F.col("start0").alias("input_start0"), "sequence"), "gene_id")
    rows = rows.withColumns({"mask_start0": F.greatest("start0", "input_start0"), "mask_end0": F.least("end0", F.col("input_start0") + F.length("sequence"))})
    at, size = (F.col("mask_start0") - F.col("input_start0")).cast("int"), (F.col("mask_end0") - F.col("mask_start0")).cast("int")
    rows = rows.withColumn("_old", F.when(size > 0, F.substring("sequence", at + 1, size)).otherwise(""))
    rows = rows.withColumn("_new", permuted(F.col("_old"), hashed_order(F.length("_old"), seed, F.col("gene_id"), F.col("mask_start0"), F.col("mask_end0"), F.concat(F.lit("mask"), F.col("rep").cast("string")))))
    place = F.concat_ws(" ", F.lit("mask"), "gene_id", "cond_id")
    sequence = (
        F.when(size <= 0, F.col("sequence"))
        .when(~F.col("_old").rlike("^[ACGT]*$"), F.raise_error(F.concat(place, F.lit(" holds letters other than A, C, G and T"))).cast("string"))
        .when(F.col("_old") == F.col("_new"), F.raise_error(F.concat(place, F.lit(" is unchanged by the reshuffle"))).cast("string"))
        .otherwise(F.overlay("sequence", "_new", at + 1))
    )
    return rows.select("gene_id", "cond_id", "input_start0", sequence.alias("sequence"), "mask_start0", "mask_end0")


def intact(targets: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return targets.select("gene_id", F.lit(INTACT).alias("cond_id"), F.col("start0").alias("input_start0"), "sequence", none.alias("mask_start0"), none.alias("mask_end0"))


def window_draws(windows: DataFrame, repeats: int, seed: int) -> DataFrame:
    """(gene_id, start0, end0, repeat, order): how each repeat permutes a window, on whatever background."""
    rows = windows.select("gene_id", "start0", "end0").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return rows.withColumn("order", hashed_order((F.col("end0") - F.col("start0")).cast("int"), seed, F.col("gene_id"), F.col("start0"), F.col("end0"), F.col("repeat")))


def pieces(held: DataFrame, windows: DataFrame, draws: DataFrame) -> DataFrame:
    """(gene_id, cond_id, start0, end0, repeat, piece, changed_bp, clear): the scrambled bases of every window of every background; without the sequences."""
    spans = windows.select("gene_id", "start0", "end0").distinct().groupBy("gene_id").agg(F.collect_list(F.struct("start0", "end0")).alias("_w"))  # a gene's windows
    block = lambda w: F.substring("sequence", (w["start0"] - F.col("input_start0") + 1).cast("int"), (w["end0"] - w["start0"]).cast("int"))
    each = held.join(spans, "gene_id").select("gene_id", "cond_id", F.explode(F.transform("_w", lambda w: F.struct(w["start0"].alias("start0"), w["end0"].alias("end0"), block(w).alias("block")))).alias("w")).select("gene_id", "cond_id", "w.*")
    rows = each.join(draws, ["gene_id", "start0", "end0"]).withColumn("piece", permuted(F.col("block"), F.col("order")))
    clear = F.col("block").rlike("^[ACGT]+$")
    return rows.select("gene_id", "cond_id", "start0", "end0", "repeat", "piece", F.when(clear, differing(F.col("block"), F.col("piece"))).otherwise(0).alias("changed_bp"), clear.alias("clear"))


def score_pieces(held: DataFrame, rows: DataFrame, factory: Callable[[], Scorer], chunk: int = CHUNK, batch: int = BATCH) -> DataFrame:
    """(gene_id, cond_id, start0, end0, repeat, prediction) of each piece that changes its background; ``chunk`` of them meet one copy of its sequence."""
    changed = rows.where("clear AND changed_bp > 0")
    n = changed.groupBy("gene_id", "cond_id").agg(F.count("*").alias("_n"))
    dealt = changed.join(n, ["gene_id", "cond_id"]).withColumn("_chunk", F.pmod(F.xxhash64("start0", "end0", "repeat"), F.ceil(F.col("_n") / chunk)))
    groups = dealt.groupBy("gene_id", "cond_id", "_chunk").agg(F.collect_list(F.struct("start0", "end0", "repeat", "piece")).alias("pieces"))  # about ``chunk`` of them
    both = groups.join(held.select("gene_id", "cond_id", "input_start0", "sequence"), ["gene_id", "cond_id"]).select("gene_id", "cond_id", "input_start0", "sequence", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()
        for rows in batches:
            for r in range(len(rows)):
                gene, cond, begin, text, found = (rows.column(i)[r].as_py() for i in range(5))
                values: list[float] = []
                for a in range(0, len(found), batch):
                    part = found[a : a + batch]
                    values += np.asarray(scorer.score([text[: p["start0"] - begin] + p["piece"] + text[p["end0"] - begin :] for p in part]), float).tolist()
                numbers = [pa.array([p[c] for p in found], pa.int64()) for c in ("start0", "end0", "repeat")]
                yield pa.RecordBatch.from_arrays([pa.array([gene] * len(found)), pa.array([cond] * len(found)), *numbers, pa.array(values, pa.float64())], names=["gene_id", "cond_id", "start0", "end0", "repeat", "prediction"])

    return both.mapInArrow(run, "gene_id string, cond_id string, start0 bigint, end0 bigint, repeat bigint, prediction double")


def scan_backgrounds(held: DataFrame, windows: DataFrame, factory: Callable[[], Scorer], repeats: int, seed: int, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Baselines (gene_id, cond_id, mask_start0, mask_end0, baseline), and scores (gene_id, cond_id, start0, end0, repeat, changed_bp, status, delta) of every window and repeat on every background.

    A scramble that changes nothing has delta 0; a window with other letters has none.
    """
    held = written(held, "backgrounds")
    base = written(scored(held, factory, "sequence", "baseline").select("gene_id", "cond_id", "mask_start0", "mask_end0", "baseline"), "baselines")
    rows = written(pieces(held, windows, window_draws(windows, repeats, seed)), "pieces")
    found = written(score_pieces(held, rows, factory, chunk), "predictions")
    keys = ["gene_id", "cond_id", "start0", "end0", "repeat"]
    any_ = rows.groupBy("gene_id", "cond_id", "start0", "end0").agg(F.when(~F.bool_and("clear"), "skipped_ambiguous_or_padding").when(F.max("changed_bp") > 0, "tested").otherwise("unchanged_all_scrambles").alias("status"))
    both = rows.join(found, keys, "left").join(base.select("gene_id", "cond_id", "baseline"), ["gene_id", "cond_id"]).join(any_, keys[:-1])
    delta = F.when(~F.col("clear"), None).when(F.col("changed_bp") == 0, 0.0).otherwise(F.col("prediction") - F.col("baseline"))
    return base, both.select(*keys, "changed_bp", "status", delta.alias("delta"))


def mask_effects(base: DataFrame, conds: DataFrame) -> DataFrame:
    """(gene_id, mask_id, kind, matched_to, rep, mask_start0, mask_end0, knockout_effect): a masked background's prediction minus the intact one."""
    plain = base.where(F.col("cond_id") == INTACT).select("gene_id", F.col("baseline").alias("_intact"))
    masked = base.where(F.col("cond_id") != INTACT).join(plain, "gene_id").withColumn("knockout_effect", F.col("baseline") - F.col("_intact"))
    return conds.select("gene_id", "cond_id", "mask_id", "kind", "matched_to", "rep").join(masked, ["gene_id", "cond_id"]).select("gene_id", "mask_id", "kind", "matched_to", "rep", "mask_start0", "mask_end0", "knockout_effect")


WINDOW = ("gene_id", "mask_id", "kind", "matched_to", "start0", "end0", "is_control")


def window_table(scores: DataFrame, base: DataFrame, conds: DataFrame, windows: DataFrame, threshold: float) -> DataFrame:
    """One row for each condition and window: valid, overlaps_mask, pairing_ok, mean effects on both backgrounds, epsilon, and crossings; null statistics where it isn't valid."""
    spot = ["gene_id", "start0", "end0", "repeat"]
    plain = scores.where(F.col("cond_id") == INTACT).select(*spot, F.col("delta").alias("delta_ref"), F.col("changed_bp").alias("_ref_bp"), F.col("status").alias("_ref_status"))
    rows = scores.where(F.col("cond_id") != INTACT).join(plain, spot).join(conds.select("gene_id", "cond_id", "mask_id", "kind", "matched_to", "rep"), ["gene_id", "cond_id"])
    rows = rows.join(base.select("gene_id", "cond_id", "mask_start0", "mask_end0"), ["gene_id", "cond_id"]).join(windows.select("gene_id", "start0", "end0", "is_control").distinct(), ["gene_id", "start0", "end0"])
    pairs = rows.withColumns({"delta_masked": F.col("delta"), "epsilon": F.col("delta") - F.col("delta_ref")})
    flags = pairs.groupBy(*WINDOW, "rep").agg(
        F.bool_and((F.col("status") == "tested") & (F.col("_ref_status") == "tested")).alias("valid"),
        F.bool_or(F.coalesce((F.col("start0") < F.col("mask_end0")) & (F.col("mask_start0") < F.col("end0")), F.lit(False))).alias("overlaps_mask"),
        F.bool_and(F.col("changed_bp") == F.col("_ref_bp")).alias("_same"),
    )
    found = flags.join(effects.epsilon_shuffles(pairs, WINDOW, threshold), [*WINDOW, "rep"])
    told = {c: F.when(F.col("valid"), F.col(c)) for c in ("delta_ref", "delta_masked", "epsilon", "epsilon_sd_scrambles")}
    told |= {c: F.col("valid") & F.col(c) for c in ("crosses_up", "crosses_down")}
    return found.withColumns({**told, "pairing_ok": ~F.col("valid") | F.col("overlaps_mask") | F.col("_same")}).drop("_same")


def window_summary(table: DataFrame) -> DataFrame:
    """Per mask and window over its usable reshuffles."""
    return effects.epsilon_windows(table, WINDOW)


def region_table(table: DataFrame, targets: DataFrame, masks: DataFrame, width: int = BIN) -> DataFrame:
    """Per mask and target region (or the gene's control windows under CONTROL): epsilon over the target's usable windows, then over reshuffles; knockout effects; and, for hits, their matched nulls.

    targets: (gene_id, region_id, start0, end0); a hit isn't its own target. masks: mask_effects().
    """
    keys = ["gene_id", "mask_id", "kind", "matched_to", "target_id"]
    rows = effects.usable(table)
    spans = rows.select("gene_id", "start0", "end0").distinct()
    on = range_join(spans, targets.select("gene_id", "region_id", "start0", "end0"), ["gene_id"], width).select("gene_id", "start0", "end0", F.col("r_region_id").alias("target_id")).distinct()
    held = rows.join(on, ["gene_id", "start0", "end0"]).where("NOT (kind = 'hit' AND target_id = matched_to)").unionByName(rows.where("is_control").withColumn("target_id", F.lit(CONTROL)))
    found = effects.epsilon_regions(held, keys, ("start0", "end0"))
    knocked = masks.groupBy("gene_id", "mask_id").agg(F.min("mask_start0").alias("mask_start0"), F.max("mask_end0").alias("mask_end0"), F.avg("knockout_effect").alias("mask_effect_mean"), F.stddev_samp("knockout_effect").alias("mask_effect_sd_reps"))
    found = found.join(knocked, ["gene_id", "mask_id"])
    nulls = found.where("kind = 'null'").groupBy("gene_id", F.col("matched_to").alias("mask_id"), "target_id").agg(F.count_distinct("mask_id").alias("n_null_masks"), F.avg("epsilon_mean").alias("null_epsilon_mean"), F.max(F.abs("epsilon_mean")).alias("null_abs_epsilon_max"))
    return found.join(nulls, ["gene_id", "mask_id", "target_id"], "left").withColumn("exceeds_all_nulls", F.when(F.col("kind") == "hit", F.abs("epsilon_mean") > F.col("null_abs_epsilon_max")))


def run(
    targets: DataFrame, hits: DataFrame, nulls: DataFrame | None, windows: DataFrame, factory: Callable[[], Scorer], reshuffles: int, repeats: int, threshold: float, seed: int = 0, mask_seed: int = 1, width: int = BIN, chunk: int = CHUNK
) -> dict[str, DataFrame]:
    """windows_by_condition, window_summary, mask_effects and region_epistasis of targets (gene_id, start0, sequence), hits (gene_id, region_id, start0, end0), nulls (gene_id, hit_id, number, start0, end0) and the windows to scan (gene_id, start0, end0, is_control)."""
    conds = written(conditions(hits, nulls, reshuffles), "conditions")
    base, scores = scan_backgrounds(intact(targets).unionByName(backgrounds(targets, conds, mask_seed)), windows, factory, repeats, seed, chunk)
    table = written(window_table(scores, base, conds, windows, threshold), "windows-by-condition")
    masks = mask_effects(base, conds)
    return {"windows_by_condition": table, "window_summary": window_summary(table), "mask_effects": masks, "region_epistasis": region_table(table, hits, masks, width)}


def fingerprints(conds: DataFrame, windows: DataFrame, settings: Sequence[object]) -> DataFrame:
    """``conds`` with the fingerprint of all that a condition's scores follow from: its mask, its gene's windows, and the settings."""
    spans = windows.select("gene_id", "start0", "end0").distinct().groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("start0", "end0"))).alias("_w"))
    what = F.to_json(F.struct(F.lit("|".join(map(str, settings))).alias("settings"), "cond_id", "kind", "mask_id", "start0", "end0", "rep", "_w"))
    return conds.join(spans, "gene_id").withColumn("fingerprint", F.sha2(what, 256)).drop("_w")
