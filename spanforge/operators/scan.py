"""The perturbation scan: windows of a sequence are scrambled, scored by a plug-in, and compared with the intact sequence.

A scorer is any object with score(sequences) -> numbers; it is made in each task from a factory, so a model is loaded once for a task and Arrow
batches have its batch size. Everything after the scores is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from spanforge.operators import effects, intervals, sampling


class Scorer(Protocol):
    def score(self, sequences: list[str]) -> np.ndarray: ...


def scored(df: DataFrame, factory: Callable[[], Scorer], sequence: str = "sequence", name: str = "prediction") -> DataFrame:
    """``df`` with the scorer's value of each sequence; null sequences have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for batch in batches:
            out = np.full(len(batch), np.nan)
            has = batch[sequence].notna().to_numpy()
            if has.any():
                out[has] = np.asarray(scorer.score(batch[sequence][has].tolist()), float)
            yield batch.assign(**{name: out})

    found = df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))
    return found.withColumn(name, F.nanvl(name, F.lit(None).cast("double")))


def plan(targets: DataFrame, width: int, stride: int, repeats: int, seed: int) -> DataFrame:
    """(gene_id, start0, sequence; window_id, offset, repeat, seed): every window and repeat of each target's sequence."""
    length = F.length("sequence")
    last = length - width
    spots = F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))))
    rows = targets.where(length >= width).select("*", F.posexplode(spots).alias("window_id", "offset")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    start = F.col("start0") + F.col("offset")
    return rows.withColumn("seed", sampling.seed_of(seed, F.col("gene_id"), start, start + width, F.col("repeat")))


def perturb(rows: DataFrame, width: int, pairs: bool) -> DataFrame:
    """``rows`` of a plan with the window scrambled in place: sequence, changed_bp, status (tested, unchanged, ambiguous_bases)."""
    window = F.substring("sequence", F.col("offset") + 1, F.lit(width))
    out = sampling.scrambled(rows.withColumn("_window", window), "_window", "seed", pairs)
    changed = F.size(F.filter(F.zip_with(F.split("_window", ""), F.split("scrambled", ""), lambda a, b: a != b), lambda x: x))
    clear = F.col("_window").rlike("^[ACGT]*$")
    return out.withColumns(
        {
            "changed_bp": F.when(clear, changed).otherwise(0),
            "status": F.when(~clear, "ambiguous_bases").when(changed == 0, "unchanged").otherwise("tested"),
            "sequence": F.when(clear & (changed > 0), F.overlay("sequence", "scrambled", F.col("offset") + 1)),
        }
    ).drop("_window", "scrambled")


def scan(targets: DataFrame, factory: Callable[[], Scorer], width: int, stride: int, repeats: int, seed: int = 0, pairs: bool = True) -> DataFrame:
    """Scores (gene_id, chrom, start0, end0, window_id, repeat, status, changed_bp, baseline, prediction, delta) of targets (gene_id, chrom, start0, sequence)."""
    base = scored(targets, factory, "sequence", "baseline").select("gene_id", "baseline")
    rows = scored(perturb(plan(targets, width, stride, repeats, seed), width, pairs), factory).join(base, "gene_id")
    start = F.col("start0") + F.col("offset")
    return rows.select("gene_id", "chrom", start.alias("start0"), (start + width).alias("end0"), "window_id", "repeat", "status", "changed_bp", "baseline", "prediction", (F.col("prediction") - F.col("baseline")).alias("delta"))


def finish(scores: DataFrame, size: int, threshold: float, min_bp: int) -> dict[str, DataFrame]:
    """windows, segments, regions and tested space of a scan's scores; run again with other cutoffs without scoring anew. Mean absolute effects are smoothed, projected and called beside the signed ones."""
    keys = ["gene_id", "chrom", "start0", "end0"]
    windows = effects.repeat_stats(scores, keys)
    smoothed = intervals.smooth(windows, "mean_effect", size, ("gene_id", "chrom"), beside=["mean_abs_effect"])
    absolute = "smoothed_mean_abs_effect"
    segments = intervals.project(smoothed, "smoothed", beside=[absolute])
    return {"windows": smoothed, "segments": segments, "regions": intervals.call_regions(segments, threshold, min_bp, "smoothed", absolute=absolute), "tested": intervals.tested_space(smoothed, "mean_effect")}
