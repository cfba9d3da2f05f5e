"""Proportional stratified interleaving: shards that each match the mixture of sources.

Rows are shuffled by a seeded hash and ranked within their source; row r of n has the fractional rank
(2r - 1) / 2n. All rows sorted by fractional rank (then source, then hash) are cut into shards whose counts are at most one
apart, so every shard holds each source in proportion.

A source may hold a third of all rows, so no window runs over a source or over all rows. Rows fall into cells
by the leading bits of the hash; counts of cells, summed before the shuffle, give each cell the rank at which it begins, and
a window ranks rows within a cell only. The sort by fractional rank is made the same way. The number of cells grows
with the rows, so a cell stays near ``CELL`` rows.

Null texts have size 1 and checksum 0, a null source is a source of its own, and repeated rows each take a slot. An empty table gives
no rows. Columns beside doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from spanforge.llm.common import cut, table

SHARDS, SEED, CELL = 16, "mixture-1", 256


def _begins(cells: DataFrame, within: list, order: list) -> DataFrame:
    """For each cell the number of rows before it."""
    w = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0)))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source for each row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        F.coalesce(F.col("source"), F.lit("\x00null")).alias("_src"),
        F.col("source"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("_h", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size"))
    slim = cut(slim, "shard-rows")
    total = slim.count()
    level = max(1, -(-total // CELL))
    # the cell follows from the high bits of the hash, so cells are in the order of the hash
    unit = (F.shiftrightunsigned("_h", 11).cast("double") / F.lit(float(1 << 53)))
    slim = slim.withColumn("_u", F.floor(unit * level).cast("long"))
    cells = slim.groupBy("_src", "_u").agg(F.count("*").alias("_rows"))
    cells = cut(cells, "shard-cells")
    coarse = max(1, level // CELL)
    # prefix sums in two levels, so that no window holds more than about CELL cells of a source
    cells = cells.withColumn("_c", F.floor(F.col("_u") / F.lit(max(1, level // coarse))).cast("long"))
    blocks = _begins(cells.groupBy("_src", "_c").agg(F.sum("_rows").alias("_rows")), ["_src"], ["_c"]).select("_src", "_c", F.col("_before").alias("_block"))
    begins = _begins(cells, ["_src", "_c"], ["_u"]).join(blocks, ["_src", "_c"]).select("_src", "_u", (F.col("_before") + F.col("_block")).alias("_begin"))
    sizes = cells.groupBy("_src").agg(F.sum("_rows").alias("_n"))
    w = W.partitionBy("_src", "_u").orderBy(F.shiftrightunsigned("_h", 1), "_h", "doc_id", "text_crc32", "size")
    ranked = (
        slim.withColumn("_r", F.row_number().over(w))
        .join(begins, ["_src", "_u"])
        .join(sizes, "_src")
        .withColumn("_rank", F.col("_r") + F.col("_begin"))
        .withColumn("_f", (2 * F.col("_rank") - 1) / (2 * F.col("_n")).cast("double"))
        .select("doc_id", "source", "size", "text_crc32", "_src", "_h", "_f", "_rank", F.least(F.floor(F.col("_f") * level), F.lit(level - 1)).cast("long").alias("_v"))
    )
    ranked = cut(ranked, "shard-ranks")
    cells = ranked.groupBy("_v").agg(F.count("*").alias("_rows")).withColumn("_c", F.floor(F.col("_v") / F.lit(max(1, level // coarse))).cast("long"))
    blocks = _begins(cells.groupBy("_c").agg(F.sum("_rows").alias("_rows")).withColumn("_one", F.lit(0)), ["_one"], ["_c"]).select("_c", F.col("_before").alias("_block"))
    begins = _begins(cells, ["_c"], ["_v"]).join(blocks, "_c").select("_v", (F.col("_before") + F.col("_block")).alias("_begin"))
    w = W.partitionBy("_v").orderBy("_f", "_src", "_rank")
    base, extra = divmod(total, shards)
    at = F.col("_at")
    edge = extra * (base + 1)
    placed = (
        ranked.withColumn("_r", F.row_number().over(w))
        .join(begins, "_v")
        .withColumn("_at", F.col("_r") - 1 + F.col("_begin"))
        .withColumn("shard", F.when(at < edge, F.floor(at / F.lit(base + 1))).otherwise(extra + F.floor((at - edge) / F.lit(max(base, 1)))).cast("int"))
        .withColumn("slot", (at - F.when(F.col("shard") < extra, F.col("shard") * F.lit(base + 1)).otherwise(edge + (F.col("shard") - extra) * F.lit(base))).cast("long"))
    )
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


QUERIES = {"op4_stratified_interleave": lambda spark, sf_dir: interleave(table(spark, sf_dir, "documents"))}
ORACLE: dict[str, str] = {}
