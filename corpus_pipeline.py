"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next stage's
documents. All but the last return the columns of documents (extra columns of the input pass through). Null and empty texts pass every
stage that doesn't reject them by its own rule.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanforge.llm import byte_bpe, decontaminate, near_dedup, quality_cnn, secret_scan
from spanforge.llm.common import table
from spanforge.sources.shared import clear, mark, written

#: Documents whose score is below this are rejected: those that op6 predicts as 0.
REJECT = 0.5
#: Words of a shingle of the near-dedup (op7 alone is bound to 2).
SHINGLE = 5
#: Contaminated documents (two numbers each) that are broadcast; more meet the texts by a shuffle.
FEW = 500_000
#: What stands for a secret.
MASK = "[SECRET]"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
OWN = ("doc_id", "text", "n_chars")


def any_columns(stage: Stage) -> Stage:
    """The stage, on documents whose other columns have names that clash with none of its own; it returns them under theirs."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"column{i}" for i, c in enumerate(docs.columns)]
        found = stage(spark, docs.toDF(*names), sf_dir)
        return found.toDF(*docs.columns) if found.columns == names else found

    return run


@any_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier doesn't reject."""
    net = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.score(docs, net).where(F.col("_score") >= REJECT).drop("_score")


@any_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest doc_id (one row of it, if it is repeated)."""
    found = near_dedup.link(docs, size=SHINGLE).where("kept").select("doc_id", "text_key").distinct().alias("k")
    keyed = docs.withColumn("_key", F.xxhash64("text")).alias("d")
    kept = keyed.join(found, F.expr("d.doc_id <=> k.doc_id AND d._key = k.text_key"), "left_semi")
    # rows that repeat both id and text are one document; a null id has no group of its own
    named = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "_key"])
    return named.unionByName(kept.where(F.col("doc_id").isNull()).dropDuplicates(["_key"])).drop("_key").select(*docs.columns)


@any_columns
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    hit = written(decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "_dc_key").distinct(), "contaminated")
    if hit.count() <= FEW:  # then no text is shuffled
        hit = F.broadcast(hit)
    keyed = docs.withColumn("_key", F.xxhash64("text")).alias("d")
    return keyed.join(hit.alias("h"), F.expr("d.doc_id <=> h.doc_id AND d._key = h._dc_key"), "left_anti").select(*docs.columns)


@any_columns
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in the texts; n_chars follows."""
    masked = secret_scan.scan(docs, mask=MASK)
    changed = F.size("_found") > 0
    columns = {f.name: f.dataType for f in docs.schema.fields}
    out = [F.col(c) for c in docs.columns if c not in ("text", "n_chars")]
    text = F.when(changed, F.col("_masked")).otherwise(F.col("text")).alias("text")
    n_chars = [F.when(changed, F.length("_masked")).otherwise(F.col("n_chars")).cast(columns["n_chars"]).alias("n_chars")] if "n_chars" in columns else []
    return masked.select(*out, text, *n_chars).select(*docs.columns)


@any_columns
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids; ``lossless`` says that they decode to the text's bytes."""
    found = byte_bpe.tokenize(docs)
    lossless = F.col("_decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return found.select("doc_id", F.col("_ids").alias("ids"), F.size("_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("_ids", ","), 256).alias("ids_sha256"), lossless.alias("lossless"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("byte-level BPE", tokens),
]
#: SQL can't express the classifier, the field's tags and the encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``. What a stage wrote for itself, and the documents that it read, go once its result is written."""
    docs, since = table(spark, sf_dir, "documents"), mark(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear(spark, since, keep=1)
    return docs
