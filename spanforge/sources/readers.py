"""Readers of interval, annotation and result files. Columns are strings unless they are numbers by definition; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from spanforge.sources.shared import written


def _long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("bigint")


def lines(spark: SparkSession, path: str | Sequence[str], skip: str = r"^(#|track\b|browser\b|\s*$)") -> DataFrame:
    """Text lines (value, path) without comments, track lines and blank lines."""
    return spark.read.text(path if isinstance(path, str) else list(path)).select("value", F.input_file_name().alias("path")).where(~F.col("value").rlike(skip))


def fields(rows: DataFrame, names: Sequence[str], sep: str = "\t") -> DataFrame:
    """Lines split into named string columns; missing ones are null."""
    parts = F.split("value", sep)
    return rows.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)], "path")


def table(spark: SparkSession, path: str | Sequence[str], null: str = "", sep: str = "\t") -> DataFrame:
    """A file with a header, all columns strings; gz is read too."""
    return spark.read.option("sep", sep).option("header", True).option("inferSchema", False).option("nullValue", null).csv(path if isinstance(path, str) else list(path))


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def regions(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Region files: region_id, gene_id, chrom, start0, end0, length and what else there is; one row for each region_id."""
    df = required(table(spark, path), ["gene_id", "chrom", "start0", "end0"]).withColumns({"start0": _long("start0"), "end0": _long("end0")}).where("end0 > start0")
    return df.withColumn("region_id", F.concat_ws("|", "gene_id", "chrom", "start0", "end0")).dropDuplicates(["region_id"]).withColumn("length", F.col("end0") - F.col("start0"))


def tested_space(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start0, end0, gene_id from a headerless four-column BED, or from a table with a header (.tsv, .tsv.gz); an empty file is an error."""
    df = table(spark, path).select("chrom", "start0", "end0", "gene_id") if path.endswith((".tsv", ".tsv.gz")) else fields(lines(spark, path), ["chrom", "start0", "end0", "gene_id"]).drop("path")
    df = df.withColumns({"start0": _long("start0"), "end0": _long("end0")})
    if df.isEmpty():
        raise ValueError(f"no tested space in {path}")
    return df


def bed(spark: SparkSession, path: str | Sequence[str], names: Sequence[str] = ("chrom", "start0", "end0")) -> DataFrame:
    """BED rows with numeric coordinates; others are left out."""
    return fields(lines(spark, path), names).drop("path").withColumns({"start0": _long("start0"), "end0": _long("end0")}).where("start0 IS NOT NULL AND end0 IS NOT NULL")


def bedgraph(spark: SparkSession, path: str | Sequence[str], territory: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """Signal (chrom, start0, end0, value); within a merged territory it is clipped to it, and values under the threshold are left out."""
    from spanforge.operators.intervals import range_join

    df = bed(spark, path, ("chrom", "start0", "end0", "value")).withColumn("value", F.col("value").try_cast("double")).where("value IS NOT NULL")
    if threshold is not None:
        df = df.where(F.col("value") >= threshold)
    if territory is None:
        return df
    both = range_join(df, territory.select("chrom", "start0", "end0"))
    return both.select("chrom", F.greatest("start0", "r_start0").alias("start0"), F.least("end0", "r_end0").alias("end0"), "value")


def strict_anchors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One-base BED6: (gene_id, chrom, tss0, strand) of the valid rows, and (gene_id, reason) of those that are not.

    A row needs six fields, whole coordinates with end = start + 1 and a strand; a gene needs one anchor.
    """
    rows = fields(lines(spark, path), ["chrom", "start0", "end0", "gene_id", "score", "strand"]).drop("path").withColumns({"start0": _long("start0"), "end0": _long("end0")})
    reason = F.when(F.col("strand").isNull() | F.col("gene_id").isNull(), "fields").when(F.col("start0").isNull() | F.col("end0").isNull(), "coordinates").when(F.col("end0") != F.col("start0") + 1, "not_one_base").when(~F.col("strand").isin("+", "-"), "strand")
    rows = rows.withColumn("reason", reason)
    anchors = rows.where("reason IS NULL").select("gene_id", "chrom", F.col("start0").alias("tss0"), "strand").distinct()
    several = anchors.groupBy("gene_id").agg(F.count("*").alias("n")).where("n > 1").select("gene_id", F.lit("ambiguous_tss").alias("reason"))
    good = anchors.join(several, "gene_id", "left_anti")
    return good, rows.where("reason IS NOT NULL").select("gene_id", "reason").unionByName(several)


def match_anchors(targets: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets (gene_id) with their anchor by exact id, else by id without version; and (gene_id, reason): missing_tss, ambiguous_tss."""
    bare = lambda c: F.regexp_replace(c, r"\.\d+$", "")
    a = anchors.select(F.col("gene_id").alias("_id"), bare("gene_id").alias("_bare"), "chrom", "tss0", "strand").distinct()
    both = targets.select("gene_id", bare("gene_id").alias("_bare")).distinct().join(a, "_bare", "left").withColumn("_rank", F.when(F.col("_id") == F.col("gene_id"), 0).otherwise(1))
    best = both.withColumn("_best", F.min("_rank").over(W.partitionBy("gene_id"))).where("_rank = _best")
    n = best.groupBy("gene_id").agg(F.count("_id").alias("n"))
    good = best.join(n.where("n = 1"), "gene_id", "left_semi").select("gene_id", "chrom", "tss0", "strand")
    return good, n.where("n <> 1").select("gene_id", F.when(F.col("n") == 0, "missing_tss").otherwise("ambiguous_tss").alias("reason"))


def placed_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines (value) of one file or many, with ``file`` and ``position``, which grows in the order of the files and their lines however they are split: a split is read in order by one task."""
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path if isinstance(path, str) else list(path)).select("value", F.col("_metadata.file_path").alias("file"), where.alias("position"))


def headed(rows: DataFrame) -> tuple[str | None, DataFrame]:
    """The header of placed_lines(), and the lines without each file's own; files with different headers are an error."""
    first = rows.groupBy("file").agg(F.min("position").alias("_first"), F.min_by("value", "position").alias("_head"))
    heads = [r[0] for r in first.select("_head").distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError("files with different headers")
    return (heads[0] if heads else None), rows.join(first.select("file", "_first"), "file").where(F.col("position") != F.col("_first")).drop("_first")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A white-space table with a header line, all strings, missing cells empty."""
    rows = placed_lines(spark, path).where(F.trim("value") != "")
    head, rest = headed(rows)
    parts = F.split(F.trim("value"), r"\s+")
    return rest.select(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate((head or "").split())])


def annotation_sets(tracks: DataFrame, skip_role: str = "mask") -> DataFrame:
    """One row for each set (name): its paths of the preferred type, bigwig before bed; masks are left out."""
    kept = tracks.where(F.col("role") != skip_role)
    first = kept.groupBy("name").agg(F.min(F.when(F.col("type") == "bigwig", 0).otherwise(1)).alias("_t"))
    return kept.join(first, "name").where((F.col("_t") == 0) == (F.col("type") == "bigwig")).groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def gtf(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    """GTF rows, half-open: feature, chrom, start0, end0, strand, gene_id, gene_name, transcript_id, tags, and position, their place in the file."""
    names = ["chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"]
    parts = F.split("value", "\t")
    rows = placed_lines(spark, path).where(~F.col("value").rlike(r"^(#|\s*$)")).select("position", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    value = lambda k: F.nullif(F.regexp_extract("attributes", rf'{k} "([^"]*)"', 1), F.lit(""))
    out = rows.select("feature", "chrom", (_long("start") - 1).alias("start0"), _long("end").alias("end0"), "strand", *[value(k).alias(k) for k in ("gene_id", "gene_name", "transcript_id")], F.regexp_extract_all("attributes", F.lit(r'tag "([^"]*)"'), 1).alias("tags"), "position")
    return out.where(F.col("feature") == feature) if feature else out


def canonical_transcripts(transcripts: DataFrame) -> DataFrame:
    """One transcript for each gene (its id without version): the first in the file that is tagged MANE_Select, else the first tagged Ensembl_canonical.

    Genes without either tag, on chrM or of PAR_Y are left out. The anchor is the strand's first base.
    """
    rank = F.when(F.array_contains("tags", "MANE_Select"), 0).when(F.array_contains("tags", "Ensembl_canonical"), 1)
    kept = transcripts.where(rank.isNotNull() & ~F.col("chrom").isin("chrM", "MT") & ~F.col("gene_id").endswith("_PAR_Y"))
    bare = F.regexp_extract("gene_id", r"^[^.]*", 0).alias("gene_id")
    best = kept.groupBy(bare).agg(F.min_by(F.struct("chrom", "start0", "end0", "strand", "transcript_id"), F.struct(rank, "position")).alias("t")).select("gene_id", "t.*")
    return best.withColumn("tss0", F.when(F.col("strand") == "-", F.col("end0") - 1).otherwise(F.col("start0")))


def exon_unions(exons: DataFrame) -> DataFrame:
    """Merged exons for each gene; a gene on two chromosomes or strands is an error."""
    from spanforge.operators.intervals import merge

    if not exons.groupBy("gene_id").agg(F.count_distinct("chrom", "strand").alias("n")).where("n > 1").isEmpty():
        raise ValueError("exons of one gene lie on several chromosomes or strands")
    return merge(exons, ("gene_id", "chrom", "strand"))


def fai(spark: SparkSession, path: str) -> DataFrame:
    """contig, length, offset, bases, width of a FASTA index; a contig that stands twice is an error."""
    df = fields(lines(spark, path), ["contig", "length", "offset", "bases", "width"]).drop("path")
    df = df.select("contig", *[_long(c).alias(c) for c in ("length", "offset", "bases", "width")])
    if not df.groupBy("contig").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a contig stands twice in the index")
    return df


def fasta(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """(contig, chunk, sequence): sequences in chunks of ``size`` bases, so no contig is one value.

    Spark splits the files as it likes: each split yields pieces of sequence, and what the splits before it hold of the contig, as counts of pieces, tells where a piece begins.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, contig, held, part = None, None, [], 0
        columns = ["path", "block", "part", "contig", "opens", "sequence"]
        rows: list[tuple] = []
        opens = False

        def end() -> None:
            nonlocal held, part, opens
            if where is not None and (held or opens):
                text = "".join(held)
                for a in range(0, max(1, len(text)), size):
                    rows.append((*where, part, contig, opens and a == 0, text[a : a + size]))
                    part += 1
            held, opens = [], False

        total = 0
        for batch in batches:
            for place, block, line in zip(batch["path"], batch["block"], batch["value"], strict=True):
                if (place, block) != where:
                    end()
                    where, contig, part, total = (place, block), None, 0, 0
                if line.startswith(">"):
                    end()
                    contig, opens, total = line[1:].split()[0], True, 0
                elif text := line.strip():
                    held.append(text)
                    total += len(text)
                    if total >= size:
                        end()
                        total = 0
            yield pd.DataFrame(rows, columns=columns)
            rows.clear()
        end()
        yield pd.DataFrame(rows, columns=columns)

    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    found = written(text.mapInPandas(pieces, "path string, block bigint, part bigint, contig string, opens boolean, sequence string"), "fasta")
    # a row without its bases for each piece: which contig it continues, and how many bases of that come before
    order = W.partitionBy("path").orderBy("block", "part")
    counted = found.select("path", "block", "part", "opens", "contig", F.length("sequence").alias("n")).withColumn("_run", F.sum(F.col("opens").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    within = W.partitionBy("path", "_run").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.select("path", "block", "part", F.first("contig").over(W.partitionBy("path", "_run").orderBy("block", "part")).alias("contig"), F.coalesce(F.sum("n").over(within), F.lit(0)).alias("start0"))
    both = found.drop("contig", "opens").join(placed, ["path", "block", "part"]).where("contig IS NOT NULL AND sequence <> ''")
    cut = both.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start0") / size), F.floor((F.col("start0") + F.length("sequence") - 1) / size)).cast("array<bigint>")))
    begin = F.greatest("start0", F.col("chunk") * size)
    bases = F.substring("sequence", (begin - F.col("start0") + 1).cast("int"), (F.least(F.col("start0") + F.length("sequence"), (F.col("chunk") + 1) * size) - begin).cast("int"))
    return cut.groupBy("contig", "chunk").agg(F.array_sort(F.collect_list(F.struct(begin.alias("b"), bases.alias("s")))).alias("p")).select("contig", "chunk", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("sequence"))


def fetch(intervals: DataFrame, chunks: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``intervals`` with their sequence; positions outside a contig are N."""
    held = intervals.withColumn("_id", F.concat_ws("|", "chrom", "start0", "end0")).select("_id", "chrom", "start0", "end0").distinct()
    spots = held.withColumn("chunk", F.explode(F.sequence(F.floor(F.greatest("start0", F.lit(0)) / size), F.floor((F.greatest(F.col("end0"), F.lit(1)) - 1) / size)).cast("array<bigint>")))
    both = spots.join(chunks.withColumnRenamed("contig", "chrom"), ["chrom", "chunk"])
    begin = F.greatest(F.col("start0"), F.col("chunk") * size)
    part = F.expr(f"substring(sequence, CAST(greatest(start0, chunk * {size}) - chunk * {size} + 1 AS INT), CAST(least(end0, (chunk + 1) * {size}) - greatest(start0, chunk * {size}) AS INT))")
    found = both.select("_id", F.struct(begin.alias("b"), F.upper(part).alias("s")).alias("p")).groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["s"]), "").alias("_s"))
    left = F.repeat(F.lit("N"), F.greatest(F.lit(0), F.least(F.col("end0"), F.lit(0)) - F.col("start0")).cast("int"))
    whole = F.concat(left, F.coalesce("_s", F.lit("")))
    return intervals.withColumn("_id", F.concat_ws("|", "chrom", "start0", "end0")).join(found, "_id", "left").withColumn("sequence", F.rpad(whole, (F.col("end0") - F.col("start0")).cast("int"), F.lit("N"))).drop("_id", "_s")


def gene_list(spark: SparkSession, path: str, column: str = "gene_id", pattern: str | None = None) -> DataFrame:
    """Gene ids of a list with or without a header, first occurrences, in order (``position``); ids that don't match the pattern are an error."""
    rows = placed_lines(spark, path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    head, rest = headed(rows)  # the header, if there is one
    names = (head or "").strip().split("\t")
    at = names.index(column) if column in names else 0
    ids = (rest if column in names else rows).select(F.trim(F.get(F.split("value", "\t"), F.lit(at))).alias("gene_id"), "position")
    if pattern and not ids.where(~F.col("gene_id").rlike(pattern)).isEmpty():
        raise ValueError("an id doesn't match the pattern")
    return ids.groupBy("gene_id").agg(F.min("position").alias("position"))


def gene_symbols(spark: SparkSession, path: str) -> DataFrame:
    """gene_id and the gene_name of its first row in a GTF."""
    rows = placed_lines(spark, path).where(F.col("value").rlike('gene_name "'))
    value = lambda k: F.regexp_extract("value", rf'{k} "([^"]*)"', 1)
    return rows.groupBy(value("gene_id").alias("gene_id")).agg(F.min_by(value("gene_name"), "position").alias("gene_name"))


def canonical_in(transcripts: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """The canonical transcripts that reach into a window."""
    return canonical_transcripts(transcripts).where((F.col("chrom") == chrom) & (F.col("start0") < end) & (F.col("end0") > start))


def first_by_gene(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The first row of each gene_id of a table with a header, in the order of the file."""
    rows = placed_lines(spark, path)
    head, rest = headed(rows)
    names = [x.strip() for x in (head or "").split(sep)]
    parts = F.split("value", sep)
    each = rest.select("position", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return each.groupBy("gene_id").agg(F.min_by(F.struct(*[n for n in names if n != "gene_id"]), "position").alias("_r")).select("gene_id", "_r.*")


def keyed_files(spark: SparkSession, pattern: str, key: str, regex: str) -> DataFrame:
    """Tables of many files read as one; ``key`` is taken from each path."""
    return table(spark, pattern).withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), regex, 1))


def motif_results(spark: SparkSession, path: str) -> DataFrame:
    """Known-motif results: motif, consensus, log_p, q, percentages, and the totals that stand in the header."""
    placed = placed_lines(spark, path)
    head, rows = headed(placed)
    head = (head or "").split("\t")

    def find(prefix: str) -> int:
        return next(i for i, h in enumerate(head) if h.startswith(prefix))

    import re

    totals = {n: int(m[1]) if (m := re.search(r"of (\d+)", head[find(p)])) else None for n, p in (("n_target", "# of Target Sequences with"), ("n_background", "# of Background Sequences with"))}
    parts = F.split("value", "\t")
    number = lambda p: F.rtrim(F.get(parts, F.lit(find(p))), F.lit("%")).try_cast("double")
    return rows.select(F.get(parts, F.lit(find("Motif Name"))).alias("motif"), F.get(parts, F.lit(find("Consensus"))).alias("consensus"), number("Log P-value").alias("log_p"), number("q-value").alias("q"), number("% of Target").alias("pct_target"), number("% of Background").alias("pct_background"), *[F.lit(v).alias(n) for n, v in totals.items()])


def prefixed_annotations(spark: SparkSession, path: str, prefix: str, drop: Sequence[str] = ()) -> DataFrame:
    """A result table whose first column is the region's id; the others are prefixed, those in ``drop`` left out."""
    df = table(spark, path)
    return df.toDF("region_id", *[f"{prefix}{c}" for c in df.columns[1:]]).drop(*[f"{prefix}{c}" for c in drop])


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start0, end0, barcode of a fragment file."""
    return bed(spark, path, ("chrom", "start0", "end0", "barcode"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one for each file."""
    return spark.read.option("multiLine", True).json(path)
