"""Column expressions on names, spans and effects."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def region_id(*columns: str) -> Column:
    """Columns joined by |, as strings."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def without_version(name: str, last_only: bool = False) -> Column:
    """An id without its version: all after the first dot, or (last_only) a last dot with digits."""
    return F.regexp_replace(name, r"\.\d+$", "") if last_only else F.substring_index(name, ".", 1)


def toggled_chrom(chrom: str) -> Column:
    """The other spelling of a chromosome: with or without chr."""
    return F.when(F.col(chrom).startswith("chr"), F.substring(chrom, 4, 1 << 20)).otherwise(F.concat(F.lit("chr"), F.col(chrom)))


def primary_contig(chrom: str) -> Column:
    """1 to 22, X, Y or MT for a primary contig in any spelling, else null."""
    bare = F.regexp_replace(F.upper(F.regexp_replace(chrom, "(?i)^chr", "")), r"^0+(?=[0-9]+$)", "")
    return F.when(bare.rlike(r"^([1-9]|1[0-9]|2[0-2]|X|Y)$"), bare).when(bare.isin("M", "MT"), "MT")


def is_main_chrom(chrom: str) -> Column:
    return F.col(chrom).rlike(r"^(chr)?([0-9]+|X|Y)$")


def cut(value: str, edges: list[float], labels: list[str], right: bool = False) -> Column:
    """Bins between edges, left-closed or right-closed (then with the lowest edge); null outside."""
    v, out = F.col(value), None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        inside = ((v > lo) & (v <= hi) | ((v == lo) if i == 0 else F.lit(False))) if right else (v >= lo) & (v < hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def safe_file_name(name: str) -> Column:
    """A name fit for files; changed names get eight digits of the original's SHA-256."""
    clean = F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")
    return F.when(clean == F.col(name), clean).otherwise(F.concat_ws("-", clean, F.substring(F.sha2(name, 256), 1, 8)))


def clipped(start: str, end: str, low, high) -> tuple[Column, Column]:
    """A span cut to bounds; keep rows whose new end is beyond the new start."""
    return F.greatest(F.col(start), low if isinstance(low, Column) else F.lit(low)), F.least(F.col(end), high if isinstance(high, Column) else F.lit(high))


def centred(anchor: str, length: int, contig_length: str) -> dict[str, Column]:
    """The interval of ``length`` around an anchor, and whether it lies in its contig."""
    start = F.col(anchor) - length // 2
    return {"start0": start, "end0": start + length, "in_contig": (start >= 0) & (start + length <= F.col(contig_length))}


def neg_log10_p(log_p: str) -> Column:
    return -F.col(log_p) / F.ln(F.lit(10.0))


def log2_fold(target: str, background: str) -> Column:
    """log2 of a ratio; null where either side is zero."""
    ratio = F.try_divide(F.col(target).cast("double"), F.col(background).cast("double"))
    return F.when(ratio > 0, F.log2(ratio))


def agrees(value: str, sign: str) -> Column:
    """Whether two signs agree; false where either is missing."""
    return F.coalesce(F.signum(value) == F.signum(sign), F.lit(False))


def normalised(name: str) -> Column:
    """Upper-case letters and digits only."""
    return F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def alias_match(a: str, b: str) -> Column:
    """Either normalised name begins with the other; those under three characters must be equal."""
    x, y = normalised(a), normalised(b)
    return F.when(F.least(F.length(x), F.length(y)) < 3, x == y).otherwise(x.startswith(y) | y.startswith(x))


def masked_unless(columns: list[str], status: str, value: str = "tested") -> list[Column]:
    """Columns that are null unless the status has the value."""
    return [F.when(F.col(status) == value, F.col(c)).alias(c) for c in columns]


def n_present(*columns: str) -> Column:
    """How many of the columns aren't null."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))


def path_key(path: str) -> Column:
    """A file's path as a key that doesn't depend on its spelling: outer blanks, repeated and trailing slashes, ``.`` and ``name/..`` go."""
    text = F.trim(path)
    rooted = F.startswith(text, F.lit("/"))
    parts = F.filter(F.split(text, "/"), lambda p: ~p.isin("", "."))
    # from left to right, a name goes with the .. after it; nothing is above the root
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when((p == "..") & (F.size(out) > 0) & ~F.coalesce(F.try_element_at(out, F.lit(-1)) == "..", F.lit(False)), F.slice(out, 1, F.greatest(F.lit(0), F.size(out) - 1))).when((p == "..") & rooted, out).otherwise(F.concat(out, F.array(p))),
    )
    joined = F.array_join(kept, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def ruler_step(span: Column, target: int = 8) -> Column:
    """The smallest of 1, 2, 5 times a power of ten that makes ``target`` intervals of a span at most."""
    raw = span / F.lit(float(target))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(raw <= power, power).when(raw <= 2 * power, 2 * power).when(raw <= 5 * power, 5 * power).otherwise(10 * power).cast("long")


def ruler_ticks(start: str, end: str, target: int = 8) -> Column:
    """The multiples of the span's ruler_step() from start to end, both included; for spans of at least ``target`` bases."""
    step = ruler_step(F.col(end) - F.col(start), target)
    first = (F.ceil(F.col(start) / step) * step).cast("long")
    return F.when(F.col(end) >= first, F.sequence(first, F.col(end), step)).otherwise(F.array().cast("array<bigint>"))
