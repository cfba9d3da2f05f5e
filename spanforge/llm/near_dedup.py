"""Near-duplicate documents by MinHash with odd sketches.

A document's set of word shingles (of 2 words for op7; link() takes other sizes) gives ``BANDS`` bands of ``ROWS`` MinHash samples, and an odd sketch: the samples are folded into a bitmap of parities, and
the population count of two bitmaps' exclusive or tells how many samples differ, precisely so where similarities are high. Documents that share a band are candidates. A second odd sketch folds the
whole set, so that with the sets' sizes it estimates the similarity without the samples' error. Candidates whose sketches allow a similarity of 0.8 (five standard deviations of either) are
confirmed on their full sets, shingle by shingle as text. At a similarity of 0.8 a pair shares no band with a probability of 3e-6.

Texts of equal words are one class, told by the SHA-256 of their words and aggregated before the shuffle. The classes of a band are not paired with each other: each meets the band's centre, the
class that shares most bands with others; confirmed links join classes into components; then only classes that share a band but are still in different components meet. In bands of up to ``FEW`` such
classes all of them do. The classes of larger bands meet by prefixes instead, in which no link can be lost: shingles are ordered by rarity among these classes, and of two sets of a similarity of 0.8 one
of the rarest fifth (and one more) of each is the same. How far from the start it may stand depends on both sizes (a ninth for sets of one size), so shingles are met by size too. So what a third of all
rows have in common, however many bands it fills, brings nobody together.

Words: A-Z lower-cased, runs without ASCII white space. With fewer words than a shingle has, the set holds them all as one; without words or text the set is empty, and the document is linked
with nothing. A repeated doc_id is one document for each distinct set. A null doc_id takes part, but names a component only as null; it is kept only where no id is in the component. Very long texts are
worked on alone. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanforge.llm.common import cut, flat, slices, small_batches, table, turn
from spanforge.llm.components import components
from spanforge.llm.kernels import BASE, SPACE, U, gram_hash, lower_ascii, mix, span_hash, word_spans

BANDS, ROWS, BITS, SLACK, WHOLE_BITS = 32, 5, 512, 0.16, 2048
#: Classes whose ids, keys and digests may be broadcast (24 bytes each).
SMALL = 50_000
#: Classes of one band, still in different components, that are paired with each other.
FEW = 16
#: The ratio of the sizes in a bucket of sizes.
NARROW = 1.04
SAMPLES = BANDS * ROWS
_KEYS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=U) * U(0xA24BAED4963EE407))
_XOR, _MUL = (_KEYS[:SAMPLES] >> U(32)).astype(np.uint32), (_KEYS[SAMPLES:] >> U(32)).astype(np.uint32) | np.uint32(1)
SIGNATURE = "doc_id {id}, text_key bigint, n_shingles bigint, words binary, bands array<bigint>, sketch array<bigint>, whole array<bigint>"


def shingle_sets(text: pa.Array, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row's shingles of ``size`` words, sorted, and each row's offsets (n + 1) in them."""
    data, offsets = flat(text)
    data = lower_ascii(data)
    starts, ends, counts = word_spans(data, offsets, SPACE)
    words = span_hash(data, starts, ends)
    grams = gram_hash(words, size)
    first = np.concatenate([[0], np.cumsum(counts)])
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            found = np.sort(grams[a : b - size + 1]) if b - a >= size else mix(gram_hash(words[a:b], b - a) + U(b - a))
            keep = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found[keep])
            sizes[i] = len(out[-1])
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def samples(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash samples (rows x SAMPLES, uint32) of rows that are not empty."""
    short = (shingles >> U(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, SAMPLES), np.uint32)
    a = 0
    while a < len(offsets) - 1:  # so many rows at a time that the values stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + 40_000, side="right")) - 1)
        part, at = short[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
        for i in range(SAMPLES):
            x = (part ^ _XOR[i]) * _MUL[i]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[a:b, i] = np.minimum.reduceat(x, at)
        a = b
    return out


def odd_sketches(found: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows x BITS / 64, int64) of MinHash samples."""
    n = len(found)
    spot = mix((found.astype(U) << U(9)) + np.arange(SAMPLES, dtype=U)) % U(BITS)
    flips = np.bincount((np.arange(n)[:, None] * BITS + spot.astype(np.int64)).ravel(), minlength=n * BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, BITS), axis=1).view(np.int64)


def whole_sketches(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows x WHOLE_BITS / 64, int64) of whole sets."""
    n = len(offsets) - 1
    spot = np.repeat(np.arange(n) * WHOLE_BITS, np.diff(offsets)) + (mix(shingles + U(BASE)) % U(WHOLE_BITS)).astype(np.int64)
    flips = np.bincount(spot, minlength=n * WHOLE_BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, WHOLE_BITS), axis=1).view(np.int64)


def signatures(docs: DataFrame, size: int = 2) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn()
        for batch in batches:
            for part in (p for a in range(0, len(batch), 256) for p in slices(batch.slice(a, 256), "text", 1 << 20)):  # few rows at a time: a row's bitmaps are spread out to 16 kB
                shingles, offsets = shingle_sets(part.column("text"), size)
                sizes = np.diff(offsets)
                some = np.flatnonzero(sizes)
                bands, sketch, whole = ([[]] * len(sizes) for _ in range(3))
                digest = [hashlib.sha256(b" ".join((t.as_py() or b"").lower().split())).digest() for t in part.column("text").cast(pa.large_binary())]
                if len(some):
                    tight = np.concatenate([offsets[some], offsets[-1:]])
                    found = samples(shingles, tight)
                    keys = np.zeros((len(some), BANDS), U)
                    for j in range(ROWS):
                        keys = mix(keys * U(BASE) + found[:, j::ROWS].astype(U) + np.arange(1, BANDS + 1, dtype=U))
                    odd = odd_sketches(found)
                    for i, k, o, w in zip(some.tolist(), keys.view(np.int64), odd, whole_sketches(shingles, tight), strict=True):
                        bands[i], sketch[i], whole[i] = k, o, w
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(sizes), pa.array(digest, pa.binary()), pa.array(bands, longs), pa.array(sketch, longs), pa.array(whole, longs)], names=["doc_id", "text_key", "n_shingles", "words", "bands", "sketch", "whole"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, SIGNATURE.format(id=kind))


def full_sets(docs: DataFrame, size: int = 2) -> DataFrame:
    """(class, shingles) of each row of (class, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn()
        for batch in batches:
            for part in slices(batch, "text"):
                shingles, offsets = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([part.column("class"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(shingles.view(np.int64)))], names=["class", "shingles"])

    return docs.select("class", "text").mapInArrow(run, "class bigint, shingles array<bigint>")


def _differ(a: str, b: str, bits: int):
    """Bits in which two odd sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x) if bits > 1024 else sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, bits // 64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _possible(percent: int):
    """Whether the sizes and both sketches of x and y allow the similarity.

    Two bitmaps of whole sets never differ in more bits than there are shingles in one set only, so that bound loses no pair; for large sets, whose flips
    cancel, five standard deviations above the mean bind first.
    """
    m = float(WHOLE_BITS)
    apart = (F.col("x_n") + F.col("y_n")) * F.lit((100 - percent) / (100 + percent))  # the most shingles that are in one set only
    two, four = F.pow(F.lit(1 - 2 / m), apart), F.pow(F.lit(1 - 4 / m), apart)
    mean = (1 - two) * (m / 2)
    spread = F.sqrt(F.greatest((1 - two * two) * (m / 4) + (four - two * two) * (m * (m - 1) / 4), F.lit(1.0)))
    sizes = F.expr(f"100 * x_n >= {percent} * y_n AND 100 * y_n >= {percent} * x_n")
    return sizes & (_differ("x_sketch", "y_sketch", BITS) <= _limit(percent)) & (_differ("x_whole", "y_whole", WHOLE_BITS) <= F.least(apart + 1e-6, mean + 5 * spread + 2))


def _limit(percent: int) -> int:
    """The most bits in which the sketches of sets of that similarity may differ."""
    apart = 2 * SAMPLES * (1 - percent / 100 + SLACK)
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** apart)
    return int(mean + 3 * (BITS / 4) ** 0.5)


def link(docs: DataFrame, percent: int = 80, size: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key for each row of ``docs``; linked with 100 * intersection >= percent * union of their sets of shingles of ``size`` words."""
    small_batches(docs.sparkSession)
    signed = cut(signatures(docs, size), "signatures")
    reps = cut(
        signed.where("n_shingles > 0")
        .groupBy("words")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("whole").alias("whole"))
        .select(F.monotonically_increasing_id().alias("class"), "words", "rep.doc_id", "rep.text_key", "n", "bands", "sketch", "whole"),
        "classes",
    )
    sketches = reps.select("class", "n", "sketch", "whole")
    banded = reps.select(F.posexplode("bands").alias("i", "band"), "class")
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(banded.join(sizes, "band"), "bands")  # the rows of bands that hold several classes
    degree = shared.groupBy("class").agg(F.sum("size").alias("degree"))
    centres = shared.join(degree, "class").groupBy("band").agg(F.max_by("class", F.struct("degree", "class")).alias("centre"))
    star = shared.join(centres, "band").select(F.least("centre", "class").alias("a"), F.greatest("centre", "class").alias("b")).where("a < b").distinct()
    near = _near(star, sketches, percent)
    near = cut(near, "near")
    edges = cut(_confirmed(near, docs, reps, percent, size), "links")
    labels = components(edges)
    # classes that share a band and are in different components by now: their pairs, but for those met already
    here = cut(shared.select("i", "band", "class").join(labels.withColumnRenamed("node", "class"), "class", "left").select("i", "band", "class", F.coalesce("label", "class").alias("label")), "labelled")
    open_ = cut(here.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi"), "open-bands")
    left = cut(here.join(open_.where(F.col("size") <= FEW), "band", "left_semi").join(reps.select("class", "n", "sketch", "whole", "bands"), "class"), "open")
    x, y = (left.select("band", *(F.col(c).alias(f"{side}_{c}") for c in ("i", "class", "label", "n", "sketch", "whole", "bands"))) for side in ("x", "y"))
    # a pair meets in the first band that it shares
    first = ~F.arrays_overlap(F.slice("x_bands", F.lit(1), F.col("x_i")), F.slice("y_bands", F.lit(1), F.col("x_i")))
    rest = x.join(y, "band").where((F.col("x_label") < F.col("y_label")) & _possible(percent) & first).select(F.least("x_class", "y_class").alias("a"), F.greatest("x_class", "y_class").alias("b"))
    hot = cut(here.join(open_.where(F.col("size") > FEW), "band", "left_semi").select("class", "label").distinct(), "hot")
    if not hot.isEmpty():
        rest = rest.unionByName(_near(_by_prefix(docs, reps, hot, percent, size), sketches, percent)).distinct()
    rest = rest.join(near, ["a", "b"], "left_anti")
    edges, labels = _join_on(cut(rest, "rest"), edges, labels, docs, reps, percent, size)
    named = reps.select("class", "doc_id").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = named.select("class", "label").join(smallest, "label").select("class", "component_id")
    found = reps.select("class", "words").join(found, "class").select("words", "component_id")
    out = signed.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("words")).alias("words")).join(found, "words", "left")
    component = F.when(F.col("words").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key")


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    x, y = sketches.toDF("a", "x_n", "x_sketch", "x_whole"), sketches.toDF("b", "y_n", "y_sketch", "y_whole")
    return pairs.join(y, "b").join(x, "a").where(_possible(percent)).select("a", "b")


def _texts(docs: DataFrame, reps: DataFrame, need: DataFrame) -> DataFrame:
    """(class, text) of the classes of ``need``."""
    wanted = cut(reps.select("class", "doc_id", "text_key").join(need, "class", "left_semi"), "wanted")
    wanted = (F.broadcast(wanted) if wanted.count() <= SMALL else wanted).alias("w")
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).alias("d").join(wanted, F.expr("d.doc_id <=> w.doc_id AND d.text_key = w.text_key"))
    return cut(found.select("class", "text").dropDuplicates(["class"]), "texts")


def shingles(text: bytes, size: int) -> set:
    """The set of a text's shingles, as words."""
    words = text.lower().split()
    return set(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else {tuple(words)} if words else set()


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked by their full sets of shingles."""
    pairs = cut(pairs.select("a", "b"), "pairs")
    texts = _texts(docs, reps, pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn()
        last: tuple[int, set] | None = None  # of a class that meets several others in a row
        for batch in batches:
            for part in slices(batch, "x"):
                a, keep = part.column("a").to_pylist(), []
                for i, (x, y) in enumerate(zip(part.column("x").cast(pa.large_binary()), part.column("y").cast(pa.large_binary()), strict=True)):
                    if last is None or last[0] != a[i]:
                        last = a[i], shingles(x.as_py(), size)
                    mine = shingles(y.as_py(), size)
                    common = len(last[1] & mine)
                    keep.append(100 * common >= percent * (len(last[1]) + len(mine) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint")


def _by_prefix(docs: DataFrame, reps: DataFrame, hot: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) of the classes of ``hot`` (class, label) with different labels that share one of their rarest shingles: all those of the similarity are among them.

    Labels of a shingle are paired first, their classes then: classes of one component are not paired with each other, however many share a shingle. Two sets that share a shingle so late in their
    orders that too few are left for the similarity are no pair, and don't meet where that follows from the buckets of their sizes.
    """
    sets = cut(full_sets(_texts(docs, reps, hot.select("class")), size), "sets")
    held = sets.select("class", F.explode("shingles").alias("token"))
    # a shingle of one class only brings nobody together, but takes its place in the prefix, among the rarest
    common = held.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    known = held.join(common, "token").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))  # as many as the set has
    m = F.size("shingles")
    least = m - F.ceil(m * (percent / 100) - 1e-9) + 1  # as many of its rarest shingles as hold a common one with any set of the similarity
    prefix = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.size("tokens") - m + least).cast("int"))
    rare = sets.join(known, "class").select("class", m.alias("m"), F.size("tokens").alias("shared"), F.posexplode(prefix).alias("i", "t")).join(hot, "class")
    rare = rare.select("class", "label", "m", (F.col("m") - F.col("shared") + F.col("i")).alias("at"), F.col("t.token").alias("token"))
    rare = cut(_by_sizes(rare, percent), "rare")
    key = ["token", "lo", "hi", "side"]
    groups = cut(rare.groupBy(*key, "label").agg(F.count("*").alias("n")), "groups")
    # the smaller group of two is spelled out first, so only the last join makes pairs; the larger one goes by the side of the smaller
    facing = F.when(F.col("lo") == F.col("hi"), F.col("side")).otherwise(1 - F.col("side")).alias("side")
    few, many = groups.toDF(*key, "few", "n"), groups.select("token", "lo", "hi", facing, F.col("label").alias("many"), F.col("n").alias("k"))
    met = few.join(many, key).where("few <> many AND struct(n, few) < struct(k, many)").select(*key, "few", "many")
    x, y = (rare.select("token", "lo", "hi", side, F.col("label").alias(group), F.col("class").alias(c), F.col("m").alias(f"{c}m"), F.col("at").alias(f"{c}at")) for c, group, side in (("a", "few", F.col("side")), ("b", "many", facing)))
    # from their places on, both have as many shingles left as a pair of the similarity shares: so it is at the first that they share
    left = f"least(am - aat, bm - bat) >= ceil({percent} * (am + bm) / {100 + percent}.0 - 1e-9)"
    pairs = met.join(x, [*key, "few"]).join(y, [*key, "many"]).where(f"100 * am >= {percent} * bm AND 100 * bm >= {percent} * am AND {left}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_sizes(rare: DataFrame, percent: int) -> DataFrame:
    """The rows of ``rare`` (with m, the set's size, and at, the shingle's place), once for each bucket of sizes of which a set of the similarity may be that has this shingle as the first in common.

    ``lo`` and ``hi`` are the two sets' buckets; ``side`` is 1 where the row's own set is the one of hi, and 0 where it is that of lo or both are the same.
    """

    def bucket(size):
        return F.floor(F.log(size) / math.log(NARROW)).cast("int")

    m, other = F.col("m"), F.col("other")
    least = F.ceil(m * percent / 100 - 1e-9)  # the sizes that go with this one
    rare = rare.withColumn("own", bucket(m)).withColumn("other", F.explode(F.sequence(bucket(least), bucket(F.floor(m * 100 / percent + 1e-9)))))
    smallest = F.greatest(least, F.ceil(F.pow(F.lit(NARROW), other) * (1 - 1e-9)))  # of the other set
    fits = m - F.col("at") >= F.ceil((m + smallest) * percent / (100 + percent) - 1e-9)
    return rare.where(fits).select("class", "label", "m", "at", "token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > other).cast("int").alias("side"))


def _join_on(pairs: DataFrame, edges: DataFrame, labels: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """More links, from those of ``pairs`` whose classes are in different components; and the components then."""
    a, b = labels.toDF("a", "_a"), labels.toDF("b", "_b")
    apart = pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    apart = cut(apart, "apart")
    if apart.isEmpty():
        return edges, labels
    more = cut(_confirmed(apart, docs, reps, percent, size), "links")
    if more.isEmpty():
        return edges, labels
    edges = edges.unionByName(more)
    return edges, components(edges)


QUERIES = {"op7_odd_sketch_dedup": lambda spark, sf_dir: link(table(spark, sf_dir, "documents")).drop("text_key")}

ORACLE = {
    "op7_odd_sketch_dedup": r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (g) JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id AND 100 * nx.n >= 80 * ny.n AND 100 * ny.n >= 80 * nx.n GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
}
