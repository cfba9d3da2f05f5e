"""Phrase collocation mining by direct-address tiling.

Words that occur ``LEAST`` times and more (no other can be in a candidate) are numbered by falling frequency, for each language. A pair of neighbours is a cell (i, j) of a matrix, cut into
tiles: the first row and column of tiles are ``TILE`` numbers wide, each further one as wide as all before it, so that the number of tiles grows with the logarithm of the vocabulary and the frequent
words' tile is dense. A task counts the pairs of its texts tile by tile, dense ones by NumPy's bincount over all cells, sparse ones as sorted coordinates with counts, and only these sums are
shuffled, by tile. There they are added as they stream past, again dense or as coordinates, however many tasks send to a tile. Sparse tiles of a corpus of more than ``SPLIT`` words are split by a hash of
the cell into so many parts that each fits a task. Frequent pairs are then numbered by frequency themselves, and (pair, next word) is counted in the same way: phrases of three words, or by
further rounds of more.

The words' and pairs' numbers are broadcast where a count shows that there are at most ``WORDS`` and ``PAIRS`` of them (and ``BYTES`` of words). Beyond that, words are numbered by a join of each document's words, and
longer phrases by joins of the texts' sums with the frequent pairs on either side.

Texts: A-Z lower-cased, cut at ``.,;:!?`` and line ends into pieces, these at blanks and tabs into words. Phrases lie within pieces. A null text is empty, a null lang ``und``. Every row counts, also repeated ones and those with a
null id. Very long texts are split into words by pieces. Other columns are ignored. Scores are exact (decimals of 38 digits).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanforge.llm.common import cut, table

LEAST, TOP, WORDS, BYTES, PAIRS = 10, 2000, 1_500_000, 40_000_000, 6_000_000
BITS = 10  # of a tile's side
TILE, CELLS, HELD, PIECE, SPLIT = 1 << BITS, 1 << 2 * BITS, 3_000_000, 4 << 20, 1 << 27
_TO = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The text's words and, between them, line ends where a piece ends; empty strings between blanks. In parts that end between two words."""
    text, a = text.translate(_TO).replace(b"\n", b" \n "), 0
    while a < len(text):
        b = len(text) if len(text) - a <= PIECE else text.find(b" ", a + PIECE)
        b = len(text) if b < 0 else b
        yield text[a:b].split(b" ")
        a = b


def language(lang: str = "lang") -> Column:
    return F.coalesce(F.col(lang), F.lit("und"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, counted within a task's texts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, count in found.items():
                count.pop(b"", None)
                count.pop(b"\n", None)
                words, n = list(count), np.fromiter(count.values(), np.int64, len(count))
                for a in range(0, len(words), 50_000):
                    part = words[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array(n[a : a + 50_000])], names=["lang", "word", "n"])
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                count = found.setdefault(lang, Counter())
                for part in pieces(text.as_py() or b""):
                    count.update(part)
            if sum(map(len, found.values())) > 500_000:
                yield from emit()
        yield from emit()

    rows = docs.select(language().alias("lang"), "text").mapInArrow(run, "lang string, word binary, n bigint")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    """``counts`` with ``name``: the rank of each row by falling n within its lang, from 0. Ranked by ranges of (lang, n), not by a window over a language."""
    order = [F.asc("lang"), F.desc("n"), *(F.asc(c) for c in by)]
    ranged = cut(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), f"{name}-ranges")
    inner = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(F.desc("n"), *by)))
    sizes = ranged.groupBy("lang", "_part").agg(F.count("*").alias("_n"))  # a row for each range and language in it
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inner.join(sizes.select("lang", "_part", before.alias("_before")), ["lang", "_part"]).withColumn(name, (F.col("_before") + F.col("_at") - 1).cast("int")).drop("_part", "_at", "_before")


def encoded(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, ids): each text's words as numbers; -1 for a word that is too rare, and for a piece's end."""
    n, size = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if n > WORDS or size > BYTES:
        return _joined(docs, vocabulary)
    known: dict[str, dict[bytes, int]] = {}
    for r in vocabulary.select("lang", "word", "id").toLocalIterator():  # WORDS rows at most
        known.setdefault(r["lang"], {b"": -2})[bytes(r["word"])] = r["id"]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                out: list[np.ndarray] = []
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.large_binary()), strict=True):
                    get = shared.value.get(lang, {b"": -2}).get
                    got = [np.fromiter((get(w, -1) for w in words), np.int32, len(words)) for words in pieces(text.as_py() or b"")]
                    ids = np.concatenate(got) if got else np.zeros(0, np.int32)
                    out.append(ids[ids != -2])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))], names=["lang", "ids"])

    return docs.select(language().alias("lang"), "text").mapInArrow(run, "lang string, ids array<int>")


def _joined(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """encoded() where the vocabulary is too large for a broadcast: one row for each word, joined, and each row's words gathered again."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", "abcdefghijklmnopqrstuvwxyz ")
    marked = F.regexp_replace(lower, "[.,;:!?\n\u000b\u000c\r]", " \n ")
    rows = cut(docs.select(language().alias("lang"), F.filter(F.split(marked, " "), lambda w: w != "").alias("words")).withColumn("row", F.monotonically_increasing_id()), "words")
    each = rows.select("row", "lang", F.posexplode("words").alias("at", "word")).withColumn("word", F.col("word").cast("binary"))
    ids = each.join(vocabulary.select("lang", "word", "id"), ["lang", "word"], "left").select("row", "lang", "at", F.coalesce("id", F.lit(-1)).alias("id"))
    held = ids.groupBy("row", "lang").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("found"))  # as many as the text has words
    return held.select("lang", F.transform("found", lambda x: x["id"]).alias("ids"))


def bands(i: np.ndarray) -> np.ndarray:
    """The row (or column) of tiles of each number: 0 below TILE, then one more each time the number doubles."""
    return np.frexp((i >> BITS).astype(np.float64))[1].astype(np.int64)


def counted(i: np.ndarray, j: np.ndarray, parts: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(tile, part of it, rows, columns, counts) of the pairs: a dense tile by bincount, the others as sorted coordinates."""
    if not len(i):
        return
    tile = bands(i) << 6 | bands(j)
    part = ((i * 0x9E3779B1 ^ j * 0x85EBCA6B) >> 7) % parts * (tile > 0)
    key = tile * parts + part
    by = np.argsort(key, kind="stable")
    key, cell = key[by], (i << 32 | j)[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    for a, b in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
        if key[a] < parts and b - a > CELLS // 16:
            n = np.bincount(cell[a:b] >> (32 - BITS) | cell[a:b] & (TILE - 1), minlength=CELLS)
            at = np.flatnonzero(n)
            yield 0, 0, at >> BITS, at & (TILE - 1), n[at]
        else:
            cells, n = np.unique(cell[a:b], return_counts=True)
            yield int(key[a]) // parts, int(key[a]) % parts, cells >> 32, cells & 0xFFFFFFFF, n


TILES = "lang string, tile int, part int, i array<int>, j array<int>, counts array<int>"
#: The cells (i, j) of one language's numbers, as they stand in texts parted by -1.
Cells = Callable[[str, np.ndarray], tuple[np.ndarray, np.ndarray]]


def neighbours(lang: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
    return ids[:-1][ok], ids[1:][ok]


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, numbers of several texts, parted by -1), of about HELD numbers."""
    held: dict[str, list[np.ndarray]] = {}
    size: Counter = Counter()
    for batch in batches:
        ids, langs = batch.column("ids"), batch.column("lang").to_pylist()
        flat, ends = ids.flatten().to_numpy().astype(np.int64), np.asarray(ids.offsets)
        ends = ends - ends[0]
        for k, lang in enumerate(langs):
            held.setdefault(lang, []).extend((flat[ends[k] : ends[k + 1]], np.array([-1])))
            size[lang] += int(ends[k + 1] - ends[k]) + 1
        for lang in [x for x, n in size.items() if n > HELD] or ([max(size, key=size.get)] if size.total() > 2 * HELD else []):
            yield lang, np.concatenate(held.pop(lang))
            del size[lang]
    for lang, parts in held.items():
        yield lang, np.concatenate(parts)


def tile_counts(texts: DataFrame, cells: Cells, least: int, words: int = 0) -> DataFrame:
    """(lang, i, j, n) of all cells that occur ``least`` times and more; words: about how many words the texts have."""
    parts = max(1, -(-words // SPLIT))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids in texts_of(batches):
            rows: list[tuple] = []
            size = 0
            for found in counted(*cells(lang, ids), parts):
                rows.append(found)
                size += len(found[4])
                if size > 200_000:
                    yield _rows(lang, rows)
                    rows, size = [], 0
            if rows:
                yield _rows(lang, rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        dense: np.ndarray | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, limit = 0, CELLS // 8

        def finished() -> Iterator[pa.RecordBatch]:
            if dense is not None:
                at = np.flatnonzero(dense >= least)
                at, n = at >> BITS << 32 | at & (TILE - 1), dense[at]
            else:
                at, n = _summed(held)
                at, n = at[n >= least], n[n >= least]
            for a in range(0, len(at), 100_000):
                some = at[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(some), pa.string()), pa.array(some >> 32, pa.int32()), pa.array(some & 0xFFFFFFFF, pa.int32()), pa.array(n[a : a + 100_000], pa.int64())], names=["lang", "i", "j", "n"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("lang", "tile", "part")), strict=True)
            ends = np.asarray(batch.column("i").offsets) - batch.column("i").offsets[0].as_py()
            flat = batch.column("i").flatten().to_numpy().astype(np.int64) << 32 | batch.column("j").flatten().to_numpy()
            n = batch.column("counts").flatten().to_numpy().astype(np.int64)
            for k, key in enumerate(keys):
                if key != now:
                    if now is not None:
                        yield from finished()
                    now, dense, held, size, limit = key, None, [], 0, CELLS // 8
                a, b = ends[k], ends[k + 1]
                if dense is not None:
                    dense[flat[a:b] >> (32 - BITS) | flat[a:b] & (TILE - 1)] += n[a:b]  # a row's cells are distinct
                    continue
                held.append((flat[a:b], n[a:b]))
                size += int(b - a)
                if size > limit:
                    at, sums = _summed(held)
                    held, size = [(at, sums)], len(at)
                    limit = max(CELLS // 8, 2 * size)
                    if key[1] == 0 and size > CELLS // 16:
                        dense = np.zeros(CELLS, np.int64)
                        dense[at >> (32 - BITS) | at & (TILE - 1)] = sums
        if now is not None:
            yield from finished()

    rows = texts.mapInArrow(count, TILES)
    return rows.repartition("lang", "tile", "part").sortWithinPartitions("lang", "tile", "part").mapInArrow(add, "lang string, i int, j int, n bigint")


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return at, np.bincount(back, weights=np.concatenate([n for _, n in held])).astype(np.int64)


def _rows(lang: str, rows: list[tuple]) -> pa.RecordBatch:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])]).astype(np.int32))
    lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in rows]).astype(np.int32))) for k in (2, 3, 4))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), *(pa.array([r[k] for r in rows], pa.int32()) for k in (0, 1)), *lists], names=["lang", "tile", "part", "i", "j", "counts"])


def triples(texts: DataFrame, pairs: DataFrame, least: int, words: int = 0) -> DataFrame:
    """(lang, i, j, k, n) of three words in a row; pairs: (lang, i, j, n, pid), the frequent ones by rank."""
    if pairs.count() > PAIRS:
        return _joined_triples(texts, pairs, least)
    found: dict[str, list[np.ndarray]] = {}
    for r in pairs.groupBy("lang").agg(F.count("*").alias("n")).collect():
        found[r["lang"]] = [np.zeros(r["n"], np.int64)]
    for batch in pairs.select("lang", "pid", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("j")).alias("key")).toLocalIterator():
        found[batch["lang"]][0][batch["pid"]] = batch["key"]
    known = {lang: (np.sort(keys), np.argsort(keys).astype(np.int32)) for lang, (keys,) in found.items()}
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def cells(lang: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, pid = shared.value.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int32)))
        if len(ids) < 3 or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
        pair = np.where(ok, ids[:-1] << 32 | ids[1:], -1)
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        of = np.where(keys[at] == pair, pid[at], -1).astype(np.int64)
        both = (of[:-1] >= 0) & (of[1:] >= 0)
        return of[:-1][both], ids[2:][both]

    again = tile_counts(texts, cells, least, words).select("lang", F.col("i").alias("pid"), F.col("j").alias("k"), F.col("n").alias("a"))
    return again.join(pairs.select("lang", "pid", "i", "j"), ["lang", "pid"]).select("lang", "i", "j", "k", F.col("a").alias("n"))


def _joined_triples(texts: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """triples() where the pairs are too many for a broadcast: sums of each task's triples, kept where both pairs are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids in texts_of(batches):
            if len(ids) < 3:
                continue
            ok = (ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0)
            rows = np.stack([ids[:-2][ok], ids[1:-1][ok], ids[2:][ok]], 1)
            rows = rows[np.lexsort(rows.T[::-1])]
            first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])) if len(rows) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(rows)))
            for a in range(0, len(first), 50_000):
                part = rows[first[a : a + 50_000]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), *(pa.array(part[:, c], pa.int32()) for c in range(3)), pa.array(n[a : a + 50_000])], names=["lang", "i", "j", "k", "n"])

    held = pairs.select("lang", "i", "j")
    rows = texts.mapInArrow(run, "lang string, i int, j int, k int, n bigint")
    rows = rows.join(held, ["lang", "i", "j"], "left_semi").join(held.toDF("lang", "j", "k"), ["lang", "j", "k"], "left_semi")
    return rows.groupBy("lang", "i", "j", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _score(a: str, left: str, right: str) -> Column:
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"CAST(1000000 AS DECIMAL(38, 0)) * {whole(a)} * {whole(a)} DIV ({whole(left)} * {whole(right)})")


def phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All candidates that no longer candidate holds at least half as often: lang, phrase, a, l, r, n, score."""
    counts = cut(word_counts(docs), "word-counts")
    totals = cut(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    vocabulary = cut(numbered(counts.where(F.col("n") >= least), ["word"], "id"), "vocabulary")
    texts = cut(encoded(docs, vocabulary), "numbers")
    pairs = cut(numbered(cut(tile_counts(texts, neighbours, least, words), "pairs"), ["i", "j"], "pid"), "ranked-pairs")
    threes = cut(triples(texts, pairs, least, words), "triples")
    word = lambda c, n=None: vocabulary.select("lang", F.col("id").alias(c), F.col("word").cast("string").alias(f"w{c}"), F.col("n").alias(n or f"n{c}"))
    two = pairs.select("lang", "i", "j", F.col("n").alias("a")).join(word("i"), ["lang", "i"]).join(word("j"), ["lang", "j"])
    longest = threes.select("lang", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("k").alias("j")))).alias("p"), "n").groupBy("lang", "p.i", "p.j").agg(F.max("n").alias("longer"))
    two = two.join(longest, ["lang", "i", "j"], "left").where("longer IS NULL OR 100 * longer < 50 * a")
    two = two.select("lang", F.concat_ws(" ", "wi", "wj").alias("phrase"), "a", F.col("ni").alias("l"), F.col("nj").alias("r"), _score("a", "ni", "nj").alias("score"))
    left, right = pairs.select("lang", "i", "j", F.col("n").alias("nij")), pairs.select("lang", F.col("i").alias("j"), F.col("j").alias("k"), F.col("n").alias("njk"))
    three = threes.withColumnRenamed("n", "a").join(left, ["lang", "i", "j"]).join(right, ["lang", "j", "k"])
    three = three.join(word("i"), ["lang", "i"]).join(word("j"), ["lang", "j"]).join(word("k"), ["lang", "k"])
    cuts = F.least(F.struct(_score("a", "ni", "njk").alias("score"), F.lit(1).alias("k"), F.col("ni").alias("l"), F.col("njk").alias("r")), F.struct(_score("a", "nij", "nk").alias("score"), F.lit(2).alias("k"), F.col("nij").alias("l"), F.col("nk").alias("r")))
    three = three.withColumn("cut", cuts).select("lang", F.concat_ws(" ", "wi", "wj", "wk").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    return two.unionByName(three).join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select("lang", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def top(found: DataFrame, k: int = TOP) -> DataFrame:
    """Each lang's k best: first of each of some parts of a language, then of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "_salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(phrases(table(spark, sf_dir, "documents")))


QUERIES = {"op11_tiled_collocations": query}
ORACLE = {
    "op11_tiled_collocations": r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT id, lang, i, list_filter(string_split_regex(p[i], '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT id, lang, p, unnest(range(1, len(p) + 1)) AS i FROM d)),
o AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, len(w) - i + 1 AS left_ FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p)),
f1 AS (SELECT lang, x, count(*) AS c FROM o GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS c FROM o WHERE left_ >= 2 GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*) AS c FROM o WHERE left_ >= 3 GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f1 GROUP BY lang),
longer AS (SELECT lang, x, y, max(c) AS c FROM (SELECT lang, x, y, c FROM f3 UNION ALL SELECT lang, y, z, c FROM f3) GROUP BY ALL),
c2 AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.c AS a, l.c AS l, r.c AS r FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y
  LEFT JOIN longer g ON g.lang = f2.lang AND g.x = f2.x AND g.y = f2.y WHERE f2.c >= 10 AND (g.c IS NULL OR 100 * g.c < 50 * f2.c)),
c3 AS (SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.c AS a, l1.c AS l1, r1.c AS r1, l2.c AS l2, r2.c AS r2 FROM f3 JOIN f1 l1 ON l1.lang = f3.lang AND l1.x = f3.x
  JOIN f2 r1 ON r1.lang = f3.lang AND r1.x = f3.y AND r1.y = f3.z JOIN f2 l2 ON l2.lang = f3.lang AND l2.x = f3.x AND l2.y = f3.y JOIN f1 r2 ON r2.lang = f3.lang AND r2.x = f3.z),
s3 AS (SELECT *, 1000000::HUGEINT * a * a // (l1::HUGEINT * r1) AS s1, 1000000::HUGEINT * a * a // (l2::HUGEINT * r2) AS s2 FROM c3),
s AS (SELECT lang, phrase, a, l, r, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM c2
  UNION ALL SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, CAST(least(s1, s2) AS BIGINT) FROM s3)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM (SELECT s.*, n.n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s JOIN n USING (lang)) WHERE rank <= 2000"""
}
