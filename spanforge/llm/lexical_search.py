"""Ranked lexical search: the best ``k`` documents of all for each item, by the Best Position Algorithm.

Documents are tokenised once, and of each only its length and its counts of the items' terms go on. They form blocks; a block holds, for each term, an impact list: its documents by
descending impact (weight times saturated frequency), with direct access to a document's impact. For an item the lists of its terms are read in step. A document that is seen anywhere is scored whole
by direct accesses, which also mark its position in each of the other lists. A list's best position is the last one up to which all positions are seen; the
impacts there, summed over the lists, bound the score of every document not seen. Reading stops once that threshold is strictly below the k-th best score, so ties are never lost. The
k-th score is carried from block to block of a task; the tasks' best are then ranked in two steps.

Nothing is approximate: weights use all documents' counts. The items' terms are broadcast in batches of items of at most ``TERMS`` terms (each batch reads the
written counts again, and tokenises only if the terms don't fit one batch), so neither their number nor the documents' is bounded. A block is at most ``BLOCK`` counts.

Terms: A-Z lower-cased, runs of ASCII letters, digits and bytes beyond ASCII. Null or empty texts have none and count as no document. Every row counts as a document of its own, also repeated ones and
those of null ids (which come last among equal scores). Equal (item_id, text) rows are one item, items without terms have no results, a null item_id is an item. Very long texts are split into words by
pieces. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanforge.llm.common import cut, table

TOP, TERMS, BLOCK, PIECE = 20, 500_000, 2_000_000, 4 << 20
_TO = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[bytes]:
    """The text with blanks between terms, in pieces that end between two terms."""
    text, a = text.translate(_TO), 0
    while a < len(text):
        b = len(text) if len(text) - a <= PIECE else text.find(b" ", a + PIECE)
        b = len(text) if b < 0 else b
        yield text[a:b]
        a = b


def terms(text: bytes) -> Counter:
    found: Counter = Counter()
    for piece in pieces(text):
        found.update(piece.split())
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """(qid, item_id, term, times) of each distinct item; qid tells items apart."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, w.decode(), n) for i, t in enumerate(batch.column("text").to_pylist()) for w, n in terms((t or "").encode()).items()]
            rows, words, times = zip(*out, strict=True) if out else ((), (), ())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("qid").take(at), batch.column("item_id").take(at), pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["qid", "item_id", "term", "times"])

    one = items.select("item_id", "text").distinct().withColumn("qid", F.sha2(F.concat_ws("\x01", F.coalesce(F.col("item_id").cast("string"), F.lit("\x02")), F.coalesce("text", F.lit(""))), 256))
    return one.select("qid", "item_id", "text").mapInArrow(run, f"qid string, item_id {kind}, term string, times bigint")


def counted(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tf): terms of each document that has any, and its counts of the terms of ``ids`` (broadcast)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                rows, sizes, held, tfs, ends = [], [], [], [], [0]
                for i, text in enumerate(part.column("text").cast(pa.large_binary())):
                    found = terms(text.as_py() or b"")
                    if found:
                        rows.append(i)
                        sizes.append(found.total())
                        mine = [(known[w], n) for w, n in found.items() if w in known]
                        held += [x for x, _ in mine]
                        tfs += [n for _, n in mine]
                        ends.append(len(held))
                lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((held, pa.int32()), (tfs, pa.int64())))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "ids", "tf"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, ids array<int>, tf array<bigint>")


def weights(df: np.ndarray, total: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Block:
    """Impact lists of some documents: by term, sorted by impact and by document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        by = np.lexsort((doc, -impact, term))
        self.docs, self.impacts = doc[by], impact[by]
        self.terms, self.first = np.unique(term[by], return_index=True)
        self.ends = np.append(self.first[1:], len(term))
        # direct access: within a list, documents in order and their positions in it
        again = np.lexsort((self.docs, term[by]))
        self.sorted, self.at = self.docs[again], again

    def of(self, term: int) -> int:
        i = int(np.searchsorted(self.terms, term))
        return i if i < len(self.terms) and self.terms[i] == term else -1

    def best(self, query: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores: all of the block's k best, ties included, whose score isn't below ``least``."""
        lists = [(int(self.first[i]), int(self.ends[i]), times) for t, times in query if (i := self.of(t)) >= 0]
        seen = [np.zeros(b - a, bool) for a, b, _ in lists]
        best = [0] * len(lists)  # how many positions are seen without a gap
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step, floor = 0, 4 * k, max(least, 1)
        while lists:
            fresh = np.unique(np.concatenate([self.docs[a + depth : min(b, a + depth + step)] for a, b, _ in lists]))
            fresh = np.setdiff1d(fresh, docs, assume_unique=True)  # sorted access; those met before are scored already
            depth += step
            total = np.zeros(len(fresh), np.int64)
            for j, (a, b, times) in enumerate(lists):  # direct access, in all lists at once for all fresh documents
                spot = np.minimum(np.searchsorted(self.sorted[a:b], fresh), b - a - 1)
                hit = self.sorted[a:b][spot] == fresh
                position = self.at[a:b][spot[hit]] - a
                total[hit] += times * self.impacts[a + position]
                seen[j][position] = True
                gap = np.flatnonzero(~seen[j][best[j] :])
                best[j] = best[j] + int(gap[0]) if len(gap) else b - a
            docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, total])
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            # a list that is seen whole holds nothing new; elsewhere no unseen document has more than the impact at the best position
            bound = sum(times * int(self.impacts[a + p - 1] if p else self.impacts[a]) for (a, b, times), p in zip(lists, best, strict=True) if p < b - a)
            if bound < floor or depth >= max(b - a for a, b, _ in lists):
                break
            step *= 2
        keep = scores >= floor
        return docs[keep], scores[keep]


def search_blocks(rows: DataFrame, queries: list[list[tuple[int, int]]], weight: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(q, doc_id, score): each task's k best documents of each query, ties in doc_id order."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, w = shared.value
        top: list[tuple[np.ndarray, list]] = [(np.zeros(0, np.int64), []) for _ in wanted]
        held: list[pa.RecordBatch] = []
        size = 0

        def work() -> None:
            rows = pa.Table.from_batches(held)
            n = rows.column("n").to_numpy()
            ids = rows.column("ids").combine_chunks()
            tf = rows.column("tf").combine_chunks().flatten().to_numpy()
            doc = np.repeat(np.arange(len(rows)), np.diff(np.asarray(ids.offsets)))
            term = ids.flatten().to_numpy().astype(np.int64)
            m = 75 + 25 * n * total // length
            block = Block(term, doc, w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc])))
            own = rows.column("doc_id")
            for q, query in enumerate(wanted):
                scores, names = top[q]
                found, s = block.best(query, k, int(scores[-1]) if len(scores) >= k else 0)
                if len(found):
                    merged = sorted([*zip((-scores).tolist(), [(x is None, x) for x in names], strict=True), *zip((-s).tolist(), [(x is None, x) for x in own.take(pa.array(found)).to_pylist()], strict=True)], key=lambda x: (x[0], x[1][0], x[1][1] or 0))[:k]
                    top[q] = np.array([-x for x, _ in merged], np.int64), [x for _, (_, x) in merged]

        for batch in batches:
            for a in range(0, len(batch), 2_000):
                part = batch.slice(a, 2_000)
                if len(part):
                    held.append(part)
                    size += len(part.column("ids").flatten()) + len(part)
                if size >= BLOCK:
                    work()
                    held.clear()
                    size = 0
        if held:
            work()
        for q, (scores, names) in enumerate(top):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q)), pa.array(names, rows_type), pa.array(scores)], names=["q", "doc_id", "score"])

    rows_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return rows.select("doc_id", "n", "ids", "tf").mapInArrow(run, f"q bigint, doc_id {kind}, score bigint")


def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, most: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    wanted = cut(item_terms(items), "items")
    n = wanted.select("term").distinct().count()
    parts = max(1, -(-2 * n // most)) if n > most else 1  # batches of items, each of about ``most`` terms at most
    out: DataFrame | None = None
    for part in range(parts):
        mine = wanted.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part) if parts > 1 else wanted
        rows = mine.orderBy("qid", "term").collect()
        if not rows:
            continue
        words = sorted({r["term"] for r in rows})
        ids = {w.encode(): i for i, w in enumerate(words)}
        counts = cut(counted(docs, ids), "counts")
        total, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            continue
        df = np.zeros(len(words), np.int64)
        for r in counts.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect():
            df[r["id"]] = r["df"]
        queries: dict[str, list[tuple[int, int]]] = {}
        names = {}
        for r in rows:
            queries.setdefault(r["qid"], []).append((ids[r["term"].encode()], r["times"]))
            names[r["qid"]] = r["item_id"]
        found = search_blocks(counts, list(queries.values()), weights(df, total), total, length, k)
        kind = items.schema["item_id"].dataType.simpleString()
        named = spark.createDataFrame([(i, names[q], q) for i, q in enumerate(queries)], f"q bigint, item_id {kind}, qid string")
        step = best(found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))), ["q", "salt"], k).drop("rank", "salt")
        result = best(step, ["q"], k).join(F.broadcast(named), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = result if out is None else out.unionByName(result)
    if out is None:
        kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((items, "item_id"), (docs, "doc_id"))}
        return spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score bigint")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_best_position_search": query}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = {
    "op13_best_position_search": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM d WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, t),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, n, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, s),
p AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_all)))) AS impact FROM tf JOIN wt USING (t), s),
sc AS (SELECT item_id, r, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN p USING (t) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 20"""
}
