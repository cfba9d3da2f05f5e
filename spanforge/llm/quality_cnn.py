"""Quality classifier: a byte-level convolutional network in NumPy.

Bytes are embedded, learned filters of ``2 * STRIDE`` bytes slide over the text, and their rectified responses are max-pooled over chunks of ``2 * HALF`` bytes
that overlap by half and cover the whole document. The pooled chunks are combined by their mean and their maximum into one
probability.

The network learns from ``TRAIN_ROWS`` labelled ids at most (half of each class, those with the smallest hashes of
doc_id; twice as many texts at most, where ids repeat), whole texts, never from rows whose crc32(doc_id as text) mod 3 is 1. The classes' true proportions are restored in the
bias. Only the text enters a score. Null texts count as empty; an empty text is one chunk of padding. Repeated rows each get their score; an empty table gives an empty result. Other
input columns pass through; one named _score is replaced. Without labels of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spanforge.llm.common import flat, sampled, slices, table, turn

TRAIN_ROWS, EPOCHS = 3000, 8
DIM, STRIDE, FILTERS, HALF = 8, 4, 32, 256
PAD, POSITIONS = 256, HALF // STRIDE
STEP = 2048  # half chunks whose responses are held at a time


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte numbers with each row padded to whole half chunks (one block of padding at least), and each row's first half chunk (n + 1)."""
    sizes = np.diff(offsets)
    halves = (sizes + STRIDE + HALF - 1) // HALF
    first = np.concatenate([[0], np.cumsum(halves)]).astype(np.int64)
    out = np.full(int(first[-1]) * HALF, PAD, np.uint16)
    shift = first[:-1] * HALF - offsets[:-1]
    out[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    return out, first


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = {
            "embed": rng.normal(0, 0.5, (257, DIM)).astype(np.float32),
            "filters": rng.normal(0, (2 * STRIDE * DIM) ** -0.5, (2, STRIDE * DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }
        self.w["embed"][PAD] = 0
        self.prior = 0.0

    def responses(self, numbers: np.ndarray) -> np.ndarray:
        """(half chunks, positions, filters), rectified."""
        blocks = self.w["embed"][numbers].reshape(-1, STRIDE * DIM)
        found = blocks @ self.w["filters"][0]
        found[:-1] += blocks[1:] @ self.w["filters"][1]
        found += self.w["bias"]
        np.maximum(found, 0, out=found)
        return found.reshape(-1, POSITIONS, FILTERS)

    def _part(self, numbers: np.ndarray, ends: np.ndarray, a: int, b: int) -> np.ndarray:
        """The responses of half chunks a to b; those at a row's end that would reach into the next row are 0."""
        found = self.responses(numbers[a * HALF : b * HALF]) if b == len(ends) else self._ahead(numbers, a, b)
        found[ends[a:b], -1] = 0
        return found

    def _chunks(self, halves: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Maxima of chunks: each half with the next of its row."""
        chunks = halves.copy()
        np.maximum(chunks[:-1], halves[1:], out=chunks[:-1])
        chunks[ends] = halves[ends]
        return chunks

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        numbers, first = padded(data, offsets)
        rows = np.diff(first)
        halves = np.empty((int(first[-1]), FILTERS), np.float32)
        ends = np.zeros(int(first[-1]), bool)
        ends[first[1:] - 1] = True
        for a in range(0, len(halves), STEP):
            halves[a : a + STEP] = self._part(numbers, ends, a, min(a + STEP, len(halves))).max(1)
        chunks = self._chunks(halves, ends)
        means = np.add.reduceat(chunks, first[:-1], axis=0) / rows[:, None]
        peaks = np.maximum.reduceat(chunks, first[:-1], axis=0)
        return np.concatenate([means, peaks], 1).astype(np.float64) @ self.w["out"] + self.w["shift"][0] + self.prior

    def _ahead(self, numbers: np.ndarray, a: int, b: int) -> np.ndarray:
        blocks = self.w["embed"][numbers[a * HALF : b * HALF + STRIDE]].reshape(-1, STRIDE * DIM)
        found = blocks[:-1] @ self.w["filters"][0]
        found += blocks[1:] @ self.w["filters"][1]
        found += self.w["bias"]
        np.maximum(found, 0, out=found)
        return found.reshape(-1, POSITIONS, FILTERS)

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        numbers, first = padded(np.concatenate(texts) if texts else np.zeros(0, np.uint8), offsets)
        n, rows = int(first[-1]), np.diff(first)
        ends = np.zeros(n, bool)
        ends[first[1:] - 1] = True
        halves, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64)
        for a in range(0, n, STEP):  # responses of a part at a time; of each half chunk the maximum and its position stay
            found = self._part(numbers, ends, a, min(a + STEP, n))
            halves[a : a + STEP], where[a : a + STEP] = found.max(1), found.argmax(1)
        chunks = self._chunks(halves, ends)
        row = np.repeat(np.arange(len(texts)), rows)
        later = np.zeros_like(halves, bool)  # the chunk's maximum is in the next half
        later[:-1] = (halves[1:] > halves[:-1]) & ~ends[:-1, None]
        means = np.add.reduceat(chunks, first[:-1], axis=0) / rows[:, None]
        peaks = np.maximum.reduceat(chunks, first[:-1], axis=0)
        pooled = np.concatenate([means, peaks], 1)
        p = 1 / (1 + np.exp(-(pooled @ self.w["out"] + self.w["shift"][0])))
        err = ((p - labels) / len(texts)).astype(np.float32)
        g = {"out": pooled.T @ err, "shift": np.array([err.sum()], np.float32)}
        d_pool = err[:, None] * self.w["out"][None]
        d_chunk = (d_pool[:, :FILTERS] / rows[:, None])[row]
        top = chunks == peaks[row]
        top &= np.cumsum(top, 0) - np.concatenate([np.zeros((1, FILTERS), int), np.cumsum(top, 0)[first[1:-1] - 1]])[row] == 1  # the first maximum of each row
        d_chunk = d_chunk + np.where(top, d_pool[:, FILTERS:][row], 0)
        d_half = np.where(later, 0, d_chunk)
        d_half[1:] += np.where(later, d_chunk, 0)[:-1]
        d_half[halves <= 0] = 0
        g["bias"] = d_half.sum(0)
        g["filters"], g["embed"] = np.zeros_like(self.w["filters"]), np.zeros_like(self.w["embed"])
        at = np.arange(n)[:, None] * POSITIONS + where
        letters = numbers.reshape(-1, STRIDE)
        for side in (0, 1):
            inside = np.minimum(at + side, len(letters) - 1)
            for f in range(FILTERS):
                d = d_half[:, f]
                live = np.flatnonzero(d)
                x = self.w["embed"][letters[inside[live, f]]].reshape(-1, STRIDE * DIM)
                g["filters"][side, :, f] = x.T @ d[live]
                back = d[live, None] * self.w["filters"][side, :, f][None]
                np.add.at(g["embed"], letters[inside[live, f]].ravel(), back.reshape(-1, DIM))
        g["embed"][PAD] = 0
        return g

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 48, seed: int = 4) -> Network:
        rng = np.random.default_rng(seed)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        step, total = 0, epochs * max(1, -(-len(texts) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                ids = order[a : a + batch]
                step += 1
                rate = 0.01 * (1 - step / (total + 1))
                for k, g in self.gradients([texts[i] for i in ids], labels[ids]).items():
                    m = moment[k]
                    g = g + 1e-5 * self.w[k]
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.99 * m[1] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    """The network learned from ``rows`` labelled documents at most."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("_label"))
    share = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    net = Network()
    ones, zeros = share.get(1, 0), share.get(0, 0)
    if not ones or not zeros:
        net.w["out"][:] = 0
        p = (ones + 0.5) / (ones + zeros + 1)
        net.prior = float(np.log(p / (1 - p)))
        return net
    some = [sampled(known.where(F.col("_label") == k), "doc_id", rows // 2, 3).orderBy("_h", "doc_id").limit(rows // 2).drop("_h") for k in (0, 1)]
    sample = some[0].unionByName(some[1])  # ``rows`` rows at most, so it may be broadcast
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    held = held.select("doc_id", "text", "_label").distinct()
    found = held.withColumn("_h", F.xxhash64("doc_id", "text")).orderBy("_h", "doc_id", "text").limit(2 * rows).drop("_h").collect()  # repeated ids: 2 * ``rows`` at most, the same each time
    found.sort(key=lambda r: (r.doc_id, r.text))
    texts = [np.frombuffer(r.text.encode(), np.uint8) for r in found]
    y = np.array([r["_label"] for r in found], np.float64)
    if not len(texts) or y.min() == y.max():
        net.w["out"][:] = 0
    else:
        net.fit(texts, y)
        net.prior = float(np.log(ones / zeros) - np.log(y.sum() / (len(y) - y.sum())))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Every input column and ``_score``, the probability of label 1."""
    docs = docs.drop("_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn()
        for batch in batches:
            for part in slices(batch, "text"):
                p = 1 / (1 + np.exp(-np.clip(net.logits(*flat(part.column("text"))), -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_quality_cnn": lambda spark, sf_dir: classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))}
ORACLE: dict[str, str] = {}
