"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A text's bytes (A-Z lower-cased) are cut into windows of ``WINDOW`` bytes, and each is compressed with both dictionaries. Where the toxic one
saves at least a calibrated number of bytes more than the ordinary one, the window is a hit; hits and windows of the whole text give the probability.

Both dictionaries are trained alike, each on its own class: runs of ``GRAM`` bytes whose share of that class's documents is surely above their share of the other's
(confidence bounds, ``GATES``) are joined into passages, and the most frequent passages fill ``SIZE`` bytes. What both classes write alike is in neither, so an ordinary window is
compressed alike by both. Every window follows a fixed ``STUB`` that both dictionaries hold: a frame of so few bytes would otherwise be stored uncompressed, and single matches would not show.

Training takes ``TRAIN_ROWS`` labelled documents at most (half of each class, those with the smallest hashes of doc_id; whole texts), never rows whose crc32(doc_id as text) mod 5 is 0. Its
statistics are Spark jobs over them. The gate, the window's threshold and the weights are calibrated on windows that dictionaries of the other half of the sample compressed; the classes' true
proportions are restored in the bias.

Only the text enters a score. Null texts count as empty; an empty text has no window and gets the score of no hits. Very long texts are worked through in windows, nothing is kept of them but
counts. Repeated rows each get their score; an empty table gives an empty result. A null doc_id is scored, not held out, and never learned from. Other input columns pass through; one named _score is replaced. Without labels of both classes every score is the
share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spanforge.llm.common import cut, sampled, slices, table

TRAIN_ROWS, WINDOW, GRAM, SIZE = 2400, 56, 6, 320
#: Standard errors of the bounds, and how many times the lower bound of the one share must exceed the upper bound of the other.
GATES = ((1.3, 3.0), (2.0, 4.0))
#: Documents, and share of a class's documents, that hold a passage at least.
LEAST, SHARE = 4, 0.03
#: Most runs of bytes and passages that a model looks at, the most frequent first: a model's size, whatever the corpus.
MODEL = 20_000
THRESHOLDS = np.arange(1, 9)
#: No text of words holds these bytes.
STUB = bytes(range(1, 8)) + bytes(range(14, 31))
U = np.uint64


def grams(text: bytes) -> np.ndarray:
    """Each run of GRAM bytes as a number."""
    x = np.frombuffer(text, np.uint8)
    out = np.zeros(max(0, len(x) - GRAM + 1), U)
    for j in range(GRAM):
        out = (out << U(8)) | x[j : len(out) + j]
    return out


def passages(text: bytes, known: np.ndarray, weight: np.ndarray) -> set[bytes]:
    """Maximal runs of ``known`` grams (sorted) in the text, less those of their grams that are much rarer than the run's most frequent one."""
    x = grams(text)
    if not len(x) or not len(known):
        return set()
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    w = np.where(known[at] == x, weight[at], 0)
    ok = w > 0
    edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return set()
    inner = np.flatnonzero(ok)
    begins = np.concatenate([[0], np.cumsum(last - first)[:-1]])
    ok[inner[w[inner] < 0.6 * np.repeat(np.maximum.reduceat(w[inner], begins), last - first)]] = False
    edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
    spans = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
    return {text[a : b + GRAM - 1] for a, b in spans if b - a + GRAM - 1 <= WINDOW // 2}


def filled(found: list[tuple[int, bytes]], least: float, size: int = SIZE) -> bytes:
    """The most frequent passages, of ``least`` documents and more, that fit; the most frequent last, where offsets are shortest."""
    chosen: list[bytes] = []
    for n, p in sorted(found, key=lambda x: (-x[0], x[1])):
        if n < least or sum(map(len, chosen)) + len(p) > size:
            break
        if not any(p in q for q in chosen):
            chosen.append(p)
    return b"".join(reversed(chosen)) + STUB


@dataclass
class Model:
    toxic: bytes = STUB
    ordinary: bytes = STUB
    threshold: int = 1
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = 0.0

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return compressor(self.toxic), compressor(self.ordinary)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    params = zstandard.ZstdCompressionParameters.from_level(3, source_size=WINDOW + len(STUB), dict_size=len(content), min_match=6, strategy=zstandard.STRATEGY_GREEDY, **plain)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=held)


def savings(text: bytes, pair: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes that the toxic dictionary saves more than the ordinary one, for each window of the lower-cased text."""
    toxic, ordinary = pair[0].compress, pair[1].compress
    cuts = (STUB + text[a : a + WINDOW] for a in range(0, len(text), WINDOW))
    return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in cuts), np.int64)


def features(hits: np.ndarray, windows: np.ndarray) -> np.ndarray:
    rate = hits / np.maximum(windows, 1)
    return np.stack([np.log(rate + 0.01), np.log1p(hits), np.log1p(windows), rate], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float, float]:
    """Weights, bias and mean log loss of a ridge logistic regression, by Newton steps."""
    a, w = np.concatenate([x, np.ones((len(x), 1))], 1), np.zeros(x.shape[1] + 1)
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w[:-1], float(w[-1]), float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def gram_counts(sample: DataFrame) -> DataFrame:
    """(gram, n0 .. n3): how many documents of (label, fold) hold it; n<2 * label + fold>. Counted within a batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                group = (2 * part.column("label").to_numpy() + part.column("fold").to_numpy()).tolist()
                each = [np.unique(grams(t.encode().lower())) for t in part.column("text").to_pylist()]
                all_ = np.concatenate(each) if each else np.zeros(0, U)
                found, back = np.unique(all_, return_inverse=True)
                of = np.repeat(np.array(group, np.int64), [len(e) for e in each])
                n = np.bincount(back * 4 + of, minlength=4 * len(found)).reshape(-1, 4)
                for a in range(0, len(found), 50_000):
                    b = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(found[b].view(np.int64)), *(pa.array(n[b, i]) for i in range(4))], names=["gram", "n0", "n1", "n2", "n3"])

    rows = sample.select("text", "label", "fold").mapInArrow(run, "gram bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
    return rows.groupBy("gram").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4)))


def surely_more(n: np.ndarray, of: float, m: np.ndarray, there: float, gate: tuple[float, float]) -> np.ndarray:
    p, q = n / max(of, 1), (m + 0.5) / (there + 1)
    low, high = p - gate[0] * np.sqrt(p * (1 - p) / max(of, 1)), q + gate[0] * np.sqrt(q * (1 - q) / (there + 1))
    return (n >= 3) & (low > gate[1] * high)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model learned from ``rows`` labelled documents at most."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("label"))
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = share.get(1, 0), share.get(0, 0)
    flat = (ones + 0.5) / (ones + zeros + 1)
    constant = Model(bias=float(np.log(flat / (1 - flat))))
    if not ones or not zeros:
        return constant
    some = [sampled(known.where(F.col("label") == k), "doc_id", rows // 2, 3).orderBy("_h", "doc_id").limit(rows // 2).drop("_h") for k in (0, 1)]
    chosen = some[0].unionByName(some[1]).distinct()  # ``rows`` rows at most, so it may be broadcast
    fold = F.xxhash64("doc_id", F.lit("fold")).bitwiseAND(1).alias("fold")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").distinct()
    sample = cut(texts.select("text", "label", fold).repartition(8, F.xxhash64("text")), "toxicity-sample")
    sizes = np.zeros(4)
    for r in sample.groupBy("label", "fold").agg(F.count("*").alias("n")).collect():
        sizes[2 * r["label"] + r["fold"]] = r["n"]
    counted = gram_counts(sample).where("n0 + n1 >= 3 OR n2 + n3 >= 3").orderBy(F.abs((F.col("n2") + F.col("n3")) / max(1.0, sizes[2] + sizes[3]) - (F.col("n0") + F.col("n1")) / max(1.0, sizes[0] + sizes[1])).desc(), "gram").limit(MODEL)
    found = np.array([tuple(r) for r in counted.collect()], np.int64).reshape(-1, 5)
    found = found[np.argsort(found[:, 0].view(U))]
    # sets of grams: (gate, folds to learn from, class)
    sets: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
    for g, gate in enumerate(GATES):
        for part, folds in enumerate(((0,), (1,), (0, 1))):
            n = [sum(found[:, 1 + 2 * k + f] for f in folds) for k in (0, 1)]
            of = [sum(sizes[2 * k + f] for f in folds) for k in (0, 1)]
            for k in (0, 1):
                good = surely_more(n[k], of[k], n[1 - k], of[1 - k], gate)
                sets[g, part, k] = found[good, 0].view(U), n[k][good]
    halves = {0: sizes[[2, 0]], 1: sizes[[3, 1]], 2: sizes[[2, 0]] + sizes[[3, 1]]}
    found = dictionaries(sample, sets).items()
    models = {(g, part): Model(*(filled(x, SHARE * n) for x, n in zip(pair, halves[part], strict=True))) for (g, part), pair in found}
    kinds = range(len(GATES))
    measured = measure(sample, {(g, 1 - f): models[g, f].compressors for g in kinds for f in (0, 1)})
    best: tuple[float, Model] | None = None
    for g in kinds:
        at = measured["kind"] == g
        y, windows = measured["label"][at], measured["windows"][at]
        if not at.any() or y.min() == y.max():
            continue
        for i, t in enumerate(THRESHOLDS.tolist()):
            weights, bias, loss = logistic(features(measured["hits"][at, i], windows), y)
            if best is None or loss < best[0] - 1e-12:
                prior = np.log(ones / zeros) - np.log(y.sum() / (len(y) - y.sum()))
                best = loss, Model(models[g, 2].toxic, models[g, 2].ordinary, t, weights, bias + float(prior))
    return best[1] if best else constant


def dictionaries(sample: DataFrame, sets: dict) -> dict:
    """For each (gate, part) the passages of toxic and of ordinary documents, with the number of documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                text = text.encode().lower()
                for (g, part, k), (known, weight) in sets.items():
                    if k == label and part in (fold, 2):
                        out += [(g, part, k, p) for p in passages(text, known, weight)]
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["gate", "part", "label", "passage"])

    rows = sample.mapInArrow(run, "gate int, part int, label int, passage binary")
    counted = rows.groupBy("gate", "part", "label", "passage").agg(F.count("*").alias("n")).where(f"n >= {LEAST}").orderBy(F.desc("n"), "gate", "part", "label", "passage").limit(MODEL)
    out = {(g, part): ([], []) for g, part, _ in sets}
    for r in counted.collect():
        out[r["gate"], r["part"]][1 - r["label"]].append((r["n"], bytes(r["passage"])))
    return out


def measure(sample: DataFrame, pairs: dict) -> dict[str, np.ndarray]:
    """Kind of model, label, number of windows and hits at each threshold, of every document of the sample by the dictionaries given for (kind, its fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {k: make() for k, make in pairs.items()}
        for batch in batches:
            out = []
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                for (g, f), pair in made.items():
                    if f == fold:
                        found = savings(text.encode().lower(), pair)
                        out.append((g, label, len(found), (found[None] >= THRESHOLDS[:, None]).sum(1).tolist()))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64()))], names=["kind", "label", "windows", "hits"])

    found = sample.mapInArrow(run, "kind bigint, label bigint, windows bigint, hits array<bigint>").collect()
    found.sort(key=tuple)
    return {c: np.array([r[c] for r in found], np.float64) for c in ("kind", "label", "windows", "hits")}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every input column and ``_score``, the probability of label 1."""
    docs = docs.drop("_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for batch in batches:
            for part in slices(batch, "text"):
                hits, windows = np.zeros(len(part)), np.zeros(len(part))
                for i, text in enumerate(part.column("text").cast(pa.large_binary())):
                    found = savings((text.as_py() or b"").lower(), pair)
                    hits[i], windows[i] = (found >= model.threshold).sum(), len(found)
                p = 1 / (1 + np.exp(-np.clip(features(hits, windows) @ model.weights + model.bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_compression_toxicity": query}
ORACLE: dict[str, str] = {}
