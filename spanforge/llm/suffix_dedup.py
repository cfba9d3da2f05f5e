"""Suffix-array dedup by longest-previous-factor arrays over bytes.

Each byte covered by a string of ``WINDOW`` bytes that also starts earlier (a smaller doc_id, or an earlier start in the same document) is removed; the first
copy stays. Candidates come from ``repeats`` in groups that fit a task. A group's suffixes are put in suffix order with their common prefixes. For each suffix, the
nearest ones before and after it in that order that start earlier (previous and next smaller positions) give its longest previous factor: the
longer of the common prefixes with the two. Suffixes whose factor reaches ``WINDOW`` bytes begin a later copy.

Null or empty texts have no bytes; texts shorter than a window lose none. Strings are judged on the input and never cross documents. Repeated rows
(equal doc_id and text) are one document and each get its result; a repeated doc_id with different texts is several documents in the order of
the texts' hashes; a null doc_id is the smallest. An empty table gives an empty result. Columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.llm.common import flat, slices, table
from spanforge.llm.kernels import BYTES
from spanforge.llm.repeats import Bytes, covered, keyed, ranges_by_document, repeated

WINDOW, PREFIX = 100, 28


def _hashed(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(text)
    return BYTES[data], offsets


def smaller_before(places: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each entry of a suffix order, its common prefix with the nearest entry before it whose place is smaller (0 without one).

    common[i] belongs to entries i - 1 and i. Pointers jump over entries with larger places, all entries at once.
    """
    n = len(places)
    to, least = np.arange(n) - 1, common.copy()
    live = np.flatnonzero(to >= 0)
    live = live[places[to[live]] > places[live]]
    while len(live):
        step = to[live]
        least[live] = np.minimum(least[live], least[step])
        to[live] = to[step]
        live = live[to[live] >= 0]
        live = live[places[to[live]] > places[live]]
    least[to < 0] = 0
    return least


def longest_previous_factors(by: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each place, given the places in suffix order and common prefixes of neighbours."""
    before = smaller_before(by, common)
    after = smaller_before(by[::-1], np.concatenate([[0], common[1:][::-1]]))[::-1]
    out = np.zeros(len(by), common.dtype)
    out[by] = np.maximum(before, after)
    return out


def dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``, and with ``text`` kept, the bytes that are left."""
    docs_ = keyed(docs.select("doc_id", "text"))

    def marks(by: np.ndarray, common: np.ndarray) -> np.ndarray:
        return np.flatnonzero(longest_previous_factors(by, common) >= window)

    found = repeated(docs_, _hashed, Bytes, window, prefix, False, marks)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                removed, spans, kept = [], [], []
                for i, ats in enumerate(part.column("ats").to_pylist()):
                    own = data[offsets[i] : offsets[i + 1]]
                    gone = covered(ats, len(own), window)
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    kept.append(own[~gone].tobytes() if removed[-1] else own.tobytes())
                longs = pa.int64()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), longs), pa.array(removed, longs), pa.array(spans, longs), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), *([pa.array(kept, pa.binary())] if text else [])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * text])

    return ranges_by_document(docs_, found).select("doc_id", "text", "ats").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * text)


QUERIES = {"op10_lpf_dedup": lambda spark, sf_dir: dedup(table(spark, sf_dir, "documents"), text=False)}
ORACLE: dict[str, str] = {}
