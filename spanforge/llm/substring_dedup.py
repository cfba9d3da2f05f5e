"""Substring dedup by prefix-partitioned suffix trees over words.

Windows of ``WINDOW`` words whose sequence also starts anywhere else (same document included) are repeats; every word that one covers is removed. The
suffixes are split by prefixes of variable length into groups that fit a task's memory: first ``PREFIX`` words, taken at each window's anchor (see ``repeats``); the windows of groups that
are too large by prefixes of their own, of ``PREFIX`` words, twice as many, and so on until they fit. A group's suffixes are sorted by their words, which lays out its suffix tree: intervals of
neighbours whose common prefix is as long as a depth are the tree's internal nodes. Those at a depth of a window's length are the deep nodes, and their leaves are the repeats.

Words are runs without ASCII white space, unchanged. Null or empty texts have no words; texts with fewer words than a window lose
none; an empty table gives an empty result. Windows are judged on the input. Repeated rows (equal doc_id and text) are one document and each get its result; a repeated doc_id with
different texts is several documents; a null doc_id is the smallest. Columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.llm.common import flat, slices, table
from spanforge.llm.kernels import SPACE, span_hash, word_spans
from spanforge.llm.repeats import Words, covered, keyed, ranges_by_document, repeated

WINDOW, PREFIX = 35, 8


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(text)
    starts, ends, counts = word_spans(data, offsets, SPACE)
    return span_hash(data, starts, ends), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def deep_leaves(by: np.ndarray, common: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The leaves below internal nodes of at least that depth."""
    inside = common >= depth
    inside[:-1] |= common[1:] >= depth
    return by[inside]


def dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs``, and with ``text`` kept, the text that is left."""
    docs_ = keyed(docs.select("doc_id", "text"))
    found = repeated(docs_, words, Words, window, prefix, True, lambda by, common: deep_leaves(by, common, window))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                starts, ends, counts = word_spans(data, offsets, SPACE)
                raw, first = data.tobytes(), np.concatenate([[0], np.cumsum(counts)]).tolist()
                removed, kept = [], []
                for i, ats in enumerate(part.column("ats").to_pylist()):
                    a, b = first[i], first[i + 1]
                    left = ~covered(ats, b - a, window)
                    removed.append(int((~left).sum()))
                    kept.append(b" ".join([raw[x:y] for x, y in zip(starts[a:b][left].tolist(), ends[a:b][left].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), *([pa.array(kept, pa.binary()).cast(pa.string())] if text else [])], names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * text])

    return ranges_by_document(docs_, found).select("doc_id", "text", "ats").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * text)


QUERIES = {"op9_suffix_tree_dedup": lambda spark, sf_dir: dedup(table(spark, sf_dir, "documents"), text=False)}

ORACLE = {
    "op9_suffix_tree_dedup": r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT words.doc_id, count(p.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.i) FILTER (p.i IS NULL), '') AS kept FROM words LEFT JOIN p ON p.doc_id = words.doc_id AND p.i = words.i GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
}
