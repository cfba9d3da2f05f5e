"""Byte-level BPE encoding and decoding by two tiers.

A text is split by the pattern; each match is a pre-token, encoded by itself. First tier: a minimal perfect hash over the vocabulary (hash and displace: a bucket's
displacement sends its keys to slots of their own, as many slots as keys) and a comparison with the slot's key tell whether the whole pre-token is in the
vocabulary. Second tier: the bytes are linked, a heap holds the ranks of neighbouring pairs, and the lowest rank, leftmost first, is merged until no pair is in the vocabulary. The ids of
recent pre-tokens are kept, four bytes each, in two generations of so many bytes at most; no result depends on what is kept. Decoding looks the ids up again.

The vocabulary is a file of fixed size, a parameter; the driver reads it and builds the hash. Null texts are empty; an empty text has no ids; every text is
encoded whole; repeated rows each give a row; an empty table gives an empty result. Other input columns pass through tokenize(); one named _ids or _decoded is
replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, types as T

from spanforge.llm.common import slices, table, turn

SLICE = 1 << 19  # bytes of text whose ids a task holds at a time; a longer text is taken alone
KEEP = 48 << 20  # bytes of each generation of recent pre-tokens and their ids, in a worker
ENTRY = 100  # bytes of a dictionary's entry, besides key and value
_ODD, _WIDE = 0x9E3779B97F4A7C15, (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: find() gives a key's index in ``keys``, or -1."""

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = n // 3 + 1
        self.shift, self.keys, self.index = [0] * self.buckets, [b""] * n, [-1] * n
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, i))
        free = set(range(n))
        for b, group in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(group) == 1:
                slot = free.pop()
                self.shift[b] = -slot - 1  # a key alone in its bucket names its slot
                slots = [slot]
            else:
                for d in range(1, 1 << 24):
                    slots = [self._slot(h, d) for h, _ in group]
                    if len(set(slots)) == len(slots) and free.issuperset(slots):
                        break
                self.shift[b] = d
                free.difference_update(slots)
            for slot, (_, i) in zip(slots, group, strict=True):
                self.keys[slot], self.index[slot] = keys[i], i

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ d * _ODD) * 0xD6E8FEB86659FD93 & _WIDE) >> 32) % self.n

    def find(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.index[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, get, pairs: list[int], single: list[int]) -> list[int]:
    """The ids of a pre-token that isn't in the vocabulary: a heap of pairs over linked bytes. get(bytes): a rank or None; pairs and single: the ranks of two bytes and of one."""
    n = len(piece)
    after = list(range(1, n + 2))  # where the part after the one that begins here begins
    before = list(range(-1, n))
    part = [single[a] for a in piece]  # the rank of the part that begins here
    now = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # the rank of the part here with the next
    now.append(-1)
    heap = [r * n + i for i, r in enumerate(now) if r >= 0]
    heapify(heap)
    while heap:
        rank, i = divmod(heappop(heap), n)
        if now[i] != rank:
            continue
        j = after[i]
        after[i] = k = after[j]
        part[i] = rank
        now[i] = now[j] = -1
        if k < n:
            before[k] = i
            r = get(piece[i : after[k]])
            if r is not None:
                now[i] = r
                heappush(heap, r * n + i)
        if i:
            p = before[i]
            r = get(piece[p:k])
            if r is None:
                now[p] = -1
            else:
                now[p] = r
                heappush(heap, r * n + p)
    out, i = [], 0
    while i < n:
        out.append(part[i])
        i = after[i]
    return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.keys = list(ranks)
        self.hash = PerfectHash(self.keys)
        self.numbers = [ranks[k] for k in self.keys]
        self.bytes_of = {i: k for k, i in ranks.items()}
        self.texts = {i: str(i) for i in self.bytes_of}
        self.pairs = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.single = [ranks.get(bytes((a,)), -1) for a in range(256)]
        self.name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
        self._start()

    def _start(self) -> None:
        self.findall = regex.compile(self.pattern).findall
        self.recent: _Recent = _Recent(self.piece)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("findall", "recent")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._start()

    @staticmethod
    def load(path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def piece(self, token: str) -> list[int]:
        raw = token.encode()
        i = self.hash.find(raw)
        return [self.numbers[i]] if i >= 0 else merge(raw, self.ranks.get, self.pairs, self.single)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.recent.__getitem__, self.findall(text))), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens, sha256 of the ids, sha256 of the decoded bytes."""
        ids = self.encode(text).tolist()
        said = ",".join(map(self.texts.__getitem__, ids))
        return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


class _Recent(dict):
    """Ids, packed, by pre-token. When they come to ``KEEP`` bytes, within a text too, the generation before is let go; a pre-token that is larger than a hundredth of that isn't kept."""

    def __init__(self, piece):
        super().__init__()
        self._piece, self._old, self._held = piece, {}, 0

    def __missing__(self, token: str) -> bytes:
        found = self._old.get(token)
        if found is None:
            found = array("i", self._piece(token)).tobytes()
        size = getsizeof(token) + getsizeof(found) + ENTRY
        if 100 * size <= KEEP:
            if self._held + size > KEEP:
                self._old, self._held = dict(self), 0
                self.clear()
            self[token] = found
            self._held += size
        return found


_CODECS: dict[tuple, Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of a rank file, built once in a process."""
    import public_tokenizers

    key = (path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    if key not in _CODECS:
        _CODECS[key] = Codec.load(*key)
    return _CODECS[key]


def _mine(name: str, sent: Broadcast) -> Codec:
    """The worker process's own codec, so that recent results last from task to task; what was sent is loaded only where there is none of that name yet."""
    here = turn("byte_bpe")
    if name not in here:
        here[name] = sent.value
    return here[name]


def tokenize(docs: DataFrame, own: Codec | None = None) -> DataFrame:
    """Every input column, ``_ids`` (array of int) and ``_decoded`` (binary)."""
    docs = docs.drop("_ids", "_decoded")
    own = own or codec()
    name, sent = own.name, docs.sparkSession.sparkContext.broadcast(own)  # the vocabulary's size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _mine(name, sent)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = [mine.encode(t.as_py() or "") for t in part.column("text")]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                decoded = pa.array((mine.decode(i.tolist()) for i in ids), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, np.concatenate(ids)), decoded], names=[*part.schema.names, "_ids", "_decoded"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_decoded", T.BinaryType())]))


def digest(docs: DataFrame, own: Codec | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    own = own or codec()
    name, sent = own.name, docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _mine(name, sent)
        for batch in batches:
            n, ids, decoded = zip(*(mine.digest(t.as_py() or "") for t in batch.column("text")), strict=True) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op8_byte_bpe": lambda spark, sf_dir: digest(table(spark, sf_dir, "documents"))}
ORACLE: dict[str, str] = {}
