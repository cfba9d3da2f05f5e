"""Finding all windows of L symbols that occur more than once in a corpus; the parts that the substring operators share.

Which windows could be equal? Each window of L symbols has an anchor: the position of the run of k symbols with the smallest hash
among those inside it, leftmost first. It depends on the window's content alone, so equal windows have anchors with equal hashes at equal offsets.
Consecutive windows mostly share their anchor; the symbols that the windows of one anchor span are its context. Per document only about 2 in L - k + 2
positions are anchors, and only they are shuffled, by hash:

1. ``anchors``: hash, SHA-256 of the context's content, document, first window and number of windows of each anchor. Equal contexts are combined before the
   shuffle, among the texts that a task holds at a time: those after the first are repeats already and travel under keys of their own.
2. ``settle``: sorted by hash, digest and document, anchors stream past once, however many share a hash. Equal contexts repeat each
   other's windows; of different contexts under one hash the first of each goes on.
3. ``contexts``: the content of those contexts, from the texts. Groups of them that fit a task are sorted into suffix arrays (``order``) by the operators, symbol by symbol.
4. ``split``: the windows of groups of more than ``GROUP`` contexts are grouped anew by longer and longer prefixes of their own, until a group fits and is sorted as above.
   Windows that are still together by their whole length are compared as they stream past in the order of their content.

Copies of whole contexts are told by 128 bits of the SHA-256 of their content: fetching the content as well would shuffle four times the input (45 % of all anchors of check_l,
400 bytes each). All other hashes of prefixes only bring windows together; whether those are equal is decided by their symbols.

Documents are told apart by did (doc_id; null is the smallest number) and ver, which is 0 unless ids repeat; then it is the text's hash. Rows that are equal in
both are one document. A document is held in memory while it is worked on, its neighbours are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spanforge.llm.common import cut, flat, slices
from spanforge.llm.kernels import SPACE, U, gram_hash, mix, word_spans

BATCH = 1 << 20  # bytes of contexts in one suffix array
GROUP = 8192  # contexts, of about BATCH bytes
BITS = 16  # of ``at``: window's start << BITS | number of windows
LEAST = -(1 << 63)

#: Symbols (uint64) and each row's offsets in them, from a string array.
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


class Bytes:
    """Symbols that are bytes."""

    @staticmethod
    def spans(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of the rows, where each symbol starts and ends in them, and each row's offsets (n + 1) in the symbols."""
        data, offsets = flat(text)
        return data, np.arange(len(data)), np.arange(1, len(data) + 1), offsets

    @staticmethod
    def content(text: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """As spans(), but equal runs of symbols are equal slices of the bytes."""
        data, *rest = Bytes.spans(text)
        return data.tobytes(), *rest

    @staticmethod
    def numbers(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of several contents, equal numbers for equal symbols, and each content's offsets (n + 1) in them."""
        content = content.cast(pa.large_binary())
        ends = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
        return np.frombuffer(content.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


class Words:
    """Symbols that are runs of bytes without ASCII white space."""

    @staticmethod
    def spans(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = flat(text)
        starts, ends, counts = word_spans(data, offsets, SPACE)
        return data, starts, ends, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    @staticmethod
    def content(text: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """As spans(), but with one blank after each word, whatever white space the text has."""
        data, starts, ends, offsets = Words.spans(text)
        last = np.cumsum(ends - starts + 1) - 1  # of each word's blank
        inside = np.ones(int(last[-1]) + 1 if len(last) else 0, bool)
        inside[last] = False
        out = np.full(len(inside), 0x20, np.uint8)
        out[inside] = data[~SPACE[data]]
        return out.tobytes(), last - (ends - starts), last, offsets

    @staticmethod
    def numbers(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known: dict[bytes, int] = {}
        out, sizes = [], [0]
        for x in content:
            found = [known.setdefault(w, len(known)) for w in x.as_py().split()]
            out += found
            sizes.append(len(found))
        return np.array(out, np.int64), np.cumsum(sizes)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with did and ver."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST).cast("long"))
    repeated = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return docs.withColumn("did", did).withColumn("ver", F.xxhash64("text") if repeated else F.lit(0).cast("long"))


def anchors_of(symbols: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows and hash of each anchor."""
    n = len(symbols) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U))
    least, where, size, width = gram_hash(symbols, k), None, 1, length - k + 1
    grams, where = least, np.arange(len(least), dtype=np.int32)
    step = []
    while size * 2 <= width:
        step.append(size)
        size *= 2
    if width > size:
        step.append(width - size)
    for d in step:
        later = least[d:] < least[:-d]
        where = np.where(later, where[d:], where[:-d])
        least = np.where(later, least[d:], least[:-d])
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    whole = np.flatnonzero(row[:n] == row[length - 1 :])
    if not len(whole):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U))
    spot = where[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (whole[1:] != whole[:-1] + 1)
    at = np.flatnonzero(new)
    first, count = whole[at], np.diff(np.append(at, len(whole)))
    spot = spot[at]
    rows = row[first].astype(np.int64)
    return rows, first - offsets[rows], count.astype(np.int64), grams[spot]


ANCHOR = "hash bigint, ctx bigint, ctx2 bigint, did bigint, ver bigint, at bigint, known boolean"


def digests(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 128 bits of the SHA-256 of each slice, as two numbers."""
    sha = hashlib.sha256
    found = b"".join([sha(raw[a:b]).digest()[:16] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
    both = np.frombuffer(found, U).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def combined(rank: np.ndarray, at: np.ndarray, digest: tuple[np.ndarray, np.ndarray], every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which of these anchors go on to be settled, and which are known to be repeats, given their documents' ranks and ``at``."""
    by = np.lexsort((at, rank, digest[1], digest[0]))
    new = np.ones(len(by), bool)
    new[1:] = (digest[0][by[1:]] != digest[0][by[:-1]]) | (digest[1][by[1:]] != digest[1][by[:-1]])
    again = ~new
    if every:
        again[:-1] |= ~new[1:]
    return by[new], by[again]


def anchors(docs: DataFrame, symbols: Symbols, kind: type[Bytes] | type[Words], length: int, k: int, every: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, first, count, hashes = anchors_of(*symbols(part.column("text")), length, k)
                raw, starts, ends, offsets = kind.content(part.column("text"))
                begin = offsets[rows] + first
                digest = digests(raw, starts[begin], ends[begin + count + length - 2])
                at = first << BITS | count
                place = np.empty(len(part), np.int64)
                place[np.lexsort((part.column("ver").to_numpy(), part.column("did").to_numpy()))] = np.arange(len(part))
                go, known = combined(place[rows], at, digest, every)
                spread = mix(hashes + mix(digest[0] + at.astype(U)) + place[rows].astype(U))  # keys that share nothing
                for ids, keys, flag in ((go, hashes, False), (known, spread, True)):
                    for a in range(0, len(ids), 50_000):
                        i = ids[a : a + 50_000]
                        own = pa.array(rows[i])
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i].view(np.int64)), *(pa.array(d[i].view(np.int64)) for d in digest), part.column("did").take(own), part.column("ver").take(own), pa.array(at[i]), pa.array(np.full(len(i), flag))], names=["hash", "ctx", "ctx2", "did", "ver", "at", "known"])

    return docs.select("did", "ver", "text").mapInArrow(run, ANCHOR)


def settle(found: DataFrame, every: bool) -> DataFrame:
    """(kind, hash, did, ver, at): kind 1 for the anchors all of whose windows are repeats, kind 0 for the first of each context under a hash that has several.

    every: each of equal contexts is a repeat; otherwise all but the first are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 6
        done = [np.zeros(0, bool)] * 2  # of the rows kept from before: known as repeat, known as first
        several = False  # the last hash so far has several contexts
        for batch in batches:
            if not len(batch):
                continue
            told = batch.column("known").to_numpy(zero_copy_only=False)
            if told.any():  # repeats already, and under keys of their own
                sure = batch.filter(batch.column("known"))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(sure), np.int8)), *(sure.column(c) for c in ("hash", "did", "ver", "at"))], names=["kind", "hash", "did", "ver", "at"])
                batch = batch.filter(pa.array(~told))
                if not len(batch):
                    continue
            cols = [np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, ("hash", "ctx", "ctx2", "did", "ver", "at"), strict=True)]
            more = len(cols[0]) - len(done[0])
            known = [np.concatenate([d, np.zeros(more, bool)]) for d in done]
            h, c, c2 = cols[:3]
            new_hash, new_ctx = np.ones(len(h), bool), np.ones(len(h), bool)
            new_hash[1:] = h[1:] != h[:-1]
            new_ctx[1:] = new_hash[1:] | (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
            repeat = ~new_ctx
            if every:
                repeat[:-1] |= ~new_ctx[1:]
            group = np.cumsum(new_hash) - 1
            many = np.bincount(group, weights=new_ctx) > 1
            many[0] |= several and len(done[0]) > 0
            first = new_ctx & many[group]
            out = [(1, repeat & ~known[0]), (0, first & ~known[1])]
            kind = np.concatenate([np.full(int(m.sum()), k, np.int8) for k, m in out])
            at = np.concatenate([np.flatnonzero(m) for _, m in out])
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(cols[i][at]) for i in (0, 3, 4, 5))], names=["kind", "hash", "did", "ver", "at"])
            several = bool(many[-1])
            begin = int(np.flatnonzero(new_hash)[-1])
            hold = [len(h) - 1] if several or begin == len(h) - 1 else [begin, len(h) - 1]
            kept = [x[hold] for x in cols]
            done = [(repeat | known[0])[hold], (first | known[1])[hold]]
            if several:
                done[1][:] = True

    ordered = found.repartition("hash").sortWithinPartitions("hash", "ctx", "ctx2", "did", "ver", "at")
    return ordered.mapInArrow(run, "kind tinyint, hash bigint, did bigint, ver bigint, at bigint")


CONTENT = "hash bigint, did bigint, ver bigint, at bigint, content binary"


def contexts(docs: DataFrame, firsts: DataFrame, kind: type[Bytes] | type[Words], length: int) -> DataFrame:
    """(hash, did, ver, at, content): the bytes from the first window's start to the last one's end."""
    spots = firsts.groupBy("did", "ver").agg(F.collect_list(F.struct("hash", "at")).alias("spots"))  # as many as the document has, at most
    held = docs.select("did", "ver", "text").join(spots, ["did", "ver"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, offsets = kind.spans(part.column("text"))
                raw = data.tobytes()
                spots = part.column("spots")
                sizes = np.diff(np.asarray(spots.offsets))
                inner = spots.flatten()
                hashes, at = np.asarray(inner.field("hash")), np.asarray(inner.field("at"))
                rows = np.repeat(np.arange(len(part)), sizes)
                first = offsets[rows] + (at >> BITS)
                last = first + (at & ((1 << BITS) - 1)) - 2 + length
                for a in range(0, len(rows), 5_000):
                    b = slice(a, a + 5_000)
                    ids = pa.array(rows[b])
                    found = [raw[x:y] for x, y in zip(starts[first[b]].tolist(), ends[last[b]].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[b]), part.column("did").take(ids), part.column("ver").take(ids), pa.array(at[b]), pa.array(found, pa.binary())], names=["hash", "did", "ver", "at", "content"])

    return held.select("did", "ver", "text", "spots").mapInArrow(run, CONTENT)


def order(symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``starts`` by their first ``length`` symbols (ties by place), and the common prefix (``length`` at most) of each with the one before it in that order."""
    levels: list[tuple[int, np.ndarray]] = []
    size = 1
    if symbols.dtype == np.uint8:
        pad = np.concatenate([symbols, np.zeros(8, np.uint8)]).astype(U)
        rank = pad[:-8]
        levels.append((1, rank))
        for s in (1, 2, 4):
            pad = np.concatenate([(pad[: len(pad) - s] << U(8 * s)) | pad[s:], np.zeros(s, U)])
            levels.append((2 * s, pad[:-8]))
        size, rank = 8, np.unique(levels.pop()[1], return_inverse=True)[1]
        levels.append((8, rank))
    else:
        rank = np.unique(symbols, return_inverse=True)[1]
        levels.append((1, rank))

    def paired(rank: np.ndarray, shift: int, at: np.ndarray | None = None) -> np.ndarray:
        ahead = np.concatenate([rank[shift:], np.zeros(min(shift, len(rank)), rank.dtype)])
        key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 1) + ahead
        return np.unique(key if at is None else key[at], return_inverse=True)[1]

    while size * 2 < length:
        rank = paired(rank, size)
        size *= 2
        levels.append((size, rank))
    full = paired(rank, length - size, starts) if length > size else np.unique(rank[starts], return_inverse=True)[1]
    by = np.argsort(full, kind="stable")
    a, b = starts[by[:-1]], starts[by[1:]]
    common = np.where(full[by[1:]] == full[by[:-1]], length, 0)
    differ = np.flatnonzero(common == 0)
    x, y, done = a[differ], b[differ], np.zeros(len(differ), np.int64)
    for step, ranks in reversed(levels):
        for _ in range(2 if step == size else 1):
            inside = (x < len(ranks)) & (y < len(ranks))
            same = inside & (ranks[np.minimum(x, len(ranks) - 1)] == ranks[np.minimum(y, len(ranks) - 1)]) & (done + step <= length)
            x, y, done = x + step * same, y + step * same, done + step * same
    common[differ] = np.minimum(done, length - 1)
    return by, np.concatenate([[0], common])


def sorted_groups(held: DataFrame, kind: type[Bytes] | type[Words], length: int, marks: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(did, ver, at): the windows of small groups that ``marks`` picks, given suffix order (numbers of windows in document order) and common prefixes."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        place = np.lexsort([rows.column(c).to_numpy() for c in ("at", "ver", "did")])
        rows = rows.take(pa.array(place))
        whole, begin = kind.numbers(rows.column("content").combine_chunks())
        at = rows.column("at").to_numpy()
        count = at & ((1 << BITS) - 1)
        owner = np.repeat(np.arange(len(at)), count)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        found = marks(*order(whole, begin[owner] + inner, length))
        # runs of marked windows of one context, as ranges
        hit = np.zeros(len(owner), bool)
        hit[found] = True
        opens = hit.copy()
        opens[1:] &= ~(hit[:-1] & (owner[1:] == owner[:-1]))
        first = np.flatnonzero(opens)
        sizes = np.bincount(np.cumsum(opens)[hit] - 1, minlength=len(first)) if len(first) else np.zeros(0, np.int64)
        own = pa.array(owner[first])
        return pa.RecordBatch.from_arrays([rows.column("did").combine_chunks().take(own), rows.column("ver").combine_chunks().take(own), pa.array((((at >> BITS)[owner[first]] + inner[first]) << BITS) | sizes)], names=["did", "ver", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= BATCH:
                rows = pa.Table.from_batches(held)
                hashes = rows.column("hash").to_numpy()
                end = int(np.searchsorted(hashes, hashes[-1]))  # the last group may go on
                if end:
                    for a, b in pieces(hashes[:end], rows):
                        yield work(rows.slice(a, b - a))
                    rows = pa.Table.from_batches(rows.slice(end).combine_chunks().to_batches())
                held, size = rows.to_batches(), rows.nbytes
        if held:
            rows = pa.Table.from_batches(held)
            for a, b in pieces(rows.column("hash").to_numpy(), rows):
                yield work(rows.slice(a, b - a))

    def pieces(hashes: np.ndarray, rows: pa.Table) -> Iterator[tuple[int, int]]:
        """Whole groups of about BATCH bytes."""
        each = max(1, int(BATCH / max(1, rows.nbytes / len(rows))))
        a = 0
        while a < len(hashes):
            b = min(a + each, len(hashes))
            if b < len(hashes):
                b = int(np.searchsorted(hashes, hashes[b - 1], side="right"))
            yield a, b
            a = b

    ordered = held.repartition("hash").sortWithinPartitions("hash")
    return ordered.mapInArrow(run, "did bigint, ver bigint, at bigint")


def single_windows(held: DataFrame, kind: type[Bytes] | type[Words], length: int) -> DataFrame:
    """(did, ver, at, content) of each single window of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                data, starts, ends, first = kind.spans(part.column("content"))
                raw = data.tobytes()
                at = part.column("at").to_numpy()
                count = at & ((1 << BITS) - 1)
                owner = np.repeat(np.arange(len(at)), count)
                inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                spots = first[owner] + inner
                for c in range(0, len(owner), 5_000):
                    b = slice(c, c + 5_000)
                    own = pa.array(owner[b])
                    found = [raw[x:y] for x, y in zip(starts[spots[b]].tolist(), ends[spots[b] + length - 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("did").take(own), part.column("ver").take(own), pa.array(((at >> BITS)[owner[b]] + inner[b]) << BITS | 1), pa.array(found, pa.binary())], names=["did", "ver", "at", "content"])

    return held.select("did", "ver", "at", "content").repartition(F.xxhash64("did", "ver", "at")).mapInArrow(run, "did bigint, ver bigint, at bigint, content binary")


def by_prefix(windows: DataFrame, kind: type[Bytes] | type[Words], symbols: int) -> DataFrame:
    """(hash, did, ver, at, content): single windows under the hash of their first ``symbols`` symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, starts, ends, first = kind.spans(batch.column("content"))
            raw = data.tobytes()
            keys = [xxhash.xxh3_64_intdigest(b" ".join([raw[x:y] for x, y in zip(starts[a : a + symbols].tolist(), ends[a : a + symbols].tolist(), strict=True)]) if kind is Words else raw[a : a + symbols]) for a in first[:-1].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, U).view(np.int64)), *batch.columns], names=["hash", *batch.schema.names])

    return windows.mapInArrow(run, CONTENT)


def equal_windows(windows: DataFrame, kind: type[Bytes] | type[Words], every: bool) -> DataFrame:
    """(did, ver, at) of the single windows that repeat: all of those with one content, or all but the first. They stream past in the order of content and place, however many are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the window before: content, place, and whether it is known as a repeat
        for batch in batches:
            out = []
            for content, *place in zip(batch.column("content").to_pylist(), *(batch.column(c).to_pylist() for c in ("did", "ver", "at")), strict=True):
                content = tuple(content.split()) if kind is Words else content
                again = last is not None and last[0] == content
                if again:
                    if every and not last[2]:
                        out.append(last[1])
                    out.append(place)
                last = (content, place, again)
            did, ver, at = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (did, ver, at)], names=["did", "ver", "at"])

    # words may be parted by different white space: it goes by the words
    key = F.array_join(F.filter(F.split(F.decode("content", "UTF-8"), r"[\x20\x09-\x0D]+"), lambda x: x != ""), " ") if kind is Words else F.col("content")
    return windows.withColumn("key", key).repartition("hash").sortWithinPartitions("hash", "key", "did", "ver", "at").select("did", "ver", "at", "content").mapInArrow(run, "did bigint, ver bigint, at bigint")


def split(held: DataFrame, kind: type[Bytes] | type[Words], length: int, k: int, every: bool, marks: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(did, ver, at): repeats among the windows of large groups, by prefixes that grow until a group fits."""
    windows, out, symbols = cut(single_windows(held, kind, length), "windows"), None, k
    while True:
        symbols = min(length, symbols)
        keyed_ = cut(by_prefix(windows, kind, symbols), "prefixes")
        large = cut(keyed_.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("hash"), "large")
        fits = sorted_groups(keyed_.join(large, "hash", "left_anti"), kind, length, marks)
        out = fits if out is None else out.unionByName(fits)
        if large.isEmpty():
            return out
        rest = keyed_.join(large, "hash", "left_semi")
        if symbols == length:
            return out.unionByName(equal_windows(rest, kind, every))
        windows, symbols = rest.drop("hash"), 2 * symbols


def repeated(docs: DataFrame, symbols: Symbols, kind: type[Bytes] | type[Words], length: int, k: int, every: bool, marks: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(did, ver, at): ranges of repeated windows of ``docs`` (with did and ver).

    symbols: each symbol as 64 random bits, to find anchors by; kind: the symbols themselves, to sort.
    """
    once = docs.select("did", "ver", "text")
    if not docs.groupBy("did", "ver").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        once = once.dropDuplicates(["did", "ver"])
    settled = cut(settle(anchors(once, symbols, kind, length, k, every), every), "settled")
    firsts = settled.where("kind = 0").select("hash", "did", "ver", "at")
    large = cut(firsts.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("hash"), "large")
    held = contexts(once, firsts, kind, length)
    out = settled.where("kind = 1").select("did", "ver", "at")
    if large.isEmpty():
        return out.unionByName(sorted_groups(held, kind, length, marks))
    held = cut(held, "contexts")
    return out.unionByName(sorted_groups(held.join(large, "hash", "left_anti"), kind, length, marks)).unionByName(split(held.join(large, "hash", "left_semi"), kind, length, k, every, marks))


def ranges_by_document(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with ``ats``, the ranges of windows of each; null where there are none."""
    return docs.join(found.groupBy("did", "ver").agg(F.collect_list("at").alias("ats")), ["did", "ver"], "left")


def covered(ats, n: int, length: int) -> np.ndarray:
    """Which of n symbols any window of the ranges covers."""
    edges = np.zeros(n + 1, np.int32)
    if ats is not None and len(ats):
        at = np.asarray(ats, np.int64)
        first = at >> BITS
        np.add.at(edges, first, 1)
        np.add.at(edges, first + (at & ((1 << BITS) - 1)) - 1 + length, -1)
    return np.cumsum(edges[:-1]) > 0
