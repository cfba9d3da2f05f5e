"""Secret scans: exact base patterns and a linear-chain conditional random field.

The base patterns find assignments, access ids and long hexadecimal runs. The field tags each token (a run of letters, digits, ``+/_.-`` or bytes
beyond ASCII) as beginning, inside or outside of a secret. Its features are the token's shape (length, kinds of characters, changes between letters and digits,
distinct characters, prefix), its neighbours (what separates it from the token before, secret-like names among the two tokens
before) and the file (share of digits, share of code-like marks). Tags are decoded by Viterbi; spans of which a part lies outside of all base spans are added whole as
kind ``crf``.

Decoding is exact and cheap: where a token's score as outside leads by more than any transitions can make up, it
is outside in the best path, whatever its neighbours are. Such tokens part the chain into short runs, and Viterbi runs
over those, many at a time.

The weights are learned from ``TRAIN_ROWS`` documents at most (those with the smallest hashes of doc_id, whole texts, of their runs of tokens ``TRAIN_RUNS`` at most, half of them with
secret-like names), labelled by the base patterns, and from lines of public secret formats that are generated here. Every document is
scanned whole. Null texts are empty; an empty text has no spans; an empty table gives an empty result; repeated rows each give a row. Other input columns pass through; one named
_found or _masked is replaced.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spanforge.llm.common import flat, sampled, slices, table, turn
from spanforge.llm.kernels import word_spans

TRAIN_ROWS, TRAIN_RUNS, EPOCHS = 800, 20_000, 60
SLICE = 1 << 19  # bytes of text whose features a task holds at a time; a longer text is taken alone

# The base patterns in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of [0-9a-f]+ that hold 16 characters
KINDS = ("assign", "access", "hex", "crf")
NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")  # one stands in every assignment
KEYWORD = re.compile(rb"(?:^|[._-])(?:\w*(?:password|passwd|secret|token|api_?key|apikey|credential|auth|bearer|private_?key|access_?key|pwd))$", re.I)

_HEX = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_RUN = b"\x01" * 16


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns' matches, in code points."""
    raw = text.encode() if raw is None else raw
    out = []
    low = raw.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _RUN in raw.translate(_HEX):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


# --- features -------------------------------------------------------------------------------------------------------
_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 4 digit, 8 mark, 16 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 16 if _b >= 128 else 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 4 if _c.isdigit() else 8 if _c in "+/_.-" else 0
_SEP = np.zeros(256, np.uint8)  # between tokens: 1 newline, 2 = or :, 4 quote, 8 other
for _b in range(128):
    _SEP[_b] = 0 if _KIND[_b] or chr(_b) in " \t" else 1 if chr(_b) in "\r\n" else 2 if chr(_b) in "=:" else 4 if chr(_b) in "\"'`" else 8
_BIT = np.left_shift(np.uint64(1), (np.arange(256) * 29 % 64).astype(np.uint64))
_PREFIX = [b"AKIA", b"ghp_", b"gho_", b"xoxb", b"xoxp", b"sk-", b"eyJ", b"AIza", b"glpat"]
LENGTHS = np.array([4, 7, 10, 12, 16, 18, 24, 32, 48])
#: Sizes of the features' ranges: length x kinds, changes x length, distinct x length, prefix, separator x name before, name two before x kinds, file.
WIDTHS = (10 * 32, 6 * 10, 8 * 10, 16, 16 * 4, 4 * 32, 16, 2 * 10)
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, the token before which each row begins (n + 1), and feature numbers (tokens x features)."""
    starts, ends, counts = word_spans(data, offsets, _KIND == 0)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    n = len(starts)
    if not n:
        return starts, ends, first, np.zeros((0, len(WIDTHS)), np.int32)
    kind = _KIND[data]
    edges = np.empty(2 * n, np.int64)
    edges[0::2], edges[1::2] = starts, ends
    shut = edges if ends[-1] < len(data) else edges[:-1]
    kinds = np.bitwise_or.reduceat(kind, shut)[0::2]
    distinct = np.bitwise_count(np.bitwise_or.reduceat(_BIT[data], shut)[0::2])
    digit = kind == 4
    change = np.zeros(len(data) + 1, np.int32)
    np.cumsum(digit[1:] != digit[:-1], out=change[2:] if len(data) > 1 else change[2:2])
    changes = change[ends] - change[starts + 1]
    length = np.searchsorted(LENGTHS, ends - starts, side="right").astype(np.int32)
    # separators before a token: the or of the bytes since the token before, or since the row's beginning
    row = np.repeat(np.arange(len(offsets) - 1), counts)
    before = np.empty(n, np.int64)
    before[0], before[1:] = 0, ends[:-1]
    np.maximum(before, offsets[row], out=before)
    sep_code = _SEP[data]
    cuts = np.empty(2 * n, np.int64)
    cuts[0::2], cuts[1::2] = before, starts
    gap = np.where(starts > before, np.bitwise_or.reduceat(sep_code, cuts)[0::2], 0).astype(np.uint8)
    name = np.zeros(n, np.int32)
    for i in np.flatnonzero(_maybe_name(data, starts, ends)).tolist():
        if KEYWORD.search(data[starts[i] : ends[i]].tobytes()):
            name[i] = 1
    begins = np.zeros(n, bool)
    begins[first[:-1][counts > 0]] = True
    name1 = np.where(begins, 0, np.concatenate([[0], name[:-1]]))
    name2 = np.where(begins, 0, np.concatenate([[0], name1[:-1]]))
    prefix = np.zeros(n, np.int32)
    for i in np.flatnonzero((kinds & 2 > 0) & (kinds & 12 > 0) | (kinds & 8 > 0) & (length >= 4)).tolist():
        t = data[starts[i] : starts[i] + 6].tobytes()
        prefix[i] = next((j + 1 for j, p in enumerate(_PREFIX) if t.startswith(p)), 0)
    size = np.maximum(np.diff(offsets), 1)
    sums = np.zeros((2, len(data) + 1), np.int64)
    np.cumsum(digit, out=sums[0, 1:])
    np.cumsum(sep_code >= 8, out=sums[1, 1:])
    share = [np.minimum(np.searchsorted([0.002, 0.02, 0.1], (s[offsets[1:]] - s[offsets[:-1]]) / size), 3) for s in sums]
    file = (share[0] * 4 + share[1])[row]
    kinds = kinds.astype(np.int32)
    hexes = np.isin(kinds, (4, 5)) & (changes >= 2)
    cols = [length * 32 + kinds, np.minimum(changes, 5) * 10 + length, np.minimum(distinct.astype(np.int32) // 4, 7) * 10 + length, prefix, gap.astype(np.int32) * 4 + name1 * 2 + (gap & 2 > 0), (name2 * 2 + name1) * 32 + kinds, file, hexes * 10 + length]
    return starts, ends, first, np.stack(cols, 1).astype(np.int32) + OFFSETS[:-1].astype(np.int32)


#: The last three letters of secret-like names.
_ENDS = np.array([int.from_bytes(x[-3:].encode(), "big") for x in ("password", "passwd", "secret", "token", "apikey", "credential", "auth", "bearer", "pwd")])


def _maybe_name(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    three = data[np.maximum(ends - 3, 0)].astype(np.int32) << 16 | data[np.maximum(ends - 2, 0)].astype(np.int32) << 8 | data[ends - 1]
    return np.isin(three | 0x202020, _ENDS)


# --- the field ------------------------------------------------------------------------------------------------------
class Field:
    """Weights: ``emit`` (features x 3 tags B, I, O) and ``move`` (tag before x tag). Rows begin and end as if beside an O."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        gain = move[:, :, None] + move[None, :, :] - (move[:, 2][:, None, None] + move[2][None, None, :])
        self.lead = float(gain[:, :2, :].max())

    def tags(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best path's tags (0 B, 1 I, 2 O) of all rows' tokens."""
        out = np.full(len(features), 2, np.int8)
        if not len(features):
            return out
        score = np.zeros((len(features), 3))
        for j in range(features.shape[1]):
            score += self.emit[features[:, j]]
        open_ = score[:, 2] - score[:, :2].max(1) <= self.lead
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begin = open_.copy()
        begin[1:] &= ~(open_[:-1] & (row[1:] == row[:-1]))
        at = np.flatnonzero(begin)
        if not len(at):
            return out
        run = np.cumsum(begin) - 1
        sizes = np.bincount(run[open_], minlength=len(at))
        order = np.argsort(-sizes, kind="stable")
        at, sizes = at[order], sizes[order]
        back = np.zeros((len(features), 3), np.int8) if len(features) else None
        best = self.move[2][None, :] + score[at]
        for t in range(1, int(sizes[0])):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            paths = best[:live, :, None] + self.move[None]
            back[at[:live] + t] = paths.argmax(1)
            best[:live] = paths.max(1) + score[at[:live] + t]
        tag = (best + self.move[:, 2][None]).argmax(1).astype(np.int8)
        for t in range(int(sizes[0]) - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            out[at[:live] + t] = tag[:live]
            tag[:live] = back[at[:live] + t, tag[:live]]
        return out


def learn(rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Field:
    """Maximum likelihood by Adam; rows: (features, tags) of short runs of tokens."""
    n, size = len(rows), max(len(t) for _, t in rows)
    feats = np.full((n, size, len(WIDTHS)), OFFSETS[-1], np.int32)
    gold = np.full((n, size), 2)
    live = np.zeros((n, size), bool)
    for i, (f, t) in enumerate(rows):
        feats[i, : len(t)], gold[i, : len(t)], live[i, : len(t)] = f, t, True
    weights = [np.zeros((OFFSETS[-1] + 1, 3)), np.zeros((3, 3))]
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    ids = np.arange(n)

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for step in range(1, epochs + 1):
        emit, move = weights
        score = np.where(live[:, :, None], emit[feats].sum(2), np.array([-1e4, -1e4, 0.0]))
        ahead, behind = np.zeros((n, size, 3)), np.zeros((n, size, 3))
        ahead[:, 0] = move[2] + score[:, 0]
        for t in range(1, size):
            ahead[:, t] = logsum(ahead[:, t - 1, :, None] + move, 1) + score[:, t]
        behind[:, -1] = move[:, 2]
        for t in range(size - 2, -1, -1):
            behind[:, t] = logsum(move + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        total = logsum(ahead[:, -1] + behind[:, -1], 1)
        one = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
        hot = np.eye(3)[gold] * live[:, :, None]
        d_emit = np.zeros_like(emit)
        np.add.at(d_emit, feats.reshape(-1, len(WIDTHS)), (one - hot).reshape(-1, 1, 3))
        d_move = np.zeros((3, 3))
        for t in range(1, size):
            two = np.exp(ahead[:, t - 1, :, None] + move + (score[:, t] + behind[:, t])[:, None, :] - total[:, None, None]) * live[:, t, None, None]
            d_move += two.sum(0)
            np.add.at(d_move, (gold[:, t - 1], gold[:, t]), -1.0 * live[:, t])
        for w, m, g in zip(weights, moment, (d_emit / n + 1e-3 * emit, d_move / n + 1e-3 * move), strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            w -= 0.15 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Field(weights[0][:-1].copy(), weights[1])


def _runs(texts: list[str], spans: list[list[tuple[int, int]]], around: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labelled runs: the tokens around each secret, and one run without any for each text."""
    out = []
    for text, marked in zip(texts, spans, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _, feats = tokens(data, np.array([0, len(data)]))
        if not len(starts):
            continue
        tag = np.full(len(starts), 2)
        heads, at = [], byte_offsets(data)
        for a, b in marked:
            i, j = np.searchsorted(ends, at[a], side="right"), np.searchsorted(starts, at[b])  # the tokens that the span touches
            if i < j:
                tag[i:j] = 1
                tag[i] = 0
                heads.append(int(i))
        marks = [max(0, h - around) for h in heads] + [(len(text) * 7919) % max(1, len(starts) - 2 * around)]
        digits = np.flatnonzero((feats[:, 1] % 10 >= 4) & (tag == 2))[:2]
        for a in [*marks, *(max(0, int(d) - around) for d in digits)]:
            out.append((feats[a : a + 2 * around].copy(), tag[a : a + 2 * around].copy()))
    return out


def byte_offsets(data: np.ndarray) -> np.ndarray:
    """Where each code point of UTF-8 bytes begins, and their end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def formats(n: int = 300, seed: int = 5) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Lines with secrets in public formats, and lines with numbers, addresses and ids that are none."""
    rng = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: draw(low, rng.randint(2, 9))
    texts, spans = [], []
    for i in range(n):
        before, after = " ".join(word() for _ in range(rng.randint(0, 9))), " ".join(word() for _ in range(rng.randint(0, 9)))
        name = rng.choice(["password", "secret", "token", "api_key", "auth", "access_key", "client_secret", "pwd"])
        value = [lambda: draw("0123456789abcdef", rng.choice([18, 32, 40])), lambda: draw(low + up + dig, rng.randint(14, 44)), lambda: "AKIA" + draw(up + dig, 16), lambda: "ghp_" + draw(low + up + dig, 36), lambda: "sk-" + draw(low + up + dig, 40), lambda: "xoxb-" + draw(dig, 12) + "-" + draw(low + up + dig, 24)][i % 6]()
        other = [lambda: draw(dig, 16), lambda: f"{draw(dig, 3)}-{draw(dig, 3)}-{draw(dig, 4)}", lambda: f"{word()}.{draw(dig, 2)}@{word()}{draw(dig, 1)}.example.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: "-".join(word() for _ in range(4)), lambda: f"{rng.randint(1990, 2030)}-{draw(dig, 2)}-{draw(dig, 2)}", lambda: word().upper() * 2, lambda: f"https://{word()}.example.org/{word()}/{draw(dig, 5)}"][i % 8]()
        if i % 2:
            lead = f"{before} {name}{rng.choice([' = ', '=', ': ', '=' + chr(34)])}" if i % 3 else before + " "
            texts.append(f"{lead}{value} {after}")
            spans.append([(len(lead), len(lead) + len(value))])
        else:
            texts.append(f"{before} {rng.choice(['', 'id: ', 'tel '])}{other} {after}")
            spans.append([])
    return texts, spans


def train(docs: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_RUNS) -> Field:
    """The field learned from a bounded sample of ``docs``: ``rows`` whole texts, and of the runs of tokens in them ``most`` at most, spread evenly over all."""
    some = docs.select("doc_id", "text").where("text IS NOT NULL")
    named = F.col("text").rlike("(?i)passw|secret|token|api_?key|AKIA[A-Z0-9]{14}")
    halves = [sampled(some, "doc_id", rows // 2, spare).where(kind).orderBy("_h", "text").limit(rows // 2) for kind, spare in ((named, 100), (F.lit(True), 2))]
    sample = halves[0].unionByName(halves[1]).collect()  # ``rows`` texts at most
    texts = sorted({r.text for r in sample})
    spans = []
    for t in texts:
        found = []
        for a, b, k in base_spans(t):
            if k == 0:
                m = ASSIGN.match(t, a)
                found.append(m.span(2))
            elif k == 1 or not t[a:b].isdigit():
                found.append((a, b))
        spans.append(found)
    more, marked = formats()
    found = _runs(texts, spans)
    found = [found[i] for i in np.unique(np.linspace(0, len(found) - 1, min(most, len(found))).astype(int))] if found else found
    return learn(found + _runs(more, marked))


# --- the scan -------------------------------------------------------------------------------------------------------
def scan_texts(texts: pa.Array, field: Field) -> list[list[tuple[int, int, int]]]:
    """All spans (start, end, kind) of each text, sorted, in code points."""
    data, offsets = flat(texts)
    starts, ends, first, feats = tokens(data, offsets)
    tag = field.tags(feats, first)
    row_of = np.repeat(np.arange(len(texts)), np.diff(first))
    added: dict[int, list[tuple[int, int]]] = {}
    for i in np.flatnonzero(tag < 2).tolist():
        r, mine = int(row_of[i]), added.setdefault(int(row_of[i]), [])
        a, b = int(starts[i] - offsets[r]), int(ends[i] - offsets[r])
        if tag[i] == 1 and mine and i and tag[i - 1] < 2 and row_of[i - 1] == r:
            mine[-1] = (mine[-1][0], b)
        else:
            mine.append((a, b))
    out = []
    for r in range(len(texts)):
        raw = data[offsets[r] : offsets[r + 1]].tobytes()
        text = texts[r].as_py() or ""
        spans = base_spans(text, raw)
        if r in added:
            base = _union(spans)
            ends_ = [y for _, y in base]
            at = byte_offsets(data[offsets[r] : offsets[r + 1]])  # one table and two sorted lists: linear in the text and its spans
            for a, b in zip(*(np.searchsorted(at, [x[i] for x in added[r]]).tolist() for i in (0, 1)), strict=True):
                if _beyond(text, a, b, base, bisect_right(ends_, a)):
                    spans.append((a, b, 3))
        out.append(sorted(spans, key=lambda s: (s[0], s[2], s[1])))
    return out


_PART = re.compile(r"[A-Za-z0-9]|[^\x00-\x7f]")


def _union(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _beyond(text: str, a: int, b: int, base: list[tuple[int, int]], first: int = 0) -> bool:
    """Whether letters or digits of text[a:b] lie outside of the base spans, which are sorted and disjoint; those before ``first`` end before it."""
    for i in range(first, len(base)):
        x, y = base[i]
        if x >= b:
            break
        if x > a and _PART.search(text, a, x):
            return True
        a = max(a, y)
    return a < b and bool(_PART.search(text, a, b))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: Field | None = None, mask: str | None = None) -> DataFrame:
    """Every input column and the array ``_found`` of (kind, start, end); with ``mask`` also ``_masked``, the text with each secret (overlapping ones once) replaced by it, null where that is null."""
    docs = docs.drop("_found", "_masked")
    field = field or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                spans = scan_texts(part.column("text"), field)
                found = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in x] for x in spans]
                more = [] if mask is None else [pa.array([masked(t.as_py(), x, mask) for t, x in zip(part.column("text"), spans, strict=True)], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind), *more], names=[*part.schema.names, "_found", *["_masked"] * len(more)])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    more = [] if mask is None else [T.StructField("_masked", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_found", T.ArrayType(span)), *more]))


def secret_part(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """The secret itself of a span: of an assignment, its value."""
    if KINDS[kind] == "assign":
        m = ASSIGN.match(text, a)
        return m.span(2) if m else (a, b)
    return a, b


def masked(text: str | None, spans: list[tuple[int, int, int]], mask: str) -> str | None:
    """The text with each secret replaced by ``mask``, overlapping ones once."""
    if text is None or not spans:
        return text
    parts, upto = [], 0
    for a, b in sorted(secret_part(text, k, a, b) for a, b, k in spans):
        if b <= upto:
            continue
        if a >= upto:
            parts += [text[upto:a], mask]
        upto = b
    return "".join(parts) + text[upto:]


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text")).drop("text")
    base = F.filter("_found", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("_found", lambda s: s["kind"] == kind)).cast("long")
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(show(base), 256).alias("base_sha256"), show(F.col("_found")).alias("spans"))


QUERIES = {"op2_secret_crf": lambda spark, sf_dir: digest(table(spark, sf_dir, "documents"))}
ORACLE: dict[str, str] = {}
