"""Exact removal of repeated windows: 50 words (super-k-mers) or 100 bytes (suffixes), over a corpus of any size.

Both operators rest on minimisers. Of all short grams in a window the one with the least hash is its minimiser; equal
windows have equal minimisers at equal places. Consecutive windows with the minimiser at the same place form a run, which
is one packed string. Steps:

1. Every document's runs give the keys of their minimisers; keys that occur in one place only cannot belong to a repeated
   window. The others go into a bitmap of fixed size (where it fills up, more runs travel; none is lost).
2. Runs whose key is in the bitmap travel as packed strings, dealt by ranges of their leading token (op 4: the
   minimiser's hash, as its bucket; op 9: the bytes at the minimiser, with Spark's sampled splitters). Ranges are taken over
   (token, document, start), so a token that a third of all documents share is split over as many tasks as it needs.
3. A task sorts its strings by multikey quicksort, eight bytes (ten words) a character. Equal strings are settled at once:
   all but the earliest are repeats. Where a token has different strings, their windows are sorted in the same way.
4. The first and last token of a task may go on in its neighbours. Windows of those that are first within their task are
   compared across the border by a 128-bit digest of their bytes.
5. Ranges to remove meet their documents by a join on the document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U64, as_longs, bitmap, column, gram_hashes, in_bitmap, joined_bytes, keyed, longs, mixed, one_each, partitions_for, powers, sha256_hex, sliced, span_hashes, word_spans, written

#: Bytes of packed strings that a task sorts at once, unless one token has more.
CHUNK_BYTES = 1 << 20
#: Windows that are sorted at once.
SORTED = 300_000
#: Characters (eight bytes) of a packed string that are sorted one by one; what is left of a longer one is two, its 128-bit digest.
DEEP = 128
_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class Windows:
    """width: symbols in a window; gram: symbols in a minimiser; words: symbols are words, else bytes.

    in_document: whether an earlier place in the same document counts as an earlier occurrence.
    """

    width: int
    gram: int
    words: bool
    in_document: bool


#: Operator 4 and operator 9.
WORDS_50 = Windows(width=50, gram=6, words=True, in_document=False)
BYTES_100 = Windows(width=100, gram=32, words=False, in_document=True)


def argmin_of_runs(a: np.ndarray, span: int) -> np.ndarray:
    """For each `span` consecutive entries, the place of their least (the leftmost of equals).

    The place stands in the low bits of each value, so one minimum gives both; values are told apart by their high bits.
    """
    bits = U64(max(22, len(a).bit_length()))
    low = (U64(1) << bits) - U64(1)
    val, have = (a & ~low) | np.arange(len(a), dtype=U64), 1
    while have < span and len(val):
        shift = min(have, span - have)
        val = np.minimum(val[shift:], val[:-shift])
        have += shift
    return (val & low).astype(np.int64)


@dataclass
class Runs:
    """Runs of a slice of documents: document (place in the slice), first window within the document, windows, minimiser's key and place, and bytes [lo, hi)."""

    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    key: np.ndarray
    anchor: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    data: np.ndarray


def runs_of(texts: list[bytes], w: Windows) -> Runs:
    data, starts, ends = joined_bytes(texts)
    if w.words:
        ws, we = word_spans(data)
        grams = gram_hashes(span_hashes(data, ws, we), w.gram)
        first = np.searchsorted(ws, starts)  # first word of each document
        last = np.append(first[1:], len(ws))
        doc = np.repeat(np.arange(len(texts)), last - first)
        n_windows = max(0, len(ws) - w.width + 1)
        valid = doc[:n_windows] == doc[w.width - 1 :] if n_windows else np.zeros(0, dtype=bool)
    else:
        n = len(data)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, n), out=sums[1:])
        m = w.gram
        grams = mixed((sums[m:] - sums[:-m]) * powers(pow(_BASE, -1, 1 << 64), n + 1)[: max(0, n - m + 1)]) if n >= m else np.zeros(0, dtype=U64)
        first = starts
        n_windows = max(0, n - w.width + 1)
        valid = np.zeros(n_windows + 1, dtype=np.int8)
        long = ends - starts >= w.width
        valid[starts[long]] += 1
        valid[ends[long] - w.width + 1] -= 1
        valid = np.cumsum(valid[:n_windows], dtype=np.int8).astype(bool)
    at = np.flatnonzero(valid)
    pos = argmin_of_runs(grams, w.width - w.gram + 1)[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(pos) != 0)
    k = np.flatnonzero(new)
    begin, n, place = at[k], np.diff(np.append(k, len(at))), pos[k]
    if w.words:
        of, lo, hi, anchor = doc[begin], ws[begin], we[begin + n + w.width - 2], place - begin
    else:
        of = np.searchsorted(starts, begin, side="right") - 1
        lo, hi, anchor = begin, begin + n + w.width - 1, place - begin
    return Runs(of, begin - first[of], n, grams[place] >> U64(16), anchor, lo, hi, data)


_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, w: Windows, most: int = SLICE_BYTES) -> Iterator[tuple[bytes, int]]:
    """A text in pieces of about `most` bytes, with the symbol at which each begins; every window is in just one piece.

    Neighbours share width - 1 symbols. A piece of words ends between words, and has a window at least.
    """
    if len(text) <= most + w.width:
        yield text, 0
    elif not w.words:
        for at in range(0, len(text) - w.width + 1, most):
            yield text[at : at + most + w.width - 1], at
    else:
        at, first, size = 0, 0, most
        while True:
            cut = _WHITE.search(text, at + size) if at + size < len(text) else None
            piece = text[at : cut.start()] if cut else text[at:]
            if not cut:
                yield piece, first
                return
            starts = word_spans(np.frombuffer(piece + b" ", dtype=np.uint8))[0]
            if len(starts) < w.width:
                size *= 2
                continue
            yield piece, first
            at, first, size = at + int(starts[len(starts) - w.width + 1]), first + len(starts) - w.width + 1, most


def _runs(b: pa.RecordBatch, w: Windows) -> Iterator[Runs]:
    """Runs of a batch: documents by their place in it, starts counted from a document's beginning; long texts in pieces."""
    lot: list[tuple[bytes, int, int]] = []
    size = 0

    def done() -> Runs:
        r = runs_of([x for x, _, _ in lot], w)
        first, row = np.array([f for _, f, _ in lot], dtype=np.int64), np.array([k for _, _, k in lot], dtype=np.int64)
        r.start, r.doc = r.start + first[r.doc], row[r.doc]
        lot.clear()
        return r

    for k, text in enumerate(_bytes(b)):
        for piece, first in pieces(text, w):
            lot.append((piece, first, k))
            size += len(piece)
            if size >= SLICE_BYTES:
                yield done()
                size = 0
    if lot:
        yield done()


def _bytes(b: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return column(b, name).cast(pa.binary()).to_pylist()


def _keys(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    for b, r in ((b, r) for b in sliced(batches) for r in _runs(b, w)):
        rows = {"key": as_longs(r.key)}
        if not w.in_document:
            rows["ord"] = longs(b, "ord")[r.doc]
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in rows.items()})


def _packed(batches: Iterator[pa.RecordBatch], w: Windows, repeated: Broadcast) -> Iterator[pa.RecordBatch]:
    for b, r in ((b, r) for b in sliced(batches) for r in _runs(b, w)):
        keep = np.flatnonzero(in_bitmap(repeated.value, r.key))
        if not len(keep):
            continue
        doc, raw = r.doc[keep], r.data.tobytes()
        segs = [raw[x:y] for x, y in zip(r.lo[keep].tolist(), r.hi[keep].tolist(), strict=True)]
        if w.words:
            segs = [b" ".join(x.split()) for x in segs]
            lead = [int(x).to_bytes(8, "big") for x in r.key[keep]]
        else:
            lead = [x[a : a + 16] for x, a in zip(segs, r.anchor[keep].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "lead": pa.array(lead, pa.binary()),
                "ord": pa.array(longs(b, "ord")[doc]),
                "th": pa.array(longs(b, "th")[doc]),
                "start": pa.array(r.start[keep]),
                "n": pa.array(r.n[keep].astype(np.int32)),
                "anchor": pa.array(r.anchor[keep].astype(np.int32)),
                "packed": pa.array(segs, pa.binary()),
            }
        )


def multikey_labels(segment: np.ndarray, n_chars: np.ndarray, char) -> np.ndarray:
    """Labels of strings, equal for equal strings of a segment, by multikey quicksort.

    char(i, d) gives the d-th character (an integer) of the strings i. Strings are split by one character at a time
    within their segment; a string that stands alone goes out at once. Strings of one segment have equally many characters.
    """
    label = np.arange(len(segment))
    act, seg, d = label.copy(), segment, 0
    while len(act):
        done = n_chars[act] <= d
        if done.any():
            at, of = act[done], seg[done]
            o = np.lexsort((at, of))
            at, of = at[o], of[o]
            head = np.ones(len(at), dtype=bool)
            head[1:] = of[1:] != of[:-1]
            label[at] = at[np.flatnonzero(head)[np.cumsum(head) - 1]]
            act, seg = act[~done], seg[~done]
            if not len(act):
                break
        ch = char(act, d)
        o = np.lexsort((ch, seg))
        act, seg, ch = act[o], seg[o], ch[o]
        new = np.ones(len(act), dtype=bool)
        new[1:] = (seg[1:] != seg[:-1]) | (ch[1:] != ch[:-1])
        seg = np.cumsum(new) - 1
        alone = np.bincount(seg)[seg] > 1
        act, seg = act[alone], seg[alone]
        d += 1
    return label


def _numbered(values: list) -> np.ndarray:
    """Equal neighbours get equal numbers."""
    out = np.zeros(len(values), dtype=np.int64)
    for k in range(1, len(values)):
        out[k] = out[k - 1] + (values[k] != values[k - 1])
    return out


class _Out:
    def __init__(self):
        self.rows: list[tuple[np.ndarray, ...]] = []

    def ranges(self, ord_: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        self.rows.append((ord_, th, a, b, np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)))

    def border(self, ord_: np.ndarray, th: np.ndarray, a: np.ndarray, digests: list[bytes]) -> None:
        d = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        self.rows.append((ord_, th, a, np.full(len(a), -1, dtype=np.int64), d[:, 0], d[:, 1]))

    def batch(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        cols = [np.concatenate(x) for x in zip(*self.rows, strict=True)]
        return pa.RecordBatch.from_pydict(dict(zip(("ord", "th", "a", "b", "d1", "d2"), map(pa.array, cols), strict=True)))


def settle(rows: dict, w: Windows, border: list[bytes]) -> pa.RecordBatch | None:
    """Sorts packed strings (all of each leading token) and gives ranges to remove, and border windows to compare further."""
    out = _Out()
    ord_, th, start, n, anchor = (np.asarray(rows[k], dtype=np.int64) for k in ("ord", "th", "start", "n", "anchor"))
    packed, lead = rows["packed"], _numbered(rows["lead"])
    is_border = np.zeros(lead[-1] + 1, dtype=bool)
    for x in border:
        is_border[[lead[k] for k in (0, len(lead) - 1) if rows["lead"][k] == x]] = True
    sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed))
    at = np.concatenate(([0], np.cumsum(sizes + 8)))[:-1]
    buffer = b"\0\0\0\0\0\0\0\0".join(packed) + bytes(16)
    eight = np.ndarray(shape=(len(buffer) - 7,), dtype=">u8", buffer=buffer, strides=(1,))

    # whole strings
    o = np.lexsort((sizes, lead))
    segment = np.empty(len(lead), dtype=np.int64)
    segment[o] = np.concatenate(([0], np.cumsum((np.diff(lead[o]) != 0) | (np.diff(sizes[o]) != 0))))
    tails: dict[int, np.ndarray] = {}

    def tail(k: int) -> np.ndarray:
        if k not in tails:
            tails[k] = np.frombuffer(hashlib.blake2b(packed[k][8 * DEEP :], digest_size=16).digest(), dtype=U64)
        return tails[k]

    def char(i: np.ndarray, d: int) -> np.ndarray:
        return eight[at[i] + 8 * d].astype(U64) if d < DEEP else np.array([tail(k)[d - DEEP] for k in i.tolist()], dtype=U64)

    label = multikey_labels(segment, np.where(sizes > 8 * DEEP, DEEP + 2, (sizes + 7) // 8), char)
    o = np.lexsort((th, start, ord_, label))
    head = np.ones(len(o), dtype=bool)
    head[1:] = np.diff(label[o]) != 0
    rep_of = np.empty(len(o), dtype=np.int64)
    rep_of[o] = o[np.flatnonzero(head)[np.cumsum(head) - 1]]
    later = ord_ > ord_[rep_of]
    if w.in_document:
        later |= (ord_ == ord_[rep_of]) & (start > start[rep_of])
    out.ranges(ord_[later], th[later], start[later], (start + n + w.width - 1)[later])

    # windows of the earliest of different strings with one token; strings in the same first place follow them
    reps = np.flatnonzero(rep_of == np.arange(len(o)))
    strings = np.bincount(lead[reps], minlength=len(is_border))
    reps = reps[(strings[lead[reps]] > 1) | is_border[lead[reps]]]
    if not len(reps):
        return out.batch()
    if w.words:
        data, _, _ = joined_bytes([packed[k] for k in reps.tolist()])
        ws, we = word_spans(data)
        tens = gram_hashes(span_hashes(data, ws, we), 10)
        first_word = np.cumsum(n[reps] + w.width - 1) - (n[reps] + w.width - 1)
        raw = data.tobytes()
    else:
        raw = buffer
    mates = np.flatnonzero(~later & (rep_of != np.arange(len(later))))
    shares = {int(r): [int(r)] for r in reps}
    for m in mates.tolist():
        if (r := int(rep_of[m])) in shares:
            shares[r].append(m)

    def settle_windows(of: np.ndarray, j: np.ndarray) -> None:
        """The j-th windows of the strings reps[of]; of each token and place all or none."""
        row = reps[of]
        if w.words:
            word = first_word[of] + j
            steps = [*range(0, w.width - 10, 10), w.width - 10]
            char = lambda i, d: tens[word[i] + steps[d]]
            lo, hi = ws[word], we[word + w.width - 1]
        else:
            lo = at[row] + j
            steps = [*range(0, w.width - 8, 8), w.width - 8]
            char = lambda i, d: eight[lo[i] + steps[d]].astype(U64)
            hi = lo + w.width
        place = anchor[row] - j
        o = np.lexsort((place, lead[row]))
        segment = np.empty(len(row), dtype=np.int64)
        segment[o] = np.concatenate(([0], np.cumsum((np.diff(lead[row][o]) != 0) | (np.diff(place[o]) != 0))))
        label = multikey_labels(segment, np.full(len(row), len(steps)), char)
        where = start[row] + j
        o = np.lexsort((where, ord_[row], label))
        head = np.ones(len(o), dtype=bool)
        head[1:] = np.diff(label[o]) != 0
        first = np.empty(len(o), dtype=np.int64)
        first[o] = o[np.flatnonzero(head)[np.cumsum(head) - 1]]
        repeat = ord_[row] > ord_[row][first]
        if w.in_document:
            repeat |= (ord_[row] == ord_[row][first]) & (where > where[first])
        hit = np.flatnonzero(repeat)
        if len(hit):
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (np.diff(j[hit]) != 1) | (np.diff(of[hit]) != 0)
            k = np.flatnonzero(new)
            a, b, r = j[hit[k]], j[hit[np.append(k[1:], len(hit)) - 1]] + w.width, row[hit[k]]
            out.ranges(ord_[r], th[r], start[r] + a, start[r] + b)
            for x, y, z in ((x, y, m) for x, y, q in zip(a.tolist(), b.tolist(), r.tolist(), strict=True) for m in shares[q][1:]):
                out.ranges(ord_[[z]], th[[z]], start[[z]] + x, start[[z]] + y)
        open_ = np.flatnonzero(~repeat & is_border[lead[row]])
        if len(open_):
            digests = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(lo[open_].tolist(), hi[open_].tolist(), strict=True)]
            out.border(ord_[row[open_]], th[row[open_]], where[open_], digests)
            for k, x in zip(open_.tolist(), digests, strict=True):
                for m in shares[int(row[k])][1:]:
                    out.border(ord_[[m]], th[[m]], start[[m]] + j[k], [x])

    of = np.repeat(np.arange(len(reps), dtype=np.int32), n[reps])
    j = np.arange(len(of), dtype=np.int32) - np.repeat(np.cumsum(n[reps]) - n[reps], n[reps]).astype(np.int32)
    if len(of) <= SORTED:
        settle_windows(of, j.astype(np.int64))
    else:
        place = anchor[reps].astype(np.int32)[of] - j
        sizes = np.bincount(place)
        group = (np.cumsum(sizes) - sizes) // SORTED
        part = group[place]
        for k in np.unique(group):
            some = np.flatnonzero(part == k)
            settle_windows(of[some], j[some].astype(np.int64))
    return out.batch()


_FIELDS = ("lead", "ord", "th", "start", "n", "anchor", "packed")


def _settled(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """Over one partition, sorted by lead: gathers whole tokens up to about CHUNK_BYTES."""
    held: dict[str, list] = {k: [] for k in _FIELDS}
    first: bytes | None = None
    size = 0
    for b in batches:
        for k in _FIELDS:
            held[k] += column(b, k).to_pylist()
        if b.num_rows == 0:
            continue
        first = held["lead"][0] if first is None else first
        size += column(b, "packed").nbytes
        if size < CHUNK_BYTES:
            continue
        last = held["lead"][-1]
        cut = next((k for k in range(len(held["lead"]) - 1, 0, -1) if held["lead"][k - 1] != last), 0)
        if cut:
            got = settle({k: v[:cut] for k, v in held.items()}, w, [first] if held["lead"][0] == first else [])
            held = {k: v[cut:] for k, v in held.items()}
            size = sum(map(len, held["packed"]))
            if got is not None:
                yield got
    if held["lead"]:
        got = settle(held, w, [first, held["lead"][-1]])
        if got is not None:
            yield got


def repeated_ranges(rows: DataFrame, w: Windows) -> DataFrame:
    """ord, th, a, b: places [a, b) (in symbols) to remove from the rows of keyed(). Ranges may overlap and repeat."""
    spark = rows.sparkSession
    keys = rows.mapInArrow(lambda it: _keys(it, w), "key long" + ("" if w.in_document else ", ord long"))
    seen = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1") if w.in_document else keys.groupBy("key").agg(F.min("ord").alias("x"), F.max("ord").alias("y")).where("x <> y")
    repeated = spark.sparkContext.broadcast(bitmap(seen, "key"))
    packed = rows.mapInArrow(lambda it: _packed(it, w, repeated), "lead binary, ord long, th long, start long, n int, anchor int, packed binary")
    buckets = packed.repartitionByRange(partitions_for(rows), "lead", "ord", "start").sortWithinPartitions("lead")
    found = written(buckets.mapInArrow(lambda it: _settled(it, w), "ord long, th long, a long, b long, d1 long, d2 long"), "windows")
    repeated.destroy()  # it lies on the disks of all workers
    border = found.where("b < 0")
    first = border.groupBy("d1", "d2").agg(F.min(F.struct("ord", "a")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = written(first.select("d1", "d2", "m"), "border")
    before = (F.col("m.ord") < F.col("ord")) | ((F.col("m.ord") == F.col("ord")) & (F.col("m.a") < F.col("a")) if w.in_document else F.lit(False))
    across = border.join(first, ["d1", "d2"]).where(before).select("ord", "th", "a", (F.col("a") + w.width).alias("b"))
    return found.where("b >= 0").select("ord", "th", "a", "b").union(across)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(batches: Iterator[pa.RecordBatch], w: Windows, with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        n, gone, spans, sha, kept_text = [], [], [], [], []
        for data, got in zip(_bytes(b), column(b, "spans").to_pylist(), strict=True):
            units = data.split() if w.words else data
            cut, at, parts = merged(got), 0, []
            for x, y in cut:
                parts.append(units[at:x])
                at = y
            parts.append(units[at:])
            kept = b" ".join(u for p in parts for u in p) if w.words else b"".join(parts)
            n.append(len(units))
            gone.append(sum(y - x for x, y in cut))
            spans.append(len(cut))
            sha.append(sha256_hex(kept))
            kept_text.append(kept.decode("utf-8", "replace") if with_text else None)
        rows = {"doc_id": column(b, "doc_id"), "n": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            rows["kept"] = pa.array(kept_text, pa.string())
        yield pa.RecordBatch.from_pydict(rows)


def without_repeats(docs: DataFrame, w: Windows, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n (words or bytes), n_removed, n_spans (removed ranges), kept_sha256, and with with_text kept.

    Null text counts as empty. Rows with a null doc_id come after all others, as one document; rows with equal doc_id are
    told apart by their text, and for words no such row is earlier than the other. Repeated rows give equal results. In
    `kept`, bytes that a removal leaves as broken UTF-8 are replaced; the hash is that of the bytes themselves.
    """
    rows = keyed(docs)
    ranges = repeated_ranges(one_each(rows), w)
    spans = ranges.groupBy("ord", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    both = rows.join(spans.hint("shuffle_hash"), ["ord", "th"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")
    return both.mapInArrow(lambda it: _kept(it, w, with_text), schema)
