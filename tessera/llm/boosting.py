"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (shares of kinds of characters, lengths of words and lines, repetition) come from numpy over Arrow
batches. Trees are grown level by level on binned statistics: each level adds up the gradients of every (node, statistic,
bin), and takes the best cut of each node. All trees have the same depth and lie in three arrays, so that a batch goes through all
of them at once: node k of a tree has the children 2k + 1 and 2k + 2.

Fitting takes a bounded sample of labelled rows (SAMPLE_DOCS), whose statistics alone are gathered; scoring is a narrow map
over all rows and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U64, column, gram_hashes, joined_bytes, sliced, span_hashes, word_spans, written

#: Labelled documents in the fitting sample, at most: those with the least hashes of their ids.
SAMPLE_DOCS = 20_000
#: Bins of a statistic, trees, their depth, the step of each, and the ridge on the leaves' values.
BINS, TREES, DEPTH, STEP, RIDGE = 64, 60, 4, 0.2, 1.0
#: Least labelled rows on either side of a cut.
LEAST_ROWS = 8
#: From which score on a document counts as good.
THRESHOLD = 0.3

# ---- statistics ------------------------------------------------------------------------------------------

LOWER, UPPER, DIGIT, BLANK, LINE_END, MARK, SYMBOL, REST, HIGH = range(9)
KINDS = 9
_KIND = np.full(256, REST, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = LOWER, UPPER, DIGIT, HIGH
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _KIND[0x0A] = BLANK, LINE_END
_KIND[list(b".,;:!?'\"()-")], _KIND[list(b"#*$%&|<>@^~_=+{}[]/\\`")] = MARK, SYMBOL
_END = np.isin(np.arange(256), list(b".!?"))

STATISTICS = (
    "log_bytes", "lower", "upper", "digit", "line_ends", "marks", "symbols", "rest", "high", "repeated_bytes",
    "log_words", "word_bytes", "word_spread", "long_words", "short_words", "capital_words", "marked_words", "bare_words",
    "log_lines", "line_words", "ended_lines", "repeated_lines", "distinct_words", "top_word", "distinct_threes",
)


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(of, 1)


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different h each row has, and how often its most frequent one comes."""
    o = np.lexsort((h, row))
    row, h = row[o], h[o]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, row[at], np.diff(np.append(at, len(row))))
    return np.bincount(row[at], minlength=n), most


class _Sums:
    """Statistics of n texts that come in pieces; what a piece leaves is sums, and eight bytes a word and a line."""

    def __init__(self, n: int):
        self.n = n
        self.kinds, self.same, self.bytes = np.zeros((n, KINDS)), np.zeros(n), np.zeros(n)
        self.words = {k: np.zeros(n) for k in ("n", "bytes", "squares", "long", "short", "capital", "marked", "bare")}
        self.lines = {k: np.zeros(n) for k in ("n", "ended")}
        self.hashes: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"words": [], "threes": [], "lines": []}

    def add(self, pieces: list[bytes], row: np.ndarray) -> None:
        data, starts, ends = joined_bytes(pieces)
        of = np.repeat(np.arange(len(pieces)), ends + 1 - starts)
        kind = _KIND[data]
        inside = np.ones(len(data), dtype=bool)
        inside[ends] = False
        counts = np.bincount(of[inside] * KINDS + kind[inside], minlength=len(pieces) * KINDS)
        np.add.at(self.kinds, row, counts.reshape(-1, KINDS))
        same = np.flatnonzero((data[1:] == data[:-1]) & inside[1:] & inside[:-1])
        np.add.at(self.same, row[of[same]], 1)
        np.add.at(self.bytes, row, ends - starts)
        ws, we = word_spans(data)
        if len(ws):
            size, at = (we - ws).astype(float), row[of[ws]]
            sums = lambda which: np.concatenate(([0], np.cumsum(which)))
            within = lambda s: s[we] - s[ws]
            upper, letters = within(sums(kind == UPPER)), within(sums((kind == UPPER) | (kind == LOWER) | (kind == HIGH)))
            each = {"n": 1, "bytes": size, "squares": size**2, "long": size > 12, "short": size < 3, "capital": (upper > 1) & (2 * upper > size), "marked": within(sums(kind == SYMBOL)) > 0, "bare": letters == 0}
            for k, x in each.items():
                self.words[k] += np.bincount(at, np.broadcast_to(np.asarray(x, dtype=float), at.shape), self.n)
            h = span_hashes(data, ws, we)
            self.hashes["words"].append((at, h))
            threes = np.flatnonzero(of[ws][2:] == of[ws][:-2]) if len(ws) > 2 else np.zeros(0, dtype=np.int64)
            self.hashes["threes"].append((at[threes], gram_hashes(h, 3)[threes]))
        edges = np.flatnonzero((kind == LINE_END) | ~inside)
        first = np.concatenate(([0], edges[:-1] + 1))
        held = np.concatenate(([0], np.cumsum((kind != BLANK) & (kind != LINE_END) & inside)))
        some = held[edges] > held[first]
        first, edges = first[some], edges[some]
        at = row[of[first]]
        self.lines["n"] += np.bincount(at, minlength=self.n)
        self.lines["ended"] += np.bincount(at, _END[data[edges - 1]].astype(float), self.n)
        self.hashes["lines"].append((at, span_hashes(data, first, edges)))

    def matrix(self) -> np.ndarray:
        w, lines, b, k = self.words, self.lines, self.bytes, self.kinds
        gathered = {}
        for name, got in self.hashes.items():
            r, h = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64))
            gathered[name] = (*_distinct(r, h, self.n), np.bincount(r, minlength=self.n))
        mean = _share(w["bytes"], w["n"])
        cols = [np.log1p(b), *[_share(k[:, x], b) for x in (LOWER, UPPER, DIGIT, LINE_END, MARK, SYMBOL, REST, HIGH)], _share(self.same, b)]
        cols += [np.log1p(w["n"]), mean, np.sqrt(np.maximum(_share(w["squares"], w["n"]) - mean**2, 0)), *[_share(w[x], w["n"]) for x in ("long", "short", "capital", "marked", "bare")]]
        cols += [np.log1p(lines["n"]), _share(w["n"], lines["n"]), _share(lines["ended"], lines["n"]), 1 - _share(gathered["lines"][0], np.maximum(lines["n"], 1))]
        cols += [_share(gathered["words"][0], w["n"]), _share(gathered["words"][1], w["n"]), _share(gathered["threes"][0], gathered["threes"][2])]
        return np.stack(cols, axis=1)


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about `most` bytes, cut at white space where there is some in the next `most` bytes."""
    at = 0
    while len(text) - at > 2 * most:
        gap = _GAP.search(text, at + most, at + 2 * most)
        to = gap.end() if gap else at + 2 * most
        yield text[at:to]
        at = to
    yield text[at:]


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text; a text of no bytes has zeros (and no repetition). About a megabyte is worked on at a time.

    Where a text over two megabytes is cut, sums go over its pieces: a line, or a run of three words, that lies across a cut
    counts for each part of it.
    """
    sums, lot, row, size = _Sums(len(texts)), [], [], 0
    for k, text in enumerate(texts):
        for piece in _pieces(text):
            lot.append(piece)
            row.append(k)
            size += len(piece)
            if size >= SLICE_BYTES:
                sums.add(lot, np.array(row))
                lot, row, size = [], [], 0
    if lot:
        sums.add(lot, np.array(row))
    return sums.matrix()


# ---- trees -----------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """base: the score (log-odds) before all trees. For each tree a row of its inner nodes' statistics and cuts, and of its leaves' values."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, for each row of x."""
        trees, inner = self.feature.shape
        if not trees or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        rows, of = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), dtype=np.int64)
        while node[0, 0] < inner:  # all leaves are equally deep
            node = 2 * node + 1 + (x[rows, self.feature[of, node]] > self.cut[of, node])
        return 1 / (1 + np.exp(-(self.base + self.value[of, node - inner].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Trees for rows x with targets y from 0 to 1, by the logistic loss. Where all targets are alike, or none is there, only a base."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    if not len(y) or (y == y[0]).all():
        return Trees(base, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, wide = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(wide)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin b: at most cut b
    place = binned + np.arange(wide) * bins
    real = np.zeros((wide, bins), dtype=bool)
    for j, c in enumerate(cuts):
        real[j, : len(c)] = True
    z = np.full(n, base)
    out = Trees(base, np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, curve = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for d in range(depth):
            at = (node[:, None] * (wide * bins) + place).ravel()
            hist = [np.bincount(at, None if v is None else np.repeat(v, wide), minlength=(1 << d) * wide * bins).reshape(1 << d, wide, bins) for v in (grad, curve, None)]
            left = [h.cumsum(axis=2) for h in hist]
            whole = [h[:, :1, -1:] for h in left]
            (gl, hl, cl), (ga, ha, ca) = left, whole
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain[~(real[None] & (cl >= LEAST_ROWS) & (ca - cl >= LEAST_ROWS))] = -np.inf
            best = gain.reshape(1 << d, -1).argmax(axis=1)
            split = gain.reshape(1 << d, -1)[np.arange(1 << d), best] > 1e-9
            feature, bin_ = best // bins, best % bins
            first = (1 << d) - 1
            for k in np.flatnonzero(split).tolist():
                out.feature[t, first + k], out.cut[t, first + k] = feature[k], cuts[feature[k]][bin_[k]]
            node = 2 * node + (split[node] & (binned[np.arange(n), feature[node]] > bin_[node]))
        g, h = np.bincount(node, grad, leaves), np.bincount(node, curve, leaves)
        out.value[t] = -STEP * g / (h + RIDGE)
        z = z + out.value[t][node]
    return out


# ---- over Spark ------------------------------------------------------------------------------------------


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        x = statistics([t or b"" for t in column(b, "text").cast(pa.binary()).to_pylist()])
        yield pa.RecordBatch.from_pydict({"doc_id": column(b, "doc_id"), "y": column(b, "y"), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, label: str, sample_docs: int = SAMPLE_DOCS) -> Trees:
    """Trees that tell documents whose `label` (0 or 1; others are passed over) is 1, from their texts alone.

    A document with several labels counts by their mean; of rows with one doc_id the one with the least statistics counts. Takes the
    sample_docs labelled ids with the least hashes: a bound on what is gathered and broadcast, whatever the input.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("double").alias("y"))
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y"))
    some = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs), "quality-labels")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(some), "doc_id")
    rows = texts.select("doc_id", "y", "text").mapInArrow(_measured, "doc_id long, y double, x array<double>")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("m")).orderBy("doc_id").select("m.x", "m.y").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return grow(x, got.column("y").to_numpy())


def classify(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1), predicted (1 from the threshold on), by the whole text and nothing else.

    Null text counts as empty, and an empty text has a score like any other. A null doc_id stays null; equal texts get equal
    scores; further columns are left out; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            score = shared.value.scores(statistics([t or b"" for t in column(b, "text").cast(pa.binary()).to_pylist()]))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(column(b, "doc_id")), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of doc_id as text; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def classify_held_out(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learns from the labels of the ids that are not held out, and scores all: doc_id, held_out, score, predicted."""
    trees = fit(docs, labels.where(~held_out(labels["doc_id"])), label, sample_docs)
    out = classify(docs, trees)
    return out.select("doc_id", held_out(out["doc_id"]).alias("held_out"), "score", "predicted")
