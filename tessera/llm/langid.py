"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over byte n-grams (mean log-odds of n-grams between
the languages with the bit and those without) is fitted; a text's bits are decoded to the codeword with the least loss,
each bit's loss weighted by how often its classifier is right on that language. Where the second-best codeword is close,
the text is flagged as ambiguous.

Fitting takes a bounded sample of labelled rows (SAMPLE_DOCS a language, chosen by a hash of text and doc_id) and gathers one
table of n-grams by bits, whatever the input's size. Everything else runs over all rows, as a narrow map.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, column, joined_bytes, mixed, sliced, written

UNKNOWN = "und"
#: Expected labelled rows of each language in the fitting sample.
SAMPLE_DOCS = 2000
#: Places of the n-gram table (log2), for n-grams of 1, 2 and 3 bytes.
TABLE_LOG2 = 16
ORDERS = (1, 2, 3)
#: A difference of losses, as a share of the best codeword's distance, under which the choice is ambiguous.
CLOSE = 0.1
#: Languages whose n-gram counts are gathered at a time.
BLOCK = 64
_SLICE = 1 << 19
#: Bytes that the log-odds of a slice may take.
_ODDS_BYTES = 1 << 24

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_A_LETTER = regex.compile(r"\p{L}")
_A_GAP = re.compile(r"\s")


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all ways to split up to five languages, else the best spread of many hashed candidates."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        cols = [[1 if k == 0 or not (c >> (k - 1)) & 1 else -1 for k in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(cols).T.astype(float)
    bits = max(15, 10 * math.ceil(math.log2(n)))
    best, spread = None, -1
    for seed in range(50):
        h = mixed(np.arange(n * bits, dtype=U64) * U64(2654435761) + U64(seed * 7919 + 1)).reshape(n, bits)
        m = np.where(h >> U64(63), 1.0, -1.0)
        m[0], m[1] = np.where((m == m[0]).all(axis=0), -m, m)[0], m[1]  # no column may be the same for all
        gap = int(((bits - m @ m.T) / 2 + np.eye(n) * bits).min())
        if gap > spread and (np.abs(m.sum(axis=0)) < n).all():
            best, spread = m, gap
    return best


def lots(texts: list[str], most: int = _SLICE) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Pieces of texts, about `most` characters at a time: the text that each is of, the piece, and how many characters at its end only follow it.

    A piece that isn't its text's last is followed by the next ones that n-grams of its end reach, and ends at white space
    if there is some in the next `most` characters.
    """
    of: list[int] = []
    pieces: list[str] = []
    ahead: list[int] = []
    size, reach = 0, max(ORDERS) - 1
    for k, text in enumerate(texts):
        at = 0
        while True:
            if len(text) - at <= 2 * most:
                to, more = len(text), 0
            else:
                gap = _A_GAP.search(text, at + most, at + 2 * most)
                to = gap.end() if gap else at + 2 * most
                more = min(reach, len(text) - to)
            of.append(k)
            pieces.append(text[at : to + more])
            ahead.append(more)
            size += to - at
            if size >= most:
                yield of, pieces, ahead
                of, pieces, ahead, size = [], [], [], 0
            if to == len(text):
                break
            at = to
    if of:
        yield of, pieces, ahead


def grams(pieces: list[str], ahead: list[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the table place of the n-gram at each byte, and where each piece's own bytes start and end.

    All but letters, and what follows a text, is a space; the space after a text is one of its bytes.
    """
    data, starts, ends = joined_bytes([t.lower().encode("utf-8", "replace") for t in pieces])
    x = _LETTERS[data].astype(np.uint32)
    x = np.concatenate((x, np.full(max(ORDERS), 32, dtype=np.uint32)))
    n, out, h = len(data), [], np.zeros(len(data), dtype=np.uint32)
    for k in ORDERS:
        after = x[k - 1 : k - 1 + n].copy()
        for j in range(k - 1):
            after[ends - j] = 32
        h = h * np.uint32(0x01000193) + after * np.uint32(0x9E3779B1) + np.uint32(k)
        out.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TABLE_LOG2)).astype(np.int32))
    more = np.array([len(t[len(t) - m :].lower().encode("utf-8", "replace")) if m else -1 for t, m in zip(pieces, ahead, strict=True)], dtype=np.int64)
    return out, starts, ends - more


@dataclass
class Model:
    """names: the languages; code: their codewords; table: log-odds of each n-gram for each bit; trust: weights by language and bit."""

    names: list[str]
    code: np.ndarray
    table: np.ndarray
    trust: np.ndarray

    def bits(self, texts: list[str]) -> np.ndarray:
        """Each text's classifiers: mean log-odds times the root of its length, within 8 of zero."""
        total, size = np.zeros((len(texts), self.code.shape[1])), np.zeros((len(texts), 1))
        for of, pieces, ahead in lots(texts, max(1 << 12, min(_SLICE, _ODDS_BYTES // (4 * max(1, self.code.shape[1]))))):
            places, starts, ends = grams(pieces, ahead)
            sums = self.table[places[0]]
            for p in places[1:]:
                sums += self.table[p]
            edges = np.stack((starts, ends), axis=1).ravel()
            if edges[-1] == len(sums):
                edges = edges[:-1]
            np.add.at(total, of, np.add.reduceat(sums, edges, axis=0, dtype=np.float64)[::2])
            np.add.at(size[:, 0], of, ends - starts)
        return np.clip(total / np.sqrt(np.maximum(size, 1)) / 4, -8, 8)

    def losses(self, bits: np.ndarray) -> np.ndarray:
        z = bits[:, None, :] * self.code[None, :, :]
        return (np.log1p(np.exp(-z)) * self.trust[None, :, :]).sum(axis=2)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1, and whether the choice is ambiguous. Without a letter: UNKNOWN, 0, false."""
        lang, score, close = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        some = [k for k, t in enumerate(texts) if t and _A_LETTER.search(t)] if self.names else []
        if not some:
            return lang, score, close
        if len(self.names) == 1:
            loss = np.zeros((len(some), 1))
        else:
            loss = self.losses(self.bits([texts[k] for k in some]))
        best = loss.argmin(axis=1)
        share = np.exp(-(loss - loss.min(axis=1)[:, None]) * max(1, self.code.shape[1]))
        score[some] = np.clip(1 / share.sum(axis=1), 0, 1)
        if len(self.names) > 1:
            two = np.partition(loss, 1, axis=1)[:, :2]
            close[some] = two[:, 1] - two[:, 0] < CLOSE * math.log(2)
        for k, b in zip(some, best.tolist(), strict=True):
            lang[k] = self.names[b]
        return lang, score, close


def fit(train: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from train (text, lang): rows without a lang or a text are passed over. No rows give a model without languages.

    Every value of lang is learned. Where train has a doc_id, copies of a text are sampled each by itself. Every language
    has the row of its least hash. Counts of n-grams are gathered for BLOCK languages at a time; what is kept of them, and goes to the workers, is a
    table of n-grams by bits, which are ten times the logarithm of the number of languages.
    """
    key = F.xxhash64("text", *(["doc_id"] if "doc_id" in train.columns else [])).bitwiseAND(F.lit((1 << 30) - 1))
    some = train.where("lang is not null and text is not null").select("text", "lang", key.alias("key"))
    sizes = some.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    most = F.greatest("least", (F.lit(float(sample_docs)) / F.col("n") * (1 << 30)).cast("long"))
    sizes = written(sizes.select("lang", most.alias("most")), "language-sizes")
    names = sorted(r["lang"] for r in sizes.select("lang").collect())
    code = codewords(len(names))
    size = 1 << TABLE_LOG2
    if len(names) < 2:
        return Model(names, code, np.zeros((size, 0), dtype=np.float32), np.ones((len(names), 0)))
    sample = written(some.join(sizes, "lang").where("key <= most").select("text", "lang"), "languages")
    number = {name: k for k, name in enumerate(names)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of (language, place) pairs, a slice's at a time."""
        for b in sliced(batches, most=_SLICE):
            langs = np.array([number[x] for x in column(b, "lang").to_pylist()])
            for rows, pieces, ahead in lots(column(b, "text").to_pylist()):
                places, starts, ends = grams(pieces, ahead)
                own = np.zeros(len(places[0]) + 1, dtype=np.int64)
                np.add.at(own, starts, 1)
                np.add.at(own, ends, -1)
                own = np.cumsum(own[:-1]) > 0
                of = np.repeat(langs[rows], np.append(starts[1:], len(own)) - starts)
                at, n = np.unique(np.concatenate([(of * size + p)[own] for p in places]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"at": pa.array(at), "n": pa.array(n)})

    counts = written(sample.mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")), "n-grams")
    with_bit, without = np.zeros((size, code.shape[1])), np.zeros((size, code.shape[1]))
    for lo in range(0, len(names), BLOCK):
        got = counts.where((F.col("at") >= lo * size) & (F.col("at") < (lo + BLOCK) * size)).toArrow()
        at, n = got.column("at").to_numpy(), got.column("n").to_numpy().astype(float)
        for k in range(lo, min(lo + BLOCK, len(names))):
            mine = at // size == k
            rates = n[mine] / max(n[mine].sum(), 1)  # each language counts alike
            with_bit[at[mine] - k * size] += rates[:, None] * (code[k] > 0)
            without[at[mine] - k * size] += rates[:, None] * (code[k] < 0)
    floor = 1e-6
    odds = np.log(with_bit / (code > 0).sum(axis=0) + floor) - np.log(without / (code < 0).sum(axis=0) + floor)
    model = Model(names, code, odds.astype(np.float32), np.full(code.shape, 1 / code.shape[1]))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, seen = np.zeros(code.shape), np.zeros(len(names))
        for b in sliced(batches, most=_SLICE):
            of = np.array([number[x] for x in column(b, "lang").to_pylist()], dtype=np.int64)
            np.add.at(hits, of, model.bits(column(b, "text").to_pylist()) * code[of] > 0)
            np.add.at(seen, of, 1)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(hits.size)), "n": pa.array(hits.ravel()), "all": pa.array(np.repeat(seen, code.shape[1]))})

    got = sample.mapInArrow(right, "k long, n double, all double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).collect()
    trust = np.full(code.size, 0.5)
    for r in got:
        trust[r["k"]] = (r["n"] + 1) / (r["all"] + 2)
    trust = trust.reshape(code.shape)
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score, ambiguous; only text is looked at, and all of it.

    Null and letterless texts are `und` with a score of 0, as is every text where nothing was learned. A null doc_id
    stays null; repeated rows get equal results; further columns are left out; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, most=_SLICE):
            lang, score, close = shared.value.predict(column(b, "text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": column(b, "doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "ambiguous": pa.array(close)})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(docs: DataFrame) -> Column:
    """Whether the CRC-32 of doc_id as text leaves 2 when divided by 4; false for a null doc_id."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 4 == 2, F.lit(False))


def identify_held_out(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learns from the rows that are not held out, and predicts all: doc_id, held_out, lang_pred, score, ambiguous."""
    model = fit(docs.where(~held_out(docs)).select(docs["doc_id"], docs["text"], docs["lang"]), sample_docs)
    out = identify(docs, model)
    return out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score", "ambiguous")
