"""Operator 1 against the tokenizers library and by round trip."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.bpe import bpe_decode, bpe_encode, encoder

from .fixtures import SCHEMA, corpus, documents, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, got, w in zip(texts, encoder(PATH).encode_batch(texts), want, strict=True):
        assert got == (" ".join(map(str, w.ids)), library.decode(w.ids, skip_special_tokens=False), len(w.ids)), text


def test_awkward_texts(library):
    same(library, ["", " ", "Hello WORLD's ΣΑΣ İ", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|ENDOFTEXT|>", "é é", "\x1c\x85 　x", "中文 😀😀", "x" * 3000, "''''s't're", "ab1234cd", "<|endoftext", "ﬁ Å"])


def test_long_words(library):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdeé1") for _ in range(40_000))
    same(library, [long, long[:30_000] + "z", f"{long} {long[:20_000]} short", long[:-1]])


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_any_text(library, texts):
    same(library, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_every_code_point(library):
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    same(library, [" ".join(f"a{c}1{c}" for c in points[k : k + 2000]) for k in range(0, len(points), 2000)])


def test_words_of_tokens(library):
    rng, tokens = random.Random(2), [t.replace("</w>", "") for t in encoder(PATH).vocab if t.isascii()]
    same(library, [" ".join("".join(rng.choice(tokens) for _ in range(rng.randint(1, 4))) for _ in range(40)) for _ in range(200)])


def test_query_columns_and_round_trip(spark, library):
    rows = corpus(3)
    got = bpe_encode(with_clashes(documents(spark, rows)), PATH, with_ids=True)
    out = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect() if r["doc_id"] is not None)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        if doc_id is not None:
            want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert out == sorted(want)
    back = {(r["doc_id"], r["text"]) for r in bpe_decode(got, PATH).collect()}
    assert back == {(r["doc_id"], r["decoded"]) for r in got.collect()}


def test_empty(spark):
    assert bpe_encode(spark.createDataFrame([], SCHEMA), PATH).collect() == []
