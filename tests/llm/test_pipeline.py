"""The pipeline's stages against brute force on a small corpus."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from . import test_lines, test_minhash, test_mixing, test_quality
from .fixtures import corpus, documents


def test_stages(spark, tmp_path):
    seen, rows = set(), []
    for r in corpus(8, 90):
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    rows += test_quality.JUNK
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "lines", "near-duplicates", "mixing", "bpe"]

    kept = steps["quality"](spark, docs, sf)
    assert kept.columns == docs.columns
    good = [r for r in rows if (p := test_quality.plain(r[1]))[0] >= 50 and 2 * p[4] <= p[0] and r not in test_quality.JUNK]
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in good}

    lines = steps["lines"](spark, kept, sf)
    want = [(d, t) for d, n, gone, t in test_lines.brute(good) if not n or gone < n]
    assert sorted((r["doc_id"], r["text"]) for r in lines.collect()) == sorted(want)

    near = steps["near-duplicates"](spark, lines, sf)
    left = [tuple(r) for r in lines.collect()]
    keep = {d for d, _, _, k in test_minhash.brute(left) if k}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(keep)

    mixed = steps["mixing"](spark, near, sf)
    took = {d: t for d, _, _, _, t in test_mixing.brute([tuple(r) for r in near.collect()]) if t}
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert dict(got) == took

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert out == sorted((r["doc_id"], len(library.encode(r["text"], add_special_tokens=False).ids)) for r in mixed.collect())
