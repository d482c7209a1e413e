"""Substring dedup by super-k-mers, and suffix-array dedup: thin faces of windows.py."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .windows import BYTES_100, WORDS_50, Windows, without_repeats


def dedup_substrings(docs: DataFrame, width: int = WORDS_50.width, with_text: bool = False) -> DataFrame:
    """Removes each word covered by a window of `width` words that also starts in a document with a smaller doc_id.

    Gives doc_id, n_words, n_removed, n_spans, kept_sha256 (and kept: the kept words joined by single spaces). See
    windows.without_repeats for nulls, ties and repeated rows. width must be at least 12.
    """
    return without_repeats(docs, Windows(width, min(WORDS_50.gram, width // 2), True, False), with_text).withColumnRenamed("n", "n_words")


def dedup_suffixes(docs: DataFrame, width: int = BYTES_100.width, with_text: bool = False) -> DataFrame:
    """Removes each byte covered by a string of `width` bytes that also starts earlier (smaller doc_id, or earlier in the document).

    Gives doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept). See windows.without_repeats. width must be at least 32.
    """
    return without_repeats(docs, Windows(width, min(BYTES_100.gram, width // 2), False, True), with_text).withColumnRenamed("n", "n_bytes")
