"""BPE encoding and decoding by walking a trie of the distinct words.

A greedy merge encoding has two properties that the walk rests on: every prefix of an encoding is the encoding of the
string it spells, and a list of tokens is an encoding when each two neighbours are (each token being the encoding of its own string, which a
vocabulary built by merges ensures). So the encoding of any prefix is
told by its last token alone, which is the one token ending there that may follow the last token of what stands before
it. New words go into a trie (as its words in order, each with what it shares with the one before); a depth-first walk hands
each node's last-token state down, so a prefix that many words share is encoded once.

The vocabulary is a file in the format of the `tokenizers` library with a word-end suffix, lower-casing and NFC, as
`word_bpe_49k.json`. Special strings in a text become their own ids, as there.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import column, sha256_hex, sliced

# fixed values: letters and numbers, and capitals with their small letters (first, last, distance), of the latest Unicode
# versions, on which the tokenizers library, the regex module and Python disagree; the library doesn't take them for letters
# or numbers, but does lower the capitals
NO_LETTERS = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
NO_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))

#: Bytes of distinct words that a worker remembers; beyond it the memory is emptied and filled anew.
BYTES_KEPT = 3 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _but(kind: str, but: str) -> str:
    """A set in the regex module's syntax: a property without ranges of code points."""
    return rf"[\p{{{kind}}}--[{''.join('-'.join(chr(int(x, 16)) for x in r.split('-')) for r in but.split())}]]"


class TrieEncoder:
    """Encodes words (pieces after the split) and whole texts; `ids` of a text are those of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.parts = {a + b: (a, b) for a, b in reversed(self.rank)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.longest = max(map(self._length, self.vocab))
        self.symbols = byte_symbols()
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split).findall
        exact = split.replace(r"\p{L}", _but("L", NO_LETTERS)).replace(r"\p{N}", _but("N", NO_NUMBERS))
        self.exact_pieces = regex.compile(exact, regex.V1).findall
        self.small = {k: k + d for a, b, d in CAPITALS for k in range(a, b + 1)}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.leads = {t[0] for t in self.special if t}
        self.white = regex.compile(r"\s+")
        self.ends = [x + self.suffix for x in self.symbols]
        self.numbers = {t: str(i) for t, i in self.vocab.items()}
        self.known: dict[str, tuple[str, str, int]] = {}
        self.known_bytes = 0
        self._may_follow: dict[tuple[str, str], bool] = {}

    def _length(self, token: str) -> int:
        """Symbols in a token: the last one carries the suffix."""
        return len(token) - len(self.suffix) if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else len(token)

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the encoding of left + right is just these two tokens."""
        key = (left, right)
        if (got := self._may_follow.get(key)) is None:
            if len(self._may_follow) > 1_000_000:
                self._may_follow.clear()
            got = self._may_follow[key] = self._holds(left, right)
        return got

    def _holds(self, left: str, right: str) -> bool:
        """Undoes merges on both sides of the border, the latest first: no merge across it may come before one undone.

        Of equal ranks the leftmost merge comes first: one across the border before one on its right, after one on its left.
        """
        none = limit = len(self.rank)
        while self.rank.get((left, right), none) >= limit:
            own_left = self.rank[self.parts[left]] if left in self.parts else -1
            own_right = self.rank[self.parts[right]] if right in self.parts else -1
            if own_left < 0 and own_right < 0:
                return True
            if own_left > own_right:
                limit, left = own_left, self.parts[left][1]
            else:
                limit, right = own_right + 1, self.parts[right][0]
        return False

    def learn(self, words: list[str]) -> None:
        """Walks the trie of words once, depth first, remembering what each encodes to.

        The trie is held as its words in order, each with the length of the prefix that it shares with the word before: that
        is where the walk goes back to. A word's last byte is a symbol of its own, as it carries the suffix.
        """
        path: list[str] = []  # symbols from the root
        last: list[str] = [""]  # last token of the encoding of each prefix
        sizes: list[int] = [0]  # symbols in it
        vocab, most, plain, ends = self.vocab, self.longest, self.symbols, self.ends
        before = b""
        for data, w in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, limit = 0, min(len(before), len(data)) - 1
            while shared < limit and before[shared] == data[shared]:
                shared += 1
            before = data
            del path[shared:], last[shared + 1 :], sizes[shared + 1 :]
            path += [plain[x] for x in data[shared:-1]]
            path.append(ends[data[-1]])
            for depth in range(shared + 1, len(path) + 1):
                token = ""
                for size in range(1, min(most, depth) + 1):
                    token = path[depth - size] + token
                    if token in vocab and (size == depth or self.may_follow(last[depth - size], token)):
                        last.append(token)
                        sizes.append(size)
                        break
                else:
                    raise ValueError(f"no token ends at {path[depth - 1]!r}")
            tokens, at = [], len(path)
            while at:
                tokens.append(last[at])
                at -= sizes[at]
            tokens.reverse()
            self.known[w] = (" ".join([self.numbers[t] for t in tokens]), " ".join(tokens), len(tokens))
            self.known_bytes += len(data)

    def split(self, text: str) -> list[str]:
        """Pieces of a text between special strings, after NFC, white space and lower case, character by character."""
        if text.isascii():
            return self.pieces(text.lower())
        text = self.white.sub(" ", unicodedata.normalize("NFC", text))
        recent = max(text) >= "\u0558"
        if recent:
            text = text.translate(self.small)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self.exact_pieces(text) if recent else self.pieces(text)

    def parts_of(self, text: str) -> list[tuple[bool, object]]:
        """(True, special string) and (False, pieces), in order."""
        if not any(c in text for c in self.leads):
            return [(False, self.split(text))]
        return [(True, x) if k % 2 else (False, self.split(x)) for k, x in enumerate(self.at_special.split(text)) if x]

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """For each text: its ids as decimals joined by spaces, its decoding, and how many ids."""
        if self.known_bytes > BYTES_KEPT:
            self.known.clear()
            self.known_bytes = 0
        cut = [self.parts_of(t) for t in texts]
        fresh = {w for parts in cut for is_special, x in parts if not is_special for w in x}.difference(self.known)
        if fresh:
            self.learn(list(fresh))
        out, known = [], self.known
        for parts in cut:
            got: list[tuple[str, str, int]] = []
            for is_special, x in parts:
                got += [(str(self.special[x]), x, 1)] if is_special else [known[w] for w in x]
            out.append((" ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got])))
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by spaces, special ones included, as a decoder that isn't set does; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, keep_text: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for b in sliced(batches):
        got = enc.encode_batch([t or "" for t in column(b, "text").to_pylist()])
        rows = {
            "doc_id": column(b, "doc_id"),
            "n_tokens": pa.array([g[2] for g in got], pa.int64()),
            "ids_sha256": pa.array([sha256_hex(g[0].encode()) for g in got], pa.string()),
            "decoded_sha256": pa.array([sha256_hex(g[1].encode()) for g in got], pa.string()),
        }
        if keep_text:
            rows["ids"] = pa.array([[int(i) for i in g[0].split()] for g in got], pa.list_(pa.int32()))
            rows["decoded"] = pa.array([g[1] for g in got], pa.string())
        yield pa.RecordBatch.from_pydict(rows)


def bpe_encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids also ids and decoded.

    path must be readable on every executor (an installed package's file, say). A narrow map: nothing is shuffled, a
    lost task is simply run again. Null text counts as empty: no ids, and the hashes of the empty string. A null doc_id
    stays null; repeated rows are repeated; further columns of docs are left out. Memory: one slice of texts (1 MB, or
    one longer text), the path to one word, and at most BYTES_KEPT of words with their encodings beside a slice's own.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(lambda it: _encoded(it, path, with_ids), schema)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids: what encoder(path).decode gives. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = [None if x is None else enc.decode(x) for x in column(b, "ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": column(b, "doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"].alias("ids")).mapInArrow(run, "doc_id long, text string")
