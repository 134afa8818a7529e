"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is held as two short contiguous arrays: its part ids and the ranks of adjacent pairs.  The smallest rank is found
by scanning, the boundary to its right is deleted, and only the two neighbouring ranks are looked up again.  Words longer
than ``LONG_WORD`` parts use a heap over linked parts, which gives the same merges in n log n.  Distinct words are
encoded once per worker; the memo has a bounded size.

Defined cases: a null text is an empty text (no ids, empty decoding); special tokens in a text become their own id;
repeated rows and null ids are passed through; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
LONG_WORD = 160
MEMO = 400_000
NO_RANK = 1 << 60
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The word pattern of this vocabulary, with white space written out (a fixed value).
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


def newer(c: str) -> bool:
    """Assigned after Unicode 3.2: libraries differ in whether they know such a character as a letter or digit yet."""
    return unicodedata.ucd_3_2_0.category(c) == "Cn"


class RankArrayBPE:
    """Encoder and decoder for one vocabulary file; keeps a bounded memo of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pieces = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), k)
            self.made.append(vocab[a + b])
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self.words = regex.compile(WORDS)
        self.known: set[str] = set()
        self.path, self.library = path, None
        self.memo: dict[str, tuple[int, str, bytes]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the parts of one word in place of rank order, leftmost first among equals."""
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        look, made = self.rank.get, self.made
        ranks = [look(p, NO_RANK) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            ids[i] = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = look((ids[i - 1], ids[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = look((ids[i], ids[i + 1]), NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, look = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := look((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j] = self.made[r], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := look((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x, ok in zip(ids, live) if ok]

    def word(self, word: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids in decimal joined by commas, and the ids' bytes."""
        if word in self.special:
            ids = [self.special[word]]
        else:
            ids = self.merge([self.byte_id[b] for b in word.encode("utf-8", "surrogatepass")])
        out = (len(ids), ",".join(map(str, ids)), b"".join([self.pieces[i] for i in ids]))
        if len(word) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = out
        return out

    def split_plain(self, text: str) -> list[str]:
        if not text.isascii() and (fresh := set(text) - self.known):
            self.known |= (old := {c for c in fresh if not newer(c)})
            if len(old) < len(fresh):
                return self.split_by_library(text)
        return self.words.findall(text)

    def split_by_library(self, text: str) -> list[str]:
        if self.library is None:  # once a worker
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def split_words(self, text: str) -> list[str]:
        if not any(t in text for t in self.special):
            return self.split_plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.split_plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.split_plain(text[at:])

    def document(self, text: str) -> tuple[int, str, str]:
        """Number of ids, all ids in decimal joined by commas, and the decoded text."""
        memo = self.memo
        parts = [memo.get(w) or self.word(w) for w in self.split_words(text)]
        return sum(p[0] for p in parts), ",".join([p[1] for p in parts]), b"".join([p[2] for p in parts]).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        ids = self.document(text)[1]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")


_CODERS: dict[str, RankArrayBPE] = {}


def coder(path: str) -> RankArrayBPE:
    """The worker's encoder for a vocabulary file."""
    if path not in _CODERS:
        _CODERS[path] = RankArrayBPE(path)
    return _CODERS[path]


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of their decoding."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        c = coder(vocabulary)
        sha = hashlib.sha256
        rows = [c.document(t or "") for t in batch["text"]]
        return {
            "doc_id": batch["doc_id"],
            "n_tokens": [n for n, _, _ in rows],
            "ids_sha256": [sha(ids.encode()).hexdigest() for _, ids, _ in rows],
            "decoded_sha256": [sha(t.encode("utf-8", "surrogatepass")).hexdigest() for _, _, t in rows],
        }

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: ``doc_id``, ``ids`` (array of int) and ``decoded`` (string)."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        c = coder(vocabulary)
        ids = [c.encode(t or "") for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "ids": ids, "decoded": [c.decode(x) for x in ids]}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bpe_digests(docs, tokenizer_path(VOCABULARY))
