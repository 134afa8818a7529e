"""Sum-of-squares online packing of token documents into fixed windows.

Every task packs the documents of its own input split, in reading order.  Whole windows of a long document are cut off
first; what remains, of length s, goes to the fill level h that makes the sum of squared counts of partially filled
windows smallest: moving one window from level h to h + s, or opening one at level s.  A level array holds the counts,
and a stack per level holds its windows.  At the end of a split the windows still partly filled are cut again: pieces of
the emptiest fill the holes of the fullest, and the last rest becomes sequences whose lengths are powers of two, which
need no padding.

Memory per task is one list of open windows (at most a few thousand pieces are open: the sum of squares keeps the
levels low) and one batch of texts.  There is no shuffle; a lost task is packed again, with the same result.

Defined cases: a null text is empty and has just the end id; repeated rows are packed as often as they come; a null id
stays null; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPACE, newer
from .common import arrow_schema, table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
WINDOW = 4096
END_ID = 2
MEMO = 800_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The word pattern of this vocabulary after lower-casing, with white space written out (a fixed value).
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


class WordIds:
    """Ids of whole texts by the tokenizers library, which encodes each distinct word once per worker.

    White space always ends a word of this vocabulary, so a text is looked up by what stands between white space.  Words
    not met before go to the library together, parted by blanks; a word's last id is one with an end mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.special = [t["content"] for t in data["added_tokens"]]
        self.ends = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in data["model"]["vocab"].items() if t.endswith("</w>")]] = True
        self.words = regex.compile(WORDS)
        self.known: set[str] = set()
        self.chunks: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def plain(self, chunk: str) -> bool:
        """Whether the libraries agree on the characters of a chunk and its lower case needs no context."""
        if not chunk.isascii() and (fresh := set(chunk) - self.known):
            self.known |= (old := {c for c in fresh if not newer(c) and c not in "Σİ"})
            return len(old) == len(fresh)
        return True

    def learn(self, chunks: list[str]) -> None:
        """Enter chunks that are not known yet."""
        parts: dict[str, tuple[str, ...] | list[str]] = {}
        for c in chunks:
            bare = c[:-1] if c[-1] in ".,;:!?" else c
            if bare.isalpha() and (c.isascii() or self.plain(c)):  # one word, at most with a sign behind it
                word = (bare if c.isascii() else unicodedata.normalize("NFC", bare)).lower()
                parts[c] = (word,) if bare is c else (word, c[-1])
            elif self.plain(c) and not any(t in c for t in self.special):
                parts[c] = self.words.findall((c if c.isascii() else unicodedata.normalize("NFC", c)).lower())
            else:
                self.chunks[c] = self.whole(c)
        memo = self.memo
        if missing := list(dict.fromkeys(w for ws in parts.values() for w in ws if w not in memo)):
            ids = np.array(self.tok.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0].ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(missing):
                data, at = ids.tobytes(), 0
                for w, end in zip(missing, (4 * last).tolist(), strict=True):
                    memo[w] = data[at:end]
                    at = end
            else:  # a piece with an end mark inside of a word
                memo |= {w: self.whole(w) for w in missing}
        for c, ws in parts.items():
            self.chunks[c] = b"".join([memo[w] for w in ws])

    def ids(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit numbers."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space for Python only
            return self.whole(text)
        chunks, known = text.split(), self.chunks
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            if len(known) > MEMO or len(self.memo) > MEMO:
                known.clear()
                self.memo.clear()
            self.learn([c for c in dict.fromkeys(chunks) if c not in known])
            return b"".join(map(known.__getitem__, chunks))


class SumOfSquares:
    """Windows of one task.  ``place`` adds a document and yields the pieces of windows that are full."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.made = 0

    def level_for(self, size: int) -> int:
        """The level h whose move to h + size gives the least sum of squares; 0 opens a window."""
        n, w = self.count, self.window
        high = w - size
        cost = 2 * (n[size : w + 1] - n[: high + 1] + 1)  # (n[h+s]+1)^2 - n[h+s]^2 + (n[h]-1)^2 - n[h]^2
        cost[high] = 1 - 2 * n[high]  # a full window is no longer counted
        cost[0] = 2 * n[size] + 1  # opening a window changes one level only
        cost[1:][n[1 : high + 1] == 0] = np.iinfo(np.int64).max
        return int(high - cost[::-1].argmin())

    def full(self, pieces: list[tuple]) -> list[tuple]:
        """A finished window: its pieces with sequence number and offset."""
        at, out = 0, []
        for doc, start, length in pieces:
            out.append((doc, start, length, self.made, at))
            at += length
        self.made += 1
        return out

    def place(self, doc: int, size: int) -> list[tuple]:
        out, start, w = [], 0, self.window
        while size - start >= w:
            out += self.full([(doc, start, w)])
            start += w
        if rest := size - start:
            h = self.level_for(rest)
            pieces = self.open[h].pop() if h else []
            self.count[h] -= 1 if h else 0
            pieces.append((doc, start, rest))
            if h + rest == w:
                out += self.full(pieces)
            else:
                self.open[h + rest].append(pieces)
                self.count[h + rest] += 1
        return out

    def finish(self) -> list[tuple]:
        """Close the open windows; only pieces of the emptiest are cut again."""
        left = [(h, p) for h in range(self.window - 1, 0, -1) for p in self.open[h]]
        out: list[tuple] = []
        lo, hi = 0, len(left) - 1
        spare: list[tuple] = []  # pieces of the emptiest windows, to be cut into holes
        while lo <= hi:
            h, pieces = left[lo]
            lo += 1
            while h < self.window:
                if not spare:
                    if lo > hi:
                        break
                    spare = left[hi][1][::-1]
                    hi -= 1
                doc, start, length = spare.pop()
                take = min(length, self.window - h)
                pieces.append((doc, start, take))
                h += take
                if take < length:
                    spare.append((doc, start + take, length - take))
            if h == self.window:
                out += self.full(pieces)
            else:
                spare = pieces[::-1]
        while spare:  # less than one window is left, or pieces of a window that was opened for its rest
            total = sum(p[2] for p in spare)
            size = 1 << (min(total, self.window).bit_length() - 1)
            pieces, h = [], 0
            while h < size:
                doc, start, length = spare.pop()
                take = min(length, size - h)
                pieces.append((doc, start, take))
                h += take
                if take < length:
                    spare.append((doc, start + take, length - take))
            out += self.full(pieces)
        self.open = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        return out


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's encoder for a vocabulary file."""
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence; columns as in ``SCHEMA``."""
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sos = word_ids(vocabulary), SumOfSquares(window)
        end = np.array([end_id], dtype="<u4").tobytes()
        task = (TaskContext.get() or 0) and TaskContext.get().partitionId()
        waiting: dict[int, list] = {}  # document -> id, ids, tokens not yet in a finished sequence
        n = 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            out: list[list] = [[] for _ in schema]
            for doc, start, length, seq, at in pieces:
                entry = waiting[doc]
                data = entry[1][4 * start : 4 * (start + length)]
                for col, v in zip(out, (entry[0], start, length, zlib.crc32(data), len(entry[1]) // 4, (task << 36) + seq, at), strict=True):
                    col.append(v)
                entry[2] -= length
                if not entry[2]:
                    del waiting[doc]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        for batch in batches:
            done: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = coder.ids(text.as_py() or "") + end
                waiting[n] = [doc_id, data, len(data) // 4]
                done += sos.place(n, len(data) // 4)
                n += 1
            yield rows(done)
        yield rows(sos.finish())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
