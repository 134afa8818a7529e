"""Language-model scores from a subword lattice, with word counts of the training documents beside them.

Model: pieces of an existing subword vocabulary are drawn independently until an end token is drawn.  A text's probability
is the sum over all its segmentations, computed word by word by a forward recursion in log space, as no piece crosses a
word's begin.  The scores of the vocabulary file weigh the pieces; they are merge ranks, the only scores there are, and a rank
r stands for the weight 1 / (r + 10), as frequencies fall with the rank.  The share of end tokens is learned from the training
rows.  Characters that are no piece are spelled in byte pieces.  The operator's ``score`` is this marginal and nothing else; with
``learn`` the weights are first estimated anew: a piece weighs what the segmentations of all distinct training words expect of it
under the file's weights (one round of expectation and maximization), plus a single token dealt out by the file's weights.

Beside it stands ``mixed_score``, where every training word is one more arc over its whole length, weighted by how often it
occurs, and the pieces share what Good-Turing leaves for words that training has not seen.  The query's ``score`` is this one, with
learned weights, and ``piece_score`` the marginal without the words' arcs.

Data flow: a task reads its split in chunks.  A chunk has its own list of distinct words, and a document is kept as numbers
of that list with counts.  Only the lists are joined with the corpus-wide counts; what they find goes back to the chunk,
packed, and meets the documents there.  A frequent word therefore gives one row per chunk, never one per document, and no
table of all words is ever broadcast; only piece weights are, as many as the vocabulary has.

Defined cases: a null text is an empty text and has just the end token; a null id counts as the empty string for the fold
and stays null; repeated rows count as often as they come; with no training documents all counts are zero, there are no
word arcs and the end token has an even chance; an empty table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, table, tokenizer_path
from .simhash import words_of

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
CHUNK_WORDS = 500_000
CHUNK_DOCS = 200_000
WORDS_AT_ONCE = 2_000
LOG10 = math.log(10)
MARK = "\u2581"
UNIT = 1 << 24  # expected counts are whole numbers of these parts, so that their sums do not depend on an order
NO_CHARACTER = "\ufdd0"  # stands for a literal MARK within a word, so that it is spelled in bytes
LISTS = "chunk long, doc_id long, held_out boolean, n_words long, numbers binary, idx int, word string, train long"


class Lattice:
    """Pieces and their natural log weights."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = [0] * 256
        self.index: dict[str, int] = {}
        score = np.full(n, -np.inf)
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            piece = sp.id_to_piece(i)
            score[i] = -math.log(10 - min(0.0, sp.get_score(i)))
            if sp.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                score[i] = -math.log(10 + n)  # bytes come after all ranks
            else:
                self.index[piece] = i
        self.trie: dict[str, list] = {}
        for piece, i in self.index.items():
            level = self.trie
            for c in piece[:-1]:
                level = level.setdefault(c, [-1, {}])[1]
            level.setdefault(piece[-1], [-1, {}])[0] = i
        self.own = score - np.logaddexp.reduce(score[np.isfinite(score)])
        self.end, self.log = 0.0, self.own.tolist()

    def ending(self, share: float) -> Lattice:
        """The same with an end token of the given share."""
        out = copy.copy(self)
        out.end, out.log = math.log(share), (self.own + math.log1p(-share)).tolist()
        return out

    def _spelling(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in c.encode("utf-8", "surrogatepass"))

    def fitted(self, counts: np.ndarray) -> Lattice:
        """The same with pieces weighed by their expected counts, and one more token dealt out by the weights of now."""
        out = copy.copy(self)
        with np.errstate(divide="ignore"):
            out.own = np.log((counts / UNIT + np.exp(self.own)) / (counts.sum() / UNIT + 1))
        out.end, out.log = 0.0, out.own.tolist()
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece is expected in the segmentations of the words, in parts of ``UNIT``: forward and backward over all words
        at once, by place within the word."""
        root, n = self.trie, len(self.log)
        spelled: dict[str, int] = {}  # characters that are no piece, numbered after the pieces
        arcs, lens, at0 = [], [], 0  # an arc: node it begins at, length, piece
        for word in words:
            s = MARK + (word.replace(MARK, NO_CHARACTER) if MARK in word else word)
            m = len(s)
            for i in range(m):
                at, begin, j = root.get(s[i]), at0 + i << 36, i + 1
                if at is None or at[0] < 0:
                    arcs.append(begin | 1 << 20 | spelled.setdefault(s[i], n + len(spelled)))
                while at is not None:
                    p, below = at
                    if p >= 0:
                        arcs.append(begin | j - i << 20 | p)
                    if j == m:
                        break
                    at = below.get(s[j])
                    j += 1
            lens.append(m + 1)
            at0 += m + 1
        out = np.zeros(n, dtype=np.int64)
        if not arcs:
            return out
        last = np.cumsum(lens) - 1
        first = last + 1 - lens
        coded = np.array(arcs, dtype=np.int64)
        begin = coded >> 36
        place = begin - np.repeat(first, lens)[begin]
        order = np.argsort(place, kind="stable")
        coded, begin, place = coded[order], begin[order], place[order]
        end, piece = begin + (coded >> 20 & 0xFFFF), coded & 0xFFFFF
        weight = np.array(self.log + [sum(self.log[b] for b in self._spelling(c)) for c in spelled])[piece]
        cut = np.searchsorted(place, np.arange(place[-1] + 2))
        steps = [slice(i, j) for i, j in zip(cut, cut[1:], strict=False)]
        into, out_of = np.full((2, at0), -np.inf)
        into[first] = 0.0
        for k in steps:
            np.logaddexp.at(into, end[k], into[begin[k]] + weight[k])
        out_of[last] = -into[last]
        for k in reversed(steps):
            np.logaddexp.at(out_of, begin[k], out_of[end[k]] + weight[k])
        parts = np.rint(np.exp(into[begin] + weight + out_of[end]) * UNIT).astype(np.int64)
        every = np.zeros(n + len(spelled), dtype=np.int64)
        np.add.at(every, piece, parts)
        out += every[:n]
        for c, k in spelled.items():
            for b in self._spelling(c):
                out[b] += every[k]
        return out

    def log_probability(self, word: str) -> float:
        """Natural log of the sum over all segmentations, by a forward recursion in log space."""
        s = MARK + (word.replace(MARK, NO_CHARACTER) if MARK in word else word)
        n, log, root, exp, ln = len(s), self.log, self.trie, math.exp, math.log
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            terms = into[i]
            if len(terms) == 1:
                a = terms[0]
            elif terms:
                top = max(terms)
                a = top + ln(sum([exp(t - top) for t in terms]))
            else:
                continue  # no segmentation ends here
            into[i] = []
            at = root.get(s[i])
            if at is None or at[0] < 0:
                into[i + 1].append(a + sum([log[b] for b in self._spelling(s[i])]))
            j = i + 1
            while at is not None:
                p, below = at
                if p >= 0:
                    into[j].append(a + log[p])
                if j == n:
                    break
                at = below.get(s[j])
                j += 1
        top = max(into[n])
        return top + ln(sum([exp(t - top) for t in into[n]]))


def unseen_share(once: int, tokens: int) -> float:
    """Share of the pieces: what Good-Turing expects of unseen tokens, given how many tokens occur once; all if there are none."""
    return (once + 1) / (tokens + 1)


def with_word_arc(lp: np.ndarray, c: np.ndarray, tokens: int, share: float) -> np.ndarray:
    """Natural log of a token's probability when its whole-word arc, met ``c`` times in training, joins the pieces' ``lp``."""
    with np.errstate(divide="ignore"):
        whole = np.log(c) - math.log(max(1, tokens)) + np.log(1 - share)
    return np.logaddexp(lp + math.log(share), whole)


_READ: dict[str, Lattice] = {}


def read_lattice(path: str) -> Lattice:
    """A lattice whose vocabulary is read once per worker."""
    if path not in _READ:
        _READ[path] = Lattice(path)
    return _READ[path]


def word_lists(docs: DataFrame) -> DataFrame:
    """Rows of ``LISTS``: documents as numbers of their chunk's words, and the words of every chunk with training counts."""
    schema = arrow_schema(LISTS)

    def batch_of(**cols: list) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        vocab: dict[str, int] = defaultdict()
        vocab.default_factory = vocab.__len__
        seen = np.zeros(1 << 16, dtype=np.int64)
        chunk, docs_ = 0, 0

        def words() -> Iterator[pa.RecordBatch]:
            names = list(vocab)
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield batch_of(chunk=[task + chunk] * len(part), idx=range(at, at + len(part)), word=part, train=seen[at : at + len(part)])

        for batch in batches:
            cols: dict[str, list] = {"chunk": [], "doc_id": [], "held_out": [], "n_words": [], "numbers": []}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = words_of(text.as_py())
                held = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT
                idx, cnt = np.unique(np.fromiter(map(vocab.__getitem__, tokens), dtype=np.uint32, count=len(tokens)), return_counts=True)
                if len(vocab) > len(seen):
                    seen = np.append(seen, np.zeros(max(len(seen), len(vocab)), dtype=np.int64))
                if not held:
                    seen[idx] += cnt
                steps = np.diff(idx, prepend=np.uint32(0)).astype("<u4")
                packed = steps.tobytes() + cnt.astype("<u4").tobytes()
                for k, v in zip(cols, (task + chunk, doc_id, held, len(tokens), packed), strict=True):
                    cols[k].append(v)
                docs_ += 1
                if len(vocab) >= CHUNK_WORDS or docs_ >= CHUNK_DOCS:
                    yield batch_of(**cols)
                    yield from words()
                    cols = {k: [] for k in cols}
                    vocab.clear()
                    seen[:] = 0
                    chunk, docs_ = chunk + 1, 0
            yield batch_of(**cols)
        yield from words()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LISTS)


def expected_counts(words: DataFrame, path: str, ends: float) -> np.ndarray:
    """Expected counts of all pieces in the column ``word``, each row once; as many numbers come to the driver as there are pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = read_lattice(path).ending(ends)
        total = np.zeros(len(lattice.log), dtype=np.int64)
        for batch in batches:
            given = batch.column(0).to_pylist()
            for at in range(0, len(given), WORDS_AT_ONCE):
                total += lattice.expected(given[at : at + WORDS_AT_ONCE])
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, type=pa.int32()), pa.array(total[met], type=pa.int64())], ["piece", "n"])

    out = np.zeros(len(read_lattice(path).log), dtype=np.float64)
    for r in words.select("word").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r.piece] = r.n
    return out


def score(docs: DataFrame, path: str, learn: bool = False) -> DataFrame:
    """Columns of the contract for every document; ``learn``: under piece weights learned from the training words, not the file's."""
    spark = docs.sparkSession
    lists = materialize(word_lists(docs), "lists")
    words = lists.filter(F.col("word").isNotNull()).select("chunk", "idx", "word", "train")
    documents = lists.filter(F.col("word").isNull())
    known = materialize(words.groupBy("word").agg(F.sum("train").alias("c")), "words")
    n_docs, n_words = documents.filter(~F.col("held_out")).agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    n_train = n_docs + n_words
    n_distinct, n_once = known.filter("c > 0").agg(F.count("*"), F.count(F.when(F.col("c") == 1, 1))).first()
    distinct = n_distinct + (n_docs > 0)
    share = unseen_share(n_once + (n_docs == 1), n_train)
    ends = (n_docs + 1) / (n_train + 2)
    counts = expected_counts(known.filter("c > 0"), path, ends) if learn else None

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = read_lattice(path)
        lattice = (lattice if counts is None else lattice.fitted(counts)).ending(ends)
        for batch in batches:
            lp = [lattice.log_probability(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp, type=pa.float64())], ["word", "c", "lp"])

    weighed = known.mapInArrow(weigh, "word string, c long, lp double")
    found = words.select("chunk", "idx", "word").join(weighed, "word").select("chunk", "idx", "c", "lp")

    reply = arrow_schema("chunk long, doc_id long, held_out boolean, n_words long, numbers binary")

    def send_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            chunk, idx, c, lp = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(4))
            order = np.lexsort((idx, chunk))
            chunk, idx, c, lp = chunk[order], idx[order], c[order], lp[order]
            cut = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
            blobs = []
            for i, j in zip(cut, cut[1:], strict=False):
                raw = np.diff(idx[i:j], prepend=0).astype("<u4").tobytes() + c[i:j].astype("<u8").tobytes() + lp[i:j].astype("<f8").tobytes()
                blobs.append(zlib.compress(raw, 1))
            n = len(blobs)
            return pa.RecordBatch.from_arrays([pa.array(chunk[cut[:-1]]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array([-1] * n, type=pa.int64()), pa.array(blobs, type=pa.binary())], schema=reply)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 500_000:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    both = found.mapInArrow(send_back, "chunk long, doc_id long, held_out boolean, n_words long, numbers binary").unionByName(
        documents.select("chunk", "doc_id", "held_out", "n_words", "numbers")
    )
    # as many partitions as chunks, so that none grows with the table
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.select("chunk").distinct().count())
    met = both.repartition(parts, "chunk").sortWithinPartitions("chunk", "n_words")  # replies have -1 words and come first
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double"
    result = arrow_schema(out)
    end_count, below, end_log = n_docs, math.log10(n_train + distinct + 1), math.log(ends)
    end_mixed = float(with_word_arc(np.array([end_log]), np.array([n_docs]), n_train, share)[0])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, known_ = None, np.zeros((3, 0)), np.zeros(0, dtype=bool)
        for batch in batches:
            rows: list[list] = [[] for _ in result]
            for chunk, doc_id, held, n, blob in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if chunk != now:
                    now, sums, known_ = chunk, np.zeros((3, 1024)), np.zeros(1024, dtype=bool)
                if n < 0:
                    raw = zlib.decompress(blob)
                    m = len(raw) // 20
                    idx = np.cumsum(np.frombuffer(raw, "<u4", m))
                    if m and (top := int(idx[-1]) + 1) > len(known_):
                        more = max(top, 2 * len(known_)) - len(known_)
                        sums, known_ = np.append(sums, np.zeros((3, more)), axis=1), np.append(known_, np.zeros(more, dtype=bool))
                    c, lp = np.frombuffer(raw, "<u8", m, 4 * m).astype(np.float64), np.frombuffer(raw, "<f8", m, 12 * m)
                    sums[:, idx] = np.log10(c + 1), lp / LOG10, with_word_arc(lp, c, n_train, share) / LOG10
                    known_[idx] = c > 0
                    continue
                m = len(blob) // 8
                idx, cnt = np.cumsum(np.frombuffer(blob, "<u4", m)), np.frombuffer(blob, "<u4", m, 4 * m).astype(np.float64)
                base, model, mixed = (sums[:, idx] @ cnt).tolist()
                seen = int(cnt @ known_[idx]) + (end_count > 0)
                values = (doc_id, held, n + 1, seen, n_train, base + math.log10(end_count + 1) - (n + 1) * below, model + end_log / LOG10, mixed + end_mixed / LOG10)
                for col, v in zip(rows, values, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, result, strict=True)], schema=result)

    return met.mapInArrow(add_up, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY), learn=True)
    same = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    return out.select(*same, F.col("mixed_score").alias("score"), F.col("score").alias("piece_score"))
