"""Removal of byte strings that occur more than once, by suffix arrays over content-defined pieces.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts anywhere else in the table.  Equal strings have
the same smallest ``GRAM``-byte hash inside, so consecutive string starts with the same smallest hash form one piece, and
equal strings always lie in pieces with equal hashes.  A piece has at most ``MOST_STARTS`` string starts.  Pieces whose hash is met once are dropped; pieces of the same bytes
are counted together.  Where pieces of one hash differ, the distinct ones are concatenated and sorted by the linear
grouping construction of :mod:`gsaca`; neighbours in that order that agree in ``LENGTH`` bytes are repeats.  A hash with more
than ``HOT_KINDS`` distinct pieces is too much for one task; its strings are told apart by digests, dealt by their value.  The
verdict for each distinct piece goes back to all its places, and the places of a document are merged.

Rows are numbered once, in a table that also holds the texts; every later step reads the stored number.  Texts are read
three times from there and shuffled once, for the last step.  Hashes that need attention are marked in a bitmap of fixed
size; a false mark costs time, never a result.  A piece that many documents share is one row per task, which lists its places;
pieces are compared by 128-bit digests of their bytes.

Defined cases: a null text has no bytes; repeated rows are repeats of each other and lose all strings of that length; a null
id is passed through; texts shorter than ``LENGTH`` bytes are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, numbered, table
from .gsaca import suffix_array

LENGTH = 200
GRAM = 50
BITMAP_BITS = 1 << 27
HOT_KINDS = 256
MOST_STARTS = 1024
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _extreme(x: np.ndarray, window: int, pick: np.ufunc) -> np.ndarray:
    """Sliding minimum or maximum over ``window`` values, by doubling."""
    span = 1
    while 2 * span <= window:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (window - span)], x[window - span :]) if span < window else x


def pieces(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per piece: smallest hash, first and last string start, and whether it may hold that hash more than once."""
    n = len(data)
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(bool)
    up, down = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    window = length - gram + 1
    least = _extreme(h, window, np.minimum)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    size = np.diff(np.append(first, len(least)))
    if (size > MOST_STARTS).any():  # a repetitive text
        first = np.concatenate([np.arange(a, a + n, MOST_STARTS) for a, n in zip(first.tolist(), size.tolist(), strict=True)])
    edge = np.zeros(window - 1, dtype=np.uint64)
    smallest = h[h == _extreme(np.concatenate([edge, least, edge]), window, np.maximum)]  # smallest of some window around them
    again = smallest[1:][smallest[1:] == smallest[:-1]]
    twice = np.isin(least[first], again) if len(again) else np.zeros(len(first), dtype=bool)
    return least[first].view(np.int64), first, np.append(first[1:] - 1, len(least) - 1), twice


def repeated_starts(strings: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Which string starts of each distinct piece are repeats, within or between the pieces or by their counts."""
    out = [np.full(max(0, len(s) - length + 1), c > 1) for s, c in zip(strings, counts, strict=True)]
    if all(c > 1 for c in counts):
        return out
    joined: list[int] = []
    owner, offset = [], []
    for k, s in enumerate(strings):
        joined += s
        joined.append(256)  # no byte: strings that cross it equal no string
        valid = len(s) - length + 1
        owner.append(np.where(np.arange(len(s) + 1) < valid, k, -1))
        offset.append(np.arange(len(s) + 1))
    who, at = np.concatenate(owner), np.concatenate(offset)
    order = np.array(suffix_array(joined))
    order = order[who[order] >= 0]
    views = np.lib.stride_tricks.sliding_window_view(np.array(joined, dtype=np.int16), length)
    for lo in range(0, len(order) - 1, 4096):
        a, b = order[lo : lo + 4096], order[lo + 1 : lo + 4097]
        a = a[: len(b)]
        same = (views[a] == views[b]).all(axis=1)
        for x in (a[same], b[same]):
            for k in np.unique(who[x]):
                out[k][at[x[who[x] == k]]] = True
    return out


def intervals(flags: np.ndarray) -> np.ndarray:
    """First and last position of every run of true flags, flat."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).ravel()


def plain_text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of every document of a task."""
    for batch in batches:
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield rid, text.as_buffer().to_pybytes()


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Fixed-size bitmap of the column ``h``."""
    at = F.pmod("h", F.lit(BITMAP_BITS)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & (BITMAP_BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _digest(data: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data)
    a, b = x >> 64, x & (2**64 - 1)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def verdicts(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``rid`` and ``runs``: first and last removed byte of runs in a document, little-endian 32-bit pairs.

    rows: a table with ``rid`` and ``text``, as :func:`numbered` gives it.
    """
    spark = rows.sparkSession
    scan = rows.select("rid", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([*held, np.zeros(0, dtype=np.int64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

        size = 0
        for _, data in _rows(batches):
            h, _, _, twice = pieces(data, length, gram)
            held += [h, h[twice]]
            size += len(h)
            if size > 1_000_000:
                yield flush()
                size = 0
        yield flush()

    seen = scan.mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    repeated = spark.sparkContext.broadcast(_bitmap(seen.select("h")))
    place_kinds = "h long, d1 long, d2 long, size int, n long, twice boolean, at binary"
    member_schema = arrow_schema(place_kinds)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each distinct piece of some texts, with all its places: number of the text and first byte."""
        held: dict[tuple, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(*k, v[0], len(v[2]) // 2, v[1], np.array(v[2], dtype="<i8").tobytes()) for k, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(member_schema)], schema=member_schema)

        for rid, data in _rows(batches):
            h, a, b, twice = pieces(data, length, gram)
            for k in np.flatnonzero(_marked(repeated.value, h)).tolist():
                first, last = int(a[k]), int(b[k])
                entry = held.setdefault((int(h[k]), *_digest(data[first : last + length])), [last - first + 1, bool(twice[k]), []])
                entry[2] += (rid, first)
                size += 1
            if size > 100_000:
                yield flush()
                size = 0
        yield flush()

    places = materialize(scan.mapInArrow(members, place_kinds), "places")
    kinds = materialize(places.groupBy("h", "d1", "d2").agg(F.sum("n").alias("n"), F.max("twice").alias("twice")), "pieces")
    by_hash = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max("twice").alias("twice"))
    mixed = by_hash.filter((F.col("kinds") > 1) | F.col("twice")).select("h")
    differing = spark.sparkContext.broadcast(_bitmap(mixed))
    crowded = by_hash.filter(F.col("kinds") > HOT_KINDS).select("h")
    n_hot = kinds.join(crowded, "h", "left_semi").count()
    hot = spark.sparkContext.broadcast(_bitmap(crowded) if n_hot else None)
    text_kinds = "h long, d1 long, d2 long, n long, hot boolean, piece binary"
    text_schema = arrow_schema(text_kinds)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            cols = [[k[0] for k in held], [k[1] for k in held], [k[2] for k in held], [v[0] for v in held.values()], [], [v[1] for v in held.values()]]
            cols[4] = [False] * len(held) if hot.value is None else _marked(hot.value, np.array(cols[0], dtype=np.int64)).tolist()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, text_schema, strict=True)], schema=text_schema)

        for _, data in _rows(batches):
            h, a, b, _ = pieces(data, length, gram)
            for k in np.flatnonzero(_marked(differing.value, h) & _marked(repeated.value, h)).tolist():
                piece = data[a[k] : b[k] + length]
                entry = held.setdefault((int(h[k]), *_digest(piece)), [0, piece])
                entry[0] += 1
                size += len(piece) if entry[0] == 1 else 0
            if size > 16_000_000:
                yield flush()
                size = 0
        yield flush()

    verdict_schema = arrow_schema("h long, d1 long, d2 long, found binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, {}
        cols: list[list] = [[] for _ in verdict_schema]

        def judge() -> None:
            keys = list(group)
            flags = repeated_starts([group[k][1] for k in keys], [group[k][0] for k in keys], length)
            for key, f in zip(keys, flags, strict=True):
                if f.any():
                    for c, v in zip(cols, (now, *key, intervals(f).astype("<i4").tobytes()), strict=True):
                        c.append(v)

        def take() -> pa.RecordBatch:
            nonlocal cols
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, verdict_schema, strict=True)], schema=verdict_schema)
            cols = [[] for _ in verdict_schema]
            return batch

        for batch in batches:
            for h, d1, d2, n, piece in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if h != now:
                    if group:
                        judge()
                    now, group = h, {}
                entry = group.setdefault((d1, d2), [0, piece])
                entry[0] += n
            yield take()
        if group:
            judge()
        yield take()

    apart = scan.mapInArrow(texts, text_kinds)
    if n_hot:
        apart = materialize(apart, "texts")
    few = apart.filter("not hot").drop("hot") if n_hot else apart.drop("hot")
    sorted_out = few.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(compare, "h long, d1 long, d2 long, found binary")
    if n_hot:
        sorted_out = sorted_out.unionByName(repeated_windows(apart.filter("hot"), n_hot, length))
    # Pieces of one content and no inner repeat need no sorting: two of them repeat each other in full.
    # A hash that is marked falsely is sorted as well, with the same verdict; one row per content is kept.
    plain = kinds.filter("n > 1").select("h", "d1", "d2", F.lit(None).cast("binary").alias("found"))
    verdict = plain.unionByName(sorted_out).groupBy("h", "d1", "d2").agg(F.max("found").alias("found"), F.max(F.col("found").isNull()).alias("whole"))
    joined = places.join(verdict, ["h", "d1", "d2"]).select("at", "size", "found", "whole")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, out = [], []
            for at, size, found, whole in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x = np.array([0, size - 1], dtype=np.int64) if whole else np.frombuffer(found, dtype="<i4").astype(np.int64)
                x[1::2] += length - 1
                pairs = np.frombuffer(at, dtype="<i8").reshape(-1, 2)
                rids.append(pairs[:, 0])
                out += [row.tobytes() for row in (x[None, :] + pairs[:, 1:]).astype("<i4")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*rids, np.zeros(0, dtype=np.int64)])), pa.array(out, type=pa.binary())], ["rid", "runs"])

    return joined.mapInArrow(runs, "rid long, runs binary").groupBy("rid").agg(F.collect_list("runs").alias("runs"))


def _windows(piece: bytes, length: int) -> np.ndarray:
    """128-bit digests of all strings of ``length`` bytes, as rows of two 64-bit words."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(piece[i : i + length]) for i in range(len(piece) - length + 1)]), dtype="<u8").reshape(-1, 2)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of two words, and whether each occurs more than once."""
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    new = np.append(True, (x[1:] != x[:-1]).any(axis=1)) if len(x) else np.zeros(0, dtype=bool)
    return x[new], np.diff(np.append(np.flatnonzero(new), len(x))) > 1


def repeated_windows(apart: DataFrame, count: int, length: int, chunk: int = 10_000) -> DataFrame:
    """Verdicts (``h``, ``d1``, ``d2``, ``found``) for the pieces of crowded hashes, whose strings are told apart by digests.

    The distinct pieces are dealt to chunks of at most about ``chunk``.  A chunk's distinct digests go, packed, to buckets by their value; a bucket
    answers every chunk which of its digests are repeated there or elsewhere.  However many pieces have a string in common, a chunk
    names it once."""
    spark = apart.sparkSession
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // chunk))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * length // 1_000_000))
    one = apart.groupBy("h", "d1", "d2").agg(F.sum("n").alias("n"), F.min("piece").alias("piece"))
    own = materialize(one.select(F.pmod(F.xxhash64("d1", "d2"), F.lit(chunks)).alias("chunk"), F.lit(-1).cast("long").alias("bucket"), "h", "d1", "d2", "n", "piece"), "crowded")
    kinds = "chunk long, bucket long, found binary, again binary"
    schema = arrow_schema(kinds)

    def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Sorted rows again, all of one first value at a time."""
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches):
            found, again = _distinct(np.concatenate([np.repeat(_windows(r[2], length), 1 + (r[1] > 1), axis=0) for r in rows]))
            at = found[:, 0] % np.uint64(buckets)
            order = np.argsort(at, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                yield packed([(rows[0][0], int(at[part[0]]), found[part].tobytes(), again[part].tobytes())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches):
            each = [np.frombuffer(r[2], dtype="<u8").reshape(-1, 2) for r in rows]
            inner = [np.frombuffer(r[3], dtype=bool) for r in rows]
            found, again = _distinct(np.concatenate([*each, *[x[i] for x, i in zip(each, inner, strict=True)]]))
            wanted = np.ascontiguousarray(found[again]).view("V16").ravel()
            for r, x in zip(rows, each, strict=True):
                hit = x[np.isin(np.ascontiguousarray(x).view("V16").ravel(), wanted)] if len(wanted) else x[:0]
                if len(hit):
                    yield packed([(r[1], r[0], hit.tobytes(), b"")])

    asked = own.select("chunk", "n", "piece").repartition(chunks, "chunk").sortWithinPartitions("chunk").mapInArrow(ask, kinds)
    replies = asked.select("bucket", "chunk", "found", "again").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, kinds)
    empty = F.lit(None)
    both = own.unionByName(replies.select("chunk", "bucket", empty.cast("long").alias("h"), empty.cast("long").alias("d1"), empty.cast("long").alias("d2"), empty.cast("long").alias("n"), F.col("found").alias("piece")))
    verdict = "h long, d1 long, d2 long, found binary"
    verdict_schema = arrow_schema(verdict)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches):
            wanted = {r[6][i : i + 16] for r in rows if r[1] >= 0 for i in range(0, len(r[6]), 16)}
            out = []
            for _, bucket, h, d1, d2, _, piece in rows:
                if bucket < 0:
                    digests = _windows(piece, length).tobytes()
                    flags = np.array([digests[i : i + 16] in wanted for i in range(0, len(digests), 16)], dtype=bool)
                    if flags.any():
                        out.append((h, d1, d2, intervals(flags).astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=f.type) for k, f in enumerate(verdict_schema)], schema=verdict_schema)

    return both.repartition(chunks, "chunk").sortWithinPartitions("chunk").mapInArrow(judge, verdict)


def merged(runs: list[bytes], n: int) -> np.ndarray:
    """Removed bytes of a text as flags."""
    edge = np.zeros(n + 1, dtype=np.int64)
    x = np.frombuffer(b"".join(runs), dtype="<i4")
    np.add.at(edge, x[0::2], 1)
    np.add.at(edge, x[1::2] + 1, -1)
    return np.cumsum(edge[:n]) > 0


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``rid``, ``doc_id``, ``text``, ``runs`` of every document."""
    own = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text()), "numbered")
    found = materialize(verdicts(own, length, gram), "runs")
    return own.join(found, "rid", "left").select("rid", "doc_id", "text", "runs")


def dedup(docs: DataFrame) -> DataFrame:
    """Columns of the contract for every document."""
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = arrow_schema(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc_id, text, runs in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                gone = merged(runs or [], len(data))
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes() if runs else data
                for c, v in zip(rows, (doc_id, len(data), int(gone.sum()), len(intervals(gone)) // 2, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return removals(docs).mapInArrow(cut, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings taken out of the texts, and ``n_chars`` to match; all rows stay."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                if runs:
                    data = np.frombuffer(data, dtype=np.uint8)[~merged(runs, len(data))].tobytes()
                kept.append(data.decode("utf-8", "ignore"))  # a character cut in half goes as a whole
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, type=pa.string()), *batch.columns[3:]], ["rid", "text", *batch.schema.names[3:]])

    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    own = numbered(docs.select(plain_text(), *[F.col(c).alias(f"c{k}") for k, c in enumerate(rest)]), "numbered")
    found = materialize(verdicts(own), "runs")
    both = own.join(found, "rid", "left").select("rid", "text", "runs", *[f"c{k}" for k in range(len(rest))])
    kinds = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(rest))
    out = both.mapInArrow(cut, f"rid long, text string, {kinds}" if rest else "rid long, text string")
    cols = {c: F.col(f"c{k}") for k, c in enumerate(rest)} | {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[cols[c].alias(c) for c in docs.columns])
