"""SimHash fingerprints and near-duplicate components by multi-index hashing.

A fingerprint bit is the majority of that bit over the hashes of all word shingles.  Distinct fingerprints are entered in one
table per segment under the segment's value; every fingerprint also enumerates a small Hamming ball around each of its
segments and is sent to those table cells.  Within a cell complete distances are verified.  With m segments and balls of
radius r all pairs up to distance m * (r + 1) - 1 meet in some cell, so two halves with radius 1 are exact for distance 2
(and 3).

A cell is never turned into all its pairs: starting from one member, whatever is close to the growing component leaves the
list of members still to be reached, and only the links that reach a new member are given out.  A cell of more than
``BLOCK`` table entries is cut into blocks, and pairs of blocks go to different tasks, so no cell is collected whole.
The list of such cells is bounded by the choice of the block size.

Defined cases: a null text is an empty text; fewer words than a shingle has give one shingle of all words; no words give
fingerprint zero, which links like any other; repeated rows share a class; null ids are passed through, and a
component of only null ids has a null id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, release, table
from .components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SEED = 42
BLOCK = 4096
SLICE = 100_000
HOT_CELLS = 65536
_BIT = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def shingle_hashes(words: list[str], n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``n`` words, repeats included."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        runs = [" ".join(words)]
    else:
        runs = map(" ".join, zip(*(words[k:] for k in range(n)), strict=False))
    return np.array([h(s, seed) for s in runs], dtype=np.uint64)


def more_bits(h: np.ndarray, times: int) -> np.ndarray:
    """``times`` 64-bit values per hash; the first is the hash itself, the others are mixed from it."""
    out = [h]
    for k in range(1, times):
        x = h + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1) if len(h) else np.zeros((0, times), dtype=np.uint64)


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How often each bit is set, lowest bit first, over rows of 64-bit values."""
    n, k = values.shape
    if not n:
        return np.zeros(64 * k, dtype=np.int64)
    columns = np.ascontiguousarray(values).view(np.uint8).reshape(n, 8 * k).astype(np.int64)
    columns += np.arange(8 * k)[None, :] * 256
    return (np.bincount(columns.ravel(), minlength=2048 * k).reshape(8 * k, 256) @ _BIT).ravel()


def fingerprint(words: list[str], shingle: int) -> np.uint64:
    """The 64-bit fingerprint of some words, from slices of bounded size."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for at in range(0, max(1, len(words) - shingle + 1), SLICE):
        h = shingle_hashes(words[at : at + SLICE + shingle - 1], shingle)
        counts += bit_counts(h[:, None])
        n += len(h)
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]


def words_of(text: str | None) -> list[str]:
    """Words of a text whose letters A-Z are lower-cased."""
    text = text or ""
    return WORD.findall(text.lower() if text.isascii() else text.translate(UPPER))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64-bit fingerprint as a signed long)."""
    schema = arrow_schema("doc_id long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(words_of(t.as_py()), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Segments:
    """Segments of a 64-bit fingerprint, and the balls of radius one around their values."""

    def __init__(self, bits: int, count: int):
        self.width, self.count = bits // count, count

    def values(self, fps: np.ndarray) -> np.ndarray:
        """Value of each segment; ``fps`` has one row of 64-bit words per fingerprint."""
        bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")[:, : self.width * self.count]
        weights = 1 << np.arange(self.width, dtype=np.int64)
        return bits.reshape(len(fps), self.count, self.width) @ weights

    def cells(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every entry: row of the fingerprint, cell, whether it is the table entry (else a probe of the ball)."""
        own = self.values(fps)
        n = len(fps)
        seg = np.arange(self.count, dtype=np.int64)[None, :] << 48
        ball = own[:, :, None] ^ (np.int64(1) << np.arange(self.width, dtype=np.int64))[None, None, :]
        cell = np.concatenate([(own | seg)[:, :, None], ball | seg[:, :, None]], axis=2)
        rows = np.broadcast_to(np.arange(n)[:, None, None], cell.shape)
        entry = np.zeros(cell.shape, dtype=bool)
        entry[:, :, 0] = True
        return rows.ravel(), cell.ravel(), entry.ravel()


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def links_of_cell(fps: np.ndarray, table_entry: np.ndarray, close) -> list[tuple[int, int]]:
    """Links (member, member) that connect what is close within one cell; each link reaches a new member."""
    todo = np.flatnonzero(np.ones(len(fps), dtype=bool))
    links: list[tuple[int, int]] = []
    if not table_entry.any():
        return links
    while len(todo) > 1:
        grown = [todo[0]]
        todo = todo[1:]
        while grown and len(todo):
            x = grown.pop()
            near = close(fps[x], fps[todo])
            if near.any():
                hit = todo[near]
                links += [(x, y) for y in hit.tolist()]
                grown += hit.tolist()
                todo = todo[~near]
    return links


def link(nodes: DataFrame, words: int, segments: Segments, close, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` between the ids of ``nodes`` (``id`` long, ``fp`` binary of ``words`` 64-bit words) that connect all pairs which share a cell and are ``close``."""
    spark = nodes.sparkSession
    long_binary = arrow_schema("cell long, hot int, entry boolean, id long, fp binary")

    def unpack(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, words)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fps = unpack(batch.column(1))
                yield pa.RecordBatch.from_arrays([pa.array((segments.values(fps) | (np.arange(segments.count, dtype=np.int64)[None, :] << 48)).ravel())], ["cell"])

    # Cells of many table entries; the block grows until their list is at most HOT_CELLS long.
    sizes = nodes.select("id", "fp").mapInArrow(entries, "cell long").groupBy("cell").count().filter(F.col("count") > block)
    hot: dict[int, int] = {}
    found = sizes.orderBy(F.desc("count")).limit(HOT_CELLS + 1).collect()
    if len(found) > HOT_CELLS:
        block = max(block, found[-1]["count"])
    hot = {r["cell"]: -(-r["count"] // block) for r in found if r["count"] > block}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array(sorted(hot), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                fps, ids = unpack(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
                rows, cell, entry = segments.cells(fps)
                blocks = np.zeros(len(rows), dtype=np.int32)
                if len(keys):
                    is_hot = np.isin(cell, keys)
                    extra = []
                    for k in np.flatnonzero(is_hot):
                        c = hot[int(cell[k])]
                        own = int(xxhash.xxh64_intdigest(ids[rows[k]].tobytes()) % c)
                        # blocks i <= j meet in task (i, j); every member goes to all tasks of its block
                        extra += [(rows[k], cell[k], entry[k], 1 + min(own, j) * c + max(own, j)) for j in range(c)]
                    stay = ~is_hot
                    rows, cell, entry, blocks = rows[stay], cell[stay], entry[stay], blocks[stay]
                    if extra:
                        r, c_, e, b = zip(*extra, strict=True)
                        rows, cell, entry, blocks = np.append(rows, r), np.append(cell, c_), np.append(entry, e), np.append(blocks, np.array(b, dtype=np.int32))
                taken = batch.column(1).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(blocks.astype(np.int32)), pa.array(entry), pa.array(ids[rows]), taken], schema=long_binary)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def runs(part: pa.Table) -> pa.RecordBatch:
            cell, hot_, entry, ids = (part.column(k).to_numpy() for k in range(4))
            cut = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (hot_[1:] != hot_[:-1])))
            ends = np.append(cut[1:], len(cell))
            many = ends - cut > 1
            a, b = [], []
            for i, j in zip(cut[many].tolist(), ends[many].tolist(), strict=True):
                if entry[i:j].any():
                    fps = unpack(part.column(4).slice(i, j - i))
                    for x, y in links_of_cell(fps, entry[i:j], close):
                        a.append(ids[i + x])
                        b.append(ids[i + y])
            return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            part = pa.Table.from_batches(held)
            cell, hot_ = part.column(0).to_numpy(), part.column(1).to_numpy()
            last = np.flatnonzero((cell != cell[-1]) | (hot_ != hot_[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield runs(part.slice(0, whole))
                held = part.slice(whole).combine_chunks().to_batches()
        if held:
            yield runs(pa.Table.from_batches(held))

    rows = nodes.select("id", "fp").mapInArrow(spread, "cell long, hot int, entry boolean, id long, fp binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(parts, "cell", "hot").sortWithinPartitions("cell", "hot")
    return sorted_rows.mapInArrow(meet, "a long, b long")


def near_classes(prints: DataFrame, max_distance: int = 2) -> DataFrame:
    """``fp``, ``component_id`` for the fingerprints of a table ``doc_id``, ``fp``."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    # the bytes are in the other order than numpy's, for all fingerprints alike: distances and halves are the same
    nodes = classes.select(F.col("fp").alias("id"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))
    edges = materialize(link(nodes, 1, Segments(64, 2), lambda x, ys: distance(x[None, :], ys) <= max_distance), "links")
    roots = materialize(components(edges), "roots")
    release(edges)
    labelled = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    return labelled.join(least, "root").select("fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(fingerprints(table(spark, sf_dir, "documents"), 3), "prints")
    out = prints.join(near_classes(prints), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
