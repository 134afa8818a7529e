"""Exact top-k search by inner product with vector-approximation files.

The approximation file holds, for every vector, one byte a component: the number of one of ``CELLS`` equal cells between the
least and greatest value of that component in the vector's chunk.  It is written once, as chunks of packed bytes, beside
a table of the exact vectors.

The file is scanned for blocks of at most ``QUERY_BLOCK`` queries.  Query blocks and groups of chunks are dealt to tasks so that every
block meets every group once; nothing of it passes through the driver.  One product of the queries with the cells' centres gives
all scores up to the query's radius, the sum of its absolute components times half a cell.  What may still beat the k-th
lower bound of the group, then of the whole file, is a candidate.  Only the exact vectors of candidates are fetched;
they are read in the order of their bounds, best first, until the k-th exact score is above the next bound.

Of equal vectors in a chunk only the rows of the ``top`` + 1 smallest ids, ``top`` of each, can be among anyone's ``top`` results; the
others are in the file but yield no candidates, so a vector that a third of all rows share does no harm.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id;
components are floor(1024 x); a query meets every row of another id, repeated rows as often as they come; of several
query rows with one id the smallest vector counts; vectors of another length than the query's are no candidates; ties go
to the smaller id; fewer candidates give fewer rows; an empty table gives none; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, release, table
from .suffix_dedup import _bitmap, _marked

SCALE = 1024
CELLS = 256
QUERY_BLOCK = 4096
CHUNKS_A_GROUP = 64
QUERY_EVERY = 100
TOP = 10

#: DuckDB form of :func:`query`.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_sum(list_transform(range(1, len(v.c) + 1), lambda i: v.c[i] * q.c[i]))::BIGINT AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (array of double holding whole numbers) of all rows that take part."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    kept = rows.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("double")).alias("v"))


class Chunk:
    """Cell numbers of some vectors of one length, with the least value and the width of the cells of every component."""

    def __init__(self, ids: np.ndarray, rids: np.ndarray, codes: np.ndarray, low: np.ndarray, step: np.ndarray):
        self.ids, self.rids, self.codes, self.low, self.step = ids, rids, codes, low, step

    @staticmethod
    def of(ids: np.ndarray, rids: np.ndarray, v: np.ndarray, cells: int = CELLS) -> Chunk:
        low = v.min(axis=0)
        step = (v.max(axis=0) - low) / cells
        safe = np.where(step > 0, step, 1.0)
        return Chunk(ids, rids, np.clip((v - low) / safe, 0, cells - 1).astype(np.uint8), low, step)

    def pack(self) -> tuple[bytes, ...]:
        return (self.ids.tobytes(), self.rids.tobytes(), self.codes.tobytes(), np.stack([self.low, self.step]).tobytes())

    @staticmethod
    def unpack(ids: bytes, rids: bytes, codes: bytes, cells: bytes) -> Chunk:
        low, step = np.frombuffer(cells, dtype="<f8").reshape(2, -1)
        return Chunk(np.frombuffer(ids, dtype="<i8"), np.frombuffer(rids, dtype="<i8"), np.frombuffer(codes, dtype=np.uint8).reshape(-1, len(low)), low, step)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle of the bounds of the score of every query (row) with every vector (column), and each query's radius."""
        reach = np.abs(self.low) + 256 * self.step
        size = np.abs(q) @ reach
        kind = np.float32 if size.max(initial=0) < 1e30 else np.float64
        centres = ((self.codes + np.float32(0.5)) * self.step.astype(kind) + self.low.astype(kind)).astype(kind)
        # half a cell, and what rounding can add; a little more never hides a candidate
        return q.astype(kind) @ centres.T, np.abs(q) @ (self.step * 0.5) + size * (1e-6 * len(self.low) ** 0.5 + 1e-6) + 1


def telling_rows(ids: np.ndarray, v: np.ndarray, top: int) -> np.ndarray:
    """Rows that can be among the ``top`` results of some query: not more than ``top`` rows of one id and one vector, nor of ids beyond the
    ``top`` + 1 smallest of one vector."""
    _, name = np.unique(np.ascontiguousarray(v + 0.0).view(f"V{8 * v.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, name))
    i, n = ids[order], name[order]
    fresh = np.append(True, n[1:] != n[:-1])
    new_id = fresh | np.append(True, i[1:] != i[:-1])
    at = np.arange(len(i))
    which = np.cumsum(new_id) - 1  # number of the id, all vectors counted through
    nth_id = which - np.maximum.accumulate(np.where(fresh, which, 0))
    nth_row = at - np.maximum.accumulate(np.where(new_id, at, 0))
    return order[(nth_id <= top) & (nth_row < top)]


def approximation_file(vectors: DataFrame, top: int) -> DataFrame:
    """``n``, ``ids``, ``rids``, ``codes``, ``cells``, ``telling``: chunks of the vectors ``rid``, ``id``, ``v``; every row is in one.

    ``telling`` has the places of :func:`telling_rows` in the chunk."""
    out = "n int, ids binary, rids binary, codes binary, cells binary, telling binary"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ids, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            ends, rows = np.cumsum(sizes), []
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                v = flat[(ends[own] - n)[:, None] + np.arange(n)[None, :]]
                rows.append((n, *Chunk.of(ids[own], rids[own], v).pack(), telling_rows(ids[own], v, top).astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)

    return materialize(vectors.select("rid", "id", "v").mapInArrow(run, out), "cells")


def candidates(chunks: DataFrame, queries: DataFrame, top: int, block: int) -> DataFrame:
    """``qid``, ``rid``, ``lower``, ``upper``: for every query, all rows of a group of chunks that may be among the group's best ``top``."""
    spark = chunks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-queries.count() // block))
    n_groups = max(parts, -(-chunks.count() // CHUNKS_A_GROUP))
    none = F.lit(None).cast("binary")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("b"), "id", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {}
            for b, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, vs = rows.setdefault((b, len(v)), ([], []))
                ids.append(i)
                vs.append(v)
            cols = [[k[0] for k in rows], [k[1] for k in rows], [np.array(x[0], dtype="<i8").tobytes() for x in rows.values()], [np.array(x[1], dtype="<f8").tobytes() for x in rows.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["b", "n", "ids", "v"])

    packed = asked.repartition(n_blocks, "b").mapInArrow(pack, "b int, n int, ids binary, v binary")
    left = packed.select("b", "n", "ids", "v", every(n_groups).alias("g")).select("b", "g", F.lit(0).alias("side"), "n", "ids", none.alias("rids"), F.col("v").alias("codes"), none.alias("cells"), none.alias("telling"))
    group = F.pmod(F.xxhash64("ids", "rids"), F.lit(n_groups)).cast("int")
    right = chunks.select(group.alias("g"), "n", "ids", "rids", "codes", "cells", "telling", every(n_blocks).alias("b"))
    met = left.unionByName(right.select("b", "g", F.lit(1).alias("side"), "n", "ids", "rids", "codes", "cells", "telling"))
    met = met.repartition(max(parts, n_blocks * n_groups), "b", "g").sortWithinPartitions("b", "g", "side")
    out = "qid long, rid long, lower double, upper double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asks = None, {}
        for batch in batches:
            for b, g, side, n, ids, rids, codes, cells, telling in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, g) != now:
                    now, asks = (b, g), {}
                if side == 0:
                    asks.setdefault(n, []).append((np.frombuffer(ids, "<i8"), np.frombuffer(codes, "<f8").reshape(-1, n), np.full((len(ids) // 8, top), -np.inf)))
                    continue
                chunk = Chunk.unpack(ids, rids, codes, cells)
                keep = np.frombuffer(telling, "<i4")
                chunk.ids, chunk.rids, chunk.codes = chunk.ids[keep], chunk.rids[keep], chunk.codes[keep]
                for q_ids, q, best in asks.get(n, ()):
                    for at in range(0, len(q_ids), 256):
                        part = slice(at, at + 256)
                        middle, radius = chunk.bounds(q[part])
                        middle = middle.astype(np.float64)
                        middle[q_ids[part][:, None] == chunk.ids[None, :]] = -np.inf
                        most = middle if middle.shape[1] <= top else np.partition(middle, -top, axis=1)[:, -top:]
                        best[part] = np.sort(np.concatenate([best[part], most - radius[:, None]], axis=1), axis=1)[:, -top:]
                        x, y = np.nonzero((middle + radius[:, None] >= best[part][:, :1]) & (middle > -np.inf))
                        score = middle[x, y]
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[part][x]), pa.array(chunk.rids[y]), pa.array(score - radius[x]), pa.array(score + radius[x])], ["qid", "rid", "lower", "upper"])

    return met.mapInArrow(scan, out)


def top_k(rows: DataFrame, queries: DataFrame, top: int = TOP, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``top`` rows for every query; both inputs have ``id`` and ``v``.

    ``read`` counts the exact vectors that were read for the query."""
    vectors = materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "v"), "vectors")
    asked = materialize(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    chunks = approximation_file(vectors, top)
    found = materialize(candidates(chunks, asked, top, block), "candidates")
    release(chunks)
    own = Window.partitionBy("qid")
    nth = F.row_number().over(own.orderBy(F.desc("lower")))
    limit = F.max(F.when(F.col("nth") == top, F.col("lower"))).over(own)
    wanted = materialize(found.withColumn("nth", nth).withColumn("limit", limit).filter(F.col("limit").isNull() | (F.col("upper") >= F.col("limit"))).select("qid", "rid", "upper"), "wanted")
    release(found)
    marks = vectors.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(F.xxhash64("rid").alias("h")).distinct()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(_marked(marks.value, batch.column(3).to_numpy()))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["rid", "id", "v"]).filter(hit)

    exact = vectors.select("rid", "id", "v", F.xxhash64("rid").alias("h")).mapInArrow(fetch, "rid long, id long, v array<double>")
    pairs = wanted.join(exact, "rid").select("qid", F.lit(1).alias("side"), "upper", "id", "v")
    heads = asked.select(F.col("id").alias("qid"), F.lit(0).alias("side"), F.lit(None).cast("double").alias("upper"), "id", "v")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = heads.unionByName(pairs).repartition(parts, "qid").sortWithinPartitions("qid", "side", F.desc("upper"), "id")
    out = "query_id long, rank int, vec_id long, score long, read long"
    schema = arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, best, count = None, None, [], 0
        done: list[tuple] = []

        def close() -> None:
            done.extend((now, k + 1, i, -s, count) for k, (s, i) in enumerate(best))

        for batch in batches:
            lists = batch.column(4)
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for k, (qid, side, upper, i) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if side == 0:
                    close()
                    now, q, best, count = qid, flat[at[k] : at[k + 1]].astype(np.int64), [], 0
                elif len(best) < top or upper >= -best[-1][0]:  # else the results are certain
                    count += 1
                    best.append((-int(flat[at[k] : at[k + 1]].astype(np.int64) @ q), i))
                    best.sort()
                    del best[top:]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], type=f.type) for c, f in enumerate(schema)], schema=schema)
            done.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], type=f.type) for c, f in enumerate(schema)], schema=schema)

    return ordered.mapInArrow(read, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("id") % QUERY_EVERY == 0)).drop("read")
