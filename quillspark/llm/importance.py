"""Quality selection by importance resampling.

Two generative models of hashed word and word-pair counts are compared: one of the target text (labelled good rows, at most
``SAMPLE`` of them) and one of the raw text, counted over all documents.  A document's log importance weight is the mean
log ratio of its n-grams under both, times ``SCALE``: every document counts as if it had ``SCALE`` n-grams, so that long ones
do not decide by their length alone and the noise has a say near the border.  Standard Gumbel noise from a hash of the id is
added, and the documents of the k greatest sums are the sample, drawn without replacement in proportion to the weights.

k is a parameter; if it is not given, it is the share of good rows among the labelled ones, of all rows.  The k-th greatest sum is
found exactly: sums are mapped to whole numbers of the same order and their digits counted, ``DIGIT`` bits at a time, so that
only counts reach the driver and nothing is sorted.  Ties go to the smaller id, then to the earlier stored row.

Defined cases: a null or empty text has log weight 0; a null id is passed through and loses ties; repeated rows have the same
weight, and the same noise if their ids are equal too; without labelled rows the two models are equal and all rows are kept; an
empty table gives no rows; columns of any name may come along, none is reserved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, release, table
from .features import labelled_sample, ngram_buckets

BUCKETS = 1 << 14
SAMPLE = 12_000
SCALE = 50.0
DIGIT = 16
SMOOTH = 1.0


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all n-gram buckets over the column ``text``; a fixed number of sums reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(ngram_buckets(t.as_py(), BUCKETS), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, type=pa.int32()), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability per bucket, both smoothed; zero without target text."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = target + SMOOTH, raw + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def with_weights(docs: DataFrame, ratio: np.ndarray, name: str) -> DataFrame:
    """All columns of ``docs`` and ``name``, the log weight."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)  # a fixed number of buckets
    at = docs.columns.index("text")
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            weights = []
            for t in batch.column(at):
                buckets = ngram_buckets(t.as_py(), BUCKETS)
                weights.append(float(w[buckets].mean()) * SCALE if len(buckets) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, type=pa.float64())], [*batch.schema.names, name])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, out)


def gumbel(*key: Column) -> Column:
    """Standard Gumbel noise from a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), *key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth(rows: DataFrame, columns: list[str], k: int) -> list[int]:
    """Values of the long ``columns`` in the k-th row (from 1) of their ascending order, of at least k rows.

    Digits are counted from the highest, so at most ``2 ** DIGIT`` counts reach the driver at a time.  As soon as all rows that
    agree so far are among the k, the digits and columns left are given their greatest value."""
    found, todo, rest = [], k, rows
    for name in columns:
        value, whole = 0, False
        for shift in range(64 - DIGIT, -1, -DIGIT):
            digit = F.shiftrightunsigned(F.col(name).bitwiseXOR(F.lit(-(1 << 63))), shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            if whole:
                value = value << DIGIT | (1 << DIGIT) - 1
                continue
            for r in sorted(rest.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()):
                if todo <= r.n:
                    break
                todo -= r.n
            value, whole = value << DIGIT | r.d, todo == r.n
            rest = rest.filter(digit == r.d)
        found.append(value - (1 << 63))
        if whole:
            break
    return found + [(1 << 63) - 1] * (len(columns) - len(found))


def models(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The log ratio per bucket, and the share of good rows among the labelled ones (1 without any)."""
    sample = materialize(labelled_sample(docs, labels, "quality", most), "quality")
    good, n = sample.agg(F.count(F.when(F.col("y") == 1, 1)), F.count("*")).first()
    ratio = log_ratio(bucket_counts(sample.filter("y = 1")), bucket_counts(docs))
    release(sample)
    return ratio, good / n if good else 1.0


def drawn(docs: DataFrame, labels: DataFrame, k: int | None = None) -> tuple[DataFrame, list[str], Column, Column]:
    """A stored table of the rows of ``docs`` with weights, the names of its three added columns (row number, log weight, sum),
    and two of its expressions: the sum, and whether the row is among the k."""
    ratio, share = models(docs, labels)
    number, weight, total = free_name(docs, "row"), free_name(docs, "log_weight"), free_name(docs, "sum")
    rows = with_weights(docs, ratio, weight)
    key = F.col(weight) + gumbel(F.col("doc_id").cast("long"))
    fixed = F.round(key * float(1 << 40)).cast("long")  # sums are compared at this step
    stored = materialize(rows.select(*docs.columns, F.monotonically_increasing_id().alias(number), weight, fixed.alias(total)), "weighed")
    n = stored.count()
    k = math.ceil(share * n) if k is None else k
    order = [-F.col(total), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.col(number)]
    if k >= n:
        chosen = F.lit(True)
    elif k <= 0:
        chosen = F.lit(False)
    else:
        a, b, c = kth(stored.select(*[x.alias(f"k{i}") for i, x in enumerate(order)]), ["k0", "k1", "k2"], k)
        chosen = (order[0] < a) | (order[0] == a) & ((order[1] < b) | (order[1] == b) & (order[2] <= c))
    return stored, [number, weight, total], F.col(total) / float(1 << 40), chosen


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """``doc_id``, ``log_weight``, ``gumbel_key``, ``selected`` (0 or 1) of every document."""
    stored, (_, weight, _), key, chosen = drawn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, k)
    return stored.select("doc_id", F.col(weight).alias("log_weight"), key.alias("gumbel_key"), chosen.cast("int").alias("selected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The selected rows of ``docs``, with their columns."""
    stored, _, _, chosen = drawn(docs, labels, k)
    return stored.filter(chosen).select(*docs.columns)
