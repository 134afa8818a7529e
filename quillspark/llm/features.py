"""Hashed word features of whole texts, shared by the two classifiers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = re.compile(r"\w+|[^\w\s]+")
MEMO = 400_000
_HASH: dict[str, int] = {}


def part_hashes(text: str | None) -> np.ndarray:
    """A 32-bit hash of every word and every run of symbols, lower-cased."""
    parts = PARTS.findall((text or "").lower())
    memo = _HASH
    if len(memo) > MEMO:
        memo.clear()
    out = []
    for p in parts:
        h = memo.get(p)
        if h is None:
            h = memo[p] = zlib.crc32(p.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, dtype=np.uint64)


def ngram_buckets(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of all words and word pairs of a text."""
    h = part_hashes(text)
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    x = h * np.uint64(0x9E3779B97F4A7C15)
    pairs = (x[:-1] ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))) * np.uint64(0xFF51AFD7ED558CCD)
    both = np.concatenate([x, pairs])
    return ((both >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, keep=None) -> DataFrame:
    """``doc_id``, ``text``, ``y`` of at most ``most`` labelled documents, the first in the order of a hash of their id."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    if keep is not None:
        chosen = chosen.filter(keep(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of two numbers


def auc(scores: Iterable[float], truth: Iterable[int]) -> float:
    """Area under the ROC curve, ties counted half."""
    s, t = np.asarray(list(scores), dtype=float), np.asarray(list(truth)) == 1
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    _, inverse = np.unique(s, return_inverse=True)
    mean = np.bincount(inverse, ranks) / np.bincount(inverse)
    p, n = t.sum(), (~t).sum()
    return float((mean[inverse][t].sum() - p * (p + 1) / 2) / (p * n)) if p and n else 0.5
