"""Toxicity scores from weak supervision.

Many voters look at a document: one per lexicon word, one per pattern, one per word or beginning of a word that labelled
training rows show to be telling, and one that fires where no other does.  A voter that does not fire abstains, which says
nothing.  A generative label model with a firing rate per class and voter is fitted by expectation maximisation over the
votes of the training rows: the class of a row is latent, its given label has no vote.  Labels of training rows serve as a weak
prior, worth ``PRIOR_ROWS`` rows of each class, so that the latent class stays the labelled notion, and for the share of
the classes.  Voters that stay correlated within the classes are not independent evidence: each one's log ratio is divided by the
sum of its positive residual correlations.  The posteriors train a logistic regression on votes and hashed words, which
scores every document; its intercept is moved so that the cut of 0.3 is the best one on the labels of the training rows.

Fitting uses at most ``SAMPLE`` labelled rows (a parameter), none of them held out.  Executors turn their texts into votes and
numbers of words; no text reaches the driver.  Scoring covers all rows.

Defined cases: a null or empty text has no words and gets the score of the voter that fires alone; a null id counts as the empty
string for the fold and is passed through; repeated rows are scored alike; without labels every row gets one score below the cut;
an empty table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, fold_bucket, materialize, release, table
from .features import PARTS, labelled_sample

FOLDS, HELD_OUT = 4, 2
SAMPLE = 8_000
MINED = 120
PREFIXES = (4, 6, 7)
BUCKETS = 1 << 15
THRESHOLD = 0.3
PRIOR_ROWS = 100.0
#: Abusive words by language.
LEXICON = """
idiot idiots moron morons stupid loser losers scum clown trash worthless pathetic disgusting dumb fool filthy garbage vermin
shut hate kill die ugly disgrace coward liar pig rat parasite
idiot dumm blöd trottel abschaum wertlos ekelhaft erbärmlich müll versager clown widerlich
idiote stupide imbécile minable ordure dégoûtant pathétique perdant crétin clown
idiota estúpido imbécil basura patético asqueroso perdedor inútil escoria payaso
""".split()
#: Patterns of address, threat and shouting.
PATTERNS = (r"\byou(?:'re| are)? (?:a|an|such|all)\b", r"\bgo (?:to hell|away|die)\b", r"!{2,}", r"\b(?:[A-Z]{4,}\s+){2,}", r"\bf[*u]+[c*]*k")


class Voters:
    """Lexicon, mined and pattern voters, and last the one that fires alone; a vote is 1, to abstain is 0."""

    def __init__(self, words: list[str]):
        self.words = list(dict.fromkeys(words))
        self.at = {w: i for i, w in enumerate(self.words)}
        self.patterns = [re.compile(p) for p in PATTERNS]
        self.count = len(self.words) + len(self.patterns) + 1

    def vote(self, text: str, parts: set[str]) -> np.ndarray:
        out = np.zeros(self.count, dtype=np.int8)
        for w in parts & self.at.keys():
            out[self.at[w]] = 1
        for k, p in enumerate(self.patterns):
            if p.search(text):
                out[len(self.words) + k] = 1
        out[-1] = not out.any()
        return out


class LabelModel:
    """Class prior, firing rates of the voters in both classes, and weights that discount correlated voters.

    labels: of the same rows, for the prior of the rates and the share of the classes only."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, rounds: int = 30, strength: float = PRIOR_ROWS):
        v, y = votes.astype(np.float64), labels.astype(np.float64)
        start = np.stack([((1 - y) @ v + 0.5) / ((1 - y).sum() + 5), (y @ v + 0.5) / (y.sum() + 5)])
        self.prior = float(np.clip(y.mean(), 1e-3, 0.5))
        self.rate, self.weight = start, np.ones(v.shape[1])
        for step in range(rounds):
            p = self.posterior(v)
            n = np.array([[(1 - p).sum()], [p.sum()]])
            self.rate = (np.stack([(1 - p) @ v, p @ v]) + strength * start) / (n + strength)
            if step % 5 == 0:
                self.weight = 1 / np.maximum(1, self.residual(v, p))

    def residual(self, v: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Per voter, one plus the sum of its clearly positive correlations within the classes."""
        expected = np.outer(1 - p, self.rate[0]) + np.outer(p, self.rate[1])
        d = v - expected
        norm = np.sqrt((d**2).sum(axis=0)) + 1e-9
        c = (d.T @ d) / np.outer(norm, norm)
        np.fill_diagonal(c, 0)
        return 1 + np.where(c > 0.1, c, 0).sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of the toxic class given what fires."""
        z = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * np.log(self.rate[1] / self.rate[0]))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def tokens_of(text: str) -> set[str]:
    """Distinct words of a text, and the beginnings of the longer ones (as ``^beginning``)."""
    words = set(PARTS.findall(text.lower()))
    return words.union(*[{f"^{w[:k]}" for w in words if len(w) > k} for k in PREFIXES])


def mine(sample: DataFrame, most: int = MINED) -> list[str]:
    """At most ``most`` tokens that are found far more often in toxic rows of ``sample`` (``text``, ``y``), best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[label == 1].update(tokens_of(text.as_py() or ""))
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), *[pa.array([c[w] for w in names], type=pa.int64()) for c in counts]], ["w", "n0", "n1"])

    total0, total1 = (F.greatest(F.lit(1), F.lit(int(n))) for n in sample.agg(F.count(F.when(F.col("y") != 1, 1)), F.count(F.when(F.col("y") == 1, 1))).first())
    words = sample.select("text", "y").mapInArrow(run, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.log((F.col("n1") + 0.5) / (total1 + 1)) - F.log((F.col("n0") + 0.5) / (total0 + 1))
    telling = words.withColumn("ratio", ratio).filter((F.col("n1") >= F.greatest(F.lit(5), F.floor(total1 / 100))) & (F.col("ratio") > 1.5))
    return [r.w for r in telling.orderBy(F.desc(F.col("ratio") * F.sqrt("n1")), "w").limit(most).collect()]


def word_features(tokens: set[str]) -> np.ndarray:
    """Buckets of distinct words and beginnings."""
    return np.unique(np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in tokens], dtype=np.int64))


class Linear:
    """Logistic regression on votes and on hashed words scaled by the square root of their number."""

    def __init__(self, voters: Voters):
        self.voters = voters
        self.bias, self.v, self.w = 0.0, np.zeros(voters.count), np.zeros(BUCKETS)

    def logit(self, votes: np.ndarray, words: np.ndarray) -> float:
        z = self.bias + float(votes @ self.v)
        return z + float(self.w[words].sum()) / max(1.0, len(words) ** 0.5)

    def fit(self, votes: np.ndarray, words: list[np.ndarray], target: np.ndarray, steps: int = 150, rate: float = 1.0, l2: float = 1e-4) -> Linear:
        """Gradient descent with momentum on the soft labels."""
        row = np.repeat(np.arange(len(words)), [len(x) for x in words])
        col = np.concatenate([*words, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        scale = np.array([1 / max(1.0, len(x) ** 0.5) for x in words])
        v, n = votes.astype(np.float64), max(1, len(words))
        speed = [0.0, np.zeros_like(self.v), np.zeros_like(self.w)]
        for _ in range(steps):
            z = self.bias + v @ self.v + scale * np.bincount(row, self.w[col], minlength=len(words))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
            step = (g.sum(), g @ v + l2 * self.v, np.bincount(col, (g * scale)[row], minlength=BUCKETS) + l2 * self.w)
            speed = [0.9 * s - rate * x for s, x in zip(speed, step, strict=True)]
            self.bias, self.v, self.w = self.bias + speed[0], self.v + speed[1], self.w + speed[2]
        return self

    def calibrate(self, votes: np.ndarray, words: list[np.ndarray], labels: np.ndarray) -> Linear:
        """Move the intercept so that ``THRESHOLD`` lies midway between the rows around the cut of the best F1."""
        z = np.array([self.logit(v, w) for v, w in zip(votes, words, strict=True)])
        cuts, first = np.unique(-z, return_inverse=True)
        hit, all_ = np.cumsum(np.bincount(first, labels)), np.cumsum(np.bincount(first))
        k = int(np.argmax(2 * hit / (all_ + labels.sum())))
        cut = -(cuts[k] + cuts[min(k + 1, len(cuts) - 1)]) / 2 if labels.any() else z.max() + 1
        self.bias += float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
        return self

    def score(self, text: str) -> float:
        tokens = tokens_of(text)
        votes = self.voters.vote(text, tokens)
        return 1 / (1 + float(np.exp(-np.clip(self.logit(votes, word_features(tokens)), -30, 30))))


def fit(votes: np.ndarray, words: list[np.ndarray], labels: np.ndarray, voters: Voters) -> Linear:
    """The classifier from the votes, words and labels of training rows."""
    model = Linear(voters)
    if not len(labels):
        model.bias = -2.0
        return model
    return model.fit(votes, words, LabelModel(votes, labels).posterior(votes)).calibrate(votes, words, labels)


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    out = "doc_id long, held_out boolean, score double, predicted int"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            scores = [m.score(t.as_py() or "") for t in batch.column(1)]
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in ids]
            cols = (ids, held, scores, [int(s >= THRESHOLD) for s in scores])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def examples(sample: DataFrame, voters: Voters) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Votes, words and labels of the rows of ``sample`` (``doc_id``, ``text``, ``y``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, words = [], []
            for text in batch.column(1):
                tokens = tokens_of(text.as_py() or "")
                votes.append(voters.vote(text.as_py() or "", tokens).tobytes())
                words.append(word_features(tokens).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(votes, type=pa.binary()), pa.array(words, type=pa.binary())], ["doc_id", "y", "votes", "words"])

    # at most SAMPLE rows, each of at most BUCKETS numbers
    rows = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, votes binary, words binary").orderBy("doc_id", "votes", "words").collect()
    votes = np.frombuffer(b"".join(r.votes for r in rows), dtype=np.int8).reshape(len(rows), voters.count)
    return votes, [np.frombuffer(r.words, dtype="<u2").astype(np.int64) for r in rows], np.array([r.y for r in rows], dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Linear:
    """The classifier, from at most ``most`` labelled rows that are not held out."""
    rows = labelled_sample(docs, labels, "toxic", most, lambda i: fold_bucket(i, FOLDS) != HELD_OUT)
    sample = materialize(rows.select("doc_id", "text", (F.col("y") == 1).cast("int").alias("y")), "toxic")
    voters = Voters(LEXICON + mine(sample))
    votes, words, y = examples(sample, voters)
    release(sample)
    return fit(votes, words, y, voters)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
