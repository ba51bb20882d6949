"""Operator 3: toxicity by a counterfactual-regularised logistic classifier.

Features are words (letters and digits, lower case) and word beginnings that the labelled
sample ties to the label, and all identity terms; a feature's value is the log of its share
of the words. A text is scored as a whole and by overlapping windows of ``WINDOW`` words,
and the highest score is the text's: a toxic passage counts alike in a short and a very long
text. Learning goes the same way: after a first fit on whole texts each labelled text adds
its highest piece under the model so far, and the fit is made again.

Every labelled piece that mentions a group is paired with its counterfactual, the same piece
with each identity term swapped for another of its list; the loss adds the squared
difference of the two logits. A group's mention then can't move a score much, however the
labelled texts happen to use it.

Learning reads a bounded sample: the ``SAMPLE`` labelled rows of least id hash (all, where
there are fewer). It is small enough to broadcast against the documents and to fit on the
driver; its texts stay on the executors, which send back the numbers of the features each
holds. Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.llm.store import keep, ship

SAMPLE = 20_000
MAX_FEATURES = 400
LEAST_TEXTS = 3          # labelled texts that must hold a word
LEAST_Z = 3.0            # two-proportion z score of a feature against the label
STEMS = (4, 5, 6, 7)     # lengths of the word beginnings
PER = 500                # a feature's value is log(1 + PER * its share of the words)
RIDGE = 0.1
COUNTERFACTUAL = 4.0
WINDOW = 150             # words of a window
STEP = 50                # words from one window to the next
REFITS = 1               # fits on whole texts and highest pieces, after the one on whole texts
MEMO = 500_000           # words whose features a worker remembers
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")

# Identity terms, by list; a term is swapped for the next one of its list.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girl", "boy"), ("girls", "boys"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"), ("transgender", "trans", "cisgender", "nonbinary"),
    ("black", "white", "asian", "latino", "latina", "hispanic", "african", "european", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "sikhs", "atheists"),
    ("american", "mexican", "chinese", "indian", "german", "french", "russian", "turkish", "polish", "nigerian"),
    ("immigrant", "migrant", "refugee", "foreigner", "citizen"), ("immigrants", "migrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "autistic", "paralyzed"), ("old", "young", "elderly", "teenage"),
)
SWAP = {term: terms[(i + 1) % len(terms)] for terms in IDENTITY_TERMS for i, term in enumerate(terms)}


def words(text: str | None) -> list[str]:
    """The words of a whole text."""
    return _WORD.findall((text or "").lower())


def features_of(word: str) -> list[str]:
    """A word's features: itself, and its beginnings marked by a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


@lru_cache(100_000)
def value(count: int, n_words: int) -> float:
    return math.log1p(PER * count / n_words)


def pieces(n_words: int) -> list[tuple[int, int]]:
    """Word ranges that a text is scored over: all of it, and its windows; the last ends with the text."""
    if n_words <= WINDOW:
        return [(0, n_words)]
    return [(0, n_words), *((a, a + WINDOW) for a in range(0, n_words - WINDOW, STEP)), (n_words - WINDOW, n_words)]


class Numbers(dict):
    """Word -> numbers of its chosen features, for the words met most recently."""

    def __init__(self, features: list[str]):
        super().__init__()
        self.number = {f: i for i, f in enumerate(features)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = tuple(self.number[f] for f in features_of(word) if f in self.number)
        return found

    def counts(self, found: list[str]) -> Counter:
        return Counter(chain.from_iterable(filter(None, map(self.__getitem__, found))))


def training_fold(doc_id: Column, folds: int, held_out: int) -> Column:
    """False for the rows whose crc32 of the id as text leaves ``held_out``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != held_out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [sorted({f for w in set(words(x)) for f in features_of(w)}) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.string()))], names=["toxic", "text", "features"])


_NUMBERED = pa.schema([("toxic", pa.int32()), ("mine_at", pa.list_(pa.int32())), ("mine_is", pa.list_(pa.float64())),
                       ("other_at", pa.list_(pa.int32())), ("other_is", pa.list_(pa.float64()))])


class Model:
    """Weights of the chosen features and a bias."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.features = [f for f, w in zip(features, weights) if w]
        self.weights = [float(w) for w in weights if w]
        self.bias = float(bias)
        self.numbers: Numbers | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"numbers": None}

    def highest(self, found: list[str]) -> tuple[float, int, int]:
        """The highest logit over a text's pieces, and the first piece that has it."""
        if self.numbers is None:
            self.numbers = Numbers(self.features)
        held = [(i, numbers) for i, numbers in enumerate(map(self.numbers.__getitem__, found)) if numbers]
        at = [i for i, _ in held]
        best, before = None, None
        for start, end in pieces(len(found)):
            first, last = bisect_left(at, start), bisect_left(at, end)
            if before == (first, last, end - start):
                continue
            before = first, last, end - start
            counts = Counter(chain.from_iterable(numbers for _, numbers in held[first:last]))
            logit = self.bias + sum(self.weights[i] * value(c, end - start) for i, c in sorted(counts.items()))
            if best is None or logit > best[0]:
                best = logit, start, end
        return best

    def score(self, text: str | None) -> float:
        logit = self.highest(words(text))[0]
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, logit))))


def fit(rows: list[dict[int, float]], swapped: list[dict[int, float]], labels: np.ndarray, n_features: int,
        ridge: float = RIDGE, penalty: float = COUNTERFACTUAL, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps with backtracking on the regularised log loss.

    ``rows`` and ``swapped`` hold the feature values of the texts and of their
    counterfactuals. The loss is ``sum(logloss) + ridge/2 |w|^2 + penalty/2 sum((w.(x-x'))^2)``.
    """
    n = len(rows)
    x = np.zeros((n, n_features + 1))
    x[:, -1] = 1
    for i, row in enumerate(rows):
        for k, v in row.items():
            x[i, k] = v
    changed = [i for i in range(n) if rows[i] != swapped[i]]
    gap = np.zeros((len(changed), n_features + 1))
    for k, i in enumerate(changed):
        for f, v in rows[i].items():
            gap[k, f] += v
        for f, v in swapped[i].items():
            gap[k, f] -= v
    still = penalty * gap.T @ gap + ridge * np.diag(np.r_[np.ones(n_features), 1e-6])
    w = np.zeros(n_features + 1)
    w[-1] = np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - labels * z).sum() + 0.5 * w @ still @ w)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (p - labels) + still @ w
        curve = (x * (p * (1 - p))[:, None]).T @ x + still
        move = np.linalg.solve(curve + 1e-9 * np.eye(len(w)), gradient)
        step = 1.0
        while step > 1e-6 and loss(w - step * move) > now:
            step /= 2
        if step <= 1e-6 or now - loss(w - step * move) < 1e-7 * max(1.0, now):
            break
        w = w - step * move
        now = loss(w)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Model:
    """Fit the classifier on ``labels(doc_id, toxic)`` outside the held-out fold."""
    ship(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    chosen = (usable.where(training_fold(F.col("doc_id"), folds, held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bags = keep(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text").distinct().mapInArrow(_bags, "toxic int, text string, features array<string>"), "bags")
    total = {r["toxic"]: r["n"] for r in bags.df.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = total.get(1, 0), sum(n for t, n in total.items() if t != 1)
    if not n1 or not n0:
        bags.drop()
        return Model([], np.zeros(0), np.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else 0.0)
    share = F.col("texts") / (n1 + n0)
    z = (F.col("toxic_texts") / n1 - (F.col("texts") - F.col("toxic_texts")) / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    found = (bags.df.select((F.col("toxic") == 1).cast("int").alias("t"), F.explode("features").alias("feature")).groupBy("feature")
             .agg(F.count(F.lit(1)).alias("texts"), F.sum("t").alias("toxic_texts"))
             .where((F.col("texts") >= LEAST_TEXTS) & (F.col("texts") < n1 + n0)).withColumn("z", z).where(F.abs("z") >= LEAST_Z)
             .orderBy(F.abs("z").desc(), "feature").limit(MAX_FEATURES).collect())
    features = sorted({r["feature"] for r in found} | SWAP.keys())

    def numbered(so_far: Model | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = Numbers(features)
            for batch in batches:
                for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = words(text)
                    if so_far is not None:
                        _, start, end = so_far.highest(found)
                        found = found[start:end]
                    mine, other = numbers.counts(found), numbers.counts([SWAP.get(w, w) for w in found])
                    yield pa.RecordBatch.from_pylist([{"toxic": toxic, **{
                        f"{name}_{part}": [v if part == "at" else value(v, len(found)) for v in (sorted(c) if part == "at" else (c[k] for k in sorted(c)))]
                        for name, c in (("mine", mine), ("other", other)) for part in ("at", "is")}}], schema=_NUMBERED)
        return run

    model, whole = None, []
    for _ in range(1 + REFITS):
        rows = whole + sorted(tuple(r) for r in bags.df.select("toxic", "text").mapInArrow(
            numbered(model), "toxic int, mine_at array<int>, mine_is array<double>, other_at array<int>, other_is array<double>").collect())
        weights, bias = fit([dict(zip(r[1], r[2])) for r in rows], [dict(zip(r[3], r[4])) for r in rows], np.array([float(r[0] == 1) for r in rows]), len(features))
        model, whole = Model(features, weights, bias), whole or rows
    bags.drop()
    return model


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs(doc_id, text, ...)``.

    Only ``text`` enters a score, in full: the highest of the whole text's score and its
    windows'. Null and empty texts score the model's bias.
    Repeated rows and null ids are scored like any other; other columns are not read.
    With no usable labels, or of one kind only, all texts get the same score: 0.5, or
    the labels' smoothed share.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(x) for x in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
