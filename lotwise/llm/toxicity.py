"""Toxicity by a classifier chain.

The categories are predicted one after another. Each has a linear model over words, word beginnings, punctuation
and a few shares of the text, plus the log-odds of the categories before it. In training those odds come out of
fold, so a later model sees them as unsure as they will be on new texts.

The models are fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of their key; everything else reads
all rows. Features are picked by their evidence in that sample. Scoring needs no shuffle.

NULL, empty and blank texts have no features and get the models' answer to an empty text. Labelled rows with a
NULL label are left out; a category seen with one value only always has that value; without labelled rows every
probability is 0. Repeated rows get equal answers; texts are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.corpus import DOUBLE, slices, unused, with_text_columns

# Labelled documents that a chain is fitted on, at most.
SAMPLE = 10_000
# Features per category, documents a feature must be in, folds and ridge of the linear models.
PICKED = 1_500
LEAST_DOCS = 4
FOLDS = 5
RIDGE = 1.0
# Tokens remembered by a worker, text bytes cut at a time.
REMEMBERED = 150_000
BATCH_BYTES = 4 << 20
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _mark(kind: bytes, text: str) -> int:
    return xxhash.xxh64_intdigest(kind + text.encode()) >> 1


def token_features(token: bytes) -> tuple[int, ...]:
    """Hashed features of one token: its word, the word's beginnings, the punctuation around it and capitals."""
    whole = token.decode()
    core = whole.strip(PUNCTUATION)
    low = core.lower()
    out = []
    if low:
        out.append(_mark(b"w", low))
    out += [_mark(b"p", low[:n]) for n in (4, 5) if len(low) > n]
    if len(core) < len(whole):
        out.append(_mark(b"m", whole.replace(core, " ", 1) if core else whole))
    if len(core) > 1 and core.isupper():
        out.append(_mark(b"s", "capitals"))
    return tuple(out)


def shares(tokens: list[bytes], distinct: set[bytes]) -> list[float]:
    """Dense features of a text: tokens (log), distinct, capital and non-letter shares."""
    n = len(tokens)
    if not n:
        return [0.0] * 4
    upper = sum(t.isupper() and len(t) > 1 for t in tokens)
    ended = sum(not (t[-1:].isalnum() or t[-1] > 127) for t in tokens)
    return [float(np.log1p(n)) / 10, len(distinct) / n, upper / n, ended / n]


@dataclass
class Linear:
    """Log-odds of one category: intercept, weights of picked features, of shares and of earlier log-odds."""

    intercept: float
    weights: np.ndarray
    dense: np.ndarray


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _logistic(owner: np.ndarray, column: np.ndarray, dense: np.ndarray, y: np.ndarray, features: int) -> Linear:
    """Ridge logistic regression by L-BFGS over 0/1 features (``owner``, ``column``) and dense columns."""
    n, width = len(y), dense.shape[1]
    if not n or y.min() == y.max():
        return Linear(30.0 if n and y[0] else -30.0, np.zeros(features), np.zeros(width))
    size = 1 + features + width

    def split(w: np.ndarray) -> np.ndarray:
        return w[0] + np.bincount(owner, w[1 + column], minlength=n) + dense @ w[1 + features :]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = split(w)
        r = _sigmoid(z) - y
        grad = np.concatenate([[r.sum()], np.bincount(column, r[owner], minlength=features), dense.T @ r])
        grad[1:] += RIDGE * w[1:]
        return float(np.logaddexp(0, z).sum() - y @ z + RIDGE / 2 * (w[1:] @ w[1:])), grad

    w = np.zeros(size)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    value, grad = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(200):
        if np.abs(grad).max() < 1e-4 * n**0.5:
            break
        way, alphas = -grad, []
        for s, g in reversed(steps):
            alphas.append(s @ way / (s @ g))
            way = way - alphas[-1] * g
        if steps:
            s, g = steps[-1]
            way *= s @ g / (g @ g)
        else:
            way /= max(1.0, np.linalg.norm(way))
        for (s, g), a in zip(steps, reversed(alphas), strict=True):
            way = way + (a - g @ way / (s @ g)) * s
        slope, size_ = grad @ way, 1.0
        while True:
            new_value, new_grad = loss(w + size_ * way)
            if new_value <= value + 1e-4 * size_ * slope or size_ < 1e-10:
                break
            size_ /= 2
        if size_ < 1e-10:
            break
        s, g = size_ * way, new_grad - grad
        w, value, grad = w + s, new_value, new_grad
        if s @ g > 1e-12:
            steps = [*steps[-9:], (s, g)]
    return Linear(float(w[0]), w[1 : 1 + features], w[1 + features :])


@dataclass
class Chain:
    """Linear models in the order of their categories, over the same picked features."""

    names: list[str]
    place: dict[int, int]  # of picked features
    models: list[Linear]
    threshold: float = 0.5  # of the last category's probability
    memory: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def picked(self, tokens: set[bytes]) -> set[int]:
        """Places of the picked features that tokens have."""
        memory, place = self.memory, self.place
        if len(memory) > REMEMBERED:
            memory.clear()
        for t in tokens.difference(memory):
            memory[t] = tuple(place[f] for f in token_features(t) if f in place)
        return set().union(*map(memory.__getitem__, tokens))

    def log_odds(self, text: bytes) -> list[float]:
        """Of each category, in order."""
        if not self.models:
            return [-np.inf] * len(self.names)
        tokens = text.split()
        distinct = set(tokens)
        at = np.fromiter(self.picked(distinct), np.int64)
        dense, out = shares(tokens, distinct), []
        for model in self.models:
            out.append(float(model.intercept + model.weights[at].sum() + model.dense @ np.array([*dense, *_bounded(out)])))
        return out


def _bounded(odds: list[float]) -> list[float]:
    """Earlier log-odds as features of later models."""
    return [max(-6.0, min(6.0, z)) for z in odds]


def _evidence(text: str, labels: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: (feature, documents with it, documents of each category with it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(len(labels) + 1)]
        for batch in batches:
            for part, found in slices(batch, text, BATCH_BYTES):
                truth = [part.column(part.schema.get_field_index(c)).to_pylist() for c in labels]
                for row, t in enumerate(found):
                    own = set().union(*map(token_features, set(t.split())))
                    for count, yes in zip(counts, [True, *[v[row] for v in truth]], strict=True):
                        if yes:
                            count.update(own)
        features = list(counts[0])
        columns = [pa.array(features, pa.int64()), *[pa.array([c[f] for f in features], pa.int64()) for c in counts]]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "n", *[f"n_{i}" for i in range(len(labels))]])

    return run


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """A chain over ``categories``, in order: name and SQL condition on a row of ``labels`` (NULL: row left out).

    At most ``sample`` labelled documents take part, those whose key has the smallest hash. A key that
    is labelled twice counts with its smallest values.
    """
    names = list(categories)
    truth = [f"__y{i}" for i in range(len(names))]
    told = labels.select(F.col(key).alias("__key"), *[F.expr(c).cast("int").alias(y) for y, c in zip(truth, categories.values(), strict=True)])
    told = told.dropna().groupBy("__key").agg(*[F.min(y).alias(y) for y in truth])
    chosen = told.orderBy(F.xxhash64("__key"), "__key").limit(sample)
    # One row of each chosen document: the smallest text of a repeated key.
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key")
    rows = rows.groupBy("__key", *truth).agg(F.min("text").alias("text")).persist()
    kinds = ", ".join(["feature long", "n long", *[f"n_{i} long" for i in range(len(names))]])
    counts = rows.select("text", *truth).mapInArrow(_evidence("text", truth), kinds).groupBy("feature").sum()
    counts = counts.toDF("feature", "_f", "n", *[f"n_{i}" for i in range(len(names))]).where(F.col("n") >= LEAST_DOCS)
    totals = rows.agg(F.count(F.lit(1)), *[F.sum(y) for y in truth]).first()
    if not totals[0]:
        rows.unpersist()
        return Chain(names, {}, [])
    total, picked = float(totals[0]), set()
    for i in range(len(names)):  # by how far a feature is from independent of the category, in squared deviations
        share = float(totals[i + 1]) / total
        excess = F.col(f"n_{i}") - F.col("n") * share
        spread = F.col("n") * (1 - F.col("n") / (total + 1)) * max(share * (1 - share), 1e-9)
        best = counts.orderBy(F.desc(excess * excess / spread), "feature").limit(PICKED)
        picked.update(r.feature for r in best.select("feature").collect())
    place = {f: i for i, f in enumerate(sorted(picked))}
    owner, column, dense, y, fold = _collected(rows, place, truth)
    rows.unpersist()
    models = []
    for i in range(len(names)):
        models.append(_logistic(owner, column, dense, y[:, i], len(place)))
        odds = _out_of_fold(owner, column, dense, y[:, i], len(place), fold)
        dense = np.column_stack([dense, np.clip(odds, -6, 6)])
    return Chain(names, place, models, _best_threshold(odds, y[:, -1]))


def _best_threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """The probability above which calling a row positive gives the best F1 out of fold, midway to the next row."""
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    if not len(y) or not hits[-1] or hits[-1] == len(y):
        return 0.5
    best = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + hits[-1])))
    cut = odds[order[best : best + 2]].mean()
    return float(_sigmoid(np.array([cut]))[0])


def _out_of_fold(owner, column, dense, y, features: int, fold: np.ndarray) -> np.ndarray:
    """Log-odds of every row by a model fitted without its fold."""
    odds = np.zeros(len(y))
    for f in range(FOLDS):
        held = fold == f
        rest = ~held[owner]
        new = np.cumsum(~held) - 1
        model = _logistic(new[owner[rest]], column[rest], dense[~held], y[~held], features)
        all_ = model.intercept + np.bincount(owner, model.weights[column], minlength=len(y)) + dense @ model.dense
        odds[held] = all_[held]
    return odds


def _collected(rows: DataFrame, place: dict[int, int], truth: list[str]):
    """The sample as arrays: (row, feature) pairs, dense shares, labels and folds."""
    shared = rows.sparkSession.sparkContext.broadcast(Chain([], place, []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for part, found in slices(batch, "text", BATCH_BYTES):
                at, dense = [], []
                for t in found:
                    tokens = t.split()
                    distinct = set(tokens)
                    at.append(sorted(chain.picked(distinct)))
                    dense.append(shares(tokens, distinct))
                made = [pa.array(at, pa.list_(pa.int32())), pa.array(dense, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=[*part.schema.names[1:], "at", "dense"])

    wide = ", ".join(["key string", *[f"{y} int" for y in truth], "at array<int>", "dense array<double>"])
    got = rows.select("text", F.col("__key").cast("string").alias("key"), *truth).mapInArrow(run, wide).toArrow()
    order = np.argsort(np.array(got["key"].to_pylist()), kind="stable")
    got = got.take(pa.array(order))
    sizes = got["at"].combine_chunks().value_lengths().to_numpy()
    owner = np.repeat(np.arange(got.num_rows), sizes)
    column = got["at"].combine_chunks().flatten().to_numpy().astype(np.int64)
    dense = np.array(got["dense"].to_pylist()).reshape(got.num_rows, -1)
    y = np.column_stack([got[c].to_numpy() for c in truth]).astype(float)
    fold = np.array([zlib.crc32(k.encode()) % FOLDS for k in got["key"].to_pylist()])
    return owner, column, dense, y, fold


def scored(docs: DataFrame, chain: Chain, columns: Sequence[str], text: str = "text") -> DataFrame:
    """``docs`` plus the probability of each category, in order, named by ``columns``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def prepare():
        own = shared.value

        def work(found: list[bytes]) -> list:
            return list(_sigmoid(np.array([own.log_odds(t) for t in found]).reshape(-1, len(columns))).T)

        return work

    return with_text_columns(docs, text, [(c, *DOUBLE) for c in columns], prepare, BATCH_BYTES)


def without_toxic(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The documents whose last category is less likely than the chain's threshold, as they are."""
    columns = unused(docs, *[f"__p{i}" for i in range(len(chain.names))])
    return scored(docs, chain, columns, text).where(F.col(columns[-1]) < chain.threshold).select(*docs.columns)
