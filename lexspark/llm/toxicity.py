"""Toxicity: a classifier chain over categories.

The labels know one kind of toxicity, so its categories are learned: toxic documents of the labelled sample that share
telling words fall into groups, in any language. Each group's category, and last the label itself, has a linear model of
the words and word beginnings that a document holds and of their share in it; a model also gets the probabilities of the
categories before it. In training these are out-of-fold predictions, so that a later model sees earlier ones as unsure
as they will be on new texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import give_back, small_batches, table, text_or_empty
from lexspark.llm.quality import labelled_sample

_word = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ChainConfig:
    """`groups`: how many categories go before the label's own. `sample` bounds the labelled rows of each class that are
    fitted; `least` drops features of fewer sampled texts (of fewer than a quarter of the toxic ones, if that is less), and
    `telling` those whose share among a category's texts is fewer standard errors away from the others'. `shares` are the
    shares of a document's words from which on a stem also counts as frequent."""

    groups: int = 2
    sample: int = 1500
    least: int = 5
    shares: tuple[float, ...] = (0.004, 0.0125)
    folds: int = 3
    steps: int = 60
    rate: float = 0.5
    l1: float = 1e-4
    telling: float = 4.0
    seed: int = 11


@dataclass
class ToxicityChain:
    """For each hashed stem with a weight its weights (levels of share x categories), the categories' biases, and each
    model's weights of earlier probabilities."""

    names: list[str]
    shares: tuple[float, ...]
    weights: dict[int, np.ndarray]
    biases: list[float]
    earlier: list[list[float]] = field(default_factory=list)

    def predict(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities, category by category, from each document's sums of weights."""
        out = np.zeros_like(sums)
        for c in range(len(self.names)):
            z = sums[:, c] + self.biases[c] + (out[:, :c] @ np.array(self.earlier[c][:c]) if c else 0)
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def stems(token: str) -> list[int]:
    """The words in a token and their beginnings of four to six letters, which stand for a stem in all its forms; hashed."""
    out = []
    for word in _word.findall(token):
        out += [zlib.crc32(s.encode("utf-8", "surrogatepass")) for s in (word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n))]
    return out


def _told(at: np.ndarray, rows: np.ndarray, n: int, width: int, y: np.ndarray, config: ChainConfig) -> np.ndarray:
    """For each feature how many standard errors its share among the positive rows is above that among the others."""
    ones, every = np.bincount(at, weights=y[rows], minlength=width), np.bincount(at, minlength=width)
    p1, p0, p = ones / y.sum(), (every - ones) / (n - y.sum()), every / n
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / y.sum() + 1 / (n - y.sum())) + 1e-12)
    return np.where(every > 1, z, 0.0)


def _fit(at: np.ndarray, rows: np.ndarray, n: int, width: int, extra: np.ndarray, y: np.ndarray, config: ChainConfig):
    """Logistic regression with an L1 penalty by accelerated proximal gradient; at, rows: the set cells of a 0/1 matrix."""
    if n == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (n + 1)
        return np.zeros(width), np.zeros(extra.shape[1]), np.log(p / (1 - p))
    told = np.abs(_told(at, rows, n, width, y, config)) >= config.telling
    full, back = width, np.flatnonzero(told)
    place = np.cumsum(told) - 1
    inside = told[at]
    at, rows, width = place[at[inside]], rows[inside], len(back)
    w, v, b = np.zeros(width), np.zeros(extra.shape[1]), np.log((y.mean() + 1e-3) / (1.001 - y.mean()))
    seen = np.bincount(at, minlength=width) + 1e-9
    size_w = config.rate * n / (seen + 0.02 * n)  # rarer words take larger steps
    mw, mv = w.copy(), v.copy()
    for step in range(config.steps):
        z = np.bincount(rows, weights=mw[at], minlength=n) + extra @ mv + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        new_w = mw - size_w * np.bincount(at, weights=r[rows], minlength=width)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - size_w * config.l1, 0)
        new_v = mv - config.rate * (extra.T @ r)
        b -= config.rate * r.sum()
        k = step / (step + 3)
        mw, mv, w, v = new_w + k * (new_w - w), new_v + k * (new_v - v), new_w, new_v
    out = np.zeros(full)
    out[back] = w
    return out, v, b


def _groups(at: np.ndarray, rows: np.ndarray, n: int, width: int, y: np.ndarray, config: ChainConfig) -> np.ndarray:
    """The group (from 0) of each positive row, -1 elsewhere: spherical k-means over the telling features that rows hold,
    from the row next to the mean on, each next centre being the row that is least like those before."""
    out = np.full(n, -1)
    pos = np.flatnonzero(y > 0)
    if not len(pos) or len(pos) == n:
        return out
    told = np.flatnonzero(_told(at, rows, n, width, y, config) >= config.telling)
    place = np.full(width, -1)
    place[told] = np.arange(len(told))
    cells = np.zeros((n, len(told)), np.float32)
    inside = place[at] >= 0
    cells[rows[inside], place[at[inside]]] = 1
    x = cells[pos]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    out[pos] = 0
    x, some = x / np.maximum(size, 1), size[:, 0] > 0
    if not some.any():
        return out
    centres = [x[int(np.argmax(np.where(some, x @ x.mean(axis=0), -1)))]]
    while len(centres) < config.groups:
        centres.append(x[int(np.argmin(np.where(some, (x @ np.array(centres).T).max(axis=1), 2)))])
    for _ in range(10):
        near = (x @ np.array(centres).T).argmax(axis=1)
        centres = [m / max(float(np.linalg.norm(m)), 1e-9) for m in (x[near == g].sum(axis=0) for g in range(config.groups))]
    out[pos] = (x @ np.array(centres).T).argmax(axis=1)
    return out


def train_chain(texts: list[str], toxic: list[int], config: ChainConfig = ChainConfig()) -> ToxicityChain:
    """Fits the chain to texts with labels 0 and 1."""
    known: dict[str, np.ndarray] = {}
    levels, n = 1 + len(config.shares), len(texts)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # stems, and how many of the levels presence, first share... they reach
    for text in texts:
        tokens = text.lower().split()
        counts = Counter(tokens)
        for token in counts:
            if token not in known:
                known[token] = np.array(stems(token), np.uint32)
        held = [known[t] for t in counts]
        have, where = np.unique(np.concatenate([np.zeros(0, np.uint32), *held]), return_inverse=True)
        times = np.bincount(where, weights=np.repeat([*counts.values()], [len(h) for h in held]), minlength=len(have))
        found.append((have, (1 + sum((times >= x * len(tokens)).astype(np.int8) for x in config.shares)).astype(np.int8)))
    del known
    least = min(config.least, max(2, sum(toxic) // 4))
    kept, seen = np.unique(np.concatenate([np.zeros(0, np.uint32), *(have for have, _ in found)]), return_counts=True)
    kept = kept[seen >= least]
    at, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i, (have, reached) in enumerate(found):
        inside = np.isin(have, kept, assume_unique=True)
        first, reached = levels * np.searchsorted(kept, have[inside]), reached[inside]
        cells = np.concatenate([first[reached > j] + j for j in range(levels)]).astype(np.int32)
        at.append(cells)
        rows.append(np.full(len(cells), i, np.int32))
    del found
    at, rows, width = np.concatenate(at), np.concatenate(rows), max(1, levels * len(kept))
    label = np.array(toxic, float)
    group = _groups(at, rows, n, width, label, config)
    fold = np.random.default_rng(config.seed).permutation(n) % config.folds
    before = np.zeros((n, 0))
    names = [*(f"group_{g + 1}" for g in range(config.groups)), "toxic"]
    weights, biases, earlier = [], [], []
    for y in [*((group == g).astype(float) for g in range(config.groups)), label]:
        out = np.zeros(n)
        for f in range(config.folds):
            train_rows, test_rows = fold != f, fold == f
            pick = train_rows[rows]
            local = np.cumsum(train_rows) - 1
            w, v, b = _fit(at[pick], local[rows[pick]], int(train_rows.sum()), width, before[train_rows], y[train_rows], config)
            z = np.bincount(rows, weights=w[at], minlength=n) + before @ v + b
            out[test_rows] = 1 / (1 + np.exp(-np.clip(z[test_rows], -30, 30)))
        w, v, b = _fit(at, rows, n, width, before, y, config)
        weights.append(w)
        biases.append(float(b))
        earlier.append([float(x) for x in v])
        before = np.column_stack([before, out])
    by_stem = np.array(weights).T[: levels * len(kept)].reshape(len(kept), levels, len(names))
    used = np.flatnonzero(np.abs(by_stem).max(axis=(1, 2)) > 1e-6) if len(kept) else []
    return ToxicityChain(names, config.shares, {int(kept[i]): by_stem[i] for i in used}, biases, earlier)


class Scorer:
    """Scores texts many at a time; keeps at most `cached` tokens and starts anew beyond that."""

    def __init__(self, model: ToxicityChain, cached: int = 150_000):
        self.model, self.cached = model, cached
        self.number = {s: i for i, s in enumerate(model.weights)}
        levels = 1 + len(model.shares)
        #: What a stem adds that has reached a level.
        self.adds = np.cumsum(np.array([*model.weights.values()]).reshape(len(self.number), levels, len(model.names)), axis=1)
        self.place: dict[str, int] = {}
        #: Tokens are of a kind if they hold the same stems with weights; most hold none and are kind 0.
        self.kind_of: dict[tuple[int, ...], int] = {(): 0}
        self._lay_out()

    def _lay_out(self) -> None:
        self.held = np.array([*chain.from_iterable(self.kind_of)], np.int64)
        self.sizes = np.fromiter(map(len, self.kind_of), np.int64, len(self.kind_of))
        self.low = np.cumsum(self.sizes) - self.sizes

    def _learn(self, tokens: set[str]) -> None:
        for token in tokens:
            have = tuple(self.number[s] for s in stems(token) if s in self.number)
            self.place[token] = self.kind_of.setdefault(have, len(self.kind_of))
        if len(self.kind_of) > len(self.sizes):
            self._lay_out()

    def probabilities(self, texts: list[str]) -> np.ndarray:
        if len(self.place) > self.cached:
            self.place.clear()
        cut = [t.lower().split() for t in texts]
        self._learn({w for c in cut for w in c if w not in self.place})
        sizes = np.array([len(c) for c in cut], np.int64)
        kinds = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        hits = np.flatnonzero(kinds)
        rows, kinds = np.repeat(np.arange(len(texts)), sizes)[hits], kinds[hits]
        many = self.sizes[kinds]
        at = np.repeat(self.low[kinds] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cells, times = np.unique(np.repeat(rows, many) * max(1, len(self.number)) + self.held[at], return_counts=True)
        row, stem = np.divmod(cells, max(1, len(self.number)))
        level = sum((times >= s * sizes[row]).astype(np.int64) for s in self.model.shares)
        sums = np.stack([np.bincount(row, weights=self.adds[stem, level, c], minlength=len(texts)) for c in range(len(self.model.names))], axis=1).astype(float)
        return self.model.predict(sums)


def toxicity_of(documents: DataFrame, fitted: ToxicityChain, rows: int = 128) -> Column:
    """The probabilities p_<category> of each text of documents, as one struct column; texts become words `rows` at a time."""
    shipped = small_batches(documents).sparkSession.sparkContext.broadcast(fitted)
    names = [f"p_{n}" for n in fitted.names]

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(shipped.value)
        for texts in batches:
            p = np.concatenate([np.zeros((0, len(names))), *(own.probabilities(texts[low : low + rows].to_pylist()) for low in range(0, len(texts), rows))])
            yield pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(len(names))], names)
        del own
        give_back()

    return scored(text_or_empty())


def score_toxicity(documents: DataFrame, fitted: ToxicityChain) -> DataFrame:
    """Adds one probability p_<category> for each category to documents with a text column.

    Whole texts count; null, empty and wordless texts get the biases alone. Other columns and rows stay; clashing columns
    are replaced. Only probabilities come back from Python.
    """
    names = [f"p_{n}" for n in fitted.names]
    rest = [c for c in documents.columns if c not in names]
    done = documents.select(*rest, toxicity_of(documents, fitted).alias("_p"))
    return done.select(*rest, *(F.col("_p")[n].alias(n) for n in names))


def toxicity_chain(spark: SparkSession, documents: DataFrame, sf_dir: str, config: ChainConfig = ChainConfig()) -> ToxicityChain:
    texts, toxic, _ = labelled_sample(spark, documents, table(spark, sf_dir, "labels"), "toxic", config.sample)
    fitted = train_chain(texts, toxic, config)
    give_back()
    return fitted


THRESHOLD = 0.5


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of all documents, and whether each counts as toxic."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(documents, toxicity_chain(spark, documents, sf_dir)).drop("text")
    return scored.withColumn("toxic", (F.col("p_toxic") >= THRESHOLD).cast("int"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that don't count as toxic; columns stay as they are, whatever their names."""
    return docs.where(toxicity_of(docs, toxicity_chain(spark, docs, sf_dir))["p_toxic"] < THRESHOLD)
