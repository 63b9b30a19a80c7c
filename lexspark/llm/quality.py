"""Quality classifier: supervised subword embeddings.

A document is the sum of three averages of learned vectors: of its words and their character n-grams (hashed), of its
word 2-grams (hashed), and of the equality patterns of its word 3-grams (which of a word's two predecessors it equals;
invented or rare words repeat in this form only). The sum goes through a softmax; vectors and softmax are learned
together by stochastic gradient descent in numpy. As averages and the softmax's input are linear, each vector adds one
fixed number to a document's score, so scoring needs one number for each hashed feature.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import give_back, mix64, small_batches, table, text_or_empty


@dataclass(frozen=True)
class SubwordConfig:
    """`sample` bounds the labelled rows of each class that are fitted; the model's size is fixed by buckets (a power of
    two) and dim. Training goes over the sample `epochs` times, and on until it has made `steps` steps."""

    buckets: int = 1 << 17
    dim: int = 12
    shortest: int = 3
    longest: int = 5
    epochs: int = 8
    steps: int = 12_000
    rate: float = 0.5
    sample: int = 1200
    seed: int = 7


_step = np.uint64(0x9E3779B97F4A7C15)
_first, _second = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
PATTERNS = 4


def word_hashes(words: list[str]) -> np.ndarray:
    return mix64(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) * _step)


def subwords(words: list[str], hashes: np.ndarray, config: SubwordConfig) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams (with marks at both ends), and the word that each belongs to."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner, ends = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes)
    mask = np.uint64(config.buckets - 1)
    buckets, owners = [hashes & mask], [np.arange(len(words))]
    run = np.zeros(len(chars), np.uint64)
    for n in range(1, config.longest + 1):
        run = run[: max(0, len(chars) - n + 1)] * _step + chars[n - 1 :]
        if n >= config.shortest:
            inside = np.arange(len(run)) + n <= ends[: len(run)]
            buckets.append(mix64(run[inside] + np.uint64(n)) & mask)
            owners.append(owner[: len(run)][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def pairs(hashes: np.ndarray, config: SubwordConfig) -> np.ndarray:
    """Buckets of the 2-grams of consecutive words, from the words' hashes."""
    return (mix64(hashes[:-1] * _first + hashes[1:] * _second) & np.uint64(config.buckets - 1)).astype(np.int64)


def patterns(words: np.ndarray) -> np.ndarray:
    """For each word from the second on, whether it equals the word before (1) and the one before that (2)."""
    out = (words[1:] == words[:-1]).astype(np.int64)
    out[1:] += 2 * (words[2:] == words[:-2])
    return out


@dataclass
class SubwordModel:
    """What is left of a trained model: each bucket's and each pattern's part in the logit, and the bias."""

    logits: np.ndarray
    patterns: np.ndarray
    bias: float
    config: SubwordConfig


class Scorer:
    """Scores texts many at a time; keeps what at most `cached` words add and starts anew beyond that."""

    def __init__(self, model: SubwordModel, cached: int = 100_000):
        self.model, self.cached = model, cached
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.sums, self.sizes, self.hashes = np.zeros(1024), np.zeros(1024), np.zeros(1024, np.uint64)

    def _learn(self, words: list[str]) -> None:
        low, high = len(self.place), len(self.place) + len(words)
        while high > len(self.sums):
            self.sums, self.sizes, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.sizes, self.hashes))
        hashes = word_hashes(words)
        buckets, owners = subwords(words, hashes, self.model.config)
        self.sums[low:high] = np.bincount(owners, weights=self.model.logits[buckets], minlength=len(words))
        self.sizes[low:high] = np.bincount(owners, minlength=len(words))
        self.hashes[low:high] = hashes
        self.place.update(zip(words, range(low, high)))

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.place) > self.cached:
            self._clear()
        cut = [t.split() for t in texts]
        ends = np.cumsum([len(c) for c in cut])
        if not len(texts):
            return np.zeros(0)
        starts, n = np.r_[0, ends[:-1]], int(ends[-1])
        if new := list({w for c in cut for w in c if w not in self.place}):
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, n)
        total = _mean(self.sums[at], self.sizes[at], starts, ends)
        # consecutive words of one text; those that reach into the next text count as nothing
        inside = np.ones(max(n - 1, 0), bool)
        inside[starts[(starts > 0) & (starts < n)] - 1] = False
        two = np.where(inside, self.model.logits[pairs(self.hashes[at], self.model.config)].astype(float), 0.0) if n > 1 else np.zeros(0)
        same = patterns(at) if n > 1 else np.zeros(0, np.int64)
        third = starts[(starts > 0) & (starts < n - 1)]
        same[third] &= 1  # a text's second word has one predecessor
        equal = np.where(inside, self.model.patterns[same].astype(float), 0.0)
        for values in (two, equal):
            total += _mean(np.r_[values, 0.0], np.r_[inside, False].astype(float), starts, ends)
        return 1 / (1 + np.exp(-np.clip(total + self.model.bias, -30, 30)))


def _mean(values: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each range the sum of values over the sum of weights, 0 where there are none; ranges follow on each other."""
    out, some = np.zeros(len(starts)), starts < ends
    if some.any():
        out[some] = np.add.reduceat(values, starts[some]) / np.maximum(np.add.reduceat(weights, starts[some]), 1.0)
    return out


def _bag(words: list[str], config: SubwordConfig) -> tuple[np.ndarray, np.ndarray]:
    """All features of a text with their weights; the last PATTERNS numbers beyond the buckets are the patterns."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    counts = Counter(words)
    kinds = list(counts)
    place = {w: i for i, w in enumerate(kinds)}
    hashes = word_hashes(kinds)
    buckets, owners = subwords(kinds, hashes, config)
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    times = np.fromiter(counts.values(), float, len(kinds))[owners]
    families = [(buckets, times)]
    if len(words) > 1:
        families += [(f, np.ones(len(f))) for f in (pairs(hashes[at], config), config.buckets + patterns(at))]
    found, where = np.unique(np.concatenate([f for f, _ in families]), return_inverse=True)
    return found.astype(np.int32), np.bincount(where, weights=np.concatenate([w / w.sum() for _, w in families])).astype(np.float32)


def train(texts: list[str], labels: list[int], prior: float, config: SubwordConfig = SubwordConfig()) -> SubwordModel:
    """Fits vectors and softmax to texts with labels 0 and 1; `prior` is the share of label 1 among all labelled rows."""
    rng = np.random.default_rng(config.seed)
    vectors = rng.uniform(-1 / config.dim, 1 / config.dim, (config.buckets + PATTERNS, config.dim)).astype(np.float32)
    out = np.zeros((2, config.dim), np.float32)
    bags = [_bag(t.split(), config) for t in texts]
    share = np.mean(labels) if len(labels) else 0.5
    epochs = max(config.epochs, -(-config.steps // max(1, len(texts))))
    steps, step = max(1, epochs * len(texts)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            at, weight = bags[i]
            if not len(at):
                continue
            rate = config.rate * (1 - step / steps)
            hidden = weight @ vectors[at]
            z = out @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            # a step moves the average by about the rate, however many features share it
            vectors[at] -= rate / float(weight @ weight) * np.outer(weight, back)
            step += 1
    # the classes are sampled alike; the bias brings the score back to the share of label 1 among all labelled rows
    clip = lambda x: min(max(x, 1e-3), 1 - 1e-3)
    bias = np.log(clip(prior) / (1 - clip(prior))) - np.log(clip(share) / (1 - clip(share)))
    logits = (vectors @ (out[1] - out[0])).astype(np.float32)
    return SubwordModel(logits[: config.buckets], logits[config.buckets :], float(bias), config)


def quality_of(documents: DataFrame, model: SubwordModel, rows: int = 128) -> Column:
    """The probability of label 1 of each text of documents, as a column of theirs; texts become words `rows` at a time."""
    shipped = small_batches(documents).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(shipped.value)
        for texts in batches:
            parts = [own.scores(texts[low : low + rows].to_pylist()) for low in range(0, len(texts), rows)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))
        del own
        give_back()

    return score(text_or_empty())


def score_quality(documents: DataFrame, model: SubwordModel, column: str = "quality_score") -> DataFrame:
    """Adds the probability of label 1 for every whole text of documents with a text column.

    Null, empty and blank texts get the score of the bias alone. Other columns and rows stay; a clashing column of the
    same name is replaced. Only scores come back from Python.
    """
    return documents.withColumn(column, quality_of(documents, model))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's labels are kept from training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def labelled_sample(spark: SparkSession, documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list[str], list[int], float]:
    """At most `per_class` whole texts of each class outside the held-out fold, with labels and the share of label 1 of all rows.

    Rows are taken in the order of a hash, so the sample does not depend on the tables' layout. Labels other than 0
    and 1, nulls included, are left out; of conflicting labels of a doc_id the smaller one holds, of its texts the
    smallest. The sample's ids (bounded by the two quotas) are all that is broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    order = F.xxhash64(F.col("doc_id"), F.lit(label))
    picked = known.where("label = 1").orderBy(order, "doc_id").limit(per_class).unionByName(known.where("label = 0").orderBy(order, "doc_id").limit(per_class))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ids = {r["doc_id"]: r["label"] for r in picked.collect()}
    if not ids:
        return [], [], 0.5
    small = spark.createDataFrame(list(ids.items()), "doc_id long, label int")
    met = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(small), "doc_id")
    rows = sorted(met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect())  # one for each id at most
    return [r["text"] for r in rows], [r["label"] for r in rows], counts.get(1, 0) / max(1, sum(counts.values()))


def quality_model(spark: SparkSession, documents: DataFrame, sf_dir: str, config: SubwordConfig = SubwordConfig()) -> SubwordModel:
    texts, labels, prior = labelled_sample(spark, documents, table(spark, sf_dir, "labels"), "quality", config.sample)
    model = train(texts, labels, prior, config)
    give_back()
    return model


THRESHOLD = 0.3


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model learned outside the held-out fold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(spark, documents, sf_dir)
    return score_quality(documents, model, "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score is at least the threshold; columns stay as they are, whatever their names."""
    return docs.where(quality_of(docs, quality_model(spark, docs, sf_dir)) >= THRESHOLD)
