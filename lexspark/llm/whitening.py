"""Embedding whitening: covariances by polarisation, from exact sums of squares alone.

A covariance needs no product of two dimensions: 2 cov(a, b) = var(a + b) - var(a) - var(b). So the squares of every
centred dimension and of every sum of two dimensions are added up, as whole numbers, and differences of these variances
give the matrix that is decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import table, written

#: Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Larger entries are cut to it, so that all sums stay exact.
LARGEST = 1 << 40


@dataclass(frozen=True)
class Whitening:
    """What is learned from the fit list: n vectors, sums of x by dimension, eigenvalues falling, eigenvectors as columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        trace = float(np.trace(self.covariance))
        return self.values / trace if trace > 0 else np.zeros(len(self.values))

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e); not a number for components without variance, which can't be scaled to one."""
        least = len(self.values) * np.finfo(float).eps * (self.values[0] if len(self.values) else 0)
        return np.array([1 / np.sqrt(e) if e > least else np.nan for e in self.values])


def finite(vector: Column) -> Column:
    """Whether a vector is not null and all its entries are numbers."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def whole_numbers(vector: Column) -> Column:
    """x = floor(64 c) + 1000000 for every entry c."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double"), F.lit(LARGEST / SCALE)), F.lit(-LARGEST / SCALE)) * SCALE).cast("long") + SHIFT)


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows; missing dimensions hold x of an entry of zero."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out, start = np.full((len(lengths), dims), SHIFT, np.int64), 0
    for row, k in enumerate(lengths.tolist()):
        out[row, :k] = flat[start : start + k]
        start += k
    return out


def _added(rows: DataFrame, parts: Column) -> list[tuple[int, int]]:
    """Sums of the numbers `value` by `place`, added up in the executors; as many rows come back as there are places."""
    return [(r.place, int(r.total)) for r in rows.groupBy("place").agg(F.sum(parts).alias("total")).collect()]


def squared_sums(fit: DataFrame, dims: int, centre: list[int]) -> dict[tuple[int, int], int]:
    """For every dimension (i, i) and pair (i, j) the sum over the fit list of (w_i)^2 and (w_i + w_j)^2, w = x - centre.

    Exact: squares are added as 64-bit numbers over as many rows as surely fit, and from there as decimals.
    """
    low = np.array(centre, np.int64)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[int] | np.ndarray = np.zeros(dims * (dims + 1) // 2, object)
        for batch in batches:
            w = _matrix(batch.column(0), dims) - low
            bound = max(1, int(np.abs(w).max(initial=0)))
            step = (1 << 62) // (4 * bound * bound)  # rows whose squares fit together
            if step < 1:
                w, step = w.astype(object), len(w)
            for at in range(0, len(w), max(1, step)):
                some, found = w[at : at + step], []
                for i in range(dims):
                    pairs = some[:, i:] + some[:, i : i + 1]
                    pairs[:, 0] = some[:, i]
                    found.append((pairs * pairs).sum(axis=0))
                if dims:
                    totals = totals + np.concatenate(found).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int64()), pa.array([str(t) for t in totals])], names=["place", "value"])

    sums = dict(_added(fit.select("x").mapInArrow(squares, "place long, value string"), F.col("value").cast("decimal(38,0)")))
    return {pair: sums.get(k, 0) for k, pair in enumerate((i, j) for i in range(dims) for j in range(i, dims))}


def covariances(n: int, sums: list[int], centre: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix, divisor n: exact until each entry becomes the nearest double.

    The centre is the whole number nearest the mean; what is left of the mean (less than a half) is taken out of each sum
    of squares as a whole number too: n^2 var(w) = n sum(w^2) - (sum w)^2.
    """
    dims = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre)]  # sums of w
    own = [n * squares[i, i] - rest[i] ** 2 for i in range(dims)]
    out = np.zeros((dims, dims))
    for i in range(dims):
        out[i, i] = own[i] / n**2
        for j in range(i + 1, dims):
            both = n * squares[i, j] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n**2)
    return out


def fit_whitening(fit: DataFrame) -> Whitening:
    """Learns from the fit list (x, distinct). Only sums come to the driver: n, one a dimension and one a pair of dimensions."""
    shape = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, dims = shape.n, shape.d or 0
    if n == 0 or dims == 0:
        return Whitening(n, [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    entries = fit.select(F.posexplode("x").alias("place", "value"))
    counted = entries.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"), F.count("*").alias("k")).collect()
    sums = [n * SHIFT] * dims
    for r in counted:
        sums[r.place] = int(r.s) + (n - r.k) * SHIFT
    centre = [(2 * s + n) // (2 * n) for s in sums]
    covariance = covariances(n, sums, centre, squared_sums(fit, dims, centre))
    values, vectors = np.linalg.eigh(covariance)
    return Whitening(n, sums, covariance, values[::-1].copy(), vectors[:, ::-1].copy())


def _centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """x - S / n as doubles, and n x - S as whole numbers (64-bit where their squares fit, else Python's)."""
    centre = np.array([(2 * s + model.n) // (2 * model.n) for s in model.sums], np.int64)
    w = x - centre
    rest = [s - model.n * int(c) for s, c in zip(model.sums, centre)]
    bound = (int(np.abs(w).max(initial=0)) + 1) * model.n
    scaled = w * model.n - np.array(rest, np.int64) if bound * bound * max(1, len(rest)) < 1 << 62 else w.astype(object) * model.n - np.array(rest, object)
    return w - np.array([r / model.n for r in rest]), scaled


def identity_error(fit: DataFrame, model: Whitening, components: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, again by polarisation."""
    keep = [k for k in range(min(components, len(model.values))) if np.isfinite(model.scales[k])]
    if not keep:
        return 0.0
    project, dims = model.vectors[:, keep] * model.scales[keep], len(model.sums)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(keep), len(keep)))
        for batch in batches:
            y = _centred(_matrix(batch.column(0), dims), model)[0] @ project
            for i in range(len(keep)):
                pairs = y + y[:, i : i + 1]
                pairs[:, i] = y[:, i]
                total[i] += (pairs * pairs).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int64()), pa.array(total.ravel())], names=["place", "value"])

    rows = fit.select("x").mapInArrow(squares, "place long, value double").groupBy("place").agg(F.sum("value").alias("total")).collect()
    found = np.zeros(len(keep) ** 2)
    for r in rows:
        found[r.place] = r.total / model.n
    found = found.reshape(len(keep), len(keep))
    own = np.diag(found)
    cov = (found - own[:, None] - own[None, :]) / 2
    np.fill_diagonal(cov, own)
    return float(np.abs(cov - np.eye(len(keep))).max())


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Whitened components of every usable vector: (key, component, n, deviation, whitened, explained, identity_error).

    Vectors that are null or hold null or non-finite entries are left out. Vectors are fitted once however often they are
    repeated; repeated rows each get their own result. A vector shorter than the longest counts as if zeros followed.
    Entries beyond 2^40 / 64 count as that. Null keys stay. `deviation` is a decimal: the exact sum over dimensions of
    (n x - S)^2, null beyond 38 digits. A component without variance (fewer different vectors than dimensions, say) has
    whitened null and doesn't count for identity_error. Empty tables, and tables of empty vectors, give no rows. Other
    columns are ignored, whatever their names. The driver holds one number for each pair of dimensions.
    """
    if components < 1:
        raise ValueError("components must be positive")
    usable = embeddings.where(finite(F.col(vector))).select(F.col(key).alias("key"), whole_numbers(F.col(vector)).alias("x"))
    fit = written(usable.select("x").distinct())
    model = fit_whitening(fit)
    k = min(components, len(model.values))
    error, explained = identity_error(fit, model, components), model.explained
    kind = embeddings.schema[key].dataType.simpleString()
    out = f"key {kind}, deviation decimal(38,0), whitened array<double>"
    project, dims = model.vectors[:, :k] * np.nan_to_num(model.scales[:k], nan=0.0), len(model.sums)
    flat = np.isnan(model.scales[:k])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Context, Decimal

        exact = Context(prec=60)
        for batch in batches:
            if not len(batch) or not k:
                continue
            centred, scaled = _centred(_matrix(batch.column(1), dims), model)
            far = [int(v) for v in (scaled * scaled).sum(axis=1)]
            told = [exact.create_decimal(Decimal(v)) if v < 10**38 else None for v in far]
            white = centred @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * k + 1, k), pa.int32()), pa.array(white.ravel(), mask=np.tile(flat, len(batch))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.decimal128(38, 0)), lists], names=["key", "deviation", "whitened"])

    shares = F.array(*[F.lit(float(e)) for e in explained[:k]]) if k else F.array().cast("array<double>")
    rows = usable.mapInArrow(projected, out).select("key", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return rows.select(
        F.col("key").alias(key), (F.col("_i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_i")).alias("explained"), F.lit(error).alias("identity_error")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened to 16 components; a deviation beyond a long is null."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
