"""Embedding near-dedup with spherical-cap filters from structured random product codes.

A filter is a direction of the sphere; all directions are sums of one random unit direction in each half of the
(randomly turned) dimensions. A vector is list-decoded to all filters with which its inner product exceeds a bound, which
the code's structure makes cheap, so vectors of a small angle almost surely share a filter. Vectors are joined on label
and filter, and pairs are verified by their cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import Roots, components, table, written


@dataclass(frozen=True)
class CapConfig:
    """filters: how many filters a random vector exceeds on average; load: how many of the largest label's vectors exceed a
    filter by chance. From both follow the share of all vectors that exceed a filter, and so its bound and the number of
    directions in each half (their square is the number of filters): a filter's list does not grow with the data. `share`
    and `directions` may be given instead. least: filters of any vector."""

    cosine: float = 0.98
    filters: int = 24
    load: float = 0.25
    directions: int | None = None
    share: float | None = None
    least: int = 12
    block: int = 512
    seed: int = 5

    def fitted(self, vectors: int) -> CapConfig:
        """With the share for a largest label of so many vectors."""
        return replace(self, share=self.share or min(0.02, self.load / max(1, vectors)))


#: Caps are never narrower than this inner product, so that near vectors share them in few dimensions, too.
NARROWEST = 0.93


def cap(dim: int, share: float) -> tuple[float, float]:
    """The inner product with a direction that a share of all unit vectors exceeds, and that share: the one given, or more."""
    x = np.linspace(0, 1, 200_001)
    density = np.maximum(1 - x * x, 1e-300) ** ((max(dim, 2) - 3) / 2)
    density[-1] = 0.0
    above = np.cumsum(density[::-1])[::-1]
    above /= 2 * above[0]
    at = min(int(np.searchsorted(-above, -share)), int(NARROWEST * (len(x) - 1)))
    return float(x[at]), float(above[at])


def turned(x: np.ndarray) -> np.ndarray:
    """Rows under an orthonormal transform (real Fourier), which after random signs spreads any vector over all dimensions
    in little time and space, however many dimensions there are."""
    y = np.fft.rfft(x, norm="ortho", axis=1)
    last = y.shape[1] - 1 if x.shape[1] % 2 == 0 else y.shape[1]
    inner = y[:, 1:last] * np.sqrt(2)
    return np.concatenate([y[:, :1].real, inner.real, inner.imag, y[:, last:].real], axis=1)


#: Vectors of fewer dimensions are laid into so many, where halves leave the code enough choice; cosines stay.
FEWEST_DIMENSIONS = 16


class ProductCode:
    def __init__(self, dim: int, config: CapConfig):
        rng = np.random.default_rng(config.seed)
        self.lift = None
        if dim < FEWEST_DIMENSIONS:
            self.lift = np.linalg.qr(rng.normal(size=(FEWEST_DIMENSIONS, dim)))[0].T
            dim = FEWEST_DIMENSIONS
        self.signs = rng.choice([-1.0, 1.0], dim)
        self.half = (dim + 1) // 2
        self.bound, share = cap(dim, config.share)
        self.directions = config.directions or max(32, math.ceil(math.sqrt(config.filters / share)))
        self.codes = []
        for size in (self.half, dim - self.half):
            c = rng.normal(size=(self.directions, max(size, 1)))
            self.codes.append((c / np.linalg.norm(c, axis=1, keepdims=True))[:, :size] / np.sqrt(2))
        self.config = config

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the numbers of all filters that exceed the bound, and at least the `least` best."""
        y = turned((unit if self.lift is None else unit @ self.lift) * self.signs)
        left, right = y[:, : self.half] @ self.codes[0].T, y[:, self.half :] @ self.codes[1].T
        k, out = self.directions, []
        for a, b in zip(left, right):
            i = np.flatnonzero(a >= self.bound - b.max())
            j = np.flatnonzero(b >= self.bound - a.max())
            u, v = np.nonzero(a[i][:, None] + b[j] >= self.bound)
            found = i[u] * k + j[v]
            if len(found) < self.config.least:
                n = min(self.config.least, k)
                i, j = np.argpartition(-a, n - 1)[:n], np.argpartition(-b, n - 1)[:n]
                sums = (a[i][:, None] + b[j]).ravel()
                best = np.argpartition(-sums, n - 1)[:n]
                found = i[best // n] * k + j[best % n]
            out.append(np.sort(found).astype(np.int64))
        return out


def _filters(config: CapConfig):
    codes: dict[int, ProductCode] = {}

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, out = batch.column("data").to_pylist(), [b""] * len(batch)
            by_dim: dict[int, list[int]] = {}
            for i, d in enumerate(data):
                by_dim.setdefault(len(d) // 4, []).append(i)
            for dim, rows in by_dim.items():
                code = codes.setdefault(dim, ProductCode(dim, config))
                for low in range(0, len(rows), 512):
                    part = rows[low : low + 512]
                    x = np.frombuffer(b"".join(data[i] for i in part), "<f4").reshape(len(part), dim).astype(float)
                    for i, found in zip(part, code.decode(x / np.linalg.norm(x, axis=1, keepdims=True))):
                        out[i] = found.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "filters"])

    return decoded


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Little-endian floats of each vector; null for vectors that link with nothing."""
    for batch in batches:
        out = []
        for vector in batch.column("embedding").to_pylist():
            x = np.array([] if vector is None else [np.nan if c is None else c for c in vector], "<f4")
            norm = np.linalg.norm(x.astype(float)) if len(x) else 0.0
            out.append(x.tobytes() if np.isfinite(norm) and norm > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["row", "vec_id", "label", "data"])


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column("filters").to_pylist()
        sizes = np.array([len(d) // 8 for d in data], np.int64)
        spread = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes)) for c in ("row", "label")]
        yield pa.RecordBatch.from_arrays([*spread, pa.array(np.frombuffer(b"".join(data), np.int64))], names=["row", "label", "filter"])


def _lower_masks(filters: list[bytes], number: int) -> list[int]:
    """For each row of a cell the filters before this one that other rows hold too, as bits."""
    lower = [set(x[x < number].tolist()) for x in (np.frombuffer(f, np.int64) for f in filters)]
    once, more = set(), set()
    for have in lower:
        more |= have & once
        once |= have
    bit = {f: 1 << i for i, f in enumerate(more)}
    return [sum(map(bit.__getitem__, have & more)) for have in lower]


def _needed(filters: list[bytes], side: list[int], number: int) -> list[int]:
    """The rows of a cell that have this filter as the smallest one in common with another row (of the other side, if there
    are two). Rows of equal masks are looked at together."""
    two = min(side) != max(side)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (mask, s) in enumerate(zip(_lower_masks(filters, number), side)):
        kinds.setdefault((mask, s if two else 0), []).append(i)
    met: set[tuple[int, int]] = set()
    every = list(kinds)
    for i, x in enumerate(every):
        if not two and x[0] == 0 and len(kinds[x]) > 1:
            met.add(x)
        for y in every[i + 1 :]:
            if not x[0] & y[0] and (not two or x[1] != y[1]) and not (x in met and y in met):
                met |= {x, y}
    return sorted(i for x in met for i in kinds[x])


def _cell_links(rows: list[tuple], number: int, cosine: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """For the rows (row, copies, side, data, filters) of a cell: how many vectors each links to by pairs whose smallest
    common filter is this one, and links that connect all rows that are connected here."""
    ids, copies = [r[0] for r in rows], [r[1] for r in rows]
    side = np.array([r[2] for r in rows])
    by_dim: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_dim.setdefault(len(r[3]), []).append(i)
    masks = _lower_masks([r[4] for r in rows], number)
    counts: dict[int, int] = {}
    roots, links = Roots(len(rows)), []
    for members in by_dim.values():
        x = np.frombuffer(b"".join(rows[i][3] for i in members), "<f4").reshape(len(members), -1).astype(float)
        norm = np.linalg.norm(x, axis=1)
        near = (x @ x.T) / (norm[:, None] * norm) >= cosine
        two = side[members]
        near &= np.triu(np.ones_like(near), 1)
        if two.min() != two.max():
            near &= two[:, None] != two
        for a, b in zip(*(z.tolist() for z in np.nonzero(near))):
            a, b = members[a], members[b]
            if not masks[a] & masks[b]:
                counts[ids[a]] = counts.get(ids[a], 0) + copies[b]
                counts[ids[b]] = counts.get(ids[b], 0) + copies[a]
            if roots.join(a, b):
                links.append((ids[a], ids[b]))
    return counts, links


_CELL = ["label", "filter", "s", "t"]


def _by_cell(names: list[str], close, out_names: list[str]):
    """Runs close(key, rows of `names`) on each cell of rows sorted by cell, one bounded cell after another; close gives
    rows of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=out_names)
        for batch in batches:
            out: list[tuple] = []
            for *key, row in zip(*(batch.column(c).to_pylist() for c in _CELL), zip(*(batch.column(c).to_pylist() for c in names))):
                if key != at:
                    out += close(at, rows) if len(rows) > 1 else []
                    at, rows = key, []
                rows.append(row)
            if out:
                yield as_batch(out)
        if len(rows) > 1 and (out := close(at, rows)):
            yield as_batch(out)

    return run


def cosine_components(embeddings: DataFrame, config: CapConfig = CapConfig()) -> DataFrame:
    """One row for every row of embeddings (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine is at least config.cosine. Vectors that are
    null, empty, zero or hold a null or non-finite component, and those without a label, link with nothing; vectors of
    different lengths don't link. Rows that repeat a vec_id are vectors of their own; equal vectors are compared once and
    counted as often as they occur. component_id is the smallest vec_id that links reach. Other columns are ignored. A
    filter that very many vectors share is compared block by block.
    """
    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<float>"))
    vectors = written(rows.mapInArrow(_usable, "row long, vec_id long, label long, data binary"))
    usable = vectors.where("label is not null and data is not null")
    first = written(usable.groupBy("label", "data").agg(F.min("row").alias("row"), F.count("*").alias("copies")))
    largest = first.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    config = config.fitted(largest)
    coded = written(first.select("row", "label", "data").mapInArrow(_filters(config), "row long, label long, data binary, filters binary").drop("data"))
    thin = coded.mapInArrow(_thin, "row long, label long, filter long")
    shared = thin.groupBy("label", "filter").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / config.block).cast("int"))
    # only filters that other vectors exceed too can be in common
    held = written(thin.join(shared.drop("count"), ["label", "filter"]))
    lists = held.groupBy("row").agg(F.array_sort(F.collect_list("filter")).alias("filters"))
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    meet = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(F.least(own, t).alias("s"), F.greatest(own, t).alias("t"), (own > t).cast("int").alias("side"))
    )
    cells = held.select("row", "label", "filter", F.explode(meet).alias("cell")).select("row", "label", "filter", "cell.*")

    def lists_meet(key: list, rows: list[tuple]) -> list[tuple]:
        # first the lists of filters alone: a pair is compared in one cell, and few rows are needed in each
        need = _needed([np.array(r[2], np.int64).tobytes() for r in rows], [r[1] for r in rows], key[1])
        return [(rows[i][0], *key, rows[i][1]) for i in need]

    def vectors_meet(key: list, rows: list[tuple]) -> list[tuple]:
        counts, links = _cell_links([(r, c, s, d, np.array(f, np.int64).tobytes()) for r, c, s, d, f in rows], key[1], config.cosine)
        return [*((r, r, n) for r, n in counts.items()), *((a, b, 0) for a, b in links)]

    sorted_cells = lambda rows: rows.repartition(*_CELL).sortWithinPartitions(*_CELL)
    asked = sorted_cells(cells.join(lists, "row")).select(*_CELL, "row", "side", "filters")
    needed = asked.mapInArrow(_by_cell(["row", "side", "filters"], lists_meet, ["row", *_CELL, "side"]), "row long, label long, filter long, s long, t long, side long")
    met = sorted_cells(needed.join(first.select("row", "copies", "data"), "row").join(lists, "row")).select(*_CELL, "row", "copies", "side", "data", "filters")
    found = met.mapInArrow(_by_cell(["row", "copies", "side", "data", "filters"], vectors_meet, ["a", "b", "n"]), "a long, b long, n long")
    found = written(found.groupBy("a", "b").agg(F.sum("n").alias("n")))
    counts = found.where("a = b").select(F.col("a").alias("row"), "n")
    reached = components(found.where("a <> b").select("a", "b"))
    # back from the first of equal vectors to all, and from row numbers to the smallest vec_id
    of_first = first.select(F.col("row").alias("head"), "label", "data", "copies").join(counts.withColumnRenamed("row", "head"), "head", "left").join(
        reached.select(F.col("node").alias("head"), "component"), "head", "left"
    )
    of_first = of_first.select("label", "data", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "head").alias("component"))
    rows = written(vectors.join(of_first, ["label", "data"], "left").select("vec_id", "n_links", "component", "row"))
    least = rows.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    return rows.join(least, "component", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("least", "vec_id"), F.lit(True)).alias("kept"),
    )


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda v: v IS NULL OR NOT isfinite(v)), true) AND list_aggregate(list_transform(embedding, lambda v: abs(v)), 'max') > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS d, vec_id AS t FROM embeddings UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.t)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, m.c AS component_id, m.c = v.vec_id AS kept FROM embeddings v JOIN (SELECT d, min(t) AS c FROM r GROUP BY d) m ON m.d = v.vec_id"""


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return cosine_components(table(spark, sf_dir, "embeddings"))
