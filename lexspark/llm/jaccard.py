"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles have one global order, rarest first by a fixed-size count sketch of the whole corpus. Two sets that are similar
enough share at least l of their first n - alpha + l shingles, alpha being the least overlap a set of n must have. Each
document chooses the l of the least estimated cost: a longer prefix costs more look-ups, but asks for more shared
shingles before a pair is verified.

Documents that share a prefix shingle are gathered by links to the first document of each shingle's list (as many links
as list entries, never all pairs). Within such a gathering documents are dealt to cells by set size and, beyond a bounded
cell, to blocks; every two blocks whose sizes allow a link meet in one cell. First only prefixes meet, and gatherings
fall apart into documents that are connected by pairs with enough shared prefix shingles; then their whole texts meet, and
pairs are verified.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import components, give_back, slices, small_batches, table, text_or_empty, written
from lexspark.llm.shingles import set_digest, shingle_sets


@dataclass(frozen=True)
class JaccardConfig:
    """Words in a shingle, percent of similarity, size of the sketch, costs of verifying a pair and of looking up a rare
    shingle (a look-up in a list is 1 for each entry), and sizes of a cell's block in shingles and rows
    where whole sets meet and where prefixes do."""

    words: int = 5
    percent: int = 80
    sketch_bits: int = 22
    most_matches: int = 5
    verify_cost: float = 8.0
    least_cost: float = 0.1
    block: int = 500_000
    block_rows: int = 4000
    prefix_block: int = 1_000_000
    prefix_block_rows: int = 30_000

    def least(self, n: int) -> int:
        """The least overlap that a set of n shingles has with any set it links to."""
        return -(-self.percent * n // 100)


_SLICES = 64


def count_sketch(documents: DataFrame, config: JaccardConfig) -> Sketch:
    """How many documents' shingles fall into each of 2**sketch_bits buckets, over all documents; its size is fixed."""
    size = 1 << config.sketch_bits
    part = size // _SLICES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in slices(batches, 256):
            found = [*shingle_sets(batch.column(0).to_pylist(), config.words)]
            at, counts = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]) >> np.uint64(64 - config.sketch_bits), return_counts=True)
            total[at.astype(np.int64)] += counts.astype(np.uint32)
        if total.any():
            yield _packed(total.reshape(_SLICES, part))
        del total
        give_back()

    def _packed(parts: np.ndarray, numbers=range(_SLICES)) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*numbers], pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["slice", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for number, data in zip(*(c.to_pylist() for c in batch.columns)):
                new = np.frombuffer(zlib.decompress(data), np.uint32)
                if number != at:
                    if at is not None:
                        yield _packed([total], [at])
                    at, total = number, new.copy()
                else:
                    total += new
        if at is not None:
            yield _packed([total], [at])
        give_back()

    kind = "slice int, counts binary"
    rows = documents.select(text_or_empty().alias("text")).mapInArrow(counted, kind).repartition("slice").sortWithinPartitions("slice").mapInArrow(summed, kind)
    out = np.zeros((_SLICES, part), np.uint32)
    for row in rows.collect():  # a fixed number of bytes
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return Sketch(out.reshape(-1), 1.5 * float(out.mean()))


@dataclass(frozen=True)
class Sketch:
    """The counts, and what a bucket holds by chance, with some room."""

    counts: np.ndarray
    noise: float


def ordered(hashes: np.ndarray, sketch: Sketch, config: JaccardConfig) -> tuple[np.ndarray, int]:
    """A set in the global order, and how many shared prefix shingles the document asks for."""
    seen = sketch.counts[(hashes >> np.uint64(64 - config.sketch_bits)).astype(np.int64)]
    order = np.argsort((seen.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)), kind="stable")
    n = len(hashes)
    alpha = config.least(n)
    first = n - alpha + 1
    # list lengths beyond what a bucket holds by chance
    extra = np.maximum(seen[order[: first + config.most_matches - 1]].astype(np.float64) - sketch.noise, config.least_cost)
    lookups = np.cumsum(extra)[first - 1 :]
    matches = np.arange(1, len(lookups) + 1)
    cost = lookups + config.verify_cost * lookups / matches + matches
    best = int(np.argmin(cost[: max(1, min(config.most_matches, alpha))])) + 1
    return hashes[order], best


def _as_sets(documents: DataFrame, sketch: Sketch, config: JaccardConfig) -> DataFrame:
    """doc_id, n, digests a and b, matches asked for, and the prefix in which they are asked (8 bytes a shingle)."""
    shipped = documents.sparkSession.sparkContext.broadcast(sketch)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            keys, rows = batch.column(0).to_pylist(), []
            for key, found in zip(keys, shingle_sets(batch.column(1).to_pylist(), config.words)):
                n, (a, b) = len(found), set_digest(found)
                line, matches = ordered(found, shipped.value, config) if n else (found, 0)
                rows.append((key, n, a, b, matches, line[: n - config.least(n) + matches].tobytes() if n else b""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "n", "a", "b", "matches", "prefix"])
        give_back()

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(made, "doc_id long, n long, a long, b long, matches int, prefix binary")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix shingle; `late` are those that come with the matches beyond the first. Of equal sets that a
    task meets (as many numbers as its split has rows) one goes on."""
    met: set[tuple[int, int]] = set()
    for batch in batches:
        new = []
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
            if key not in met:
                met.add(key)
                new.append(i)
        for batch in slices([batch.take(pa.array(new, pa.int64()))], 1024):
            keys, asked = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data = batch.column(1).to_pylist()
            sizes = np.array([len(d) // 8 for d in data], np.int64)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            late = place > np.repeat(sizes - asked, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(data), np.int64)), pa.array(late), pa.array(np.repeat(keys, sizes))], names=["token", "late", "set_id"])
    give_back()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by token, late and set_id those whose token another set holds too, each with its list's first
    set; entries that tasks have sent more than once count once."""
    rest, hub = np.zeros((0, 3), np.int64), None  # the last entry waits, as the next may hold the same token

    def told(rows: np.ndarray, before: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Entries that are shared and each entry's hub; `before`: the hub of the first entry's list if that began earlier."""
        tokens = rows[:, 0]
        new = np.r_[before is None, tokens[1:] != tokens[:-1]]
        heads = np.where(new, rows[:, 2], 0)
        if before is not None:
            heads[0] = before
        hubs = heads[np.maximum.accumulate(np.where(new | (np.arange(len(rows)) == 0), np.arange(len(rows)), 0))]
        return ~new | np.r_[~new[1:], False], hubs

    for batch in batches:
        rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy()], 1)
        rows = np.concatenate([rest, rows])
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]] if len(rows) else rows
        if len(rows) < 2:
            rest = rows
            continue
        keep, hubs = told(rows, hub)
        done = slice(0, len(rows) - 1)
        # the last row goes on to the next batch, with its hub if its list has begun
        hub = int(hubs[-1]) if rows[-1, 0] == rows[-2, 0] else None
        rest = rows[-1:]
        yield _shared_rows(rows[done][keep[done]], hubs[done][keep[done]])
    if len(rest) and hub is not None:
        yield _shared_rows(rest, np.array([hub]))
    give_back()


def _shared_rows(rows: np.ndarray, hubs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1] == 1), pa.array(rows[:, 2]), pa.array(hubs)], names=["token", "late", "set_id", "hub"])


class Cell:
    """Sets that meet in one cell: rows of (id, size, matches asked for, side, prefix, set); only verifying needs the set."""

    def __init__(self, rows: list[tuple], config: JaccardConfig):
        rows.sort(key=lambda r: (r[1], r[0]))
        self.ids = [r[0] for r in rows]
        self.n = np.array([r[1] for r in rows], np.int64)
        self.asked = np.array([r[2] for r in rows], np.int64)
        self.side = np.array([r[3] for r in rows])
        self.prefixes, self.sets = [r[4] for r in rows], [r[5] for r in rows]
        self.config = config

    def links(self, verify: bool) -> list[tuple[int, int]]:
        """Pairs with enough shared prefix shingles, or (verify) of enough similarity, that connect all sets which such
        pairs connect here; a pair of sets that are already connected is left out."""
        m, percent = len(self.ids), self.config.percent
        index, full = _Index(self.prefixes), None
        label, out = np.arange(m), []
        two_sides = self.side.min() != self.side.max()
        for i in range(1, m):
            if not index.meets(i):
                continue
            near, counts = index.sharing(i)
            fit = (near < i) & (counts >= np.minimum(self.asked[i], self.asked[near])) & (100 * self.n[near] >= percent * self.n[i]) & (label[near] != label[i])
            if two_sides:
                fit &= self.side[near] != self.side[i]
            near = near[fit]
            if verify and len(near):
                if len(near) <= 8:
                    shared = np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in near])
                else:
                    full = full or _Index(self.sets)
                    others, counts = full.sharing(i)
                    shared = counts[np.searchsorted(others, near)]
                near = near[100 * shared >= percent * (self.n[i] + self.n[near] - shared)]
            for j in near.tolist():
                if label[i] != label[j]:
                    out.append((self.ids[i], self.ids[j]))
                    label[label == label[i]] = label[j]
        return out


class _Index:
    """Which of some sets hold each element."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        _, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owners = np.repeat(np.arange(len(sets)), sizes)
        self.owners = owners[np.argsort(where, kind="stable")]
        self.low = np.cumsum(counts) - counts
        self.counts, self.m = counts, len(sets)
        self.elements = np.split(where, np.cumsum(sizes)[:-1])

    def meets(self, i: int) -> bool:
        """Whether another set holds any element of set i."""
        return bool((self.counts[self.elements[i]] > 1).any())

    def sharing(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets that share elements with set i, in order, and how many."""
        mine = self.elements[i]
        mine = mine[self.counts[mine] > 1]
        sizes = self.counts[mine]
        at = np.repeat(self.low[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        if len(at) < self.m // 4:
            return np.unique(self.owners[at], return_counts=True)
        counts = np.bincount(self.owners[at], minlength=self.m)
        found = np.flatnonzero(counts)
        return found, counts[found]


_CELL = ["gathering", "c", "s", "t", "kind"]


def _meetings(planned: DataFrame, config: JaccardConfig, key: str, size: str, block: int, block_rows: int) -> DataFrame:
    """Rows of a plan once for each cell in which they meet others, with the cell's name and the row's side."""
    return _cells(planned, config, key, size, block, block_rows).select("*", F.explode("cells").alias("cell")).select("*", "cell.*").drop("cell", "cells")


def _cells(planned: DataFrame, config: JaccardConfig, key: str, weight: str, block: int, block_rows: int) -> DataFrame:
    """Adds to (key, n, gathering) the cells in which a set meets others: an array of (c, s, t, kind, side).

    A gathering that fits into one block is one cell. Others are cut by size class (sets that link are at most one class
    apart) and each class into as many blocks as its shingles fill.
    """
    step = math.log(100 / config.percent) * 1.001
    planned = planned.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    classes = planned.groupBy("gathering", "c").agg(F.count("*").alias("rows"), F.sum(weight).alias("size"))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("rows") / block_rows)).cast("int")
    classes = classes.withColumn("blocks", blocks)
    shape = classes.groupBy("gathering").agg(
        F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("c", "blocks"))).alias("blocks")
    )  # the number of size classes grows with the logarithm of the longest text
    both = planned.join(shape.where("rows > 1"), "gathering")
    small = (F.col("rows") <= block_rows) & (F.col("size") <= block)
    of = lambda c: F.coalesce(F.try_element_at("blocks", c), F.lit(0))
    up_to = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    cell = lambda c, s, t, kind, side: F.struct(c.alias("c"), s.alias("s"), t.alias("t"), F.lit(kind).alias("kind"), side.alias("side"))
    c, s = F.col("c"), F.col("own")
    met = F.concat(
        F.transform(up_to(of(c)), lambda t: cell(c, F.least(s, t), F.greatest(s, t), 0, (s > t).cast("int"))),
        F.transform(up_to(of(c + 1)), lambda t: cell(c, s, t, 1, F.lit(0))),
        F.transform(up_to(of(c - 1)), lambda t: cell(c - 1, t, s, 1, F.lit(1))),
    )
    alone = F.array(cell(F.lit(0), F.lit(0), F.lit(0), 0, F.lit(0)))
    both = both.withColumn("own", F.pmod(F.xxhash64(key, "n"), of(c)).cast("int"))
    return both.withColumn("cells", F.when(small, alone).otherwise(met)).drop("blocks", "own", "rows", "size", "c")


def _gatherings(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("a"), F.col("component").alias("gathering"))


def _prefix_links(rows: pa.Table, config: JaccardConfig, sketch: None) -> list[tuple[int, int]]:
    tokens = rows.column("tokens").combine_chunks()
    values, ends = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
    lines = [values[low:high] for low, high in zip(ends[:-1], ends[1:])]
    return Cell([*zip(*(rows.column(c).to_pylist() for c in ("a", "n", "matches", "side")), lines, [None] * len(lines))], config).links(verify=False)


def _verified_links(rows: pa.Table, config: JaccardConfig, sketch: Sketch) -> list[tuple[int, int]]:
    sets = []
    texts = (t for batch in slices(rows.select(["text"]).to_batches(), 256) for t in batch.column(0).to_pylist())
    for key, side, a, b, found in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "side", "a", "b")), shingle_sets(texts, config.words)):
        if set_digest(found) == (a, b):  # else another text of the same doc_id
            line, matches = ordered(found, sketch, config)
            sets.append((key, len(found), matches, side, line[: len(line) - config.least(len(line)) + matches], found))
    return Cell(sets, config).links(verify=True) if len(sets) > 1 else []


def _in_cells(met: DataFrame, compare, config: JaccardConfig, sketch: Sketch | None) -> DataFrame:
    """Runs compare on the rows of each cell, one bounded cell after another; rows stay Arrow until their cell is compared."""
    shipped = met.sparkSession.sparkContext.broadcast(sketch)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        rows: list[pa.RecordBatch] = []

        def close() -> list[tuple[int, int]]:
            return compare(pa.Table.from_batches(rows), config, shipped.value) if sum(map(len, rows)) > 1 else []

        as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        for batch in slices(batches, 2048):
            out: list[tuple[int, int]] = []
            keys = np.stack([batch.column(c).to_numpy() for c in _CELL], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                key = tuple(keys[low].tolist())
                if key != at:
                    out += close()
                    at, rows = key, []
                rows.append(batch.slice(low, high - low))
            if out:
                yield as_batch(out)
        if out := close():
            yield as_batch(out)
        rows.clear()
        give_back()

    return met.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(linked, "a long, b long")


def jaccard_components(documents: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """For every row of documents (doc_id, text): doc_id, n_shingles and component_id.

    Two documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id that links reach. Null, empty and blank texts have no shingles and link with nothing. Rows that repeat a doc_id
    are one document, which links if any of its texts does; a null doc_id is its own component (null). Other columns are
    ignored. No partner is dropped: beyond a block's size a gathering is compared block by block.
    """
    sketch = count_sketch(small_batches(documents), config)
    sets = written(_as_sets(documents, sketch, config))
    known = sets.where("n > 0 and doc_id is not null")
    # a set goes by its first digest here: copies are one, and a chance collision only makes a few candidates more
    entries = known.select("a", "prefix", "matches", "b").mapInArrow(_entries, "token long, late boolean, set_id long")
    by_token = entries.repartition("token").sortWithinPartitions("token", "late", "set_id")
    shared = written(by_token.mapInArrow(_shared, "token long, late boolean, set_id long, hub long"))
    gathered = _gatherings(components(shared.where("not late and set_id <> hub").select(F.col("set_id").alias("a"), F.col("hub").alias("b"))))
    # equal sets are compared once; the copies link to their smallest doc_id
    distinct = written(known.groupBy("a", "b", "n").agg(F.min("doc_id").alias("doc_id"), F.min("matches").alias("matches")))
    copies = known.select("doc_id", "a", "b", "n").join(distinct.select("a", "b", "n", F.col("doc_id").alias("first")), ["a", "b", "n"]).where("doc_id <> first")
    # only shingles that other sets hold too can meet; a set's are as many as its prefix at most
    tokens = shared.groupBy(F.col("set_id").alias("a")).agg(F.collect_set("token").alias("tokens"))
    meeting = distinct.join(gathered, "a").join(tokens, "a").select("a", "n", "matches", "gathering", "tokens", F.size("tokens").alias("weight"))
    candidates = _in_cells(_meetings(meeting, config, "a", "weight", config.prefix_block, config.prefix_block_rows), _prefix_links, config, None)
    refined = distinct.drop("matches").join(_gatherings(components(candidates)), "a")
    plan = written(refined)
    # whole texts go to the cells: they are smaller than their sets, which each cell makes anew
    texts = _maybe_in(documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), plan)
    links = _in_cells(texts.join(_meetings(plan, config, "doc_id", "n", config.block, config.block_rows), "doc_id"), _verified_links, config, sketch)
    found = components(links.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))))
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


_BITS = 1 << 23


def _maybe_in(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows whose doc_id is in the plan, and a few others: a bitmap of a fixed size (1 MB) spares most texts a shuffle."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(_BITS))
    parts = plan.select((place("doc_id") + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    found = {r["bucket"]: r["bits"] for r in parts.collect()}
    bits = np.frombuffer(b"".join(bytes(found.get(i + 1, bytes(4096))) for i in range(_BITS // 32768)), np.uint8)
    shipped = rows.sparkSession.sparkContext.broadcast(bits)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_p").to_numpy()
            inside = (shipped.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield batch.select(names).filter(pa.array(inside))

    names = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.where("doc_id is not null").withColumn("_p", place("doc_id")).mapInArrow(kept, fields)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a similarity of 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), JaccardConfig(words=4, percent=85))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS t FROM w UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.t)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, t.c AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT d, min(t) AS c FROM r GROUP BY d) t ON t.d = w.doc_id"""


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, and all documents outside groups.

    Rows that repeat a doc_id are one document: they stay or go together. Rows without a doc_id stay, and so do null and
    empty texts. Columns stay as they are, whatever their names.
    """
    found = jaccard_components(docs.select("doc_id", "text"))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
