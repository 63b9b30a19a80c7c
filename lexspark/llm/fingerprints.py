"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line. Long and short ones alike are cut into passages where their own characters say so (see
`passage_ends`), so that an edit changes the passages around it and no others. A sketch adds the digest of each passage
to three cells; the smallest sketch is the printed fingerprint. Subtracting the sketches of two versions cancels what
they share, and peeling cells that hold one digest recovers the digests that differ. Where peeling sticks, larger
sketches of both are made, by an estimate from the cells that are left, and tried.
"""

from __future__ import annotations

import base64
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import give_back, mix64, slices, small_batches, table, text_or_empty

CELLS = 24
#: A passage ends at a character whose window's hash is the least among those of so many characters before and after it.
REACH = 5
_GRAM = 4
_PAD = REACH + _GRAM
FULL = -1
_NONE = np.uint32(0xFFFFFFFF)
_letters = np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)
_radix = np.uint64(0x9E3779B97F4A7C15)
_salts = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F], [0x165667B19E3779F9]], np.uint64)
_high = np.uint64(33)
_spread = np.uint64(0xFF51AFD7ED558CCD)
_check = np.uint64(0x27D4EB2F165667C5)


def passage_ends(chars: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether a passage ends at each of some characters: at line ends, and where the hash of a character and the three
    before it is the least within REACH characters on both sides (ties count, so that runs of one character or word are
    cut, too). `text` marks the characters of texts; before and after each text stand at least _PAD zeros that are none."""
    grams = np.zeros(len(chars), np.uint32)
    for j in range(min(_GRAM, len(chars))):
        grams[j:] += (chars[: len(chars) - j] + np.uint32(1)) * _letters[j]
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x2C1B3C6D)
    grams ^= grams >> np.uint32(12)
    grams[~text] = _NONE
    wide = np.concatenate([np.full(REACH, _NONE, np.uint32), grams, np.full(REACH, _NONE, np.uint32)])
    least, width = wide, 1
    while 2 * width <= 2 * REACH + 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(grams)], least[2 * REACH + 1 - width :][: len(grams)])
    return text & ((grams == least) | (chars == 10))


def digests(texts: list[str], block: int = 1 << 19) -> list[np.ndarray]:
    """For each text the distinct 64-bit digests of its passages, in order; the n-th repetition of a passage has a digest of
    its own. Texts are joined up to `block` characters, so memory follows the longest text."""
    out: list[np.ndarray] = []
    low = 0
    while low < len(texts):
        high, size = low + 1, len(texts[low])
        while high < len(texts) and size + len(texts[high]) <= block:
            size += len(texts[high])
            high += 1
        out += _digests(texts[low:high])
        low = high
    return out


def _digests(texts: list[str]) -> list[np.ndarray]:
    gap = "\0" * _PAD
    chars = np.frombuffer(gap.join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + _PAD) - sizes
    edges = np.zeros(len(chars) + 1, np.int8)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + sizes, -1)
    text = np.cumsum(edges[:-1]) > 0
    last = passage_ends(chars, text)
    last[(starts + sizes - 1)[sizes > 0]] = True
    ends = np.flatnonzero(last)
    if not len(ends):
        return [np.zeros(0, np.uint64) for _ in texts]
    owner = np.searchsorted(starts, ends, side="right") - 1
    first = np.maximum(np.r_[0, ends[:-1] + 1], starts[owner])
    lengths = ends - first + 1
    # the characters of all passages stand one after another once the gaps are gone
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.full(int(lengths.max()), _radix)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(mix64(chars[text].astype(np.uint64) + _radix) * powers[place], np.cumsum(lengths) - lengths)
    keys = mix64(sums + lengths.astype(np.uint64))
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    again = np.r_[False, (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])]
    if again.any():
        at = np.arange(len(keys))
        nth = at - np.maximum.accumulate(np.where(again, 0, at))
        keys = np.where(again, mix64(keys + nth.astype(np.uint64) * _salts[0, 0]), keys)
    return np.split(keys, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """Each key's cells, one in each third. Keys are digests, so a product spreads them well enough."""
    third = cells // 3
    return (((keys * _salts) >> _high) % np.uint64(third)).astype(np.int64) + np.array([[0], [third], [2 * third]])


def _checked(keys: np.ndarray) -> np.ndarray:
    """A check of each key that exclusive-or doesn't carry over to sums of keys."""
    return ((keys ^ _check) * _spread) >> _high


class Sketches:
    """Sketches of many sets, each of `cells` cells (a multiple of three): counts, exclusive-or of keys and of checks."""

    def __init__(self, sets: list[np.ndarray], cells: int):
        self.n, self.cells = len(sets), cells
        self.counts = np.zeros(self.n * cells, np.int64)
        self.keys, self.checks = np.zeros(self.n * cells, np.uint64), np.zeros(self.n * cells, np.uint64)
        if sets:
            keys = np.concatenate(sets)
            self._toggle(keys, np.repeat(np.arange(self.n), [len(s) for s in sets]), np.ones(len(keys), np.int64))

    def _toggle(self, keys: np.ndarray, owner: np.ndarray, signs: np.ndarray) -> None:
        """Puts keys in, or takes them out, as exclusive-or does either; signs are added to the counts."""
        at = (_places(keys, self.cells) + owner * self.cells).ravel()
        self.counts += np.bincount(at, weights=np.tile(signs, 3), minlength=len(self.counts)).astype(np.int64)
        np.bitwise_xor.at(self.keys, at, np.tile(keys, 3))
        np.bitwise_xor.at(self.checks, at, np.tile(_checked(keys), 3))

    def minus(self, first: list[int], second: list[int]) -> Sketches:
        """For each pair of numbers the first one's sketch less the second one's."""
        out = Sketches([], self.cells)
        counts, keys, checks = (x.reshape(self.n, self.cells) for x in (self.counts, self.keys, self.checks))
        out.n, out.counts = len(first), (counts[first] - counts[second]).ravel()
        out.keys, out.checks = (keys[first] ^ keys[second]).ravel(), (checks[first] ^ checks[second]).ravel()
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes single keys out until none is left: (sketch, key, sign) of all found, which sketches have come out empty,
        and an estimate of how many keys each held, from the share of cells that were empty (FULL: none was)."""
        busy = (self.counts != 0) | (self.keys != 0)
        idle = self.cells - busy.reshape(self.n, self.cells).sum(axis=1)
        held = np.where(idle > 0, np.ceil(-self.cells / 3 * np.log(np.maximum(idle, 1) / self.cells)), FULL).astype(np.int64)
        found: list[tuple] = []
        for _ in range(4 * self.cells):  # beyond, a false check has turned up, and a larger sketch is tried
            one = np.flatnonzero(np.abs(self.counts) == 1)
            one = one[_checked(self.keys[one]) == self.checks[one]]
            if not len(one):
                break
            owner = one // self.cells
            _, pick = np.unique(mix64(self.keys[one] + owner.astype(np.uint64) * _radix), return_index=True)
            keys, owner, signs = self.keys[one[pick]], owner[pick], self.counts[one[pick]]
            found.append((owner, keys, signs))
            self._toggle(keys, owner, -signs)
        left = ((self.counts != 0) | (self.keys != 0) | (self.checks != 0)).reshape(self.n, self.cells).any(axis=1)
        kinds = (np.int64, np.uint64, np.int64)
        return *(np.concatenate([np.zeros(0, k), *(f[i] for f in found)]) for i, k in enumerate(kinds)), ~left, held

    def printed(self, sizes: list[int]) -> list[str]:
        """The number of digests and the sketch of each set, as text."""
        counts, keys, checks = (x.reshape(self.n, self.cells) for x in (self.counts.astype("<i4"), self.keys.astype("<u8"), self.checks.astype("<u4")))
        return [base64.b64encode(struct.pack("<I", s) + counts[i].tobytes() + keys[i].tobytes() + checks[i].tobytes()).decode() for i, s in enumerate(sizes)]


def fingerprints(texts: list[str], cells: int = CELLS) -> list[str]:
    sets = digests(texts)
    return Sketches(sets, cells).printed([len(s) for s in sets])


def parsed(fingerprint: str) -> tuple[int, Sketches]:
    """The number of digests and the sketch of a printed fingerprint."""
    data = base64.b64decode(fingerprint)
    cells = (len(data) - 4) // 16
    out = Sketches([], cells)
    out.n, out.counts = 1, np.frombuffer(data, "<i4", cells, 4).astype(np.int64)
    out.keys, out.checks = np.frombuffer(data, "<u8", cells, 4 + 4 * cells).copy(), np.frombuffer(data, "<u4", cells, 4 + 12 * cells).astype(np.uint64)
    return struct.unpack_from("<I", data)[0], out


def _larger(cells: int, held: int) -> int:
    """The next size to try: doubled until it gives room for about 1.5 cells a key, eight times if no cell was empty."""
    return cells * (8 if held == FULL else 2 ** max(1, math.ceil(math.log2(max(1.5 * held, 1) / cells))))


def differences(sets: list[np.ndarray], pairs: list[tuple[int, int]], most_cells: int = 1 << 18) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of numbers of sets the keys that only the first and only the second holds. All start with the smallest
    sketches; pairs whose difference doesn't come out empty are sketched anew, larger, until it does. Pairs whose sketches
    have more than `most_cells` cells together are taken in turns."""
    out: list = [None] * len(pairs)
    todo = {CELLS: [*range(len(pairs))]}
    while todo:
        cells = min(todo)
        waiting = todo.pop(cells)
        step = max(1, most_cells // cells)
        for low in range(0, len(waiting), step):
            some = waiting[low : low + step]
            used = sorted({x for i in some for x in pairs[i]})
            place = {x: j for j, x in enumerate(used)}
            made = Sketches([sets[x] for x in used], cells)
            owner, keys, signs, done, held = made.minus(*([place[pairs[i][k]] for i in some] for k in (0, 1))).peel()
            order = np.argsort(owner, kind="stable")
            keys, signs, cuts = keys[order], signs[order], np.searchsorted(owner[order], np.arange(len(some) + 1))
            for j, i in enumerate(some):
                if done[j]:
                    mine, sign = keys[cuts[j] : cuts[j + 1]], signs[cuts[j] : cuts[j + 1]]
                    out[i] = mine[sign > 0], mine[sign < 0]
                else:
                    todo.setdefault(_larger(cells, int(held[j])), []).append(i)
    return out


def compare_versions(documents: DataFrame, base: str, others: list[str], rows: int = 64) -> DataFrame:
    """Fingerprints a text column and other versions of it, and compares them.

    For the column `base` and each column in `others` a column <name>_fingerprint is added, and for the latter
    <name>_likeness (0 to 1: shared over all passages, from what peeling recovers), <name>_gone and <name>_new (counts of
    differing passage digests). Null texts are empty; two empty texts have likeness 1, an empty and another one 0. The text
    columns themselves are not returned; other columns and rows stay, and clashing columns are replaced.
    """
    names = [f"{base}_fingerprint", *(f"{o}_{x}" for o in others for x in ("fingerprint", "likeness", "gone", "new"))]
    rest = [c for c in documents.columns if c not in (base, *others, *names)]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            columns = [batch.column(c).to_pylist() for c in (base, *others)]
            kinds = [*dict.fromkeys(t for c in columns for t in c)]
            number = {t: i for i, t in enumerate(kinds)}
            sets = digests(kinds)
            sizes = [*map(len, sets)]
            prints = dict(zip(kinds, Sketches(sets, CELLS).printed(sizes)))
            found = differences(sets, [(number[a], number[b]) for other in columns[1:] for a, b in zip(columns[0], other)])
            out: list[list] = [[prints[t] for t in columns[0]]]
            for k, other in enumerate(columns[1:]):
                gone, new = zip(*((len(a), len(b)) for a, b in found[k * len(batch) : (k + 1) * len(batch)]))
                shared = [sizes[number[t]] - g for t, g in zip(columns[0], gone)]
                like = [s / (s + g + n) if s + g + n else 1.0 for s, g, n in zip(shared, gone, new)]
                out += [[prints[t] for t in other], like, [*gone], [*new]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *map(pa.array, out)], names=[*rest, *names])
        give_back()

    kept = small_batches(documents).select(*rest, *(text_or_empty(c).alias(c) for c in (base, *others)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in rest]
    new = [f"`{base}_fingerprint` string", *(f"`{o}_fingerprint` string, `{o}_likeness` double, `{o}_gone` long, `{o}_new` long" for o in others)]
    return kept.mapInArrow(compared, ", ".join([*fields, *new]))


def with_next(documents: DataFrame) -> DataFrame:
    """Adds next_text, the text of the document with the next larger doc_id (after the last: of the first).

    Documents are dealt to ranges of doc_id in one shuffle; the first row of a range also goes to the range before it.
    Equal ids are ordered by text; null ids come first; null texts are empty. An empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    # how many of the cuts (a bounded number) are at most doc_id: first by groups of cuts, then within one
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    listed = lambda cs: F.array(*[F.lit(c) for c in cs]).cast("array<long>")
    upto = lambda cs: F.size(F.filter(cs, lambda c: c <= F.col("doc_id")))
    group = upto(listed([g[0] for g in groups]))
    within = upto(F.element_at(F.array(*map(listed, groups)), F.greatest(group, F.lit(1)))) if cuts else F.lit(0)
    above = F.when(group > 0, (group - 1) * step + within).otherwise(0) if cuts else F.lit(0)
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(above))
    firsts = sorted((r["range"], r["m"]) for r in rows.groupBy("range").agg(F.min("doc_id").alias("m")).collect())
    if not firsts:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    to = [(m, firsts[i - 1][0]) for i, (_, m) in enumerate(firsts)]  # the last range is before the first
    small = spark.createDataFrame(to, "first_id long, into int")
    rows = rows.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    places = F.array(F.struct(F.col("range").cast("int").alias("range"), F.lit(False).alias("copy")), F.struct(F.col("into").alias("range"), F.lit(True).alias("copy")))
    dealt = rows.select("doc_id", "text", F.explode(F.when(F.col("into").isNull(), F.slice(places, 1, 1)).otherwise(places)).alias("p")).select("doc_id", "text", "p.range", "p.copy")

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in slices(batches):
            out = []
            for key, text, at, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "copy"))):
                if waiting and waiting[2] == at:
                    out.append((waiting[0], waiting[1], text))
                waiting = None if copy else (key, text, at)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], names=["doc_id", "text", "next_text"])

    return dealt.repartition("range").sortWithinPartitions("range", "copy", "doc_id", "text").mapInArrow(followed, "doc_id long, text string, next_text string")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and against the next document."""
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    pairs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn(
        "edited", F.concat(F.substr(F.col("text"), F.lit(1), n - quarter), F.substr(F.col("next_text"), F.lit(1), quarter))
    )
    pairs = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    return compare_versions(pairs, "text", ["edited", "next_text"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("text_fingerprint").alias("fingerprint"),
        "edited_fingerprint",
        F.col("edited_likeness").alias("near_edited"),
        F.col("next_text_likeness").alias("near_next"),
        "edited_gone",
        "edited_new",
    )
