"""Suffix-array dedup by a run-length index: bytes of 200-byte strings that also start elsewhere are removed.

Documents are cut into pieces: runs of starts whose 200-byte strings share their least k-gram (by hash). Equal strings have
an equal least k-gram, so they meet under one key, and every start is in exactly one piece. Only pieces whose key occurs
more than once are looked at; equal ones are one string with a weight. The pieces of whole keys, some megabytes at a time,
make a Burrows-Wheeler transform that is kept as its runs with the text places of both ends of each run. A place that
doesn't stand at a run's end has the match of the place before it, shortened by one; so the lengths at run ends, streamed
over the texts, are all matching statistics, and matches of 200 bytes or more are marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import give_back, mix64, slices, table, text_or_empty, written

SPAN = 200
#: Lengths of the k-grams that are keys; a key with too many different pieces is cut anew by the next, at last by whole strings.
LEVELS = (32, 150, 190, SPAN)
#: Different pieces of one key that one index takes.
MOST_PIECES = 8192
#: Bytes after which an index is full, at the end of a key.
INDEX_BYTES = 1_500_000
#: Starts of a document that are cut at a time.
SEGMENT = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(SEGMENT + SPAN + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:n], _powers[1][:n]


def _window_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` numbers in a row: from blocks of that width, the rest of one and the start of the next."""
    n = len(h) - width + 1
    blocks = np.concatenate([h, np.full(-len(h) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def cut(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, content hash, first start, number of starts) of a text's pieces; a piece's bytes reach 199 beyond its last start.

    A long text goes segment by segment, which may cut a piece in two but changes no key.
    """
    found, total = [], len(data) - SPAN + 1
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, total, SEGMENT):
        c = whole[at : at + SEGMENT + SPAN - 1]
        m = len(c) - SPAN + 1
        up, down = _power(len(c))
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        h = mix64((sums[k:] - sums[:-k]) * down[: len(c) - k + 1])
        least = _window_least(h, SPAN - k + 1)
        new = np.ones(m, bool)
        new[1:] = (least[1:] != least[:-1]) | (h[: m - 1] == least[: m - 1])  # another least k-gram, or the same one passed
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, m))
        content = mix64((sums[first + count + SPAN - 1] - sums[first]) * down[first] + count.astype(np.uint64))
        found.append((least[first].view(np.int64), content.view(np.int64), first + at, count))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_order(text: np.ndarray, packed: np.ndarray, depth: int) -> np.ndarray:
    """Starts of a text's suffixes in order of their first `depth` characters, by doubling; packed holds seven characters."""
    n = len(text)
    order = np.argsort(packed)
    of = packed[order]
    head = np.concatenate([[True], of[1:] != of[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = group
    open_at = np.flatnonzero(~(head & np.append(head[1:], True)))
    k = 7
    while k < depth and len(open_at):
        starts = order[open_at]
        both = rank[starts] << 32 | rank[np.minimum(starts + k, n)]
        by = np.argsort(both)
        starts, both = starts[by], both[by]
        order[open_at] = starts
        head = np.concatenate([[True], both[1:] != both[:-1]])
        rank[starts] = open_at[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
        open_at = open_at[~(head & np.append(head[1:], True))]
        k *= 2
    return order


@dataclass(frozen=True)
class RunIndex:
    """A run-compressed Burrows-Wheeler transform of strings, with the text places of each run's first and last row."""

    text: np.ndarray  # characters plus one; each string ends with a zero
    packed: np.ndarray  # seven characters from each place on
    starts: np.ndarray  # of the strings
    left: np.ndarray  # bytes from a place to its string's end
    letters: np.ndarray  # of the runs
    lengths: np.ndarray
    firsts: np.ndarray
    lasts: np.ndarray

    @classmethod
    def build(cls, strings: list[bytes]) -> RunIndex:
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        text = raw.astype(np.uint64) + np.uint64(1)
        sizes = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        text[ends] = 0
        two = text << np.uint64(9) | np.append(text[1:], np.zeros(1, np.uint64))
        four = two << np.uint64(18) | np.concatenate([two[2:], np.zeros(2, np.uint64)])[: len(two)]
        packed = four << np.uint64(27) | np.concatenate([four[4:], np.zeros(4, np.uint64)])[: len(four)] >> np.uint64(9)
        left = np.repeat(ends, sizes + 1) - np.arange(len(text))
        order = suffix_order(text, packed, int(sizes.max(initial=0)) + 1)
        before = text[order - 1].astype(np.uint16)  # the place before the first is the last end
        head = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])  # a string's start has no place before it
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(order)) - 1
        return cls(text, packed, ends - sizes, left, before[first], last - first + 1, order[first], order[last])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes from places a and b agree, up to the ends of their strings."""
        most, out = np.minimum(self.left[a], self.left[b]), np.zeros(len(a), np.int64)
        live, step = np.arange(len(a)), 0
        while len(live):
            odd = self.packed[a[live] + step] ^ self.packed[b[live] + step]
            same = odd == 0
            differ = odd[~same]
            out[live[~same]] = step + (62 - np.floor(np.log2(differ.astype(float))).astype(np.int64)) // 9
            live, step = live[same], step + 7
            over = step >= most[live]
            out[live[over]] = most[live[over]]
            live = live[~over]
        return np.minimum(out, most)

    def covered(self, weights: np.ndarray) -> np.ndarray:
        """Which places lie in a match of SPAN bytes or more with another place; a string of a weight over one matches its copy.

        A run's last row and the next run's first are neighbours, so the best match of each is known; streamed along the
        text it holds until a further one starts.
        """
        reach = np.zeros(len(self.text), np.int64)
        above, below = self.lasts[:-1], self.firsts[1:]
        long = (self.left[above] >= SPAN) & (self.left[below] >= SPAN)
        above, below = above[long], below[long]
        size = self.common(above, below)
        long = size >= SPAN
        above, below, size = above[long], below[long], size[long]
        reach[below] = below + size
        reach[above] = np.maximum(reach[above], above + size)
        twice = self.starts[weights > 1]
        reach[twice] = twice + self.left[twice]
        statistics = np.maximum.accumulate(reach) - np.arange(len(reach))
        return (statistics > 0) & (self.text > 0)


def marked(strings: list[bytes], weights: list[int]) -> list[list[tuple[int, int]]]:
    """The covered ranges of each string."""
    index = RunIndex.build(strings)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], index.covered(np.array(weights)), [False]]).astype(np.int8)))
    low, high = edges[::2], edges[1::2]
    owner = np.searchsorted(index.starts, low, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for o, a, b in zip(owner.tolist(), (low - index.starts[owner]).tolist(), (high - index.starts[owner]).tolist()):
        out[o].append((a, b))
    return out


def _identified(documents: DataFrame) -> DataFrame:
    """Documents as bytes with their text's identity, 96 bits of hashes; equal texts have equal results."""
    text = text_or_empty().alias("text")
    return documents.select("doc_id", text).select(F.col("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("t1"), F.crc32(F.col("text").cast("binary")).alias("t2"))


def _pieces(texts: DataFrame) -> DataFrame:
    """(key, content, t1, t2, start, starts) of all pieces of all texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found, rows = [], []
            for row, data in enumerate(batch.column(0).to_pylist()):
                found.append(cut(data, LEVELS[0]))
                rows.append(np.full(len(found[-1][0]), row))
            rows = np.concatenate(rows)
            key, content, start, starts = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(content), batch.column(1).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array(start.astype(np.int32)), pa.array(starts.astype(np.int32))],
                names=["key", "content", "t1", "t2", "start", "starts"],
            )
        give_back()

    return texts.select("text", "t1", "t2").mapInArrow(of, "key long, content long, t1 long, t2 long, start int, starts int")


def _with_bytes(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(key, content, weight, bytes) of pieces (key, content, weight, t1, t2, start, starts); rows may repeat.

    A document takes part once for each of its equal neighbours in the sorted join.
    """
    lists = pieces.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "content", "weight", "start", "starts")).alias("pieces"))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, 64):
            out: list[tuple] = []
            for t1, t2, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text", "pieces"))):
                if (t1, t2) != last:
                    last = (t1, t2)
                    out += [(p["key"], p["content"], p["weight"], data[p["start"] : p["start"] + p["starts"] + SPAN - 1]) for p in wanted]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "content", "weight", "bytes"])
        give_back()

    joined = texts.join(lists.hint("merge"), ["t1", "t2"]).select("doc_id", "text", "t1", "t2", "pieces")
    return joined.mapInArrow(taken, "key long, content long, weight long, bytes binary")


def _marks(pieces: DataFrame) -> DataFrame:
    """(key, content, low, high): the covered ranges of pieces (key, content, weight, bytes), by indexes of whole keys."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def settle() -> pa.RecordBatch:
            ranges = marked([h[3] for h in held], [h[2] for h in held])
            rows = [(h[0], h[1], a, b) for h, found in zip(held, ranges) for a, b in found]
            columns = list(zip(*rows)) or [()] * 4
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "content", "low", "high"])

        for batch in slices(batches, 1024):
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "weight", "bytes"))):
                if row[:2] == last:
                    continue
                if size >= INDEX_BYTES and row[0] != last[0]:
                    yield settle()
                    size = 0
                held.append(row)
                size, last = size + len(row[3]), row[:2]
        if held:
            yield settle()
        give_back()

    return pieces.repartition("key").sortWithinPartitions("key", "content").mapInArrow(of, "key long, content long, low int, high int")


def _settled(pieces: DataFrame, level: int, most: int) -> DataFrame:
    """Marks of pieces (key, content, weight, bytes); those of keys with more than `most` of them by their parts, cut anew."""
    if level + 1 == len(LEVELS):  # a key is a whole string: it has one content
        return _marks(pieces)
    many = pieces.select("key", "content").distinct().groupBy("key").count().where(F.col("count") > most).select("key")
    many = written(many)
    if many.isEmpty():
        return _marks(pieces)
    hot = pieces.join(many, "key", "left_semi").groupBy("key", "content").agg(F.first("weight").alias("weight"), F.first("bytes").alias("bytes"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out: list[tuple] = []
            for key, content, weight, data in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "weight", "bytes"))):
                for k, c, a, n in zip(*(x.tolist() for x in cut(data, LEVELS[level + 1]))):
                    out.append((key, content, a, k, c, weight, data[a : a + n + SPAN - 1]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["of_key", "of_content", "at", "key", "content", "weight", "bytes"])

    parts = written(hot.mapInArrow(again, "of_key long, of_content long, at int, key long, content long, weight long, bytes binary"))
    own = written(parts.groupBy("key", "content").agg(F.sum("weight").alias("weight"), F.first("bytes").alias("bytes")))
    found = _settled(own, level + 1, most).join(parts.select("of_key", "of_content", "at", "key", "content"), ["key", "content"])
    found = found.select(F.col("of_key").alias("key"), F.col("of_content").alias("content"), (F.col("low") + F.col("at")).alias("low"), (F.col("high") + F.col("at")).alias("high"))
    return _marks(pieces.join(many, "key", "left_anti")).unionByName(found)


def repeated_ranges(documents: DataFrame, most: int = MOST_PIECES) -> DataFrame:
    """(doc_id, text as bytes, ranges): byte ranges of each document that 200-byte strings with another start cover.

    Ranges (low, high) may overlap and are in no order; null where there are none. Every row of documents (doc_id, text)
    comes back; null texts are empty, other columns are left out. Equal texts, rows that repeat and null ids each count as
    documents of their own. No candidate is dropped: keys that are too frequent for one index are cut anew. Of a document
    that is copied thousands of times rows of 40 bytes meet, not texts; equal pieces are aggregated before the shuffle.
    """
    texts = _identified(documents)
    pieces = written(_pieces(texts))
    often = pieces.groupBy("key").count().where("count > 1").select("key")
    members = written(pieces.join(often, "key", "left_semi"))
    contents = members.groupBy("key", "content").agg(F.count("*").alias("weight"), F.min(F.struct("t1", "t2", "start", "starts")).alias("at"))
    contents = written(contents.select("key", "content", "weight", "at.*"))
    marks = _settled(written(_with_bytes(texts, contents)), 0, most)  # once, as keys are counted and cut anew from it
    found = members.join(marks, ["key", "content"]).select("t1", "t2", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    ranges = found.groupBy("t1", "t2").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    return texts.join(ranges.hint("merge"), ["t1", "t2"], "left").select("doc_id", "text", "ranges")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges in order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def without_repeats(documents: DataFrame, most: int = MOST_PIECES) -> DataFrame:
    """(doc_id, kept, removed): the bytes that stay of each document and its maximal removed ranges, see repeated_ranges."""
    found = repeated_ranges(documents, most)
    kind = found.schema["doc_id"].dataType.simpleString()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out, spans = [], []
            for data, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone, at, parts = merged([(r["low"], r["high"]) for r in ranges or ()]), 0, []
                for low, high in gone:
                    parts.append(data[at:low])
                    at = high
                out.append(b"".join([*parts, data[at:]]))
                spans.append([{"low": a, "high": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(spans, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))], names=["doc_id", "kept", "removed"])
        give_back()

    return found.mapInArrow(kept, f"doc_id {kind}, kept binary, removed array<struct<low:int,high:int>>")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated bytes."""
    done = without_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["high"] - r["low"])
    return done.select("doc_id", (F.length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
