"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from lexspark.llm.common import give_back, slices, small_batches, table, text_or_empty

#: A blank, as byte-level models write it.
_BLANK = "Ġ"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], windows: int) -> list[int]:
    """Deals sizes to windows with near-equal sums; returns the window of each size.

    Every size starts as a partial partition with one filled window. The two partitions with the largest imbalance
    are merged, the fullest windows of one with the emptiest of the other, until one partition is left.
    """
    if windows <= 1 or not sizes:
        return [0] * len(sizes)
    # a partition holds its filled windows only, fullest first, as (sum, tree); a tree is an item or a pair of trees
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, x = heapq.heappop(heap)
        _, _, y = heapq.heappop(heap)
        over = len(x) + len(y) - windows
        if over <= 0:
            merged = x + y
        else:  # the last `over` windows of x meet the last of y, the emptiest of one the fullest of the other
            meet = [(a + b, (s, t)) for (a, s), (b, t) in zip(x[len(x) - over :], reversed(y[len(y) - over :]))]
            merged = x[: len(x) - over] + y[: len(y) - over] + meet
        merged.sort(key=itemgetter(0), reverse=True)
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], made, merged))
        made += 1
    out = [0] * len(sizes)
    for window, (_, tree) in enumerate(heap[0][2]):
        todo = [tree]
        while todo:
            if isinstance(node := todo.pop(), tuple):
                todo += node
            else:
                out[node] = window
    return out


def windows_for(sizes: list[int], capacity: int) -> tuple[int, list[int]]:
    """The number of windows and the window of each size; the number rises until no window exceeds the capacity."""
    n = max(1, -(-sum(sizes) // capacity))
    while True:
        where = differencing(sizes, n)
        if max(np.bincount(where, weights=sizes, minlength=1), default=0) <= capacity:
            return n, where
        n += 1


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them with add_special_tokens=False.

    Byte-level models cut a text into runs of letters, numbers, other characters and white space, and none of these reaches
    across the start of a word (a run without white space, with the blank before it), nor from Latin letters to a sign
    after them (an apostrophe aside, which may begin an ending). So each distinct word, cut after the letters that it
    begins with, and each run of other white space, is encoded by the library once and looked up afterwards; at most
    `cached` of them and those of one call are kept: once half of them are new, those not met since are forgotten. Texts
    that hold an added token, which cuts before words do, and texts for models of other kinds go to the library whole.
    """

    def __init__(self, path: str, cached: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.by_word = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.library = Tokenizer.from_file(path)
        # the same model for ASCII letters with a blank before them, which it knows as they are: no pattern is needed to cut them
        self.letters = Tokenizer.from_file(path)
        self.letters.pre_tokenizer = Split(_BLANK, "merged_with_next")
        # the four separators from 0x1C on are no white space for the library
        word, blank = r"[\S\x1c-\x1f]", r"[^\S\x1c-\x1f]"
        letters, others = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[^\t-\r -&(-/:-@\[-`{-~]"  # the latter: all but ASCII's signs and blanks
        self.cut = re.compile(rf" ?{letters}++(?!{others})| ?{word}+|{blank}+(?!{word})|{blank}+")
        self.begins = np.zeros(self.library.get_vocab_size(), bool)
        self.begins[[i for t, i in self.library.get_vocab().items() if t.startswith(_BLANK)]] = True
        self.cached = cached
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Asks the library for the ids of new words: those that begin with a blank as one text, in which an id that begins
        with a blank begins a word; the others one by one. What was known before is taken from there."""
        again = self.before.keys() & words
        self.known.update(zip(again, map(self.before.__getitem__, again)))
        spaced: tuple[list[str], list[str]] = [], []
        for w in words - again:
            if w[0] == " " and not w.isspace():
                spaced[w.isascii() and w[1:].isalpha()].append(w)
        for some, library, blank in zip(spaced, (self.library, self.letters), (" ", _BLANK)):
            if some:
                text = "".join(some).replace(" ", blank)
                ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                starts = np.flatnonzero(self.begins[ids])
                if len(starts) == len(some):
                    self._keep(some, ids, np.r_[starts, len(ids)])
        rest = [*words.difference(self.known)]
        if rest:
            done = self.library.encode(rest, is_pretokenized=True, add_special_tokens=False)
            self._keep(rest, np.array(done.ids, "<u4"), np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(rest) + 1)))

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        data, at = ids.tobytes(), (4 * ends).tolist()
        self.known.update((w, data[low:high]) for w, low, high in zip(words, at, at[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        whole = [not self.by_word or (self.added is not None and self.added.search(t) is not None) for t in texts]
        if 2 * len(self.known) > self.cached:
            self.known, self.before = {}, self.known
        words = [[] if w else self.cut.findall(t) for t, w in zip(texts, whole)]
        self._learn(set(chain.from_iterable(words)).difference(self.known))
        out = [b"".join(map(self.known.__getitem__, c)) for c in words]
        for i in (i for i, w in enumerate(whole) if w):
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


@cache
def _encoder(path: str) -> Encoder:
    """One for each worker process; each task forgets the words it has learned."""
    return Encoder(path)


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, piece: int = 256, block: int = 512) -> DataFrame:
    """Packs documents (doc_id, text) into sequences; returns the pieces.

    A document's ids (a null text is empty) and `end_id` are cut into full sequences and a rest of pieces of at most
    `piece` ids. Blocks of `block` pieces, in the order in which a task reads them, are dealt to windows by
    differencing; memory is bound by a block, nothing is shuffled, and a task that is run again gives the same rows.
    Columns: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. Rows with equal
    or null doc_id are packed each on its own; other columns are ignored; an empty table gives no rows.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pyspark.TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        def dealt(pieces: list[tuple]) -> list[tuple]:
            nonlocal number
            n, where = windows_for([p[2] for p in pieces], capacity)
            filled, out = [0] * n, []
            for p, w in zip(pieces, where):
                out.append((*p, number + w, filled[w]))
                filled[w] += p[2]
            number += n
            return out

        encoder, last = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        gc.disable()  # the many small lists here hold no cycles, and looking for some takes time
        try:
            for batch in slices(batches, 256):
                out: list[tuple] = []
                for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                    data, n, start = ids + last, len(ids) // 4 + 1, 0
                    while n - start >= capacity:
                        out.append((key, start, capacity, data[4 * start : 4 * (start + capacity)], n, number, 0))
                        number, start = number + 1, start + capacity
                    while start < n:
                        length = min(piece, n - start)
                        waiting.append((key, start, length, data[4 * start : 4 * (start + length)], n))
                        start += length
                while len(waiting) >= block:
                    out += dealt(waiting[:block])
                    del waiting[:block]
                if out:
                    yield as_batch(out)
            if waiting:
                yield as_batch(dealt(waiting))
        finally:  # also where the task fails or is cut short
            encoder.forget()
            gc.enable()
            give_back()

    return small_batches(documents).select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(packed, PIECES)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _digested(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return _digested(pack_documents(table(spark, sf_dir, "documents"), byte_bpe()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of 1024 ids."""
    return _digested(pack_documents(docs, byte_bpe()))
