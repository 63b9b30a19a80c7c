"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model's protobuf is parsed here; normaliser, metaspace marker, scores or merges and byte fallback are rebuilt as a
tokenizers model. Pieces never reach across the start of a word, so words are encoded once each, in multithreaded
batches, and looked up afterwards. Each of these words is compared with the sentencepiece library, whose ids hold where
the two differ: the merges' order cannot tell apart the ways in which a piece splits, as in long runs of spaces.
Decoding joins what the ids stand for.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import give_back, small_batches, table, text_or_empty

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        field, wire = divmod(number(), 8)
        if wire == 0:
            yield field, number()
        else:
            size = {1: 8, 5: 4}.get(wire) or number()
            yield field, data[at : at + size]
            at += size


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[tuple[str, float, int], ...]
    unigram: bool
    byte_fallback: bool
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    trim_spaces: bool


def parse_model(data: bytes) -> PieceModel:
    pieces, trainer, normaliser = [], {}, {}
    for field, value in _fields(data):
        if field == 1:
            p = dict(_fields(value))
            pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    if trainer.get(3, 1) not in (1, 2):
        raise ValueError("only unigram and byte-pair models are known")
    unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    return PieceModel(tuple(pieces), trainer.get(3, 1) == 1, bool(trainer.get(35, 0)), unknown, normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))


def build_single(model: PieceModel):
    """The tokenizers library's form of a model, for single words that are already normalised."""
    from tokenizers import Tokenizer, models

    if model.unigram:
        return Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback))
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    merges = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            halves = [(piece[:i], piece[i:]) for i in range(1, len(piece))]
            merges += [(-score, ids[a], ids[b], a, b) for a, b in halves if a in ids and b in ids]
    merges.sort()
    return Tokenizer(models.BPE(ids, [(a, b) for *_, a, b in merges], unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback))


def build(model: PieceModel):
    """The same with the model's normaliser and decoder, for whole texts."""
    from tokenizers import AddedToken, Regex, decoders, normalizers, pre_tokenizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    whole = build_single(model)
    whole.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if splits(model):
        whole.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    whole.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    own = [AddedToken(p, normalized=False) for p, _, k in model.pieces if k == USER]
    if own:
        whole.add_tokens(own)
    return whole


def splits(model: PieceModel) -> bool:
    """Whether no piece holds a marker after another character, so that words can be encoded one by one."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) or k == USER for p, _, k in model.pieces)


class Encoder:
    """Encodes and decodes texts; keeps the ids of at most `cached` words. Tokenizers are built when first used."""

    def __init__(self, data: bytes, cached: int = 100_000, verify_every: int = 128):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.data, self.model = data, parse_model(data)
        # unknown words next to each other become one id, unless they are bytes or a known marker parts them
        parted = self.model.byte_fallback or any(p == MARK for p, _, _ in self.model.pieces)
        self.simple = splits(self.model) and parted and not self.model.charsmap and not self.model.trim_spaces
        self.known: dict[str, bytes] = {}
        self.cached, self.every = cached, verify_every
        self.marked = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    @cached_property
    def whole(self):
        return build(self.model)

    @cached_property
    def single(self):
        return build_single(self.model)

    @cached_property
    def reference(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.data)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " not in text and MARK not in text and text[-1] != " " and text[0] != " " and self.model.dummy_prefix:
            return [MARK + w for w in text.split(" ")]
        return self.marked.findall(MARK * self.model.dummy_prefix + text.replace(" ", MARK))

    def _library_ids(self, words: list[str]) -> list[list[int]]:
        """The sentencepiece library's ids of words with their markers."""
        if not self.model.dummy_prefix:
            return self.reference.encode(words, num_threads=1)
        ids = self.reference.encode([w[1:] for w in words], num_threads=1)
        for i, w in enumerate(words):
            if w == MARK:  # an empty text has no ids, the marker at a text's end has
                ids[i] = self.reference.encode("a ")[len(self.reference.encode("a")) :]
        return ids

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        done = self.single.encode(words, is_pretokenized=True, add_special_tokens=False)
        own, ends = np.array(done.ids, "<u4"), np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(words) + 1))
        theirs = self._library_ids(words)
        flat, sizes = np.fromiter(chain.from_iterable(theirs), "<u4"), np.fromiter(map(len, theirs), np.int64, len(words))
        if not (np.array_equal(own, flat) and np.array_equal(np.diff(ends), sizes)):  # the library's ids hold
            own, ends = flat, np.r_[0, np.cumsum(sizes)]
        data, at = own.tobytes(), (4 * ends).tolist()
        self.known.update((w, data[low:high]) for w, low, high in zip(words, at, at[1:]))

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.simple:
            own = (e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False))
            return [np.array(a if a == b else b, "<u4").tobytes() for a, b in zip(own, self.reference.encode(texts, num_threads=1))]
        cut = [self.words(t) for t in texts]
        if len(self.known) > self.cached:
            self.known.clear()
        self._learn(list({w for c in cut for w in c if w not in self.known}))
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        if any(np.array(self.reference.encode(texts[i]), "<u4").tobytes() != out[i] for i in range(0, len(texts), self.every)):
            out = [np.array(ids, "<u4").tobytes() for ids in self.reference.encode(texts, num_threads=1)]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(b, "<u4").tolist() for b in self.encode_bytes(texts)]

    @cached_property
    def spelt(self) -> list[bytes]:
        """What each id stands for, with spaces for markers."""
        return [bytes([int(p[3:5], 16)]) if k == BYTE and self.model.byte_fallback else p.replace(MARK, " ").encode() for p, _, k in self.model.pieces]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids; the tokenizers library decodes those whose bytes are no text."""
        out = []
        for row in ids:
            try:
                text = b"".join(map(self.spelt.__getitem__, row)).decode()
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.whole.decode(row, skip_special_tokens=False))
        return out


@cache
def _encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def _by_slices(use, model: str, rows: int):
    """An Arrow function that runs use(encoder, values) on so many values at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [use(_encoder(model), batch[low : low + rows].to_pylist()) for low in range(0, len(batch), rows)]
            yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts or [use(_encoder(model), [])])
        give_back()

    return run


def _ids(encoder: Encoder, texts: list[str]) -> pa.Array:
    return pa.array(encoder.encode_bytes(texts), pa.binary())


def _texts(encoder: Encoder, data: list[bytes]) -> pa.Array:
    return pa.array(encoder.decode([np.frombuffer(d, "<u4").tolist() for d in data]), pa.string())


def _both(encoder: Encoder, texts: list[str]) -> pa.Array:
    ids = encoder.encode_bytes(texts)
    return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), _texts(encoder, ids)], ["ids", "text"])


def encode_pieces(documents: DataFrame, model: str, column: str = "piece_ids", rows: int = 128) -> DataFrame:
    """Adds the piece ids of whole texts, as little-endian unsigned 32-bit numbers in a binary column.

    `model` is a path that every executor has. A null or empty text has no ids. Each distinct word that a task meets is
    compared with the sentencepiece library, whose ids are taken where they differ. That words can be joined is checked
    with the first text of every `rows`; the library encodes all of these if they ever differ. Other columns
    and rows stay; a clashing column of the same name is replaced.
    """
    return small_batches(documents).withColumn(column, _arrow(_by_slices(_ids, model, rows), "binary")(text_or_empty()))


def decode_pieces(encoded: DataFrame, model: str, column: str = "piece_ids", text: str = "decoded", rows: int = 128) -> DataFrame:
    """Adds the text of piece ids; null or no ids give an empty text. Ids outside the model's range raise an error."""
    return small_batches(encoded).withColumn(text, _arrow(_by_slices(_texts, model, rows), "string")(F.coalesce(column, F.lit(b""))))


def recode_pieces(documents: DataFrame, model: str, column: str = "recoded", rows: int = 128) -> DataFrame:
    """Adds a struct of the piece ids of whole texts (as encode_pieces gives them) and the text that they decode to, in one pass."""
    return small_batches(documents).withColumn(column, _arrow(_by_slices(_both, model, rows), "ids binary, text string")(text_or_empty()))


def _arrow(run, kind: str):
    @F.arrow_udf(kind)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return coded


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    documents = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    ids, decoded = F.col("recoded.ids"), F.col("recoded.text")
    return recode_pieces(documents, piece_model()).select(
        "doc_id",
        (F.octet_length(ids) / 4).cast("long").alias("n_pieces"),
        F.crc32(ids).alias("ids_crc32"),
        F.length(decoded).cast("long").alias("decoded_chars"),
        (decoded == F.col("text")).alias("round_trip"),
    )
