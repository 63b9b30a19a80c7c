"""License scans: exact phrases, and short notices found with a bounded number of edits.

A notice that may carry k edits is cut into k + 1 pieces; wherever it stands with at most k edits, one piece stands
exactly. An automaton over all pieces finds these places, and the regex library then verifies the whole notice there.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import slices, small_batches, table, text_or_empty


@dataclass(frozen=True)
class Notice:
    """A notice in lower-case words; `edits` it may carry; `key` is the part that tells similar notices apart, and may carry
    few of them (see _key_holds)."""

    label: str
    words: str
    edits: int
    key: str = ""


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = (
    Notice("mit", "released under the mit license", 3, "mit"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("apache", "licensed under the apache license version 2 0", 4, "2 0"),
    Notice("gpl", "licensed under the gnu general public license", 4, "gnu"),
    Notice("lgpl", "licensed under the gnu lesser general public license", 4, "lesser"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 6),
    Notice("mpl", "subject to the terms of the mozilla public license", 4, "mozilla"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2, "nc"),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 2, "sa"),
    Notice("cc-by", "licensed under cc by 4 0", 1, "by 4"),
)
#: Word characters are kept, all other bytes are blanks; letters are lower-cased before.
_blanks = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in range(256))
MATCHES = "array<struct<label:string,first_word:bigint,last_word:bigint,edits:int,base:boolean>>"
_struct = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())]))


def distance(a: str, b: str) -> int:
    """The least number of insertions, deletions and substitutions of characters between two short strings."""
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def within(pattern: str, text: str, edits: int) -> bool:
    """Whether some part of a text is at most so many edits from a pattern: a column of the distance table as two bit masks,
    of its rises and falls, which each character of the text moves on in a few operations."""
    size, masks = len(pattern), _masks(pattern)
    whole, last = (1 << size) - 1, 1 << (size - 1)
    up, down, score = whole, 0, size
    for c in text:
        same = masks.get(c, 0)
        left = same | down
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up) & whole, up & across
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
            if score <= edits:
                return True
        rise, fall = rise << 1 & whole, fall << 1 & whole
        up, down = fall | ~(left | rise) & whole, rise & left
    return score <= edits


@cache
def _masks(pattern: str) -> dict[str, int]:
    """For each character the places of a pattern that hold it, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def _key_holds(notice: Notice, m: regex.Match) -> bool:
    """Whether the key carries at most one edit for every three of its characters, so that no other name passes for it."""
    return not notice.key or distance(m["key"], notice.key) <= len(notice.key) // 3


def _pattern(notice: Notice):
    """The whole notice with at most its edits; what stands for its key is a group."""
    literal = lambda text: regex.escape(text, literal_spaces=True)
    before, _, after = notice.words.partition(notice.key) if notice.key else (notice.words, "", "")
    key = f"(?P<key>{literal(notice.key)})" if notice.key else ""
    return regex.compile(rf"(?b)\b(?:{literal(before)}{key}{literal(after)}){{e<={notice.edits}}}\b")


@cache
def _automaton(notices: tuple[Notice, ...]):
    """Pieces of all notices, each with its notice and place (null without notices), and a pattern for each notice."""
    found = ahocorasick.Automaton()
    pieces: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices):
        cuts = [round(j * len(notice.words) / (notice.edits + 1)) for j in range(notice.edits + 2)]
        for a, b in zip(cuts, cuts[1:]):
            pieces.setdefault(notice.words[a:b], []).append((i, a))
    for piece, places in pieces.items():
        found.add_word(piece, (len(piece), places))
    if pieces:
        found.make_automaton()
    return found if pieces else None, [_pattern(n) for n in notices]


def scan(text: str, notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] = PHRASES) -> tuple[int, list[dict]]:
    """The number of words of a text, and its matches: label, first and last word (from 0), edits, whether a base phrase.

    Every place that a seed points to is verified once: bit masks tell whether anything there is near enough, and only then
    the pattern looks for the best match, so that a text full of seeds that lead nowhere takes linear time too.
    """
    words = text.encode("utf-8", "surrogatepass").lower().translate(_blanks).split()
    line = b" ".join(words)
    out = []
    blanks: list[int] | None = None

    def word_at(place: int) -> int:
        nonlocal blanks
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
        return bisect_left(blanks, place)

    padded = b" " + line + b" "
    for phrase, label in phrases.items():
        sought, at = f" {phrase} ".encode(), -1
        while (at := padded.find(sought, at + 1)) >= 0:
            first = word_at(at)
            out.append({"label": label, "first_word": first, "last_word": first + phrase.count(" "), "edits": 0, "base": True})
    automaton, patterns = _automaton(notices)
    plain = line.decode("latin-1")
    tried: list[set] = [set() for _ in notices]
    windows: list[list[tuple[int, int]]] = [[] for _ in notices]
    for end, (length, places) in automaton.iter(plain) if automaton is not None else ():
        for i, offset in places:
            start, k = end + 1 - length - offset, notices[i].edits
            if (start // 8) not in tried[i]:
                tried[i].add(start // 8)
                windows[i].append((max(0, start - k - 8), start + len(notices[i].words) + k + 8))
    for i, notice in enumerate(notices):
        spans = set()
        for a, b in windows[i]:
            m = patterns[i].search(plain, a, min(b, len(plain))) if within(notice.words, plain[a:b], notice.edits) else None
            if m and _key_holds(notice, m) and m.span() not in spans:
                spans.add(m.span())
                start = m.start() + (len(m[0]) - len(m[0].lstrip()))
                first = word_at(start)
                out.append({"label": notice.label, "first_word": first, "last_word": first + m[0].strip().count(" "), "edits": sum(m.fuzzy_counts), "base": False})
    return len(words), sorted(out, key=lambda m: (m["first_word"], not m["base"], m["label"], m["last_word"]))


def license_matches(documents: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Adds n_words and matches (label, first_word, last_word, edits, base) to documents with a text column.

    Whole texts are scanned; a null or empty text has no words and no matches. All other columns and rows, repeated
    ones too, stay as they are; clashing columns n_words and matches are replaced.
    """
    rest = [c for c in documents.columns if c not in ("n_words", "matches", "text")]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [scan(t, notices) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], _struct)], names=[*rest, "n_words", "matches"]
            )

    kept = small_batches(documents).select(*rest, text_or_empty().alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInArrow(scanned, f"{fields}{', ' * bool(rest)}n_words long, matches {MATCHES}")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and labels of every document, with the labels and best score of the fuzzy notices."""
    found = license_matches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda m: F.array_join(F.sort_array(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first_word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: 1.0 / (1 + m["edits"]))), F.lit(0.0)).alias("score"),
        F.filter("matches", lambda m: ~m["base"]).alias("spans"),
    )
