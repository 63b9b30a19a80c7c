"""Text functions on columns: cleaning, tokens, folding, identifiers, citations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks (Latin-1, Latin Extended-A and Additional, precomposed) and what is left without the marks.
_MARKED = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
_PLAIN = [unicodedata.normalize("NFD", c)[0] for c in _MARKED]


def clean_text(text: Column) -> Column:
    """Line ends as LF, no-break spaces as spaces, runs of blanks as one, lines stripped, single blank lines, no outer blank lines."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.replace(out, F.lit(" "), F.lit(" "))
    out = F.regexp_replace(out, "[\t ]+", " ")
    # strip each line of all Unicode blanks but the line feed
    out = F.regexp_replace(out, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Runs of characters that are not blank in Unicode."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def strip_marks(text: Column) -> Column:
    """Letters without combining marks; d with stroke stays. Combining characters go."""
    return F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_PLAIN)), r"\p{Mn}", "")


def search_terms(text: Column) -> Column:
    """Tokens as the lexical index has them: lower case, marks stripped, runs of letters and digits."""
    return F.regexp_extract_all(strip_marks(F.lower(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without marks, d with stroke as d, blanks collapsed."""
    plain = F.translate(strip_marks(F.lower(text)), "đ", "d")
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", " "), "^ | $", "")


def name_key(text: Column) -> Column:
    """A document name in the form that analyses compare: folded, slashes as hyphens, only a-z, 0-9 and hyphens."""
    return F.regexp_replace(F.translate(fold(text), "/", "-"), "[^a-z0-9-]", "")


def slug(identifier: Column) -> Column:
    """An identifier as it stands in a stored document name."""
    return F.translate(strip_marks(identifier), "Đđ/", "Dd-")


def like_escaped(text: Column) -> Column:
    """Text in which LIKE's wildcards stand for themselves (escape character: backslash)."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


# Shapes of legal identifiers and citations.
_KIND = r"[A-Za-zĐĐ][A-Za-z0-9ĐĐ]*(?:-[A-Za-z0-9ĐĐ]+)*"
NUMBER_YEAR_KIND = rf"(?U)(?<![\d/-])(\d{{1,5}})\s*[/-]\s*(\d{{4}})\s*[/-]\s*({_KIND})"
NUMBER_KIND = rf"(?iuU)(?<![\d/-])(\d{{1,5}})\s*[/-]\s*((?:Q[ĐD]|N[ĐD]|TT|TTLT|CT|NQ|PL|QH\d*|L|SL|UBTVQH\d*)(?:-{_KIND})?)"
GOLD = {
    "documents": r"(?U)(\d+/\d{4}/[A-ZĐ][A-ZĐ-]*|\d+-\d{4}-[A-ZĐ][A-ZĐ-]*)",
    "articles": r"(?U)Điều\s+(\d+)",
    "clauses": r"(?U)[Kk]hoản\s+(\d+)",
    "points": r"(?U)[Đđ]iểm\s+([a-zđ]+)",
}


def _tidy(kind: Column) -> Column:
    """Segments that are all lower case become upper case; mixed ones (an agency such as TTg) stay."""
    lower = lambda s: s.eqNullSafe(F.lower(s)) & ~s.eqNullSafe(F.upper(s))
    return F.array_join(F.transform(F.split(kind, "-"), lambda s: F.when(lower(s), F.upper(s)).otherwise(s)), "-")


def legal_identifier(text: Column) -> Column:
    """The first number/year/kind in a text, else the first number/kind; null without one."""
    part = lambda p, i: F.regexp_extract(text, p, i)
    full = F.concat_ws("/", part(NUMBER_YEAR_KIND, 1), part(NUMBER_YEAR_KIND, 2), _tidy(part(NUMBER_YEAR_KIND, 3)))
    short = F.concat_ws("/", part(NUMBER_KIND, 1), _tidy(part(NUMBER_KIND, 2)))
    return F.when(text.rlike(NUMBER_YEAR_KIND), full).when(text.rlike(NUMBER_KIND), short)


def citations(text: Column, kind: str) -> Column:
    """Distinct citations of a kind (documents, articles, clauses, points) in the order of their first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(GOLD[kind]), F.lit(1)))


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Token windows of a size with an overlap, as (position, text); a tail no longer than the overlap is no window."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    stride, n = size - overlap, F.size(tokens)
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / stride)).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("position"), F.array_join(F.slice(tokens, i * stride + 1, size), " ").alias("text")))


def round_even(x: Column, digits: int = 4) -> Column:
    """Half-even rounding."""
    return F.bround(x, digits)
