"""Legal hierarchy, parent and child chunks, adjacency and integrity."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.conf import Settings
from lexspark.functions.text import token_count, windows, words
from lexspark.sources.tables import small_batches

# Headings of the hierarchy.
CHAPTER = r"(?im)^\s*Chương\s+([IVXLCDM]+|\d+)\s*[:.]?\s*(.*)$"
SECTION = r"(?im)^\s*Mục\s+(\d+[A-Za-zĐđ]?)\s*[:.]?\s*(.*)$"
ARTICLE = r"(?im)^\s*Điều\s+(\d+[A-Za-zĐđ]?)\s*[.:]?\s*(.*)$"
CLAUSE = r"(?m)^\s*(\d+)\s*[.)]\s+(.+)$"
POINT = r"(?im)^\s*([a-zđ])\s*[.)]\s+(.+)$"

_HEADINGS = {kind: re.compile(p) for kind, p in (("chapter", CHAPTER), ("section", SECTION), ("article", ARTICLE), ("clause", CLAUSE), ("point", POINT))}
UNIT = "clause_position int, clause_number string, point_position int, point_label string, unit_text string"
ARTICLES = (
    "document_id long, article_position int, article_number string, article_title string, article_text string, chapter string, section string, "
    f"units array<struct<{', '.join(f.replace(' ', ':') for f in UNIT.split(', '))}>>"
)
_units_type = pa.list_(pa.struct([(n, {"int": pa.int32(), "string": pa.string()}[t]) for n, t in (f.split(" ") for f in UNIT.split(", "))]))


def _parts(kind: str, text: str) -> list[tuple[str, str, str]]:
    """(number, title, text) of each heading of a kind; its text goes up to the next one, stripped."""
    marks = list(_HEADINGS[kind].finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return [(m[1], m[2].strip(), text[m.start() : end].strip()) for m, end in zip(marks, ends)]


def _unit_rows(article: str) -> list[tuple]:
    """An article's points, and its clauses without points, as UNIT has them."""
    out = []
    for i, (number, _, clause) in enumerate(_parts("clause", article)):
        points = [(j, label, text) for j, (label, _, text) in enumerate(_parts("point", clause))] or [(None, None, clause)]
        out += [(i, number, *point) for point in points]
    return out


def _article_rows(text: str) -> list[tuple]:
    """The articles of one document, each with the chapter and section it stands in and its units; the text stands once."""
    upper = {}
    for kind, word in (("chapter", "Chương"), ("section", "Mục")):
        marks = list(_HEADINGS[kind].finditer(text))
        upper[kind] = [m.start() for m in marks], [f"{word} {m[1]} {m[2].strip()}".rstrip() for m in marks]
    starts = [m.start() for m in _HEADINGS["article"].finditer(text)]
    out = []
    for i, (start, (number, title, body)) in enumerate(zip(starts, _parts("article", text))):
        at = {kind: bisect_left(places, start) - 1 for kind, (places, _) in upper.items()}
        chapter = upper["chapter"][1][at["chapter"]] if at["chapter"] >= 0 else None
        inside = at["section"] >= 0 and (chapter is None or upper["section"][0][at["section"]] > upper["chapter"][0][at["chapter"]])
        out.append((i, number, title or None, body, chapter, upper["section"][1][at["section"]] if inside else None, _unit_rows(body)))
    return out


def _in_order(articles: list[tuple]) -> list[tuple]:
    """A document's articles in the order in which chunks are made: within a chapter first the articles outside sections,
    then section by section; then sections outside chapters, then the other articles."""
    chapters, sections = {}, {}
    for i, (*_, chapter, section, _) in enumerate(articles):
        chapters.setdefault(chapter, i)
        sections.setdefault((chapter, section), i)

    def place(article: tuple) -> tuple:
        *_, chapter, section, _ = article
        kind = 0 if chapter is not None else 1 if section is not None else 2
        return kind, -1 if chapter is None else chapters[chapter], -1 if section is None else sections[chapter, section], article[0]

    return sorted(articles, key=place)


def _lists(rows: list[list[tuple]], fields: list[pa.Field], columns: Callable[[list[tuple]], list[pa.Array]]) -> pa.Array:
    """Lists of structs as an Arrow array, column by column."""
    flat = [row for some in rows for row in some]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), pa.StructArray.from_arrays(columns(flat), fields=fields))


def _arrays(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]


def _units(rows: list[list[tuple]]) -> pa.Array:
    fields = list(_units_type.value_type)
    return _lists(rows, fields, lambda flat: _arrays(flat, [f.type for f in fields]))


def legal_articles(documents: DataFrame) -> DataFrame:
    """Articles of documents (document_id, text), one row each, with their clauses and points as an array.

    Documents without an article have no rows. The text before the first article belongs to none; a chapter or section
    counts for the articles after it, a section only within its chapter. Null texts have no rows.
    """
    names = [f.split(" ")[0] for f in ARTICLES.split(", units")[0].split(", ")] + ["units"]
    kinds = [pa.int64(), pa.int32(), *[pa.string()] * 5]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                rows = [(key, *article) for key, text in zip(*(c.to_pylist() for c in part.columns)) for article in _article_rows(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([*_arrays([r[:-1] for r in rows], kinds), _units([r[-1] for r in rows])], names=names)

    return small_batches(documents.select(F.col("document_id").cast("long"), "text").where("text is not null")).mapInArrow(extract, ARTICLES)


def legal_units(documents: DataFrame) -> DataFrame:
    """The articles, clauses and points of documents, one row for each smallest unit, as legal_articles finds them."""
    return legal_articles(documents).drop("article_text").select("*", F.explode_outer("units").alias("_u")).select("*", "_u.*").drop("units", "_u")


def _documents_with_articles(documents: DataFrame) -> DataFrame:
    """Documents (document_id, document_name, source_link, articles): the articles in the order in which chunks are made, as
    (article_position, article_number, text, chapter, section, units); the whole text as one without a number where there are none."""
    plain = [("article_position", pa.int32()), *((n, pa.string()) for n in ("article_number", "text", "chapter", "section"))]
    fields = [pa.field(n, t) for n, t in plain] + [pa.field("units", _units_type)]
    unit = ARTICLES.split(", units ")[1]
    schema = f"document_id long, document_name string, source_link string, articles array<struct<article_position:int,article_number:string,text:string,chapter:string,section:string,units:{unit}>>"

    def articles(text: str) -> list[tuple]:
        found = [(i, number, body, chapter, section, units) for i, number, _, body, chapter, section, units in _in_order(_article_rows(text))]
        return found or [(None, None, text, None, None, [])]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                rows = [articles(text) for text in part.column(3).to_pylist()]
                told = _lists(rows, fields, lambda flat: [*_arrays([r[:-1] for r in flat], [t for _, t in plain]), _units([r[-1] for r in flat])])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], told], names=["document_id", "document_name", "source_link", "articles"])

    rows = documents.select(F.col("document_id").cast("long"), F.col("document_name").cast("string"), F.col("source_link").cast("string"), "text")
    return small_batches(rows.where("text is not null")).mapInArrow(extract, schema)


def parent_child_chunks(documents: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Parent chunks and child chunks of documents (document_id, document_name, source_link, text).

    A parent is an article, or each window of a long one; its children are the article's points and clauses in windows, or
    windows of the parent where it is longer than parent_max_tokens or has no such units. An article between target and
    maximum gives two parents with the full set of units each. Documents without articles are cut into windows.

    A document's text is one row, and so are its parents and children until they are numbered: each document is read once,
    and nothing is joined, shuffled or sorted. Ids are unique.
    """
    size, overlap = settings.child_target_tokens, settings.child_overlap_tokens
    # words are cut once each: what a lambda computes from a text, it computes anew wherever the result is used
    cut = F.transform("articles", lambda a: F.struct(a.alias("a"), words(a["text"]).alias("words")))
    segments = lambda x: F.transform(
        windows(x["words"], settings.parent_target_tokens, 0),
        lambda w: F.struct(
            *[x["a"][c].alias(c) for c in ("article_position", "article_number", "chapter", "section", "units")],
            (F.size(x["words"]) > settings.parent_max_tokens).alias("long_article"), w["position"].alias("segment"), w["text"].alias("text"),
        ),
    )
    rows = _documents_with_articles(documents).select("document_id", "document_name", "source_link", F.flatten(F.transform(cut, segments)).alias("parents"))
    article = F.concat(F.lit("Điều "), "article_number").alias("article")
    structured = F.col("article_position").isNotNull()

    def parent_id(position: str) -> Column:
        named = F.concat_ws(":", F.lit("doc"), "document_id", F.lit("article"), "article_position", "article_number", F.lit("segment"), "segment")
        return F.when(structured, named).otherwise(F.concat_ws(":", F.lit("doc"), "document_id", F.lit("fallback"), position))

    parents = rows.select("document_id", "document_name", "source_link", F.posexplode("parents").alias("position", "p")).select("*", "p.*")
    method = F.when(~structured, "token_window").when(F.col("long_article"), "article_segment").otherwise("article")
    parents = parents.select(
        parent_id("position").alias("parent_id"), "document_id", "document_name", "source_link", "chapter", "section", article, "position", "text", token_count(F.col("text")).alias("token_count"), method.alias("chunking_method")
    )
    null = F.lit(None).cast("string")

    def cut_unit(tokens: Column, clause: Column, point: Column, kind: Column) -> Column:
        return F.transform(
            windows(tokens, size, overlap), lambda w: F.struct(clause.alias("clause"), point.alias("point"), w["text"].alias("text"), F.when(w["position"] == 0, kind).otherwise(F.concat(kind, F.lit("_window"))).alias("method"))
        )

    def by_unit(units: Column) -> Column:
        told = F.transform(units, lambda u: F.struct(u.alias("u"), words(u["unit_text"]).alias("words")))
        kind = lambda u: F.when(u["point_label"].isNull(), "clause").otherwise("point")
        return F.flatten(F.transform(told, lambda x: cut_unit(x["words"], F.concat(F.lit("Khoản "), x["u"]["clause_number"]), F.concat(F.lit("Điểm "), x["u"]["point_label"]), kind(x["u"]))))

    plain = lambda p: p["long_article"] | p["article_position"].isNull() | (F.size(p["units"]) <= 0)
    told = F.transform("parents", lambda p: F.struct(p.alias("p"), F.when(plain(p), words(p["text"])).alias("words")))
    by_window = lambda tokens: F.transform(windows(tokens, size, overlap), lambda w: F.struct(null.alias("clause"), null.alias("point"), w["text"].alias("text"), F.lit("token_window").alias("method")))
    families = F.transform(told, lambda x: F.struct(x["p"].alias("p"), F.when(plain(x["p"]), by_window(x["words"])).otherwise(by_unit(x["p"]["units"])).alias("children")))
    child = lambda x, i: F.transform(
        x["children"],
        lambda c, j: F.struct(
            *[x["p"][n].alias(n) for n in ("article_position", "article_number", "chapter", "section", "segment")],
            i.alias("parent_position"), j.alias("local"), F.size(x["children"]).alias("siblings"), *[c[n].alias(n) for n in ("clause", "point", "text", "method")],
        ),
    )
    children = rows.select("document_id", "document_name", "source_link", families.alias("families"))
    children = children.select("document_id", "document_name", "source_link", F.posexplode(F.flatten(F.transform("families", child))).alias("position", "c"))
    children = children.select("*", "c.*").withColumn("parent_id", parent_id("parent_position"))
    child_id = lambda local: F.concat_ws(":", "parent_id", F.lit("child"), local)
    local = F.col("local")
    children = children.select(
        "document_id", "document_name", "source_link", "chapter", "section", article, "parent_id", child_id(local).alias("child_id"), "position", "clause", "point", "text", F.col("method").alias("chunking_method"),
        F.when(local > 0, child_id(local - 1)).alias("previous_child_id"), F.when(local + 1 < F.col("siblings"), child_id(local + 1)).alias("next_child_id"), token_count(F.col("text")).alias("token_count"),
    )
    return parents, children.withColumn("embedding_text", embedding_text())


def embedding_text() -> Column:
    """The path of a chunk's headings, a blank line, its text; missing headings are skipped, a missing name is made up."""
    name = F.coalesce(F.nullif(F.col("document_name"), F.lit("")), F.concat(F.lit("Văn bản "), F.col("document_id").cast("string")))
    path = F.concat_ws(" > ", name, *[F.nullif(F.col(c), F.lit("")) for c in ("chapter", "section", "article", "clause", "point")])
    return F.concat(path, F.lit("\n\n"), F.col("text"))


def window_chunks(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of documents (document_id, text) as children (child_id, document_id, position, text)."""
    # words are a column of their own: the windows' lambda would cut the text anew for each window
    tokens = documents.select("document_id", words(F.col("text")).alias("_words"))
    cut = tokens.select("document_id", F.explode(windows(F.col("_words"), size, overlap)).alias("w")).select("document_id", "w.*")
    return cut.select(F.concat_ws(":", F.lit("doc"), "document_id", F.lit("child"), "position").alias("child_id"), "document_id", "position", "text")


def adjacency(children: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Adds the ids of the children before and after within the parent."""
    by = Window.partitionBy(parent).orderBy("position", "child_id")
    return children.withColumn("previous_child_id", F.lag("child_id").over(by)).withColumn("next_child_id", F.lead("child_id").over(by))


def integrity(documents: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """How many rows break each rule of a chunk store: one row per rule (rule, violations)."""
    known = children.select(F.col("child_id").alias("known_id"), F.col("parent_id").alias("known_parent"), F.col("previous_child_id").alias("known_previous"), F.col("next_child_id").alias("known_next"))

    def dangling(link: str) -> DataFrame:
        return children.where(F.col(link).isNotNull()).join(known, F.col(link) == F.col("known_id"), "left_anti")

    def linked(link: str, back: str) -> DataFrame:
        return children.join(known, F.col(link) == F.col("known_id")).where((F.col("known_parent") != F.col("parent_id")) | ~F.col(back).eqNullSafe(F.col("child_id")))

    rules = {
        "orphan_parents": parents.join(documents.select("document_id"), "document_id", "left_anti"),
        "orphan_children": children.join(parents.select("parent_id"), "parent_id", "left_anti"),
        "dangling_previous": dangling("previous_child_id"),
        "dangling_next": dangling("next_child_id"),
        "broken_links": linked("next_child_id", "known_previous").select("child_id").unionByName(linked("previous_child_id", "known_next").select("child_id")),
    }
    out = None
    for rule, rows in rules.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
