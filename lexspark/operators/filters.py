"""Query analysis and the metadata filter."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import legal_identifier, slug

# Explicit references in a question.
REFERENCES = {
    "article": (r"(?iuU)(?<!\w)điều\s+(\d+[a-zđ]?)\b", "Điều"),
    "clause": (r"(?iuU)(?<!\w)khoản\s+(\d+[a-zđ]?)\b", "Khoản"),
    "point": (r"(?iuU)(?<!\w)điểm\s+([a-zđ]|\d+)\b", "Điểm"),
    "chapter": (r"(?iuU)(?<!\w)chương\s+([ivxlcdm]+|\d+)\b", "Chương"),
    "section": (r"(?iuU)(?<!\w)mục\s+(\d+[a-zđ]?)\b", "Mục"),
}
DOCUMENT_ID = r"(?iuU)(?:document_id|document\s+id|văn\s+bản\s+id)\s*[:=#]?\s*(\d+)\b"
DOCUMENT_NAME = (
    r"(?iuU)\b((?:bộ\s+luật|luật|nghị\s+định|thông\s+tư|quyết\s+định|pháp\s+lệnh)\s+[A-ZÀ-ỸĐ][\wÀ-ỹĐđ]*(?:\s+[A-ZÀ-ỸĐ][\wÀ-ỹĐđ]*){0,7})"
)
NAME_END = r"(?iuU)\s+(?:quy\s+định|được|phải|có|là|thì|tại|theo|nêu)\b.*$"


def query_metadata(question: Column) -> Column:
    """A struct of the references that a question makes; confidence is 1 only with a document id or number, else 0."""
    text = F.trim(question)
    fields = []
    for name, (pattern, label) in REFERENCES.items():
        value = F.regexp_extract(text, pattern, 1)
        value = F.lower(value) if name == "point" else F.upper(value)
        fields.append(F.when(text.rlike(pattern), F.concat(F.lit(f"{label} "), value)).alias(name))
    number = legal_identifier(text)
    document_id = F.when(text.rlike(DOCUMENT_ID), F.regexp_extract(text, DOCUMENT_ID, 1).cast("long"))
    name = F.regexp_replace(F.regexp_extract(text, DOCUMENT_NAME, 1), r"(?U)\s+", " ")
    name = F.regexp_replace(F.regexp_replace(name, r"^[ ,.;:?!…]+|[ ,.;:?!…]+$", ""), NAME_END, "")
    sure = F.when(number.isNotNull() | document_id.isNotNull(), 1.0).otherwise(0.0)
    return F.struct(*fields, document_id.alias("document_id"), number.alias("document_number"), F.when(text.rlike(DOCUMENT_NAME), F.trim(name)).alias("document_name"), sure.alias("confidence"))


def documents_of_identifiers(names: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(document_number, document_id): documents whose stored name (document_id, document_name) holds an identifier's slug
    after a hyphen, in any case. Only names that share the slug's first part are compared."""
    wanted = identifiers.select("document_number").distinct().withColumn("_slug", F.lower(slug(F.col("document_number"))))
    wanted = wanted.withColumn("_first", F.substring_index("_slug", "-", 1))
    parts = names.select("document_id", F.lower("document_name").alias("_name")).distinct()
    # a part may end in the middle of the name's part, so the part's digits are compared
    parts = parts.select("document_id", "_name", F.explode(F.array_distinct(F.slice(F.split("_name", "-"), F.lit(2), F.length("_name") + 1))).alias("_first"))
    return parts.join(wanted, "_first").where(F.contains(F.col("_name"), F.concat(F.lit("-"), F.col("_slug")))).select("document_number", "document_id").distinct()


def metadata_filter(questions: DataFrame, names: DataFrame, children: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Which questions are filtered, and the children each of them allows.

    questions: (question_id, metadata as query_metadata gives it); children: with document_id and the heading columns.
    A filter applies with enough confidence and a field to filter by; a document number without an id must name exactly one
    document, else it is ambiguous; a filter that no child passes is an empty lookup and doesn't apply.
    """
    heads = ["article", "clause", "point", "chapter", "section"]
    q = questions.select("question_id", "metadata.*").where((F.col("confidence") >= least) & reduce(or_, (F.col(c).isNotNull() for c in ("document_id", "document_number", *heads))))
    by_number = documents_of_identifiers(names, q.where("document_number is not null and document_id is null"))
    found = by_number.groupBy("document_number").agg(F.count("*").alias("_found"), F.min("document_id").alias("_only"))
    q = q.join(found, "document_number", "left")
    unsure = F.col("document_id").isNull() & F.col("document_number").isNotNull() & (F.coalesce("_found", F.lit(0)) > 1)
    q = q.withColumn("ambiguous", unsure).withColumn("_document", F.coalesce("document_id", "_only"))
    sure = q.where("not ambiguous and _document is not null").select("question_id", "_document", *[F.col(h).alias(f"_{h}") for h in heads])
    same = F.lit(True)
    for h in heads:
        same = same & (F.col(f"_{h}").isNull() | F.col(h).eqNullSafe(F.col(f"_{h}")))
    allowed = sure.join(children, F.col("_document") == F.col("document_id")).where(same).select("question_id", "child_id")
    counts = allowed.groupBy("question_id").agg(F.count("*").alias("matched"))
    flags = questions.select("question_id").join(q.select("question_id", "ambiguous", F.lit(True).alias("_tried")), "question_id", "left").join(counts, "question_id", "left")
    n, tried = F.coalesce("matched", F.lit(0)), F.coalesce("_tried", F.lit(False))
    unsure = F.coalesce("ambiguous", F.lit(False))
    return flags.select("question_id", (n > 0).alias("applied"), unsure.alias("ambiguous"), (tried & ~unsure & (n == 0)).alias("empty_lookup"), n.alias("matched")), allowed


def should_filter(flags: DataFrame) -> DataFrame:
    """(question_id, should_filter): whether a question's candidates are to be restricted, from metadata_filter's flags."""
    return flags.select("question_id", F.coalesce("applied", F.lit(False)).alias("should_filter"))


def allowed_ids(flags: DataFrame, matches: DataFrame) -> DataFrame:
    """(question_id, child_id) of the children that filtered questions may get; questions without a filter have none here, as
    all children are theirs."""
    return matches.join(flags.where("applied").select("question_id"), "question_id", "left_semi").select("question_id", "child_id").distinct()
