"""All queries on the given tables, by name, with SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.conf import Settings
from lexspark.functions import text as T
from lexspark.functions.answers import normalise_answer
from lexspark.operators import audits, chunks, evaluate, filters, retrieve, validate
from lexspark.plans import answer, search
from lexspark.sources import writers
from lexspark.sources.tables import new_folder, small_batches, spread
from lexspark.streaming.ingest import stream_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIZE, OVERLAP = 256, 48


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


# ---- text functions -------------------------------------------------------------------------------------------------

_WORD = r"[^\s\x0b\x{85}\p{Z}]+"


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '\r\n?', chr(10), 'g'),
  '[\t ]+', ' ', 'g'), '[\t\x0b\f\r\x{85}\p{Z}]*\n[\t\x0b\f\r\x{85}\p{Z}]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g') AS cleaned
FROM documents""")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{_WORD}'))::BIGINT AS tokens FROM documents")
def token_count(spark, d):
    return docs(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


_CHUNKS = rf"""
words AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM documents),
chunks AS (SELECT doc_id, i AS position, array_to_string(w[i * {SIZE - OVERLAP} + 1 : least(i * {SIZE - OVERLAP} + {SIZE}, len(w))], ' ') AS text
  FROM (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {SIZE} THEN 1 ELSE 1 + ceil((len(w) - {SIZE}) / {SIZE - OVERLAP}.0)::BIGINT END)) AS i FROM words))"""


def doc_chunks(spark, d) -> DataFrame:
    return chunks.window_chunks(docs(spark, d).select(F.col("doc_id").alias("document_id"), "text"), SIZE, OVERLAP)


@query(f"WITH {_CHUNKS} SELECT doc_id, position, text FROM chunks")
def chunk_windows(spark, d):
    return doc_chunks(spark, d).select(F.col("document_id").alias("doc_id"), F.col("position").cast("long").alias("position"), "text")


@query(f"""WITH {_CHUNKS} SELECT doc_id, position, lag(id) OVER w AS previous_child_id, lead(id) OVER w AS next_child_id
FROM (SELECT *, 'doc:' || doc_id || ':child:' || position AS id FROM chunks) WINDOW w AS (PARTITION BY doc_id ORDER BY position)""")
def chunk_adjacency(spark, d):
    linked = chunks.adjacency(doc_chunks(spark, d), "document_id")
    return linked.select(F.col("document_id").alias("doc_id"), F.col("position").cast("long").alias("position"), "previous_child_id", "next_child_id")


@query("""WITH c AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS id, o_custkey AS p, lag(o_orderkey::VARCHAR) OVER w AS prev, lead(o_orderkey::VARCHAR) OVER w AS next, o_orderstatus FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
b AS (SELECT id, p, o_orderstatus, CASE WHEN k % 11 = 0 THEN 'gone' ELSE prev END AS prev, CASE WHEN k % 13 = 0 THEN 'gone' WHEN k % 17 = 0 THEN id ELSE next END AS next FROM c)
SELECT 'orphan_parents' AS rule, count(*) AS violations FROM (SELECT DISTINCT p FROM b) LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON p = c_custkey WHERE c_custkey IS NULL
UNION ALL SELECT 'orphan_children', count(*) FROM b LEFT JOIN (SELECT DISTINCT p AS q FROM b WHERE o_orderstatus <> 'F') ON p = q WHERE q IS NULL
UNION ALL SELECT 'dangling_previous', count(*) FROM b WHERE prev IS NOT NULL AND prev NOT IN (SELECT id FROM b)
UNION ALL SELECT 'dangling_next', count(*) FROM b WHERE next IS NOT NULL AND next NOT IN (SELECT id FROM b)
UNION ALL SELECT 'broken_links', (SELECT count(*) FROM b x JOIN b y ON x.next = y.id WHERE y.p <> x.p OR y.prev IS DISTINCT FROM x.id) + (SELECT count(*) FROM b x JOIN b y ON x.prev = y.id WHERE y.p <> x.p OR y.next IS DISTINCT FROM x.id)""")
def chunk_integrity(spark, d):
    """Orders as children of their customers, with links that some of them have lost or mixed up."""
    orders = table(spark, d, "orders")
    linked = chunks.adjacency(orders.select(F.col("o_orderkey").cast("string").alias("child_id"), F.col("o_custkey").alias("parent_id"), F.col("o_orderkey").alias("position")))
    k = F.col("position")
    children = linked.withColumn("previous_child_id", F.when(k % 11 == 0, "gone").otherwise(F.col("previous_child_id")))
    children = children.withColumn("next_child_id", F.when(k % 13 == 0, "gone").when(k % 17 == 0, F.col("child_id")).otherwise(F.col("next_child_id")))
    customers = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("document_id"))
    all_parents = orders.select(F.col("o_custkey").alias("parent_id"), F.col("o_custkey").alias("document_id")).distinct()
    some_parents = orders.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("parent_id")).distinct()
    whole = chunks.integrity(customers, all_parents, children)
    missing = chunks.integrity(customers, some_parents.withColumn("document_id", F.col("parent_id")), children)
    return whole.where("rule <> 'orphan_children'").unionByName(missing.where("rule = 'orphan_children'"))


# ---- legal hierarchy, on passages made of orders and their items ----------------------------------------------------


def passages(spark, d) -> DataFrame:
    """One document per customer: an article per order, a clause per line item."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(". Hàng "), x["l_partkey"].cast("string"), F.lit(" của "), x["l_suppkey"].cast("string"))), "\n").alias("clauses")
    )
    orders = table(spark, d, "orders").join(items, "o_orderkey").select(F.col("o_custkey").alias("document_id"), "o_orderkey", F.concat(F.lit("Điều "), F.col("o_orderkey").cast("string"), F.lit(". Đơn "), "o_orderpriority", F.lit("\n"), "clauses").alias("a"))
    texts = orders.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "a"))), lambda x: x["a"]), "\n").alias("text"))
    return texts.select("document_id", F.concat(F.lit("Luat-"), F.col("document_id").cast("string")).alias("document_name"), F.lit("link").alias("source_link"), "text")


_PASSAGES = """
arts AS (SELECT o_custkey AS document_id, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS article_position FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
clauses AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS clause_position, l_linenumber || '. Hàng ' || l_partkey || ' của ' || l_suppkey AS unit_text FROM lineitem)"""


@query(f"WITH {_PASSAGES} SELECT document_id, article_position, o_orderkey::VARCHAR AS article_number, 'Đơn ' || o_orderpriority AS article_title, (SELECT count(*) FROM clauses WHERE l_orderkey = o_orderkey) AS clauses FROM arts")
def structure_articles(spark, d):
    units = chunks.legal_units(passages(spark, d))
    return units.groupBy("document_id", F.col("article_position").cast("long").alias("article_position"), "article_number", "article_title").agg(F.count("clause_number").alias("clauses"))


@query(f"WITH {_PASSAGES} SELECT document_id, article_position, clause_position, l_linenumber::VARCHAR AS clause_number, unit_text FROM arts JOIN clauses ON l_orderkey = o_orderkey")
def structure_clauses_points(spark, d):
    units = chunks.legal_units(passages(spark, d)).where("clause_position is not null")
    return units.select("document_id", F.col("article_position").cast("long").alias("article_position"), F.col("clause_position").cast("long").alias("clause_position"), "clause_number", "unit_text")


@query(f"""WITH {_PASSAGES} SELECT document_id, 'doc:' || document_id || ':article:' || article_position || ':' || o_orderkey || ':segment:0:child:' || clause_position AS child_id,
row_number() OVER (PARTITION BY document_id ORDER BY article_position, clause_position) - 1 AS position, 'Điều ' || o_orderkey AS article, 'Khoản ' || l_linenumber AS clause, 'clause' AS chunking_method,
len(string_split(unit_text, ' '))::BIGINT AS token_count FROM arts JOIN clauses ON l_orderkey = o_orderkey""")
def parent_child_chunks(spark, d):
    _, children = chunks.parent_child_chunks(passages(spark, d))
    return children.select("document_id", "child_id", F.col("position").cast("long").alias("position"), "article", "clause", "chunking_method", "token_count")


@query(f"""WITH {_PASSAGES} SELECT 'doc:' || document_id || ':article:' || article_position || ':' || o_orderkey || ':segment:0:child:' || clause_position AS child_id,
'Luat-' || document_id || ' > Điều ' || o_orderkey || ' > Khoản ' || l_linenumber || chr(10) || chr(10) || unit_text AS embedding_text FROM arts JOIN clauses ON l_orderkey = o_orderkey""")
def embedding_text(spark, d):
    _, children = chunks.parent_child_chunks(passages(spark, d))
    return children.select("child_id", "embedding_text")


# ---- identifiers and filters ----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 99999) || '/' || year(o_orderdate) || '/ND-CP' ELSE (o_orderkey % 99999) || '/QĐ-TTg' END AS identifier,
CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 99999) || '-' || year(o_orderdate) || '-ND-CP' ELSE (o_orderkey % 99999) || '-QD-TTg' END AS slug FROM orders""")
def legal_identifiers(spark, d):
    n = (F.col("o_orderkey") % 99999).cast("string")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("theo "), n, F.lit("/"), F.year("o_orderdate").cast("string"), F.lit("/nd-cp quy định"))).otherwise(F.concat(F.lit("theo "), n, F.lit("/QĐ-TTg và")))
    found = table(spark, d, "orders").select("o_orderkey", T.legal_identifier(said).alias("identifier"))
    return found.withColumn("slug", T.slug(F.col("identifier")))


@query(r"SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) AS folded FROM documents")
def slug_fold(spark, d):
    return docs(spark, d).select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(f"""WITH {_PASSAGES}, q AS (SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS hit, o_orderkey % 2 = 0 OR o_custkey <= 99999 AS sure FROM orders)
SELECT o_orderkey AS question_id, hit AND sure AS applied, false AS ambiguous, sure AND NOT hit AS empty_lookup, CASE WHEN sure THEN (SELECT count(*) FROM clauses WHERE l_orderkey = o_orderkey) ELSE 0 END AS matched FROM q""")
def metadata_filter(spark, d):
    """Each order asks for its own article of its customer's document, by the document's id or by its number."""
    _, children = chunks.parent_child_chunks(passages(spark, d))
    flags, _ = filters.metadata_filter(filter_questions(spark, d).select("question_id", filters.query_metadata(F.col("q")).alias("metadata")), filter_names(spark, d), children)
    return flags


def filter_questions(spark, d, number=lambda key: key, year=lambda key: F.lit(2020)) -> DataFrame:
    customer = F.col("o_custkey")
    named = F.concat(number(customer).cast("string"), F.lit("/"), year(customer).cast("string"), F.lit("/TT-BTC"))
    document = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("văn bản id "), customer.cast("string"))).otherwise(named)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("Theo điều "), F.col("o_orderkey").cast("string"), F.lit(" của "), document).alias("q"))


def filter_names(spark, d, number=lambda key: key, year=lambda key: F.lit(2020)) -> DataFrame:
    customer = F.col("o_custkey")
    name = F.concat(F.lit("Thong-tu-"), number(customer).cast("string"), F.lit("-"), year(customer).cast("string"), F.lit("-TT-BTC-huong-dan"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), name.alias("document_name")).distinct()


@query("""SELECT DISTINCT (a.o_orderkey % 1000) || '/' || year(a.o_orderdate) || '/TT-BTC' AS document_number, b.o_orderkey AS document_id FROM orders a JOIN orders b
ON a.o_orderkey % 1000 = b.o_orderkey % 1000 AND year(a.o_orderdate) = year(b.o_orderdate) WHERE a.o_orderstatus = 'O'""")
def identifier_lookup(spark, d):
    orders = table(spark, d, "orders")
    n, y = (F.col("o_orderkey") % 1000).cast("string"), F.year("o_orderdate").cast("string")
    names = orders.select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("Thong-tu-"), n, F.lit("-"), y, F.lit("-TT-BTC-huong-dan")).alias("document_name"))
    asked = orders.where("o_orderstatus = 'O'").select(F.concat(n, F.lit("/"), y, F.lit("/TT-BTC")).alias("document_number"))
    return filters.documents_of_identifiers(names, asked)


# ---- retrieval ------------------------------------------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"


def _bm25(name: str, k: int, questions: str = "SELECT item_id AS question_id, text FROM benchmark", where: str = "") -> str:
    """SQL for the best k documents by BM25, as tables whose names begin with `name`; query words are single tokens."""
    return rf"""
{name}_t AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
{name}_s AS (SELECT count(*) AS nd, avg(len(t)) AS al FROM {name}_t),
{name}_f AS (SELECT doc_id, len(any_value(t)) AS l, term, count(*) AS f FROM (SELECT doc_id, t, unnest(t) AS term FROM {name}_t) GROUP BY doc_id, term),
{name}_q AS (SELECT question_id, term, count(*) AS times FROM (SELECT question_id, unnest({_TOKENS.replace("(lower(text))", "(lower(array_to_string(list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '')[1:64], ' ')))")}) AS term FROM ({questions})) GROUP BY ALL),
{name}_i AS (SELECT term, CASE WHEN ln((nd - n + 0.5) / (n + 0.5)) > 0 THEN ln((nd - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT term, count(*)::DOUBLE AS n FROM {name}_f GROUP BY term), {name}_s),
{name}_r AS (SELECT question_id, doc_id, round(sum(times * idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))), 9) AS score FROM {name}_q JOIN {name}_f USING (term) JOIN {name}_i USING (term), {name}_s {where} GROUP BY ALL),
{name} AS (SELECT question_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM {name}_r) WHERE rank <= {k})"""


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def searched(asked: DataFrame) -> DataFrame:
    """Questions by their first 64 words, which is what the SQL of `_bm25` searches for."""
    return asked.withColumn("text", F.array_join(F.slice(T.words(F.replace(F.col("text"), F.lit('"'), F.lit(""))), 1, 64), " "))


def children(spark, d) -> DataFrame:
    return docs(spark, d).select(F.col("doc_id").alias("child_id"), "text")


def good_documents(spark, d) -> DataFrame:
    return table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("child_id")).distinct()


def ranked(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("question_id", F.col("child_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), *more)


_SHOW = "question_id, doc_id, rank, round(score, 6) AS score"
_score = lambda: F.round("score", 6).alias("score")
_GOOD = "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


@query(f"WITH {_bm25('b', 20)} SELECT {_SHOW} FROM b")
def bm25_topk(spark, d):
    return ranked(retrieve.bm25_top_k(searched(questions(spark, d)), children(spark, d), 20), _score())


@query(f"WITH {_bm25('b', 20, where=_GOOD)} SELECT {_SHOW} FROM b")
def bm25_filtered_topk(spark, d):
    return ranked(retrieve.bm25_top_k(searched(questions(spark, d)), children(spark, d), 20, good_documents(spark, d)), _score())


@query(f"WITH {_bm25('b', 1000)} SELECT question_id, doc_id, rank, round(score, 6) AS score FROM (SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM b {_GOOD}) WHERE rank <= 20")
def bm25_filtered_after(spark, d):
    return ranked(retrieve.bm25_filtered_after(searched(questions(spark, d)), children(spark, d), good_documents(spark, d), 20), _score())


@query(rf"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), s AS (SELECT count(*) AS nd, avg(len(t)) AS al FROM t),
p AS (SELECT doc_id, len(t) AS l, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM t),
q AS (SELECT item_id AS question_id, {_TOKENS}[1:3] AS w FROM benchmark),
hit AS (SELECT question_id, a.doc_id, a.l, count(*) AS f FROM q JOIN p a ON a.term = w[1] JOIN p b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.term = w[2] JOIN p c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 AND c.term = w[3] GROUP BY ALL),
n AS (SELECT question_id, count(*)::DOUBLE AS n FROM hit GROUP BY ALL)
SELECT question_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM (
SELECT question_id, doc_id, round(CASE WHEN ln((nd - n + 0.5) / (n + 0.5)) > 0 THEN ln((nd - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al)), 9) AS score FROM hit JOIN n USING (question_id), s)) WHERE rank <= 20""")
def bm25_phrase(spark, d):
    """The first three words of each benchmark text as one hyphenated word, that is, as a phrase."""
    three = F.array_join(F.slice(T.search_terms(F.col("text")), 1, 3), "-")
    return ranked(retrieve.bm25_top_k(questions(spark, d).withColumn("text", three), children(spark, d), 20), _score())


_DENSE = """dot AS (SELECT q.vec_id AS question_id, v.vec_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id {same} WHERE q.vec_id % 50 = 0)
SELECT question_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM dot) WHERE rank <= 20"""


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    every = table(spark, d, "embeddings")
    return every.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding", "label"), every.select(F.col("vec_id").alias("child_id"), "embedding", "label")


def _near(rows: DataFrame) -> DataFrame:
    return rows.select("question_id", F.col("child_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), _score())


@query("WITH " + _DENSE.format(same=""))
def dense_topk(spark, d):
    asked, every = _vectors(spark, d)
    return _near(retrieve.dense_top_k(asked, every.drop("label"), 20, apart=True))


@query("WITH " + _DENSE.format(same="AND q.label = v.label"))
def dense_filtered_topk(spark, d):
    asked, every = _vectors(spark, d)
    return _near(retrieve.dense_top_k(asked, every, 20, apart=True, same="label"))


_HALVES = {
    "first": "SELECT item_id AS question_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '')[1:12], ' ') AS text FROM benchmark",
    "rest": "SELECT item_id AS question_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '')[13:64], ' ') AS text FROM benchmark",
}


def _rewrites(spark, d, *names: str, texts: DataFrame | None = None) -> DataFrame:
    """Ranked lists of the whole question, of its first twelve words and of the others."""
    q = questions(spark, d)
    part = lambda a, n: q.withColumn("text", F.array_join(F.slice(T.words(F.col("text")), a, n), " "))
    every = {"whole": searched(q), "first": part(1, 12), "rest": part(13, 52)}
    return retrieve.bm25_lists({n: every[n] for n in names}, children(spark, d) if texts is None else texts, 20)


def _fused(names: list[str], k: int = 30) -> str:
    union = " UNION ALL ".join(f"SELECT *, '{n}' AS list FROM {n}" for n in names)
    return f"SELECT question_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT question_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM ({union}) GROUP BY ALL)) WHERE rank <= {k}"


_LISTS = ", ".join([_bm25("whole", 20), _bm25("first", 20, _HALVES["first"]), _bm25("rest", 20, _HALVES["rest"])])


@query(f"WITH {_LISTS} SELECT question_id, doc_id, rank, round(score, 9) AS score FROM ({_fused(['whole', 'first'])})")
def rrf_fuse(spark, d):
    names = ["whole", "first"]
    return ranked(retrieve.fuse_rows(_rewrites(spark, d, *names), names), F.round("score", 9).alias("score"))


@query(f"WITH {_LISTS} SELECT question_id, doc_id, rank, round(score, 9) AS score FROM ({_fused(['whole', 'first', 'rest'])})")
def rrf_multi_query(spark, d):
    names = ["whole", "first", "rest"]
    return ranked(retrieve.fuse_rows(_rewrites(spark, d, *names), names), F.round("score", 9).alias("score"))


_SET = r"list_distinct(list_filter(regexp_split_to_array(lower({}.text), '[\s\x0b\x{{85}}\p{{Z}}]+'), lambda x: x <> ''))"
_OVERLAP = f"""scored AS (SELECT b.question_id, b.doc_id, b.rank AS old, len(list_intersect({_SET.format("m")}, {_SET.format("x")}))::DOUBLE AS score FROM b JOIN benchmark m ON m.item_id = b.question_id JOIN documents x ON x.doc_id = b.doc_id),
new AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rr FROM scored)"""


@query(f"WITH {_bm25('b', 20)}, {_OVERLAP} SELECT question_id, doc_id, rr AS rank, score FROM new WHERE rr <= 10")
def rerank_overlap(spark, d):
    q, c = questions(spark, d), children(spark, d)
    return ranked(retrieve.rerank(retrieve.bm25_top_k(searched(q), c, 20), q, c, retrieve.overlap_scorer, 10), "score")


@query(f"""WITH {_bm25('b', 20)}, {_OVERLAP} SELECT question_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(1.0::DOUBLE / (60 + rr) + 1.0::DOUBLE / (60 + old), 12) DESC, doc_id) AS rank FROM new) WHERE rank <= 10""")
def rank_blend(spark, d):
    q, c = questions(spark, d), children(spark, d)
    return ranked(retrieve.rerank(retrieve.bm25_top_k(searched(q), c, 20), q, c, retrieve.overlap_scorer, 10, blend=60), "score")


@query(f"WITH {_bm25('b', 20)}, {_OVERLAP} SELECT CASE WHEN rr < old THEN 'improved' WHEN rr > old THEN 'worsened' ELSE 'unchanged' END AS verdict, question_id, doc_id FROM new WHERE rr <= 10 UNION ALL SELECT 'gold_dropped_from_top_k', question_id, doc_id FROM new WHERE rr > 10")
def reranker_verdict(spark, d):
    """What reranking does to each candidate: moved up, down, not at all, or out of the first ten."""
    q, c = questions(spark, d), children(spark, d)
    before = retrieve.bm25_top_k(searched(q), c, 20)
    after = retrieve.rerank(before, q, c, retrieve.overlap_scorer, 10).select("question_id", "child_id", F.col("rank").alias("after"))
    both = before.join(after, ["question_id", "child_id"], "left")
    return both.select(evaluate.verdict(F.col("rank"), F.col("after")).alias("verdict"), "question_id", F.col("child_id").alias("doc_id"))


_CHUNK_HITS = rf"""hits AS (SELECT o_custkey AS question_id, o_orderkey AS child, o_orderkey % 97 AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
kids AS (SELECT o_orderkey AS child, o_orderkey % 97 AS parent, o_orderkey % 7 AS doc, row_number() OVER (PARTITION BY o_orderkey % 97 ORDER BY o_orderkey) - 1 AS position FROM orders),
placed AS (SELECT question_id, h.child, h.parent, h.parent % 11 AS doc, rank, k.position FROM hits h JOIN kids k ON k.child = h.child WHERE rank <= 12),
firsts AS (SELECT question_id, parent, doc, min(rank) AS rank FROM placed GROUP BY ALL),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc ORDER BY rank, parent) AS n FROM firsts) WHERE n <= 3),
near AS (SELECT DISTINCT p.question_id, p.parent, k.child, k.position FROM placed p JOIN kept USING (question_id, parent) JOIN kids k ON k.parent = p.parent AND k.position BETWEEN p.position - 1 AND p.position + 1)"""


@query(f"WITH {_CHUNK_HITS} SELECT question_id, 'p' || parent AS parent_id, kept.rank, array_to_string(list(near.child ORDER BY near.position), ',') AS children FROM kept JOIN near USING (question_id, parent) GROUP BY ALL")
def parent_expand(spark, d):
    """Orders as children of 97 parents in 11 documents; each customer's dearest orders as hits."""
    orders = table(spark, d, "orders")
    parent = F.col("o_orderkey") % 97
    kids = orders.select(
        F.col("o_orderkey").cast("string").alias("child_id"), F.concat(F.lit("p"), parent.cast("string")).alias("parent_id"), (parent % 11).alias("document_id"),
        (F.row_number().over(Window.partitionBy(parent).orderBy("o_orderkey")) - 1).alias("position"), F.col("o_orderpriority").alias("text"),
    )
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    hits = orders.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").cast("string").alias("child_id"), F.row_number().over(order).cast("long").alias("rank")).where("rank <= 12")
    return retrieve.expand(hits, kids).select("question_id", "parent_id", "rank", F.array_join("child_ids", ",").alias("children"))


@query()
def overlap_merge(spark, d):
    """All windows of each document merged again: without the overlaps it is the document's words."""
    parts = doc_chunks(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("p"))
    merged = small_batches(parts).select(F.col("document_id").alias("doc_id"), retrieve.merge_texts(F.col("p.text")).alias("merged"))
    return merged.select("doc_id", "merged", T.token_count(F.col("merged")).alias("tokens"))


@query(f"WITH {_CHUNKS} SELECT doc_id, position, cost, spent FROM (SELECT *, sum(cost) OVER (PARTITION BY doc_id ORDER BY position)::BIGINT AS spent FROM (SELECT *, len(string_split(text, ' '))::BIGINT AS cost FROM chunks)) WHERE spent <= 600")
def context_budget(spark, d):
    evidence = doc_chunks(spark, d).select(F.col("document_id").alias("question_id"), F.col("position").cast("long").alias("rank"), "text")
    return retrieve.within_budget(evidence, 600).select(F.col("question_id").alias("doc_id"), F.col("rank").alias("position"), "cost", "spent")


@query(f"WITH {_CHUNKS} SELECT c.doc_id, position, '[' || (position + 1) || ']' || chr(10) || 'source: ' || source || CASE WHEN trim(lang) <> '' THEN chr(10) || 'lang: ' || lang ELSE '' END || chr(10) || c.text AS block FROM chunks c JOIN documents d ON d.doc_id = c.doc_id")
def prompt_render(spark, d):
    rows = doc_chunks(spark, d).withColumnRenamed("document_id", "doc_id").join(docs(spark, d).select("doc_id", "source", "lang"), "doc_id")
    block = retrieve.rendered_evidence([("source", F.col("source")), ("lang", F.col("lang"))], F.col("position") + 1, F.col("text"))
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), block.alias("block"))


@query()
def hybrid_search(spark, d):
    """For each benchmark text the ten best document windows by dense and lexical search, fused."""
    rows = search.hybrid_search(questions(spark, d), doc_chunks(spark, d)).where("rank <= 10")
    return rows.select(F.col("question_id").alias("item_id"), "child_id", F.split("child_id", ":")[1].cast("long").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("fusion_score"), F.round("bm25_score", 6).alias("bm25_score"), F.round("dense_score", 6).alias("dense_score"))


@query(f"""WITH {_bm25("whole", 20)}, lists AS (SELECT dense, k, w.* FROM whole w, (VALUES (5, 3), (10, 5), (20, 10)) v(dense, k)), f AS (SELECT dense, k, question_id, doc_id, round(1.0::DOUBLE / (60 + rank), 12) AS score FROM lists WHERE rank <= dense)
SELECT dense AS pool, k, question_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY dense, k, question_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= k""")
def config_sweep(spark, d):
    """Settings of pool and cut replayed on one candidate table."""
    pool = retrieve.bm25_top_k(searched(questions(spark, d)), children(spark, d), 20)
    out = None
    for size, k in ((5, 3), (10, 5), (20, 10)):  # a fixed list of settings
        one = ranked(retrieve.fuse({"bm25": pool.where(F.col("rank") <= size)}, most=k)).select(F.lit(size).alias("pool"), F.lit(k).alias("k"), "question_id", "doc_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


# ---- generation and validation --------------------------------------------------------------------------------------


def _turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'assistant'")


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE turn::VARCHAR || ',' || (turn % 2 + 1)::VARCHAR END AS ids, turn % 3 <> 0 AND turn <= 3 AS valid FROM conversations WHERE role = 'assistant' AND turn % 2 + 1 <> turn
UNION ALL SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE turn::VARCHAR END, turn % 3 <> 0 AND turn <= 3 FROM conversations WHERE role = 'assistant' AND turn % 2 + 1 = turn""")
def citation_validate(spark, d):
    """Assistant turns with marks added; three evidences are there."""
    mark = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit(" ["), F.col("turn").cast("string"), F.lit("] ["), (F.col("turn") % 2 + 1).cast("string"), F.lit("]")))
    rows = _turns(spark, d).select("conv_id", "turn", F.concat("text", mark).alias("answer"), F.lit(3).alias("n_evidence"))
    return validate.validate_citations(rows).select("conv_id", "turn", F.array_join(F.transform("citation_ids", lambda i: i.cast("string")), ",").alias("ids"), F.col("citations_valid").alias("valid"))


def _asked(spark, d) -> DataFrame:
    """Each assistant turn as the only evidence of the turn before it."""
    key = F.concat_ws(":", "conv_id", "turn")
    evidence = F.array(F.struct(F.col("conv_id").alias("document_id"), F.lit("Luật").alias("document_name"), F.lit("").alias("source_link"), *[F.lit(None).cast("string").alias(c) for c in ("chapter", "section", "article", "clause", "point")], "text"))
    return _turns(spark, d).select(key.alias("question_id"), "text", evidence.alias("evidence"))


_STOPS = "(" + ", ".join(f"'{w}'" for w in validate.STOP_WORDS) + ")"
_CONTENT = rf"list_distinct(list_transform(list_filter(regexp_extract_all(trim(regexp_replace(replace(strip_accents(lower({{}})), 'đ', 'd'), '[\s\p{{{{Z}}}}]+', ' ', 'g')), '[a-z0-9]+'), lambda w: len(w) > 1 AND w NOT IN {_STOPS}), lambda w: regexp_replace(w, '^0+([0-9]+)$', '\1')))"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '\p{{L}}+')"


@query(f"""WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), p AS (SELECT a.conv_id, a.turn, a.text, {_WORDS.format("a.text")} AS w, {_WORDS.format("o.text")} AS o FROM a LEFT JOIN a o ON o.conv_id = a.conv_id + 1 AND o.turn = a.turn),
c AS (SELECT conv_id, turn, text, array_to_string(CASE conv_id % 4 WHEN 0 THEN w[1:12] WHEN 1 THEN list_concat(w[1:12], ['9731']) WHEN 2 THEN list_concat(w[1:10], o[1:5]) ELSE o[1:12] END, ' ') AS claim FROM p),
t AS (SELECT conv_id, turn, conv_id % 4 = 1 AS number, {_CONTENT.format("claim")} AS need, {_CONTENT.format("'Luật' || chr(10) || text")} AS have FROM c),
e AS (SELECT conv_id, turn, CASE WHEN len(need) = 0 THEN 0 WHEN number OR len(list_intersect(need, have)) / len(need)::DOUBLE < CASE WHEN len(need) <= 3 THEN 1.0::DOUBLE ELSE 0.72::DOUBLE END THEN 1 ELSE 0 END AS errors FROM t)
SELECT conv_id || ':' || turn AS question_id, errors = 0 AS grounded, errors FROM e""")
def grounding_validate(spark, d):
    """Answers of a turn's own words, of these and a number, of these and some of another conversation's, and of another
    conversation's alone, each citing the turn's text."""
    rows = _turns(spark, d)
    others = rows.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("text").alias("_other"))
    cut = lambda c: F.coalesce(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\p{L}+"), F.lit(0)), F.array().cast("array<string>"))
    own, other, kind = cut("text"), cut("_other"), F.col("conv_id") % 4
    said = F.when(kind == 0, F.slice(own, 1, 12)).when(kind == 1, F.concat(F.slice(own, 1, 12), F.array(F.lit("9731")))).when(kind == 2, F.concat(F.slice(own, 1, 10), F.slice(other, 1, 5))).otherwise(F.slice(other, 1, 12))
    answers = rows.join(others, ["conv_id", "turn"], "left").select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.concat(F.array_join(said, " "), F.lit(" [1].")).alias("answer"))
    asked = _asked(spark, d).join(answers, "question_id").withColumn("n_evidence", F.lit(1))
    return validate.validate_grounding(validate.validate_citations(asked)).select("question_id", "grounded", F.size("grounding_errors").alias("errors"))


@query()
def answer_pipeline(spark, d):
    """Generation by the extractive stand-in, validation, and submission rows."""
    return answer.submission_rows(answer.generate_answers(_asked(spark, d)))


@query(r"SELECT conv_id, turn, upper(left(t, 1)) || substr(t, 2) AS answer FROM (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), ' ([,.;:])', '\1', 'g') AS t FROM conversations WHERE role = 'assistant')")
def answer_normalise(spark, d):
    """Assistant turns with prompt scaffolding around them, of one of twelve kinds each, which normalising takes off again."""
    text, kind = F.col("text"), F.col("conv_id") % 12
    before = {
        0: "Dựa trên ngữ cảnh 1, ", 1: "Theo ngữ cảnh được cung cấp: ", 2: "Câu trả lời cho câu hỏi \"Ai?\" là: ", 3: "> ", 4: "**Văn bản 2**: ", 5: "Ngữ cảnh 3 (mục b): ",
        6: "Ở đây không có thông tin. Tuy nhiên, ", 7: "Đây là nội dung trong ngữ cảnh 2. ", 8: "## ", 9: ";, ", 10: "Căn cứ vào ngữ cảnh trên; ", 11: "",
    }
    after = {
        0: " [1] (Ngữ cảnh 2)", 1: " (Document ID: 12:ab)", 2: ", Child ID 7", 3: " [2][3]", 4: " ()", 5: " [theo ngữ cảnh 1 và 2]", 6: " _", 7: " (a-b-c-d xem thêm)", 8: " [ ]", 9: " (x-y-z", 10: " (,)",
        11: " Vì vậy, đây là thông tin chính xác và rõ.",
    }
    pick = lambda parts: F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[kind.cast("int")]
    return _turns(spark, d).select("conv_id", "turn", normalise_answer(F.concat(pick(before), text, pick(after))).alias("answer"))


@query("""WITH a AS (SELECT conv_id::VARCHAR AS question_id FROM conversations WHERE role = 'assistant'), e AS (SELECT DISTINCT conv_id::VARCHAR AS question_id FROM conversations WHERE role = 'user' UNION SELECT DISTINCT doc_id::VARCHAR FROM labels)
SELECT 'missing' AS issue, question_id FROM e WHERE question_id NOT IN (SELECT question_id FROM a) UNION ALL SELECT 'unexpected', question_id FROM (SELECT DISTINCT question_id FROM a) WHERE question_id NOT IN (SELECT question_id FROM e)
UNION ALL SELECT 'repeated', question_id FROM a GROUP BY question_id HAVING count(*) > 1""")
def submission_validate(spark, d):
    conversations = table(spark, d, "conversations")
    answers = _turns(spark, d).select(F.col("conv_id").cast("string").alias("question_id"), F.col("text").alias("answer"))
    expected = conversations.where("role = 'user'").select(F.col("conv_id").cast("string").alias("question_id")).union(table(spark, d, "labels").select(F.col("doc_id").cast("string"))).distinct()
    return validate.submission_issues(answers, expected)


# ---- evaluation -----------------------------------------------------------------------------------------------------


def _pairs(spark, d) -> DataFrame:
    """Each user turn against the assistant's next one."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("reference", F.lead("text").over(after)).withColumn("_r", F.lead("role").over(after))
    return rows.where("role = 'user' and _r = 'assistant'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("hypothesis"), "reference")


_PAIRS = r"""pairs AS (SELECT conv_id || ':' || turn AS id, text AS h, nt AS r FROM (SELECT *, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'),
tok AS (SELECT id, list_filter(regexp_split_to_array(lower(h), '[\s\p{Z}]+'), lambda x: x <> '') AS h, list_filter(regexp_split_to_array(lower(r), '[\s\p{Z}]+'), lambda x: x <> '') AS r FROM pairs)"""


@query(f"""WITH {_PAIRS}, hs AS (SELECT *, row_number() OVER (PARTITION BY id, t ORDER BY p) AS n FROM (SELECT id, unnest(h) AS t, generate_subscripts(h, 1) AS p FROM tok)),
rs AS (SELECT *, row_number() OVER (PARTITION BY id, t ORDER BY p) AS n FROM (SELECT id, unnest(r) AS t, generate_subscripts(r, 1) AS p FROM tok)),
m AS (SELECT id, hs.p AS hp, rs.p AS rp FROM hs JOIN rs USING (id, t, n)), c AS (SELECT id, count(*) AS m, sum(CASE WHEN a = 1 AND b = 1 THEN 0 ELSE 1 END)::BIGINT AS ch FROM (SELECT id, hp - lag(hp) OVER w AS a, rp - lag(rp) OVER w AS b FROM m WINDOW w AS (PARTITION BY id ORDER BY hp)) GROUP BY id)
SELECT id, coalesce(m, 0) AS matches, coalesce(ch, 0) AS chunks, round(coalesce((m / len(h)::DOUBLE) * (m / len(r)::DOUBLE) / (0.9::DOUBLE * (m / len(h)::DOUBLE) + 0.1::DOUBLE * (m / len(r)::DOUBLE)) * (1 - 0.5::DOUBLE * pow(ch / m::DOUBLE, 3)), 0), 9) AS meteor FROM tok LEFT JOIN c USING (id)""")
def meteor(spark, d):
    return evaluate.meteor(_pairs(spark, d)).withColumn("meteor", F.round("meteor", 9))


@query(rf"""WITH RECURSIVE {_PAIRS}, hs AS (SELECT id, unnest(h) AS t, generate_subscripts(h, 1) AS i FROM tok), rs AS (SELECT id, unnest(r) AS t, generate_subscripts(r, 1) AS j FROM tok),
l AS (SELECT id, 0::BIGINT AS i, j, 0::BIGINT AS v FROM rs UNION ALL SELECT id, i, j, max(c) OVER (PARTITION BY id ORDER BY j) FROM (
  SELECT l.id, hs.i, l.j, greatest(l.v, CASE WHEN hs.t = rs.t THEN 1 + coalesce(lag(l.v) OVER (PARTITION BY l.id ORDER BY l.j), 0) ELSE 0 END) AS c FROM l JOIN hs ON hs.id = l.id AND hs.i = l.i + 1 JOIN rs ON rs.id = l.id AND rs.j = l.j)),
n AS (SELECT id, max(v) AS n FROM l GROUP BY id)
SELECT id, round(CASE WHEN n > 0 THEN 2 * n / (len(h) + len(r))::DOUBLE ELSE 0 END, 9) AS rouge_l FROM tok LEFT JOIN n USING (id)""")
def rouge_l(spark, d):
    """The SQL fills the table of the longest common subsequence, a row of it for each word of the hypothesis."""
    return _pairs(spark, d).select("id", F.round(evaluate.rouge_l(F.col("hypothesis"), F.col("reference")), 9).alias("rouge_l"))


_RECALL = f"""WITH {_bm25("b", 20)}, gold AS (SELECT m.item_id AS question_id, x.doc_id, b.rank FROM benchmark m JOIN documents x ON contains(x.text, m.text) LEFT JOIN b ON b.question_id = m.item_id AND b.doc_id = x.doc_id),
g AS (SELECT question_id, count(*) AS n, min(rank) AS r, count(*) FILTER (rank <= 1) AS a, count(*) FILTER (rank <= 5) AS e, count(*) FILTER (rank <= 20) AS z FROM gold GROUP BY question_id)"""


def _gold(spark, d) -> tuple[DataFrame, DataFrame]:
    """The candidates of each benchmark text, and all documents that hold it in full, found or not."""
    q, c = questions(spark, d), children(spark, d)
    rows = retrieve.bm25_top_k(searched(q), c, 20)
    return rows.select("question_id", "rank", F.col("child_id").alias("item")), evaluate.holders(q, c).select("question_id", F.col("child_id").alias("item"))


@query(_RECALL + " SELECT question_id, r AS first_hit_rank, a / n::DOUBLE AS recall_at_1, e / n::DOUBLE AS recall_at_5, z / n::DOUBLE AS recall_at_20 FROM g")
def recall_at_k(spark, d):
    return evaluate.recall_at(*_gold(spark, d), cutoffs=(1, 5, 20)).withColumn("first_hit_rank", F.col("first_hit_rank").cast("long"))


@query(_RECALL + " SELECT round(avg(coalesce(1.0::DOUBLE / r, 0)), 9) AS mrr, count(*) AS questions FROM g")
def mrr(spark, d):
    return evaluate.recall_at(*_gold(spark, d)).agg(F.round(evaluate.mean_reciprocal_rank(F.col("first_hit_rank")), 9).alias("mrr"), F.count("*").alias("questions"))


@query("""SELECT event_type, user_id, count(value) AS n, round_even(sum(value::DECIMAL(30, 10))::DOUBLE / count(value), 4) AS mean, round_even(quantile_cont(value, 0.5), 4) AS median, round_even(min(value), 4) AS min, round_even(max(value), 4) AS max,
round_even(list(value ORDER BY value)[round_even(0.95 * (count(value) - 1), 0)::BIGINT + 1], 4) AS p95 FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def latency_summary(spark, d):
    return evaluate.latency_summary(table(spark, d, "events").where("value is not null"), ["event_type", "user_id"], "value")


@query("""WITH g AS (SELECT event_type, user_id, list(value ORDER BY value) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL HAVING count(value) >= 2),
q AS (SELECT *, i, least(greatest((i * (n + 1)) // 4, 1), n - 1) AS j FROM g, (VALUES (1), (2), (3)) x(i)), r AS (SELECT event_type, user_id, i, (v[j] * (4 - (i * (n + 1) - 4 * j)) + v[j + 1] * (i * (n + 1) - 4 * j)) / 4 AS x FROM q)
SELECT event_type, user_id, round(max(x) FILTER (i = 1), 6) AS q1, round(max(x) FILTER (i = 2), 6) AS q2, round(max(x) FILTER (i = 3), 6) AS q3 FROM r GROUP BY ALL""")
def quartiles_exclusive(spark, d):
    rows = evaluate.quartiles_exclusive(table(spark, d, "events"), ["event_type", "user_id"], "value")
    return rows.select("event_type", "user_id", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")])


_FLAGS = "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity >= 25 AS dense, l_discount >= 0.05 AS bm25, l_tax >= 0.04 AS rrf, l_returnflag = 'R' AS fused, l_linestatus = 'F' AND l_returnflag = 'A' AS final, l_discount * 10 AS m FROM lineitem"
_STAGE = """CASE WHEN final THEN 'none' WHEN NOT dense AND NOT bm25 THEN 'both_miss' WHEN dense <> bm25 AND NOT rrf THEN 'rrf_ranking' WHEN fused THEN 'reranker_ranking' WHEN NOT rrf AND (dense OR bm25) THEN 'insufficient_top_k' ELSE 'PENDING_MANUAL_REVIEW' END"""


@query(f"SELECT stage, CASE WHEN stage = 'both_miss' AND dense THEN 'metadata_entity_failure' WHEN stage = 'both_miss' THEN 'both_miss' WHEN stage = 'rrf_ranking' THEN 'fusion_failure' WHEN stage = 'reranker_ranking' THEN 'reranker_failure' WHEN n = 7 THEN 'context_failure' WHEN m < 0.3 THEN 'generation_failure' WHEN m > 0.8 THEN 'verbosity_failure' ELSE 'ok' END AS cls, k, n FROM (SELECT *, {_STAGE} AS stage FROM ({_FLAGS}))")
def failure_classes(spark, d):
    """Line items as questions whose stages found evidence or not."""
    f = table(spark, d, "lineitem").selectExpr(
        "l_orderkey k", "l_linenumber n", "l_quantity >= 25 dense", "l_discount >= 0.05 bm25", "l_tax >= 0.04 rrf", "l_returnflag = 'R' fused", "l_linestatus = 'F' AND l_returnflag = 'A' final", "l_discount * 10 m"
    )
    f = f.withColumn("stage", evaluate.failure_stage(*[F.col(c) for c in ("dense", "bm25", "rrf", "fused", "final")]))
    cls = evaluate.failure_class(F.col("stage"), F.col("dense"), F.col("n") == 7, F.col("m"), F.when(F.col("m") > 0.8, 3.0).otherwise(1.0))
    return f.select("stage", cls.alias("cls"), "k", "n")


@query("""WITH a AS (SELECT user_id, avg(value) AS s FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, avg(value) AS s FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT count(*) FILTER (b.s - a.s IS NOT NULL) AS questions, round_even(avg(b.s - a.s), 6) AS mean_delta, count(*) FILTER (b.s - a.s > 0.02) AS rescued, count(*) FILTER (b.s - a.s < -0.02) AS regressed, count(*) FILTER (b.s - a.s IS NULL) AS unmatched FROM a FULL JOIN b USING (user_id)""")
def ab_compare(spark, d):
    run = lambda kind: table(spark, d, "events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("question_id")).agg(F.avg("value").alias("score"))
    return evaluate.compare_runs(run("view"), run("click"))


@query("""WITH e AS (SELECT value, user_id::DOUBLE AS user_id, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE -0.1::DOUBLE END AS delta FROM events WHERE value IS NOT NULL),
l AS (SELECT 'value' AS feature, value AS v, delta FROM e UNION ALL SELECT 'user_id', user_id, delta FROM e), o AS (SELECT feature, list(v ORDER BY v) AS s, count(*) AS n FROM l GROUP BY 1),
t AS (SELECT DISTINCT feature, s[floor(q * n)::BIGINT + 1] AS threshold FROM o, (VALUES (0.25), (0.5), (0.75)) x(q))
SELECT feature, threshold, side, n, round_even(s / (SELECT count(*) FROM e), 6) AS gain FROM (SELECT feature, threshold, CASE WHEN v >= threshold THEN 'above' ELSE 'below' END AS side, count(*) AS n, sum(delta) AS s FROM l JOIN t USING (feature) GROUP BY ALL) WHERE n BETWEEN 10 AND 1000000000""")
def gate_search(spark, d):
    rows = table(spark, d, "events").where("value is not null").withColumn("user_id", F.col("user_id").cast("double")).withColumn("delta", F.when(F.col("event_type") == "purchase", 1.0).otherwise(-0.1))
    return evaluate.gate_search(rows, ["value", "user_id"], "delta", (0.25, 0.5, 0.75), 10, 10**9)


@query("SELECT 'value' AS feature, round((avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type <> 'purchase')) / stddev_pop(value), 6) AS separation FROM events UNION ALL SELECT 'user_id', round((avg(user_id) FILTER (event_type = 'purchase') - avg(user_id) FILTER (event_type <> 'purchase')) / stddev_pop(user_id), 6) FROM events")
def feature_separation(spark, d):
    rows = table(spark, d, "events").withColumn("bought", F.col("event_type") == "purchase")
    return evaluate.separation(rows, ["value", "user_id"], "bought").withColumn("separation", F.round("separation", 6))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round_even(sum(greatest(0.0::DOUBLE, 200000.0::DOUBLE - o_totalprice)) / (SELECT count(*) FROM orders), 6) AS ceiling FROM orders GROUP BY ALL")
def oracle_ceiling(spark, d):
    return evaluate.oracle_ceiling(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", 200000.0)


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS tn, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn FROM labels)
SELECT *, round_even(tp / (tp + fp)::DOUBLE, 6) AS precision, round_even(tp / (tp + fn)::DOUBLE, 6) AS recall, round_even(fp / (fp + tn)::DOUBLE, 6) AS false_positive_rate, round_even(fn / (fn + tp)::DOUBLE, 6) AS false_negative_rate, round_even((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy FROM c""")
def confusion_matrix(spark, d):
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("gold"), (F.col("toxic") == 0).alias("predicted"))
    return evaluate.confusion(rows, "gold", "predicted")


@query()
def deterministic_sample(spark, d):
    """A sampling operator: 100 documents by seeded hash."""
    return evaluate.sample(docs(spark, d).select("doc_id"), "doc_id", 100, 42)


# ---- audits ---------------------------------------------------------------------------------------------------------


@query(f"""SELECT k, n, CASE WHEN n > 6 THEN 'Other' WHEN final THEN 'OK' WHEN NOT (dense OR bm25) THEN 'A' WHEN NOT rrf THEN 'B' WHEN NOT fused THEN 'C' WHEN m < 0.5 THEN 'E' ELSE 'D' END AS cls FROM ({_FLAGS})""")
def causal_audit(spark, d):
    """Line items as questions: which stage lost their evidence."""
    return _audited(spark, d).select("k", "n", "cls")


def _audited(spark, d) -> DataFrame:
    f = table(spark, d, "lineitem").selectExpr(
        "l_orderkey k", "l_linenumber n", "l_quantity >= 25 OR l_discount >= 0.05 pool", "l_tax >= 0.04 rrf", "l_returnflag = 'R' fused", "l_linestatus = 'F' AND l_returnflag = 'A' final", "l_discount * 10 m"
    )
    return f.withColumn("cls", audits.causal_class(F.col("n") <= 6, F.col("final"), F.col("pool"), F.col("rrf"), F.col("fused"), F.col("m") >= 0.5))


@query(f"""WITH r AS (SELECT m, CASE WHEN n > 6 THEN 'Other' WHEN final THEN 'OK' WHEN NOT (dense OR bm25) THEN 'A' WHEN NOT rrf THEN 'B' WHEN NOT fused THEN 'C' WHEN m < 0.5 THEN 'E' ELSE 'D' END AS cls FROM ({_FLAGS})),
g AS (SELECT cls, count(*) AS n, sum(greatest(0.0::DOUBLE, (SELECT avg(m) FROM r WHERE cls = 'OK') - m)) AS g FROM r GROUP BY cls)
SELECT c AS combination, sum(n)::BIGINT AS questions, round_even(sum(g) / (SELECT count(*) FROM r), 6) AS ceiling FROM g JOIN (VALUES ('D', ['D']), ('C+D+E', ['C', 'D', 'E']), ('A+B+C+D+E', ['A', 'B', 'C', 'D', 'E'])) v(c, s) ON list_contains(s, cls) GROUP BY c""")
def category_ceilings(spark, d):
    return audits.category_ceilings(_audited(spark, d), "cls", "m")


@query(f"""WITH {_CHUNKS}, e AS (SELECT doc_id, position, sum(len(string_split(text, ' '))) OVER (PARTITION BY doc_id ORDER BY position)::BIGINT AS spent FROM chunks),
q AS (SELECT b AS budget, doc_id, count(*) FILTER (spent <= b) AS kept, coalesce(max(spent) FILTER (spent <= b), 0) AS tokens, count(*) AS n FROM e, (VALUES (300), (600), (1200)) v(b) GROUP BY ALL)
SELECT budget, round_even(avg(kept), 4) AS mean_kept, quantile_cont(kept, 0.5)::DOUBLE AS median_kept, max(kept) AS max_kept, round_even(avg(tokens), 4) AS mean_tokens, max(tokens) AS max_tokens, count(*) FILTER (kept < n) AS truncated FROM q GROUP BY budget""")
def budget_probe(spark, d):
    evidence = doc_chunks(spark, d).select(F.col("document_id").alias("question_id"), F.col("position").alias("rank"), T.token_count(F.col("text")).alias("cost"))
    return audits.budget_probe(evidence, [300, 600, 1200])


@query("""WITH r AS (SELECT quality = 1 AS b, toxic = 1 AS f, doc_id FROM labels), p AS (SELECT 'all' AS policy, b, f, true AS t FROM r UNION ALL SELECT 'missed', b, f, NOT b FROM r UNION ALL SELECT 'even', b, f, doc_id % 2 = 0 FROM r)
SELECT policy, count(*) FILTER (t) AS triggered, count(*) FILTER (t AND NOT b AND f) AS rescued, count(*) FILTER (t AND b AND NOT f) AS regressed, count(*) FILTER (t AND NOT b AND f) - count(*) FILTER (t AND b AND NOT f) AS net_gain,
round_even(count(*) FILTER (t AND NOT b AND f) / nullif(count(*) FILTER (t), 0)::DOUBLE, 4) AS precision, round_even(avg(CASE WHEN t THEN f ELSE b END::INT), 4) AS recall FROM p GROUP BY policy""")
def policy_evaluation(spark, d):
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("base_hit"), (F.col("toxic") == 1).alias("fallback_hit"), "doc_id")
    flat = rows.withColumn("even", F.col("doc_id") % 2 == 0)
    kept = flat.select("base_hit", "fallback_hit", "even")
    return audits.policy_results(kept, {"all": F.lit(True), "missed": ~F.col("base_hit"), "even": F.col("even")})


@query(f"""WITH {_bm25("whole", 20)}, {_bm25("first", 20, _HALVES["first"])}, f AS (SELECT w.question_id, w.doc_id, w.rank, d.lang, d.source FROM whole w JOIN documents d ON d.doc_id = w.doc_id WHERE w.rank <= 10),
c AS (SELECT question_id, lang, source, count(*) AS n, min(rank) AS r FROM f GROUP BY ALL),
s AS (SELECT question_id, count(*) AS n_articles, count(DISTINCT lang) AS n_documents, max(n) AS max_chunks_per_article, arg_min(n, r) / sum(n)::DOUBLE AS top1_article_share FROM c GROUP BY 1),
o AS (SELECT question_id, count(*) FILTER (w.rank <= 10 AND x.rank <= 10) / 10.0::DOUBLE AS dense_bm25_overlap FROM (SELECT DISTINCT question_id FROM whole UNION SELECT DISTINCT question_id FROM first) LEFT JOIN whole w USING (question_id) LEFT JOIN first x ON x.question_id = w.question_id AND x.doc_id = w.doc_id GROUP BY 1)
SELECT question_id, n_articles, n_documents, max_chunks_per_article, round(top1_article_share, 6) AS top1_article_share, dense_bm25_overlap FROM s LEFT JOIN o USING (question_id)""")
def gate_features(spark, d):
    """Documents as chunks, their languages as documents and their sources as articles."""
    lists = _rewrites(spark, d, "whole", "first")
    whole = lists.where("list = 'whole'").drop("list")
    where = docs(spark, d).select(F.col("doc_id").alias("child_id"), F.col("lang").alias("document"), F.col("source").alias("article"))
    final = whole.join(where, "child_id")
    named = lists.withColumn("list", F.when(F.col("list") == "whole", "dense").otherwise("bm25"))
    rows = audits.gate_features(final, named, 10)
    return rows.select("question_id", "n_articles", "n_documents", "max_chunks_per_article", F.round("top1_article_share", 6).alias("top1_article_share"), "dense_bm25_overlap")


@query("""WITH o AS (SELECT o_custkey AS question_id, o_orderpriority AS stage, list(DISTINCT (o_orderkey % 10)::VARCHAR) AS a, list(DISTINCT (o_orderkey % 7)::VARCHAR) AS c, list(DISTINCT (o_orderkey % 3)::VARCHAR) AS p FROM orders GROUP BY ALL),
r AS (SELECT stage, list_has_any(a, [(question_id % 10)::VARCHAR]) AS h, list_contains(c, (question_id % 7)::VARCHAR) AS k, list_contains(p, (question_id % 3)::VARCHAR) AS q FROM o)
SELECT stage, count(*) AS questions, round_even(avg(h::INT), 4) AS article, round_even(avg(k::INT), 4) AS clauses, round_even(avg(q::INT), 4) AS points, round_even(avg((h AND k AND q)::INT), 4) AS "full" FROM r GROUP BY stage""")
def evidence_by_stage(spark, d):
    """Customers as questions, order priorities as stages, remainders of order keys as what a stage holds."""
    part = lambda c, n: F.collect_set((F.col(c) % n).cast("string"))
    orders = table(spark, d, "orders")
    stages = orders.groupBy(F.col("o_custkey").alias("question_id"), F.col("o_orderpriority").alias("stage")).agg(part("o_orderkey", 10).alias("articles"), part("o_orderkey", 7).alias("clauses"), part("o_orderkey", 3).alias("points"))
    one = lambda n: F.array((F.col("question_id") % n).cast("string"))
    gold = stages.select("question_id").distinct().select("question_id", one(10).alias("articles"), one(7).alias("clauses"), one(3).alias("points"))
    return audits.evidence_by_stage(stages, gold)


# ---- stores ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN upper(source) ELSE source END AS source, 'old' AS created_at FROM documents UNION ALL SELECT doc_id + 1000000000, 'new', 'new' FROM documents WHERE lang = 'fr'")
def document_upsert(spark, d):
    """English documents come again with another source, French ones under new ids; created_at stays as it was."""
    old = docs(spark, d).select("doc_id", "lang", "source", F.lit("old").alias("created_at"))
    again = old.where("lang = 'en'").withColumn("source", F.upper("source")).withColumn("created_at", F.lit("new"))
    fresh = old.where("lang = 'fr'").select((F.col("doc_id") + 1000000000).alias("doc_id"), "lang", F.lit("new").alias("source"), F.lit("new").alias("created_at"))
    return writers.upsert(old, again.unionByName(fresh), "doc_id", keep=("created_at",)).select("doc_id", "source", "created_at")


@query("SELECT doc_id FROM documents WHERE NOT (lang = 'en' OR lang = 'fr') UNION ALL SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src0'")
def ingest_pending(spark, d):
    """English documents failed before with the same content, French ones are complete but for a source that isn't stored."""
    found = docs(spark, d).select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("checksum"), "lang", "source")
    state = found.where("lang in ('en', 'fr')").select("document_id", "checksum", F.when(F.col("lang") == "en", "failed").otherwise("completed").alias("status"), (F.col("source") != "src0").alias("stored"))
    return writers.pending_documents(found, state).select(F.col("document_id").alias("doc_id"))


@query("SELECT doc_id, c.position, c.text FROM (WITH " + _CHUNKS + " SELECT * FROM chunks) c")
def streaming_windows(spark, d):
    """The windows of all documents, made by a stream of the documents table."""
    source = f"{d.rstrip('/')}/documents.parquet"
    out = new_folder(spark)
    # as a pattern, since a file stream takes a plain path for a folder
    rows = stream_windows(spark, f"{source[:-1]}[t]", spark.read.parquet(source).schema, SIZE, OVERLAP)
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").select("doc_id", F.col("position").cast("long").alias("position"), "text")


#: Settings that the queries share.
SETTINGS = Settings()
