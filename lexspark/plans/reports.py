"""Queries of reports over runs, on the given tables, with SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators import audits, chunks, evaluate, filters, reports, retrieve
from lexspark.plans.catalog import _CHUNKS, _FLAGS, _LISTS, _PAIRS, _PASSAGES, _STAGE, SQL, _pairs, _rewrites, children, doc_chunks, docs, filter_names, filter_questions, passages, query, questions, table
from lexspark.sources.tables import written

_RUNS = f"""{_LISTS}, lists AS (SELECT 'whole' AS config, question_id, doc_id, rank FROM whole UNION ALL SELECT 'first', question_id, doc_id, rank FROM first UNION ALL SELECT 'rest', question_id, doc_id, rank FROM rest),
gold AS (SELECT m.item_id AS question_id, x.doc_id FROM benchmark m JOIN documents x ON contains(x.text, m.text)),
z AS (SELECT question_id, count(*) AS n FROM gold GROUP BY 1),
f AS (SELECT config, question_id, min(rank) AS r, count(*) AS found, {", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}" for k in reports.CUTOFFS)} FROM lists JOIN gold USING (question_id, doc_id) GROUP BY ALL),
roll AS (SELECT config, count(*) AS questions, {", ".join(f"round_even(avg(coalesce(h{k}, 0) / n::DOUBLE), 4) AS recall_at_{k}" for k in reports.CUTOFFS)}, round_even(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr,
  round_even(avg(CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS any_hit, round_even(avg(CASE WHEN found = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS all_hit
  FROM (SELECT DISTINCT config FROM lists) CROSS JOIN z LEFT JOIN f USING (config, question_id) GROUP BY config)"""
_METRICS = [*(f"recall_at_{k}" for k in reports.CUTOFFS), "mrr", "any_hit", "all_hit"]


def _rollup(spark, d) -> DataFrame:
    texts = written(children(spark, d))  # read by the search and by what looks for holders
    runs = _rewrites(spark, d, "whole", "first", "rest", texts=texts).select(F.col("list").alias("config"), "question_id", "rank", F.col("child_id").alias("item"))
    gold = evaluate.holders(questions(spark, d), texts).select("question_id", F.col("child_id").alias("item"))
    return reports.config_rollup(runs, gold)


@query(f"WITH {_RUNS} SELECT * FROM roll")
def retrieval_rollup(spark, d):
    """Three ways to ask for each benchmark text as configurations."""
    return _rollup(spark, d)


@query(f"WITH {_RUNS}, l AS ({' UNION ALL '.join(f'''SELECT config, '{m}' AS metric, {m} AS value FROM roll''' for m in _METRICS)}) SELECT l.config, l.metric, round_even(l.value - b.value, 4) AS gain FROM l JOIN l b ON b.metric = l.metric AND b.config = 'whole' WHERE l.config <> 'whole'")
def retrieval_gains(spark, d):
    return reports.gains(_rollup(spark, d), "whole")


@query("""WITH r AS (SELECT o_custkey AS question_id, o_orderkey AS item, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderstatus = 'F' AS gold FROM orders),
g AS (SELECT *, min(rank) FILTER (gold) OVER (PARTITION BY question_id) AS gold_rank FROM r)
SELECT question_id, max(score) FILTER (rank = 1) AS top1, max(score) FILTER (rank = 2) AS top2, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin, max(gold_rank) AS gold_rank, max(score) FILTER (rank = gold_rank) AS gold_score,
max(score) FILTER (rank = 1) - max(score) FILTER (rank = gold_rank) AS gap, coalesce(string_agg(item::VARCHAR, ',' ORDER BY rank) FILTER (rank < gold_rank AND rank >= gold_rank - 3), '') AS blockers FROM g GROUP BY question_id""")
def rerank_diagnostics(spark, d):
    """Each customer's orders by price as a reranked list; fulfilled orders are gold."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "item")
    ranked = orders.withColumn("rank", F.row_number().over(order).cast("long"))
    gold = orders.where("o_orderstatus = 'F'").select("question_id", "item")
    return reports.rerank_diagnostics(ranked.drop("o_orderstatus"), gold).withColumn("blockers", F.array_join("blockers", ","))


def _number(key: Column) -> Column:
    return key % 100_000


def _year(key: Column) -> Column:
    return 2020 + F.floor(key / 100_000)


@query(f"""WITH {_PASSAGES}, q AS (SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem) AS hit, o_orderkey % 2 = 1 AND o_custkey % 10 = 0 AS twice, o_orderkey % 2 = 0 AS by_id, o_custkey FROM orders)
SELECT count(*) AS questions, count(*) FILTER (hit AND NOT twice) AS applied, count(*) FILTER (twice) AS ambiguous, count(*) FILTER (NOT hit AND NOT twice) AS empty_lookup, count(DISTINCT o_custkey) FILTER (by_id) AS document_ids, count(DISTINCT o_custkey) FILTER (NOT by_id) AS document_numbers FROM q""")
def filter_statistics(spark, d):
    """The questions of metadata_filter, by id or by number, counted; a tenth of the numbers is that of two documents.

    An identifier's number has at most five digits, so customers beyond these go on in the numbers of the years after 2020.
    """
    _, kids = chunks.parent_child_chunks(passages(spark, d))
    asked = filter_questions(spark, d, _number, _year).select("question_id", filters.query_metadata(F.col("q")).alias("metadata"))
    names = filter_names(spark, d, _number, _year)
    other = names.where("document_id % 10 = 0").select((-F.col("document_id") - 1).alias("document_id"), F.replace("document_name", F.lit("huong-dan"), F.lit("khac")).alias("document_name"))
    flags, _ = filters.metadata_filter(asked, names.unionByName(other), kids)
    return reports.filter_statistics(flags, asked)


@query(f"""WITH f AS (SELECT k * 10 + n AS id, n, {_STAGE} AS cls, m FROM ({_FLAGS}))
SELECT cls, count(*) AS n, round_even(avg(m), 6) AS mean_score, quantile_cont(n, 0.5)::DOUBLE AS median_words, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM f), 4) AS percent, array_to_string(list(id ORDER BY id)[1:5], ',') AS examples FROM f GROUP BY cls""")
def class_rollup(spark, d):
    """Line items as questions, by the stage that lost their evidence; line numbers as lengths."""
    f = table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber id", "l_linenumber n", "l_quantity >= 25 dense", "l_discount >= 0.05 bm25", "l_tax >= 0.04 rrf", "l_returnflag = 'R' fused", "l_linestatus = 'F' AND l_returnflag = 'A' final", "l_discount * 10 m"
    )
    f = f.withColumn("cls", evaluate.failure_stage(*[F.col(c) for c in ("dense", "bm25", "rrf", "fused", "final")]))
    return reports.class_rollup(f.select("id", "cls", "m", F.col("n").alias("words")), "cls", "m", "words", "id")


_METEOR = SQL["meteor"].split("SELECT id, coalesce(m, 0) AS matches")[0]


@query(f"""{_METEOR}, s AS (SELECT id AS question_id, len(h) AS words, round(coalesce((m / len(h)::DOUBLE) * (m / len(r)::DOUBLE) / (0.9::DOUBLE * (m / len(h)::DOUBLE) + 0.1::DOUBLE * (m / len(r)::DOUBLE)) * (1 - 0.5::DOUBLE * pow(ch / m::DOUBLE, 3)), 0), 9) AS score FROM tok LEFT JOIN c USING (id))
SELECT row_number() OVER (ORDER BY score, question_id) AS place, question_id, score, words::BIGINT AS words, (SELECT round_even(avg(score), 6) FROM s) AS mean_score, (SELECT quantile_cont(words, 0.5) FROM s)::DOUBLE AS median_words FROM (SELECT * FROM s ORDER BY score, question_id LIMIT 10)""")
def score_report(spark, d):
    """A top-k report: the ten worst pairs of turns by METEOR."""
    pairs = _pairs(spark, d)
    scored = evaluate.meteor(pairs).select("id", F.round("meteor", 9).alias("score"))
    words = pairs.select("id", F.size(evaluate.meteor_tokens(F.col("hypothesis"))).cast("long").alias("words"))
    return reports.score_report(scored.join(words, "id").withColumnRenamed("id", "question_id"))


@query(f"""WITH {_CHUNKS}, b AS (SELECT c.doc_id, position, len(string_split(c.text, ' ')) + 3 + len(regexp_extract_all(source, '[^\\s]+')) + 2 AS cost FROM chunks c JOIN documents d ON d.doc_id = c.doc_id)
SELECT doc_id, position, cost::BIGINT AS cost, spent, spent <= 1668 AS fits FROM (SELECT *, sum(cost) OVER (PARTITION BY doc_id ORDER BY position)::BIGINT AS spent FROM b)""")
def prompt_fit(spark, d):
    """Windows of documents as evidence of a prompt of 2,500 tokens, 500 reserved and 300 fixed."""
    rows = doc_chunks(spark, d).select(F.col("document_id").alias("question_id"), F.col("position").cast("long").alias("rank"), "text").join(docs(spark, d).select(F.col("doc_id").alias("question_id"), "source"), "question_id")
    block = retrieve.rendered_evidence([("source", F.col("source"))], F.col("rank") + 1, F.concat(F.lit("text "), "text"))
    return reports.prompt_fit(rows, block, 2500, 500, 300).select(F.col("question_id").alias("doc_id"), F.col("rank").alias("position"), "cost", "spent", "fits")


@query("""WITH v AS (SELECT vec_id - CASE WHEN vec_id % 13 = 1 THEN 1 ELSE 0 END AS vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN embedding[1:32] ELSE embedding END AS embedding FROM embeddings)
SELECT count(*) AS vectors, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(embedding) <> 64) AS other_dimension, (SELECT count(*) FROM (SELECT vec_id FROM v GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids FROM v""")
def vector_checks(spark, d):
    """All vectors, some of them taken out, cut short or given their neighbour's id."""
    key, vector = F.col("vec_id"), F.col("embedding")
    broken = F.when(key % 7 == 0, None).when(key % 11 == 0, F.slice(vector, 1, 32)).otherwise(vector)
    rows = table(spark, d, "embeddings").select((key - (key % 13 == 1).cast("int")).alias("vec_id"), broken.alias("embedding"))
    return reports.vector_checks(rows, 64)


@query("""WITH s AS (SELECT o_custkey AS question_id, list(DISTINCT o_orderkey % 5) FILTER (o_orderpriority = '1-URGENT') AS said, list(DISTINCT o_orderkey % 5) FILTER (o_orderstatus = 'O') AS gold FROM orders GROUP BY 1)
SELECT question_id, list_has_any(coalesce(said, []), coalesce(gold, [])) OR (said IS NULL AND gold IS NULL) AS hit FROM s""")
def article_hits(spark, d):
    """Customers as questions; remainders of urgent orders' keys as cited articles, of open orders' keys as gold."""
    part = lambda c: F.collect_set(F.when(c, F.col("o_orderkey") % 5))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("question_id")).agg(part(F.col("o_orderpriority") == "1-URGENT").alias("said"), part(F.col("o_orderstatus") == "O").alias("gold"))
    return reports.article_hits(rows).select("question_id", "hit")


_GATE = """o AS (SELECT o_custkey AS question_id, o_orderkey AS child, o_orderkey % 97 AS parent, o_orderkey % 97 % 11 AS document, o_orderkey % 400 + 20 AS tokens, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
t AS (SELECT * FROM o WHERE rank <= 12), pt AS (SELECT parent, max(tokens) AS cost FROM o GROUP BY 1), pa AS (SELECT question_id, parent, document, min(rank) AS f FROM t GROUP BY ALL),
pe AS (SELECT *, row_number() OVER (PARTITION BY question_id, document ORDER BY f) AS n FROM pa),
sp AS (SELECT *, sum(cost) OVER (PARTITION BY question_id ORDER BY f) AS spent FROM pe JOIN pt USING (parent) WHERE n <= 2),
bu AS (SELECT question_id, count(*) AS parents_after_expansion, count(*) FILTER (spent <= 1500) AS evidences_in_context, coalesce(max(spent) FILTER (spent <= 1500), 0)::BIGINT AS token_count, count(*) FILTER (spent > 1500) AS dropped_by_budget FROM sp GROUP BY 1),
ch AS (SELECT question_id, count(*) AS children FROM t GROUP BY 1),
tr AS (SELECT c_custkey AS question_id, CASE WHEN c_custkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS metadata_confidence, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 END AS metadata_candidate_count, c_custkey % 40 / 8.0::DOUBLE AS bm25_ms, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 70 / 4.0::DOUBLE END AS reranker_ms FROM customer),
gf AS (SELECT c_custkey AS question_id, children, parents_after_expansion, evidences_in_context, token_count, dropped_by_budget, metadata_confidence, metadata_candidate_count, bm25_ms, reranker_ms FROM customer LEFT JOIN ch ON ch.question_id = c_custkey LEFT JOIN bu ON bu.question_id = c_custkey LEFT JOIN tr ON tr.question_id = c_custkey)"""
_RUN_FEATURES = ("children", "parents_after_expansion", "evidences_in_context", "token_count", "dropped_by_budget", "metadata_confidence", "metadata_candidate_count", "bm25_ms", "reranker_ms")


def _run_features(spark, d) -> DataFrame:
    """Customers as questions with their twelve dearest orders as children of 97 parents in 11 documents; traces by number."""
    k, q = F.col("o_orderkey"), F.col("question_id")
    orders = table(spark, d, "orders")
    places = orders.select(k.alias("child_id"), (k % 97).alias("parent_id"), (k % 97 % 11).alias("document_id"), (k % 400 + 20).alias("tokens"))
    costs = places.groupBy("parent_id").agg(F.max("tokens").alias("tokens"))
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = orders.select(F.col("o_custkey").alias("question_id"), k.alias("child_id"), F.row_number().over(order).alias("rank")).where("rank <= 12")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"))
    traces = asked.select("question_id", F.when(q % 3 == 0, 1.0).otherwise(0.0).alias("metadata_confidence"), F.when(q % 3 == 0, q % 50).alias("metadata_candidate_count"), (q % 40 / 8.0).alias("bm25_ms"), F.when(q % 5 != 0, q % 70 / 4.0).alias("reranker_ms"))
    return audits.run_features(asked, ranked, places.drop("tokens").join(costs, "parent_id"), traces, budget=1500, per_document=2)


@query(f"WITH {_GATE} SELECT * FROM gf")
def run_features(spark, d):
    return _run_features(spark, d)


@query(f"WITH {_GATE} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS known, count(*) - count({f}) AS missing, count({f}) = count(*) AS for_all FROM gf" for f in _RUN_FEATURES))
def features_available(spark, d):
    return audits.features_available(_run_features(spark, d), list(_RUN_FEATURES))
