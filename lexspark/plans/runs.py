"""Queries of whole runs: second passes, replayed settings, forensics and logs, with SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import evaluate, fallback, forensics, retrieve, sweep
from lexspark.plans.catalog import _HALVES, _OVERLAP, _SET, _bm25, children, docs, query, questions, searched, table
from lexspark.sources import readers
from lexspark.sources.tables import new_folder, written

# ---- the second pass ------------------------------------------------------------------------------------------------

#: Below so many shared words a question's best candidate is weak, for the second policy.
_LEAST = 9.0
_GOLD_DOCS = "gold AS (SELECT m.item_id AS question_id, x.doc_id FROM benchmark m JOIN documents x ON contains(x.text, m.text))"
_OVERLAP_OF = f"len(list_intersect({_SET.format('m')}, {_SET.format('x')}))::DOUBLE"
_SECOND = f"""{_bm25("b", 20, _HALVES["first"])}, {_OVERLAP}, {_bm25("v", 20)}, {_bm25("w", 20, _HALVES["rest"])},
asked AS (SELECT item_id AS question_id, CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 5) END AS name FROM benchmark),
sig AS (SELECT a.question_id, coalesce(t.s, 0) AS top_score, name IS NOT NULL AS detected, name IS NULL OR f.question_id IS NOT NULL AS matching FROM asked a LEFT JOIN (SELECT question_id, max(score) AS s FROM new GROUP BY 1) t USING (question_id)
  LEFT JOIN (SELECT DISTINCT n.question_id FROM new n JOIN documents d ON d.doc_id = n.doc_id JOIN asked s ON s.question_id = n.question_id WHERE n.rr <= 5 AND d.source = s.name) f USING (question_id)),
pc AS (SELECT list_sort(list(top_score))[1 + floor(count(*) * 0.10)::BIGINT] AS p10, list_sort(list(top_score))[1 + floor(count(*) * 0.25)::BIGINT] AS p25 FROM sig),
trig AS (SELECT 'F1' AS policy, question_id FROM sig WHERE detected AND NOT matching UNION ALL SELECT 'F2', question_id FROM sig WHERE top_score < {_LEAST} UNION ALL SELECT 'F3', question_id FROM sig, pc WHERE top_score < p25
  UNION ALL SELECT 'F4', question_id FROM sig, pc WHERE (detected AND NOT matching) OR top_score < p10),
fresh AS (SELECT question_id, doc_id FROM v UNION SELECT question_id, doc_id FROM w EXCEPT SELECT question_id, doc_id FROM new),
merged AS (SELECT question_id, doc_id, score, false AS added FROM new UNION ALL SELECT f.question_id, f.doc_id, {_OVERLAP_OF} AS score, true FROM fresh f JOIN benchmark m ON m.item_id = f.question_id JOIN documents x ON x.doc_id = f.doc_id),
after AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM merged)"""


def _second(spark, d, texts: DataFrame) -> tuple[DataFrame, ...]:
    """Benchmark texts by their first twelve words as a first search; every third names a source; the whole text and its
    other words are the rewrites."""
    asked = questions(spark, d)
    part = lambda a, n: F.array_join(F.slice(T.words(F.col("text")), a, n), " ")
    first = retrieve.bm25_top_k(asked.withColumn("text", part(1, 12)), texts, 20)
    baseline = written(retrieve.rerank(first, asked, texts, retrieve.overlap_scorer, 20))
    q = F.col("question_id")
    named = asked.select("question_id", F.when(q % 3 == 0, F.concat(F.lit("src"), (q % 5).cast("string"))).alias("document_name"), F.lit(None).cast("string").alias("article"))
    places = docs(spark, d).select(F.col("doc_id").alias("child_id"), F.col("source").alias("document_name"), F.lit(None).cast("string").alias("article"))
    chosen = written(fallback.triggered(fallback.signals(baseline, named, places), fallback.policies(_LEAST)))
    rewrites = searched(asked).select("question_id", F.lit("whole").alias("list"), "text").unionByName(asked.select("question_id", F.lit("rest").alias("list"), part(13, 52).alias("text")))
    return baseline, chosen, fallback.second_pass(baseline, chosen, rewrites, asked, texts, 20, retrieve.overlap_scorer, 60)


@query(f"WITH {_SECOND} SELECT policy, question_id, doc_id, rank, score, added FROM trig JOIN after USING (question_id) WHERE rank <= 60")
def fallback_candidates(spark, d):
    """What each policy's second pass gives for the questions that it triggers."""
    after = _second(spark, d, written(children(spark, d)))[2]
    return after.select("policy", "question_id", F.col("child_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "score", "added")


@query(f"""WITH {_SECOND}, {_GOLD_DOCS}, hb AS (SELECT DISTINCT question_id FROM new JOIN gold USING (question_id, doc_id) WHERE rr <= 10), ha AS (SELECT DISTINCT question_id FROM after JOIN gold USING (question_id, doc_id) WHERE rank <= 10),
r AS (SELECT p.policy, t.question_id IS NOT NULL AS t, hb.question_id IS NOT NULL AS b, CASE WHEN t.question_id IS NOT NULL THEN ha.question_id IS NOT NULL ELSE hb.question_id IS NOT NULL END AS a FROM (VALUES ('F1'), ('F2'), ('F3'), ('F4')) p(policy)
  CROSS JOIN (SELECT item_id AS question_id FROM benchmark) q LEFT JOIN trig t ON t.policy = p.policy AND t.question_id = q.question_id LEFT JOIN hb ON hb.question_id = q.question_id LEFT JOIN ha ON ha.question_id = q.question_id)
SELECT policy, count(*) AS questions, count(*) FILTER (t) AS triggered, round_even(avg(a::INT), 4) AS recall, count(*) FILTER (NOT b AND a) AS rescued, count(*) FILTER (b AND NOT a) AS regressed, count(*) FILTER (NOT b AND a) - count(*) FILTER (b AND NOT a) AS net_gain,
coalesce(round_even(count(*) FILTER (NOT b AND a) / nullif(count(*) FILTER (t), 0)::DOUBLE, 4), 0) AS precision FROM r GROUP BY policy""")
def fallback_outcome(spark, d):
    """What each policy gains and costs."""
    texts = written(children(spark, d))  # read by several searches
    baseline, chosen, after = _second(spark, d, texts)
    asked = questions(spark, d)
    gold = evaluate.holders(asked, texts).select("question_id", "child_id")
    return fallback.outcome(baseline, written(after), chosen, gold, asked, 10, ["F1", "F2", "F3", "F4"])


# ---- settings -------------------------------------------------------------------------------------------------------

_SETTINGS = ", ".join(f"('{s.name}', {s.dense}, {s.bm25}, {s.fused}, {s.reranked})" for s in sweep.SETTINGS)
_CANDIDATES = f"""{_bm25("first", 50, _HALVES["first"])}, {_bm25("whole", 50)}, st(config, dense, bm25, fused, reranked) AS (VALUES {_SETTINGS}),
cand AS (SELECT coalesce(f.question_id, w.question_id) AS question_id, coalesce(f.doc_id, w.doc_id) AS doc_id, f.rank AS dr, w.rank AS br FROM first f FULL JOIN whole w ON w.question_id = f.question_id AND w.doc_id = f.doc_id),
fus AS (SELECT * FROM (SELECT st.*, cand.*, round(coalesce(CASE WHEN dr <= dense THEN 1.0::DOUBLE / (60 + dr) END, 0) + coalesce(CASE WHEN br <= bm25 THEN 1.0::DOUBLE / (60 + br) END, 0), 12) AS fusion FROM cand, st) WHERE fusion > 0),
num AS (SELECT *, row_number() OVER (PARTITION BY config, question_id ORDER BY fusion DESC, doc_id) AS n FROM fus)"""


def _candidates(spark, d, texts: DataFrame) -> DataFrame:
    """The first twelve words' list as the dense one, the whole text's as the lexical one."""
    q = questions(spark, d)
    first = q.withColumn("text", F.array_join(F.slice(T.words(F.col("text")), 1, 12), " "))
    lists = retrieve.bm25_lists({"first": first, "whole": searched(q)}, texts, 50)
    rank = lambda name: F.min(F.when(F.col("list") == name, F.col("rank")))
    return written(lists.groupBy("question_id", "child_id").agg(rank("first").alias("dense_rank"), rank("whole").alias("bm25_rank")))


@query(f"""WITH {_CANDIDATES}, sc AS (SELECT num.*, CASE WHEN num.doc_id % 7 <> 0 THEN {_OVERLAP_OF} ELSE -999.0::DOUBLE END AS s FROM num JOIN benchmark m ON m.item_id = num.question_id JOIN documents x ON x.doc_id = num.doc_id WHERE n <= fused),
rr AS (SELECT *, row_number() OVER (PARTITION BY config, question_id ORDER BY s DESC, doc_id) AS r FROM sc),
tk AS (SELECT doc_id % 500 AS parent, sum(len(regexp_extract_all(text, '[^\\s\\x0b\\x{{85}}\\p{{Z}}]+')))::BIGINT AS tokens FROM documents GROUP BY 1),
pa AS (SELECT config, question_id, doc_id % 500 AS parent, min(r) AS f, arg_min(doc_id, r) AS best FROM rr WHERE r <= reranked GROUP BY ALL),
dc AS (SELECT pa.*, tokens, row_number() OVER (PARTITION BY config, question_id, pa.parent % 40 ORDER BY f) AS dn FROM pa JOIN tk USING (parent))
SELECT config, question_id, parent AS parent_id, row_number() OVER o AS place, tokens AS cost, (sum(tokens) OVER o)::BIGINT AS spent, sum(tokens) OVER o <= 10000 AS fits, best AS best_child_id FROM dc WHERE dn <= 3 WINDOW o AS (PARTITION BY config, question_id ORDER BY f)""")
def settings_sweep(spark, d):
    """Eight settings replayed on one candidate table; documents as children of 500 parents in 40 documents, a seventh of
    them without a reranker's score."""
    asked, texts = questions(spark, d), written(children(spark, d))
    found = _candidates(spark, d, texts)
    scored = retrieve.rerank(found.where("child_id % 7 <> 0").select("question_id", "child_id", F.lit(0).alias("rank")), asked, texts, retrieve.overlap_scorer, 1 << 30)
    rows = found.join(scored.select("question_id", "child_id", F.col("score").alias("rerank_score")), ["question_id", "child_id"], "left")
    parent = F.col("doc_id") % 500
    tokens = docs(spark, d).groupBy(parent.alias("parent_id")).agg(F.sum(T.token_count(F.col("text"))).alias("tokens"))
    places = docs(spark, d).select(F.col("doc_id").alias("child_id"), parent.alias("parent_id"), (parent % 40).alias("document_name")).join(tokens, "parent_id")
    return sweep.replay(rows, places)


@query(f"""WITH {_CANDIDATES}, {_GOLD_DOCS}, e AS (SELECT config, num.question_id, max((g.doc_id IS NOT NULL)::INT) AS i, max((g.doc_id IS NOT NULL AND n <= fused)::INT) AS o FROM num LEFT JOIN gold g ON g.question_id = num.question_id AND g.doc_id = num.doc_id GROUP BY ALL)
SELECT config, count(*) AS questions, count(*) FILTER (i = 1 AND o = 0) AS lost FROM e GROUP BY config""")
def settings_lost_in_fusion(spark, d):
    texts = written(children(spark, d))
    gold = evaluate.holders(questions(spark, d), texts).select("question_id", "child_id")
    return sweep.lost_in_fusion(_candidates(spark, d, texts), gold)


# ---- forensics ------------------------------------------------------------------------------------------------------

_LIFE = """o AS (SELECT o_custkey AS question_id, o_orderkey AS child, o_orderkey % 997 AS parent, o_orderkey % 997 % 11 AS document, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank,
  o_orderkey % 2 = 0 AS dense, o_orderkey % 3 = 0 AS bm25, (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND o_orderkey % 5 <> 0 AS rrf, (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND o_orderkey % 5 <> 0 AND o_orderpriority <> '5-LOW' AS reranker FROM orders),
rk AS (SELECT question_id, child, parent, document, rank, row_number() OVER (PARTITION BY question_id, parent ORDER BY rank) = 1 AS first FROM o WHERE reranker),
pr AS (SELECT *, coalesce(sum(first::INT) OVER (PARTITION BY question_id, document ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM rk),
cx AS (SELECT DISTINCT question_id, parent FROM pr WHERE prior < 2 AND rank <= 8),
gold AS (SELECT question_id, child FROM o UNION ALL SELECT o_custkey - 1, o_orderkey FROM orders WHERE o_custkey > 1),
life AS (SELECT g.question_id, g.child, (CASE WHEN o.dense THEN 1 ELSE 0 END + CASE WHEN o.bm25 THEN 2 ELSE 0 END + CASE WHEN o.rrf THEN 4 ELSE 0 END + CASE WHEN o.reranker THEN 8 ELSE 0 END)::INT AS passed, cx.parent IS NOT NULL AS final,
  CASE WHEN coalesce(o.reranker, false) AND cx.parent IS NOT NULL THEN 'Not missing (In final context)' WHEN coalesce(o.reranker, false) AND pr.prior >= 2 THEN 'Max parents per document limit (D4)' WHEN coalesce(o.reranker, false) THEN 'Token budget cut (D6)' WHEN coalesce(o.rrf, false) THEN 'Filtered by Reranker (D7)'
    WHEN coalesce(o.dense OR o.bm25, false) THEN 'Filtered by RRF fusion (D7)' WHEN s.parent IS NOT NULL THEN 'Neighbor expansion omitted (D5)' ELSE 'Not in candidate pool (D7)' END AS reason
  FROM gold g LEFT JOIN o ON o.question_id = g.question_id AND o.child = g.child LEFT JOIN pr ON pr.question_id = g.question_id AND pr.child = g.child
  LEFT JOIN (SELECT DISTINCT question_id, parent FROM rk) s ON s.question_id = g.question_id AND s.parent = g.child % 997 LEFT JOIN cx ON cx.question_id = g.question_id AND cx.parent = g.child % 997)"""
_AUDIT = f"""{_LIFE}, qs AS (SELECT c_custkey AS question_id, c_custkey % 3 = 0 AS points FROM customer),
au AS (SELECT q.question_id, count(l.child) AS gold_children, coalesce(bool_or(passed & 3 > 0), false) AS retrieved, coalesce(bool_or(passed & 4 > 0 AND passed & 8 = 0), false) AS lost_by_reranker, coalesce(bool_or(passed & 8 > 0 AND NOT final), false) AS lost_by_context, coalesce(bool_or(final), false) AS in_context,
  CASE WHEN coalesce(bool_or(passed & 8 > 0), false) THEN 'Context Construction' ELSE 'Retrieval' END AS missing_due_to,
  CASE WHEN coalesce(bool_or(reason LIKE 'Not missing%'), false) THEN CASE WHEN points THEN 'D3' ELSE 'D2' END WHEN coalesce(bool_or(reason LIKE 'Token%'), false) THEN 'D6' WHEN coalesce(bool_or(reason LIKE 'Max%'), false) THEN 'D4' WHEN coalesce(bool_or(reason LIKE 'Neighbor%'), false) THEN 'D5' ELSE 'D7' END AS cls
  FROM qs q LEFT JOIN life l USING (question_id) GROUP BY q.question_id, points)"""


def _life(spark, d) -> DataFrame:
    """Customers as questions and their orders by price as what a run found; their own and the next customer's orders are gold."""
    k = F.col("o_orderkey")
    order = Window.partitionBy("question_id").orderBy(F.desc("o_totalprice"), "child_id")
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), k.alias("child_id"), "o_totalprice", "o_orderpriority").withColumn("rank", F.row_number().over(order))
    dense, lexical = F.col("child_id") % 2 == 0, F.col("child_id") % 3 == 0
    fused = (dense | lexical) & (F.col("child_id") % 5 != 0)
    reranked = fused & (F.col("o_orderpriority") != "5-LOW")
    named = F.array(*[F.when(c, F.lit(s)) for s, c in (("dense", dense), ("bm25", lexical), ("rrf", fused), ("reranker", reranked))])
    stages = own.select("question_id", "child_id", "rank", F.explode(named).alias("stage")).where("stage is not null")
    kids = table(spark, d, "orders").select(k.alias("child_id"), (k % 997).alias("parent_id"), (k % 997 % 11).alias("document_id"))
    ranked = stages.where("stage = 'reranker'").join(kids, "child_id")
    ranked = ranked.withColumn("_first", (F.row_number().over(Window.partitionBy("question_id", "parent_id").orderBy("rank")) == 1).cast("int"))
    before = Window.partitionBy("question_id", "document_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    context = ranked.withColumn("_prior", F.coalesce(F.sum("_first").over(before), F.lit(0))).where("_prior < 2 and rank <= 8").select("question_id", "parent_id")
    gold = own.select("question_id", "child_id").unionByName(own.where("question_id > 1").select((F.col("question_id") - 1).alias("question_id"), "child_id"))
    return forensics.evidence_lifecycle(gold, stages, kids, context, cap=2)


@query(f"WITH {_LIFE} SELECT question_id, child AS child_id, passed, final, reason FROM life")
def evidence_lifecycle(spark, d):
    return _life(spark, d)


def _audit(spark, d) -> DataFrame:
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), (F.col("c_custkey") % 3 == 0).alias("has_points"))
    return forensics.evidence_audit(asked, _life(spark, d))


@query(f"WITH {_AUDIT} SELECT * FROM au")
def evidence_audit(spark, d):
    return _audit(spark, d)


@query(f"WITH {_AUDIT} SELECT cls, count(au.question_id) AS questions, round_even(100.0::DOUBLE * count(au.question_id) / (SELECT count(*) FROM au), 4) AS percent FROM (SELECT 'D' || i AS cls FROM range(1, 10) t(i)) LEFT JOIN au USING (cls) GROUP BY cls")
def evidence_classes(spark, d):
    return forensics.evidence_classes(_audit(spark, d))


_POSITIONS = """ctx AS (SELECT o_custkey AS question_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position, (o_orderkey % 30)::VARCHAR AS article FROM orders),
gold AS (SELECT c_custkey AS question_id, (c_custkey % 30)::VARCHAR AS article FROM customer UNION SELECT c_custkey, (c_custkey * 7 % 30)::VARCHAR FROM customer),
cited AS (SELECT DISTINCT o_custkey AS question_id, (o_orderkey % 30)::VARCHAR AS article FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 7 <> 0 UNION SELECT c_custkey, '99' FROM customer WHERE c_custkey % 11 = 0),
f AS (SELECT question_id, article, min(position) AS fp FROM ctx GROUP BY ALL),
ga AS (SELECT question_id, min(fp) AS gold_at FROM gold JOIN f USING (question_id, article) GROUP BY 1),
ca AS (SELECT c.question_id, count(*) AS n, min(fp) AS cited_at, count(*) FILTER (fp IS NULL) AS "foreign", count(*) FILTER (g.article IS NULL AND EXISTS (SELECT 1 FROM gold x WHERE x.question_id = c.question_id AND abs(x.article::BIGINT - c.article::BIGINT) BETWEEN 1 AND 2)) AS near
  FROM cited c LEFT JOIN f ON f.question_id = c.question_id AND f.article = c.article LEFT JOIN gold g ON g.question_id = c.question_id AND g.article = c.article GROUP BY 1),
po AS (SELECT c_custkey AS question_id, CASE WHEN c_custkey % 5 = 0 THEN {'c': 'D', 'p': 0.95::DOUBLE} WHEN coalesce("foreign", 0) > 0 THEN {'c': 'F', 'p': 0.90::DOUBLE} WHEN coalesce(near, 0) > 0 THEN {'c': 'C', 'p': 0.90::DOUBLE} WHEN coalesce(n, 0) = 0 THEN {'c': 'A', 'p': 0.85::DOUBLE}
  WHEN gold_at >= 3 AND coalesce(cited_at < gold_at, false) THEN {'c': 'B', 'p': 0.80::DOUBLE} WHEN gold_at IS NOT NULL THEN {'c': 'A', 'p': 0.85::DOUBLE} ELSE {'c': 'G', 'p': 0.70::DOUBLE} END AS k, gold_at, cited_at, coalesce("foreign", 0) AS "foreign", coalesce(near, 0) AS near
  FROM customer LEFT JOIN ga ON ga.question_id = c_custkey LEFT JOIN ca ON ca.question_id = c_custkey)"""


def _positions(spark, d) -> DataFrame:
    """Customers as questions, their orders by price as the context, urgent orders as what is cited."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"))
    article = (F.col("o_orderkey") % 30).cast("string").alias("article")
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    context = orders.select(F.col("o_custkey").alias("question_id"), F.row_number().over(order).alias("position"), article)
    q = F.col("question_id")
    gold = customers.select("question_id", F.explode(F.array((q % 30).cast("string"), (q * 7 % 30).cast("string"))).alias("article"))
    cited = orders.where("o_orderpriority = '1-URGENT' and o_custkey % 7 <> 0").select(F.col("o_custkey").alias("question_id"), article).unionByName(customers.where("question_id % 11 = 0").select("question_id", F.lit("99").alias("article")))
    return forensics.position_forensics(customers.withColumn("complete", q % 5 != 0), cited, gold, context)


@query(f"WITH {_POSITIONS} SELECT question_id, k.c AS cls, k.p AS confidence, gold_at, cited_at, \"foreign\", near FROM po")
def position_forensics(spark, d):
    at = lambda c: F.col(c).cast("long").alias(c)
    return _positions(spark, d).select("question_id", "cls", F.col("confidence").cast("double").alias("confidence"), at("gold_at"), at("cited_at"), "foreign", "near")


@query(f"""WITH {_POSITIONS} SELECT k.c AS cls, count(*) AS questions, round_even(avg(s), 6) AS mean_score, quantile_cont(s, 0.5) AS median_score, quantile_cont(gold_at, 0.5)::DOUBLE AS median_gold_at, quantile_cont(cited_at, 0.5)::DOUBLE AS median_cited_at,
round_even(sum(greatest(0.0::DOUBLE, 0.5506::DOUBLE - s)) / (SELECT count(*) FROM customer), 6) AS ceiling FROM (SELECT *, (question_id % 64) / 64.0::DOUBLE AS s FROM po) GROUP BY 1""")
def position_rollup(spark, d):
    scores = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), (F.col("c_custkey") % 64 / 64.0).alias("score"))
    return forensics.position_rollup(_positions(spark, d), scores, 0.5506)


@query("""WITH r AS (SELECT o_custkey AS list_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 4 = 0 THEN o_totalprice ELSE round(o_totalprice, -4) END DESC, o_orderkey) AS b FROM orders),
i AS (SELECT x.list_id, count(*) AS inversions FROM r x JOIN r y ON y.list_id = x.list_id AND x.a < y.a AND x.b > y.b GROUP BY 1)
SELECT list_id, count(*) AS items, coalesce(any_value(inversions), 0) AS inversions, min(a) FILTER (a <> b) AS first_difference, coalesce(min(a) FILTER (a <> b) > 5, true) AS same_top FROM r LEFT JOIN i USING (list_id) GROUP BY list_id""")
def order_check(spark, d):
    """Each customer's orders by price, and by price rounded to ten thousands as a scoring of less precision."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("list_id"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"))
    return forensics.order_check(orders, orders.withColumn("score", F.when(F.col("list_id") % 4 == 0, F.col("score")).otherwise(F.round("score", -4))))


# ---- logs -----------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT c_custkey AS step, k AS checkpoint, CASE WHEN c_custkey % 2 = 0 THEN 'eval' ELSE 'train' END AS split, c_acctbal + k AS loss FROM customer, (VALUES (10), (20), (130)) v(k) WHERE k < 130 OR c_custkey % 3 <> 0)
SELECT step, split, round_even(step / 8.0::DOUBLE, 4) AS epoch, round(arg_max(loss, checkpoint), 4) AS loss FROM e GROUP BY step, split""")
def training_log(spark, d):
    """Customers as steps logged by three checkpoints, a third of them missing from the last; their balances as losses."""
    run = new_folder(spark)
    entry = lambda k: F.struct(F.col("c_custkey").alias("step"), (F.col("c_custkey") / 8.0).alias("epoch"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_acctbal") + k).alias("loss"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + k).alias("eval_loss"))
    for k in (10, 20, 130):
        some = table(spark, d, "customer").where(F.lit(k < 130) | (F.col("c_custkey") % 3 != 0))
        parts = some.groupBy(F.floor(F.col("c_custkey") / 1000)).agg(F.collect_list(entry(k)).alias("log_history"))
        parts.select("log_history").write.option("maxRecordsPerFile", 1).json(f"{run}/checkpoint-{k}/trainer_state.json")
    return readers.training_log(spark, run).select("step", "split", "epoch", F.round("loss", 4).alias("loss"))
