"""Whole searches against plain Python: hashed words, dot products, BM25, reciprocal ranks."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexspark.conf import Settings
from lexspark.operators import retrieve
from lexspark.plans import catalog, search, stored  # noqa: F401  (it registers more queries)


def embedding(text, dim=256):
    v = np.zeros(dim)
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if h & (1 << 31) else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def tokens(text):
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", plain)


def lexical(questions, children, k):
    bags = {c: Counter(tokens(t)) for c, t in children}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = {}
    for q, text in questions:
        scores = Counter()
        for term, times in Counter(t for w in text.split()[:64] for t in tokens(w)).items():
            holders = [c for c, b in bags.items() if term in b]
            weight = math.log((len(bags) - len(holders) + 0.5) / (len(holders) + 0.5)) if holders else 0
            for c in holders:
                f = bags[c][term]
                scores[c] += times * (weight if weight > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(bags[c].values()) / mean))
        out[q] = sorted(((round(s, 9), c) for c, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
    return out


def test_hybrid_search_by_brute_force(spark, data):
    settings = Settings()
    children = [(r.child_id, r.text) for r in catalog.doc_chunks(spark, data).collect()]
    questions = [(r.question_id, r.text) for r in catalog.questions(spark, data).collect()]
    single = lambda t: all(len(tokens(w)) <= 1 for w in t.split()[:64])
    assert all(single(t) for _, t in questions)
    matrix, ids = np.array([embedding(t) for _, t in children]), [c for c, _ in children]
    words = lexical(questions, children, settings.bm25_top_k)
    rows = search.hybrid_search(catalog.questions(spark, data), catalog.doc_chunks(spark, data), settings).collect()
    got = {}
    for r in rows:
        got.setdefault(r.question_id, {})[r.child_id] = r
    assert got.keys() == {q for q, _ in questions}
    for q, text in questions:
        scores = matrix @ embedding(text)
        dense = sorted(((s, c) for s, c in zip(scores, ids)), key=lambda x: (-round(x[0], 12), x[1]))[: settings.dense_top_k]
        fused = Counter()
        for ranked in (dense, words[q]):
            for n, (_, c) in enumerate(ranked, 1):
                fused[c] += 1 / (settings.rrf_k + n)
        best = sorted(fused.items(), key=lambda x: (-round(x[1], 12), x[0]))[: settings.rrf_top_k]
        least = best[-1][1]
        sure = {c: n for n, (c, s) in enumerate(best, 1) if s > least + 1e-9}
        # scores that tie but for the last bits may swap, and with them the ranks behind
        mine = got[q]
        assert sum(c in mine for c in sure) >= 0.95 * len(sure)
        for c, s in best:
            if c in mine and mine[c].dense_score is not None:
                assert abs(mine[c].dense_score - scores[ids.index(c)]) < 1e-9
        lex = dict((c, s) for s, c in words[q])
        assert all(abs(r.bm25_score - lex[c]) < 1e-6 for c, r in mine.items() if r.bm25_score is not None and c in lex)
        assert [r.child_id for r in sorted(mine.values(), key=lambda r: r["rank"])][:3] == [c for c, _ in best][:3] or len({round(s, 9) for _, s in best[:4]}) < 4


def test_held_words_and_the_join_agree(spark):
    rows = [(1, "a b c-d a", ), (2, "b b c d"), (3, None), (4, ""), (5, "d c c-d e" * 5), (6, "Ế a")]
    children = spark.createDataFrame(rows, "child_id long, text string")
    asked = spark.createDataFrame([(1, "a c-d"), (2, "b b e"), (3, "e z"), (4, ""), (5, "zz")], "question_id long, text string")
    show = lambda df: sorted((r.question_id, r["rank"], r.child_id, r.score) for r in df.collect())
    for k in (0, 1, 3, 10):
        for allowed in (None, children.where("child_id <> 5").select("child_id")):
            assert show(retrieve.bm25_top_k(asked, children, k, allowed)) == show(retrieve.bm25_top_k(asked, children, k, allowed, held=0))
    assert retrieve.bm25_top_k(asked, children.limit(0), 3).count() == 0
    many = children.select("text").where("text is not null").join(spark.range(3000)).selectExpr("'t' || id || text AS child_id", "text")
    named = asked.selectExpr("named_struct('list', 'x', 'question_id', question_id) AS question_id", "text")
    got, want = retrieve.bm25_top_k(named, many, 5), retrieve.bm25_top_k(named, many, 5, held=0)
    assert sorted((str(r.question_id), r["rank"], r.child_id) for r in got.collect()) == sorted((str(r.question_id), r["rank"], r.child_id) for r in want.collect())


def test_long_questions_are_searched_whole(spark):
    """A text's score is the sum of those by parts of the question; the last words alone are found too."""
    rows = [(f"doc:{i}:child:0", " ".join(f"w{(i * j * j + j) % 211}" for j in range(1, 30))) for i in range(60)] + [("doc:60:child:0", "needle in hay-stack w3")]
    children = spark.createDataFrame(rows, "child_id string, text string")
    long = [f"w{j * 7 % 211}" for j in range(180)]
    questions = [(1, [*long, "needle"]), (2, [f"none{j}" for j in range(64)] + ["needle"]), (3, [f"none{j}" for j in range(500)] + ["hay-stack"])]
    asked = spark.createDataFrame([(q, " ".join(words)) for q, words in questions], "question_id long, text string")
    want = Counter()
    for low in range(0, 181, 50):
        want.update({c: s for s, c in lexical([(1, " ".join(questions[0][1][low : low + 50]))], rows, 100)[1]})
    for held in (retrieve.HELD_PAIRS, 0):
        got = retrieve.bm25_top_k(asked, children, 100, held=held).collect()
        mine = {r.child_id: r.score for r in got if r.question_id == 1}
        assert mine.keys() == want.keys() and all(abs(mine[c] - want[c]) < 1e-6 for c in want)
        assert [(r.question_id, r.child_id) for r in got if r.question_id > 1] == [(2, "doc:60:child:0"), (3, "doc:60:child:0")]
    found = {(r.question_id, r.child_id): r for r in search.hybrid_search(asked, children).collect()}
    assert all(found[q, "doc:60:child:0"].bm25_score > 0 for q in (2, 3))


def test_words_are_multiplied_part_by_part():
    import pyarrow as pa

    terms = [[f"t{i * j % 17}" for j in range(1, 12)] for i in range(40)] + [None, [], ["a", "b", "a", "b"], ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(terms)), pa.int64()), pa.array(terms, pa.list_(pa.string()))], names=["child_id", "terms"])
    words = retrieve.HeldWords.of([(q, f"t{(q * 5 + n) % 19}", 1 + n % 2) for q in range(9) for n in range(q + 2)] + [(9, "a b", 1), (9, "b a b", 1)])
    counts = next(words.counted(iter([batch.select([1])]))).to_pydict()
    found = dict(zip(counts["key"], counts["holders"]))
    assert found[words.keys.index("a b")] == found[words.keys.index("b a b")] == 1
    words.weigh({k: n for k, n in found.items() if k >= 0}, found[-1], 10.0)
    show = lambda **sizes: [b.to_pydict() for b in words.searcher(3, **sizes)(iter([batch]))]
    assert show(words=1) == show(words=4) == show(block=2, rows=7, words=2) == show() and len(show()[0]["score"]) > 20


def long_questions(data, folder):
    """The given tables with each question followed by two others, so that it has some hundred words."""
    import os

    import duckdb

    for file in os.listdir(data):
        if file != "benchmark.parquet":
            os.symlink(f"{data}/{file}", f"{folder}/{file}")
    con = duckdb.connect()
    con.execute(f"""COPY (WITH b AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS c FROM '{data}/benchmark.parquet')
        SELECT b.item_id, b.text || ' ' || x.text || ' ' || y.text AS text FROM b JOIN b x ON x.n = (b.n + 1) % b.c JOIN b y ON y.n = (b.n + 7) % b.c) TO '{folder}/benchmark.parquet'""")
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    return con


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_multi_query", "rerank_overlap", "postings_topk", "postings_updated"])
def test_queries_search_as_much_as_their_sql(spark, data, tmp_path, name):
    con = long_questions(data, tmp_path)
    assert con.execute("SELECT count(*) FROM benchmark WHERE len(string_split(text, ' ')) > 64").fetchone()[0] > 30
    want = con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
