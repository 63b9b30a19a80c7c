"""Ingestion, its resumption, versions, readers and the stream."""

import json

import pytest

from lexspark.plans.ingest import ingest
from lexspark.sources import readers
from lexspark.sources.writers import IndexVersions, manifest_issues
from lexspark.streaming.ingest import start_ingest


def corpus(folder):
    for i in range(1, 6):
        record = {"id": i, "name": "" if i == 2 else f" Luật {i} ", "link": "l", "passage": "" if i == 5 else f"Điều {i}. Nội dung\n1. Khoản một\n2. Khoản hai", "extra": 1}
        (folder / f"context_{i:06}.json").write_text(json.dumps(record, ensure_ascii=False), encoding="utf-8")


def test_ingest_resumes_and_publishes(spark, tmp_path):
    source = tmp_path / "corpus"
    source.mkdir()
    corpus(source)
    versions = IndexVersions(spark, f"file://{tmp_path}/index")
    manifest = ingest(readers.read_contexts(spark, str(source)), versions)
    assert (manifest["documents_valid"], manifest["documents_failed"], manifest["status"]) == (4, 1, "ready")
    assert versions.current() == "v1" and manifest["counts"]["children"] == 8
    again = ingest(readers.read_contexts(spark, str(source)), versions)
    assert again["counts"] == manifest["counts"] and versions.current() == "v2"
    (source / "context_000001.json").write_text(json.dumps({"id": 1, "link": "l", "passage": "Điều 1. Mới\n1. Một"}), encoding="utf-8")
    changed = ingest(readers.read_contexts(spark, str(source)), versions)
    assert changed["counts"]["children"] == 7 and changed["documents_total"] == 5
    versions.publish("v1")
    assert versions.current() == "v1"


def test_stream(spark, tmp_path):
    source = tmp_path / "corpus"
    source.mkdir()
    corpus(source)
    root, state = f"file://{tmp_path}/index", f"file://{tmp_path}/state"
    for _ in range(2):  # the second run finds nothing new
        start_ingest(spark, str(source), root, state, per_batch=3).awaitTermination()
    versions = IndexVersions(spark, root)
    assert versions.read(versions.current(), "children").count() == 8


@pytest.mark.parametrize("record, bad", [({"id": 1, "link": "l"}, False), ({"id": "1", "link": "l"}, True), ({"id": 1, "link": ""}, True), ({"id": 1, "link": "l", "name": 5}, True), ({"id": 1, "link": "l", "x": {"name": 5, "passage": []}}, False), ([1], True)])
def test_strict_records(spark, tmp_path, record, bad):
    (tmp_path / "context_1.json").write_text(json.dumps(record))
    row = readers.read_contexts(spark, str(tmp_path)).first()
    assert (row.error is not None) == bad
    if not bad:
        assert row.text == "" and row.document_name is None


@pytest.mark.parametrize(
    "name, content",
    [
        ("q.json", '{"80189": {"question": " hỏi ", "answer": null}}'),
        ("q.json", '[{"question_id": "80189", "question": "hỏi"}]'),
        ("q.json", '{"80189": "hỏi"}'),
        ("q.json", '﻿{"question_id": "80189", "question": "hỏi"}'),
        ("q.jsonl", '{"question_id": "80189", "question": "hỏi"}\n\n'),
        ("q.csv", "question_id,question\n80189,hỏi\n"),
    ],
)
def test_questions(spark, tmp_path, name, content):
    (tmp_path / name).write_text(content, encoding="utf-8")
    assert [tuple(r) for r in readers.read_questions(spark, str(tmp_path / name)).collect()] == [("80189", "hỏi")]


def test_bad_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text("question_id,question\n1,a\n1,b\n")
    with pytest.raises(ValueError):
        readers.read_questions(spark, str(tmp_path / "q.csv"))


def test_latest_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "a", "v": 1}\n\n{"k": "b", "v": 2}\n{"k": "a", "v": 3}\n{"k": "c", "v"')
    got = readers.read_latest_lines(spark, str(tmp_path / "a.jsonl"), "k string, v long", "k").collect()
    assert {(r.k, r.v) for r in got} == {("a", 3), ("b", 2)}


def test_manifest_rules():
    assert manifest_issues({"documents_total": 2, "documents_valid": 1, "documents_failed": 0, "counts": {"children": 1, "vectors": 2}, "dimension": 0})
    assert not manifest_issues({"documents_total": 1, "documents_valid": 1, "documents_failed": 0, "counts": {"children": 1, "vectors": 1, "lexical": 1}, "dimension": 4})
