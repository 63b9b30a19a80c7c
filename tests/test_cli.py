"""The command line from a corpus to a checked submission."""

import json

from lexspark import cli


def test_ingest_submit_validate(spark, tmp_path, capsys):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    for i in range(1, 4):
        (corpus / f"context_{i}.json").write_text(json.dumps({"id": i, "name": f"Luật {i}", "link": "l", "passage": f"Điều {i}. Tên\n1. Doanh nghiệp số {i} nộp hồ sơ."}, ensure_ascii=False), encoding="utf-8")
    questions = tmp_path / "q.json"
    questions.write_text(json.dumps({"a": {"question": "Doanh nghiệp số 2 nộp gì"}, "b": {"question": "hồ sơ số 3"}}, ensure_ascii=False), encoding="utf-8")
    index, output = f"file://{tmp_path}/index", str(tmp_path / "s.json")
    assert cli.main(["ingest", str(corpus), index]) == 0
    assert cli.main(["submit", str(questions), index, output]) == 0
    assert cli.main(["validate-submission", output, "--questions", str(questions)]) == 0
    assert "2 answers are valid" in capsys.readouterr().out
    assert set(json.load(open(output, encoding="utf-8"))) == {"a", "b"}


def test_evaluate_grounding(spark, tmp_path, capsys):
    (tmp_path / "g.jsonl").write_text('{"question_id": "1", "gold_grounded": true}\n{"question_id": "2", "gold_grounded": null}\n')
    (tmp_path / "p.jsonl").write_text('{"question_id": "1", "validator_grounded": true}\n{"question_id": "2", "validator_grounded": true}\n')
    assert cli.main(["evaluate-grounding", str(tmp_path / "g.jsonl"), str(tmp_path / "p.jsonl")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["tp"] == 1
