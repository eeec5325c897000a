"""Readers and writers over files."""

import json

import pytest
from pyspark.sql import functions as F

from ratewise.operators import agreement
from ratewise.sources import delimited, documents, lexicons, sinks


def test_prediction_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿ID;prediction;x\n1;"a;b";q\n1;second;\n;lost;\n2;"line\nbreak";z\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("prediction,id\nP,7\n\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("ID;prediction\n", encoding="utf-8")
    rows = {(r.path.rsplit("/", 1)[1], r.id): r.prediction for r in delimited.read_predictions(spark, str(tmp_path)).collect()}
    assert rows == {("a.csv", "1"): "second", ("a.csv", "2"): "line\nbreak", ("b.csv", "7"): "P"}
    counts = {r.path.rsplit("/", 1)[1]: r.output_rows for r in delimited.count_rows(spark, str(tmp_path)).collect()}
    assert counts == {"a.csv": 4, "b.csv": 1, "c.csv": 0}


def test_delimiters(spark):
    df = spark.createDataFrame([("a;b,c",), ("a,b",), ("a\tb",), ("a;b,c,d",)], "h string")
    pick = lambda rule: [r.d for r in df.select(delimited.delimiter_of(F.col("h"), rule).alias("d")).collect()]
    assert pick("two") == [";", ",", ";", ","]
    assert pick("three") == [";", ",", "\t", ","]
    assert pick("header") == [";", ",", ",", ";"]


def test_examples_need_a_node(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ID,Left Context,Node,metadata\n1,l,n,i\n , , ,\n", encoding="utf-8")
    rows = delimited.read_examples(spark, str(tmp_path / "x.csv")).collect()
    assert [(r.id, r.left_context, r.node, r.info) for r in rows] == [("1", "l", "n", "i")]
    (tmp_path / "y.csv").write_text("ID;text\n1;n\n", encoding="utf-8")
    with pytest.raises(Exception, match="node column"):
        delimited.read_examples(spark, str(tmp_path / "y.csv")).collect()


def test_metrics_files(spark, tmp_path):
    good = {"accuracy": 0.5, "macro_f1": "0.4", "labels": ["a", "b"], "confusion_matrix_sparse": [[0, 0, 1], [1, 1, 1]], "run_config": {"tags": "x; y"}, "first_prompt_timestamp": "2026-05-14T10:30:00Z"}
    (tmp_path / "t__p__m__2026-05-14-10-30__metrics.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad__metrics.json").write_text("{")
    (tmp_path / "list__metrics.json").write_text("[]")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "other_metrics.json").write_text("{}")
    found = documents.discover(spark, [str(tmp_path)])
    assert found.count() == 4
    manifest = spark.createDataFrame([("sub/other_metrics.json",)], "name string")
    assert documents.discover(spark, [str(tmp_path)], manifest=manifest).count() == 1
    files = documents.read_whole(spark, str(tmp_path / "*.json"))
    assert sorted(r.message.split(" ")[0] for r in documents.metrics_warnings(files).collect()) == ["Invalid", "Unexpected"]
    run = documents.with_derived_kappa(documents.flatten_runs(documents.parse_metrics(files))).head()
    assert (run.task, run.provider, run.model, run.accuracy, run.macro_f1, run.tags, run.cohen_kappa) == ("t", "p", "m", 50.0, None, ["x", "y"], 1.0)


def test_logs(spark, tmp_path):
    lines = [
        "", "{broken", "[1]", json.dumps({"record_type": "run_metadata", "model_details": {"provider": "one"}}), json.dumps({"record_type": "run_metadata", "model_details": {"provider": "two"}}),
        json.dumps({"record_type": "example_result", "attempts": [{"status": "error", "error_category": "request_timeout", "duration_seconds": 2}, {"status": "success", "response": {"usage_metadata": {"a": 1}}}], "final_prediction": {"validator_status": None}}),
    ]
    (tmp_path / "r.log").write_text("\n".join(lines))
    records = documents.parse_log(documents.read_log_lines(spark, str(tmp_path)))
    assert documents.run_metadata(records).head().model_details.provider == "one"
    rows = sorted((r.attempt, r.status, r.duration_seconds, r.has_usage) for r in documents.log_attempts(records).collect())
    assert rows == [(0, "error", 2.0, False), (1, "success", None, True)]
    whole = spark.createDataFrame([("old", json.dumps([json.loads(x) for x in lines[3:]]))], "path string, text string")
    assert documents.parse_log(documents.legacy_log_lines(whole)).count() == 3


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Gan\tV\tx\nGAN;N\n\nhus N\n", encoding="utf-8")
    rows = sorted((r.lemma, r.pos) for r in lexicons.read_lexicon(spark, str(tmp_path / "a.txt")).collect())
    assert rows == [("GAN", "N"), ("Gan", "V"), ("hus", "N")]
    (tmp_path / "b.csv").write_text("pos;lemma\nN^x$y;Stan\n;eorþe\n", encoding="utf-8")
    assert sorted((r.lemma, r.pos) for r in lexicons.read_header_lexicon(spark, str(tmp_path / "b.csv")).collect()) == [("eorþe", ""), ("stan", "N")]
    (tmp_path / "c.csv").write_text("id,Headword\n1,Colour\n", encoding="utf-8")
    (tmp_path / "d.txt").write_text("Honour\n", encoding="utf-8")
    assert [lexicons.read_headwords(spark, str(tmp_path / f)).head().lemma for f in ("c.csv", "d.txt")] == ["colour", "honour"]


def test_writers_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.write_table(df, str(tmp_path / "t"), ["v", "k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == ["v", "k"]
    with pytest.raises(Exception):
        sinks.write_table(df, str(tmp_path / "t"))


def test_agreement_lookup_takes_the_later_group(spark):
    runs = spark.createDataFrame([("r1",), ("r2",)], "run_stem string")
    groups = spark.createDataFrame([(1, "a", 0.1, ["r1"]), (2, "b", 0.2, ["r1"])], "position int, group_id string, alpha_nominal double, run_stems array<string>")
    got = {r.run_stem: r.group_id for r in agreement.with_agreement(runs, groups).collect()}
    assert got == {"r1": "b", "r2": None}
