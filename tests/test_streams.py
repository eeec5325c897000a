"""Streams without a single file, and the folders of kept tables."""

from pyspark.sql import functions as F

from ratewise.operators import lexicon as lx
from ratewise.streaming import levels, live


def test_validation_of_a_stream_without_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    requests = spark.readStream.schema("request_id string, label string, info string, attempt int").parquet(str(tmp_path / "in"))
    terms = spark.createDataFrame([("cat", "cat", "")], "norm string, canonical string, pos string")
    decide = lambda batch: lx.decide_lemma(batch, terms, max_suggestions=3)
    rows = live.validate_stream(requests, decide, str(tmp_path / "checkpoint"), str(tmp_path / "rows"))
    assert rows.collect() == [] and rows.columns == ["request_id", "label", "action", "reason", "normalized", "allowed_labels"]
    spark.createDataFrame([("a", "cat", "", 1), ("b", "cot", "", 1)], "request_id string, label string, info string, attempt int").write.parquet(str(tmp_path / "in" / "one"))
    for file in (tmp_path / "in" / "one").glob("*.parquet"):
        file.rename(tmp_path / "in" / file.name)
    rows = live.validate_stream(requests, decide, str(tmp_path / "checkpoint"), str(tmp_path / "rows"))
    assert sorted((r.request_id, r.action) for r in rows.collect()) == [("a", "accept"), ("b", "retry")]


def test_spans_cover_all_batches_in_few_folders():
    for fan_in in (2, 3, 8):
        kept = set()
        for n in range(1, 1_001):
            spans = levels.level_spans(n, fan_in)
            assert [i for a, b in spans for i in range(a, b)] == list(range(n))
            inputs = levels.merged_spans(n, fan_in)
            kept.add((n - 1, n))
            assert set(inputs) <= kept
            if inputs:
                kept.add((inputs[0][0], n))
            kept -= set(levels.merged_spans(n - levels.GRACE, fan_in)) if n > levels.GRACE else set()
            assert set(spans) <= kept
            digits = len(spans)
            assert len(kept) <= digits + (levels.GRACE + 1) * 2 * fan_in * 10 and digits <= (fan_in - 1) * 10
    assert len(levels.level_spans(1_000, 8)) <= 4 * 7


ATTEMPT = "run_id long, id long, status string, error_category string, duration_seconds double, ts timestamp"


def attempts(spark, low, high):
    """Attempts in a shuffled order of time, a few to a batch."""
    at = F.pmod(F.col("id") * 37, F.lit(240))
    error = F.col("id") % 5 == 0
    return spark.range(low, high, 1, 1).select(
        (F.col("id") % 2).alias("run_id"), F.col("id"), F.when(error, "error").otherwise("success").alias("status"),
        F.when(error, "request_timeout").alias("error_category"), (F.col("id") % 7).cast("double").alias("duration_seconds"),
        F.timestamp_seconds(at * 600 + 1_700_000_000).alias("ts"),
    ).select(*[F.col(c) for c in "run_id id status error_category duration_seconds ts".split()])


def test_kept_tables_equal_the_batch_result_after_merges_and_repeated_batches(spark, tmp_path):
    tables = {"counters": live.live_counters(), "alerts": live.timeout_alerts("1 day"), "sessions": live.active_sessions("15 minutes"), "first": live.first_predictions()}
    for name, table in tables.items():
        path, batches = str(tmp_path / name), 11
        for b in range(batches):
            part = table.part(attempts(spark, b * 6, b * 6 + 9))
            levels.add_batch(part, b, path, table.compact or table.merge, 3, 1)
            # The batches that end a span, and one that does not, are run once more, as after a lost driver.
            if b in (2, 4, 8):
                levels.add_batch(table.part(attempts(spark, b * 6, b * 6 + 9)), b, path, table.compact or table.merge, 3, 1)
        rows = table.merge(levels.read_table(spark, path, part.schema, 3))
        whole = attempts(spark, 0, 9)
        for b in range(1, batches):
            whole = whole.unionByName(attempts(spark, b * 6, b * 6 + 9))
        want = table.merge(table.part(whole))
        assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect())), name
        assert {f.name for f in (tmp_path / name / "rows").iterdir()} >= {"0-9", "9-10", "10-11"}
        assert not {f.name for f in (tmp_path / name / "rows").iterdir()} & {"0-1", "1-2", "2-3", "0-3", "3-6", "8-9"}
        assert len(list((tmp_path / name / "commits").iterdir())) <= 3


def test_a_commit_decides_what_is_read(spark, tmp_path):
    path, same = str(tmp_path / "t"), lambda rows: rows
    levels.commit(spark, path, 0)
    schema = spark.range(1).schema
    assert levels.read_table(spark, path, schema).collect() == []
    levels.add_batch(spark.range(5), 0, path, same)
    # A batch that was lost before its commit left a folder behind.
    spark.range(100).write.parquet(f"{path}/rows/1-2")
    assert levels.read_table(spark, path, schema).count() == 5
    levels.add_batch(spark.range(7), 1, path, same)
    assert levels.read_table(spark, path, schema).count() == 12
