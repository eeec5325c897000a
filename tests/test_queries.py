"""Registered queries against their SQL, and the entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from ratewise.plans import load_registry

SF = os.environ.get("RATEWISE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# All with RATEWISE_ALL=1; tools/check_oracle.py compares all of them at any scale.
QUICK = [
    "run_scores", "confusion_triplets", "kappa_from_stored_matrix", "calibration", "alpha_per_task_and_model", "run_pair_distances", "run_pair_kappas",
    "agreement_summary", "visible_cluster_pairs", "model_temperature_summary", "attempt_telemetry", "within_group_correlations", "bad_days",
    "outlier_report", "leaderboard_filtered", "balanced_model_means", "price_scatter_by_model", "token_profile", "line_price_quantiles", "price_matches",
    "run_costs", "price_rows", "lemma_decisions", "labels_within_one_edit", "artifact_issues", "repaired_totals", "resume_stop_test", "parsed_run_names",
    "prompts_in_context", "evenly_sampled_prompts", "page_texts", "tier_block_prices", "synced_catalogue", "inherited_rates", "delimited_predictions",
    "telemetry_from_log_lines", "flattened_runs", "live_run_counters", "live_sessions", "attempts_near_errors",
]
REGISTRY = load_registry()
NAMES = [n for n, q in REGISTRY.items() if q.sql] if os.environ.get("RATEWISE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    q = REGISTRY[name]
    df = q.plan(spark, SF)
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(q.sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    assert sorted(names) == sorted(df.columns)

    def table(rows, columns):
        order = [columns.index(c) for c in sorted(columns)]
        return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))

    assert table(got, df.columns) == table(want, names)


def test_every_query_names_its_survey_rows():
    assert all(q.covers.strip() for q in REGISTRY.values())


def test_entry_points(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
