"""Declared schemas of the JSON files read."""

METRICS = """
task_name string, task_description string, provider string, model string, model_requested string,
accuracy double, cohen_kappa double, macro_precision double, macro_recall double, macro_f1 double,
labels array<string>, confusion_matrix map<string, map<string, double>>, confusion_matrix_sparse array<array<double>>,
calibration_metrics struct<available: boolean, ece: double, mce: double, brier_score: double, sample_count: double>,
total_examples double, evaluated_example_count double, prediction_count double, truth_label_count double,
token_usage_totals struct<attempts_total: double, attempts_with_token_usage: double, attempts_with_output_tokens: double, input_tokens_total: double,
  cached_input_tokens_total: double, non_cached_input_tokens_total: double, output_tokens_total: double, thinking_tokens_total: double>,
usage_metadata_summary struct<attempts_total: double, attempts_with_usage_metadata: double, cached_tokens_total_estimate: double, cache_read_tokens_total: double>,
request_control_summary struct<attempts_total: double, configured: struct<thinking_level: string, reasoning_effort: string, effort: string>>,
model_details struct<provider: string, model_requested: string, model_for_requests: string>,
run_config struct<task_name: string, task_description: string, service_tier: string, temperature: double, provider: string, model: string>,
first_prompt_timestamp string, last_prompt_timestamp string, overall_time_seconds double, source_output_csv string,
label_metrics_available boolean, label_metrics_reason string
"""

LOG_RECORD = """
record_type string, run_config struct<service_tier: string, temperature: double, provider: string, model: string>,
model_details struct<provider: string, model_requested: string, model_for_requests: string>,
attempts array<struct<status: string, duration_seconds: double, error_category: string, response: struct<usage_metadata: map<string, string>>>>,
final_prediction struct<validator_status: string>
"""

AGREEMENT_GROUP = """
group_id string, representative_policy string, task_name_display string, task_names_seen array<string>, tags_display string, provider string, model string,
run_count double, model_count double, alpha_nominal double, pairable_item_count double, rated_item_count double, fully_shared_item_count double,
category_count double, run_stems array<string>, representative_run_stems array<string>,
representatives array<struct<run_stem: string, provider: string, model: string, timestamp: string>>,
pairwise array<struct<a: double, b: double, distance: double, overlap_count: double, agreement_count: double, disagreement_count: double>>,
linkage array<array<double>>
"""

PRICE_ENTRY = """struct<service_tiers: map<string, struct<input_usd_per_mtokens: double, cached_input_usd_per_mtokens: double, output_usd_per_mtokens: double>>,
pricing_ref: string, alias_kind: string, reason: string, needs_manual_update: boolean,
long_context: struct<threshold_input_tokens: double, service_tiers: map<string, struct<input_usd_per_mtokens: double, cached_input_usd_per_mtokens: double, output_usd_per_mtokens: double>>>,
sources: array<struct<label: string, url: string>>, notes: array<string>>"""
PRICE_CATALOG = f"updated_at string, providers map<string, struct<models: map<string, {PRICE_ENTRY}>>>"
