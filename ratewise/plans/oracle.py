"""The views of ``fixtures.py`` as SQL common table expressions, and a helper to put them before a query."""

from __future__ import annotations

RUNS = """
runs AS (
  SELECT s_suppkey AS run_id,
         r_name || '__lab' || (s_suppkey % 2) || '__m' || (s_suppkey % 2) || '__' || stamp AS run_stem,
         r_name AS task, 'lab' || (s_suppkey % 2) AS provider, 'm' || (s_suppkey % 2) AS model,
         CAST((s_suppkey % 3) * 0.5 AS DOUBLE) AS temperature, stamp,
         strptime(stamp, '%Y-%m-%d-%H-%M') AS started,
         n_name || '; ' || CASE s_suppkey % 3 WHEN 0 THEN 'open source' WHEN 1 THEN ' gold ' ELSE '' END AS tags_text
  FROM (SELECT *, '2026-05-' || lpad(CAST(s_suppkey % 10 + 10 AS VARCHAR), 2, '0') || '-'
               || lpad(CAST(s_suppkey % 24 AS VARCHAR), 2, '0') || '-'
               || lpad(CAST(s_suppkey % 60 AS VARCHAR), 2, '0') AS stamp FROM supplier)
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

PREDICTIONS = """
predictions AS (
  SELECT l_suppkey AS run_id, l_partkey AS id, l_returnflag AS prediction, 0.5 + l_discount * 5 AS confidence,
         CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS truth
  FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey
          ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_returnflag DESC, l_discount DESC) = 1)
  JOIN part ON l_partkey = p_partkey
)"""

# Scores per run by plain counting, without the confusion matrix.
SCORES = """
truths AS (SELECT run_id, truth AS label, count(*) AS actual FROM predictions GROUP BY ALL),
guesses AS (SELECT run_id, prediction AS label, count(*) AS predicted FROM predictions GROUP BY ALL),
hits AS (SELECT run_id, truth AS label, count(*) AS hits FROM predictions WHERE truth = prediction GROUP BY ALL),
label_scores AS (
  SELECT run_id, label, coalesce(hits, 0) AS hits, coalesce(actual, 0) AS actual, coalesce(predicted, 0) AS predicted,
         CASE WHEN coalesce(predicted, 0) = 0 THEN 0.0 ELSE coalesce(hits, 0) / predicted END AS p,
         CASE WHEN coalesce(actual, 0) = 0 THEN 0.0 ELSE coalesce(hits, 0) / actual END AS r
  FROM truths FULL JOIN guesses USING (run_id, label) LEFT JOIN hits USING (run_id, label)
),
scores AS (
  SELECT run_id, CAST(sum(actual) AS BIGINT) AS evaluated, CAST(sum(hits) AS BIGINT) AS correct,
         sum(hits) / sum(actual) AS accuracy, avg(p) AS macro_precision, avg(r) AS macro_recall,
         avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END) AS macro_f1,
         CASE WHEN abs(1 - sum(actual * predicted) / (sum(actual) * sum(actual))) <= 1e-12
              THEN CASE WHEN sum(hits) = sum(actual) THEN 1.0 ELSE 0.0 END
              ELSE (sum(hits) / sum(actual) - sum(actual * predicted) / (sum(actual) * sum(actual)))
                   / (1 - sum(actual * predicted) / (sum(actual) * sum(actual))) END AS cohen_kappa,
         count(*) AS labels
  FROM label_scores GROUP BY run_id
)"""

TOKENS = """
tokens AS (
  SELECT l_suppkey AS run_id,
         CASE WHEN l_linenumber <> 7 THEN l_partkey END AS prompt_tokens,
         CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS completion_tokens,
         CASE WHEN l_linenumber < 6 THEN l_partkey + l_suppkey - l_linenumber END AS total_tokens
  FROM lineitem
)"""

ATTEMPTS = """
attempts AS (
  SELECT user_id AS run_id, event_id // 3 AS example_id, event_id AS attempt_id,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'other' ELSE 'success' END AS status,
         CASE WHEN event_type = 'error' AND value > 100 THEN 'request_timeout' WHEN event_type = 'error' THEN 'server_error' END AS error_category,
         CASE WHEN event_id % 11 <> 0 THEN value END AS duration_seconds,
         CASE WHEN event_id % 13 = 0 THEN 'accepted_after_request_timeout' END AS validator_status,
         ts, date_trunc('day', ts) AS invocation, CAST(json_extract_string(props, '$.k') AS BIGINT) AS cached_tokens
  FROM events
)"""

LEXICON = """
lexicon AS (
  SELECT DISTINCT word AS norm, substr(word, 1, 1) AS pos FROM (
    SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM benchmark
    UNION ALL SELECT unnest(regexp_extract_all(lower(p_name), '\\p{L}+')) FROM part)
)"""

REQUESTS = """
requests AS (
  SELECT doc_id || '-' || pos AS request_id, word AS label, pos % 4 + 1 AS attempt,
         CASE WHEN pos % 3 = 0 THEN 'POS=' || substr(word, 1, 1) ELSE '' END AS info
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents))
)"""

PRICES = """
named AS (
  SELECT lower(p_brand) AS provider, p_name AS model, lower(arg_max(p_type, p_partkey)) AS target FROM part GROUP BY ALL
),
promo AS (
  SELECT DISTINCT lower(p_brand) AS provider, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 2 = 1 AS odd
  FROM part WHERE p_type = 'PROMO'
),
prices AS (
  SELECT lower(p_brand) AS provider, lower(p_type) AS model, CASE WHEN p_size % 2 = 0 THEN 'standard' ELSE 'flex' END AS tier,
         round(avg(p_retailprice) / 1000 + 1e-9, 4) AS input_rate,
         CASE WHEN lower(p_type) <> 'small' THEN round(min(p_retailprice) / 10000 + 1e-9, 4) END AS cached_rate,
         round(max(p_retailprice) / 250 + 1e-9, 4) AS output_rate,
         CAST(NULL AS VARCHAR) AS pricing_ref, CAST(NULL AS VARCHAR) AS reason, false AS needs_manual
  FROM part WHERE p_type <> 'PROMO' GROUP BY 1, 2, 3, lower(p_type)
  UNION ALL SELECT provider, model, NULL, NULL, NULL, NULL, target, NULL, false FROM named
  UNION ALL SELECT provider, 'new ' || model, NULL, NULL, NULL, NULL, model, NULL, false FROM named
  UNION ALL SELECT provider, 'promo', NULL, NULL, NULL, NULL, NULL,
                   CASE WHEN odd THEN 'no official price' ELSE 'added, price to be filled in' END, NOT odd FROM promo
)"""

USAGE = """
usage AS (
  SELECT l_partkey AS run_id,
         CASE l_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'elsewhere' ELSE p_brand END AS provider,
         CASE l_partkey % 5 WHEN 0 THEN 'models/' || p_name WHEN 1 THEN 'x/y/' || lower(p_type)
              WHEN 2 THEN 'new ' || p_name WHEN 3 THEN p_type ELSE ' unknown model ' END AS requested,
         CASE l_partkey % 3 WHEN 0 THEN 'FLEX' WHEN 1 THEN 'odd' ELSE 'batch' END AS service_tier,
         lower(p_type) AS file_slug, input_tokens, cached_tokens, output_tokens,
         CASE WHEN l_partkey % 4 = 0 THEN input_tokens - 1 END AS non_cached_tokens
  FROM (SELECT l_partkey, sum(l_quantity) AS input_tokens, sum(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS cached_tokens,
               CAST(sum(l_linenumber) AS DOUBLE) AS output_tokens FROM lineitem GROUP BY 1)
  JOIN part ON l_partkey = p_partkey
)"""


def with_views(*views: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(v.strip() for v in views) + "\n" + select.strip()
