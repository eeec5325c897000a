"""Queries on prices and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.operators import pricing
from ratewise.plans import fixtures as fx
from ratewise.plans.oracle import PRICES, RUNS, USAGE, with_views
from ratewise.plans.registry import query
from ratewise.plans.scores import rd, rounded

ENTRIES = """
entries AS (SELECT provider, model, max(pricing_ref) AS pricing_ref, max(reason) AS reason,
  CASE WHEN max(pricing_ref) IS NOT NULL THEN 'alias' WHEN bool_or(coalesce(input_rate, cached_rate, output_rate) IS NOT NULL) THEN 'priced'
       WHEN bool_or(needs_manual) THEN 'unpriced' WHEN max(reason) IS NOT NULL THEN 'unsupported' ELSE 'unpriced' END AS kind
  FROM prices GROUP BY ALL),
chain AS (SELECT provider, model, coalesce(pricing_ref, model) AS node, CASE WHEN pricing_ref IS NULL THEN 0 ELSE 1 END AS hops FROM entries
  UNION ALL SELECT c.provider, c.model, e.pricing_ref, hops + 1 FROM chain c JOIN entries e ON c.provider = e.provider AND c.node = e.model
  WHERE e.pricing_ref IS NOT NULL AND hops BETWEEN 1 AND 10),
resolved AS (SELECT c.provider, c.model, c.node AS resolved, e.kind, max(hops) AS hops FROM chain c JOIN entries e ON c.provider = e.provider AND c.node = e.model
  WHERE e.kind <> 'alias' GROUP BY ALL)"""


@query("catalogue_entry_kinds", "D12 S12", with_views(PRICES, ENTRIES, select="SELECT provider, model, kind FROM entries"))
def catalogue_entry_kinds(spark, sf_dir):
    return pricing.classify_entries(fx.prices(spark, sf_dir)).select("provider", "model", "kind")


@query(
    "resolved_aliases", "J16",
    with_views(PRICES, ENTRIES, select="SELECT provider, model, resolved, kind, hops FROM resolved"),
)
def resolved_aliases(spark, sf_dir):
    out = pricing.resolve_aliases(pricing.classify_entries(fx.prices(spark, sf_dir)))
    return out.select("provider", "model", "resolved", "kind", F.col("hops").cast("int").alias("hops"))


@query(
    "resolved_aliases_unbounded", "J16",
    with_views(PRICES, ENTRIES, select="SELECT provider, model, resolved, kind FROM resolved"),
)
def resolved_aliases_unbounded(spark, sf_dir):
    return pricing.resolve_aliases(pricing.classify_entries(fx.prices(spark, sf_dir)), None).select("provider", "model", "resolved", "kind")


# Names tried per run, own provider first, then the only provider that lists one of them.
MATCHES = """
spelled AS (SELECT *, trim(requested) AS t, lower(trim(provider)) AS pkey FROM usage),
strong AS (SELECT run_id, pkey, unnest(c) AS cand, unnest(range(len(c))) AS pos FROM (
  SELECT run_id, pkey, [t, CASE WHEN starts_with(t, 'models/') THEN substr(t, 8) END, CASE WHEN contains(t, '/') THEN split_part(t, '/', -1) END,
    regexp_replace(lower(t), '[^0-9a-z]+', '', 'g')] AS c FROM spelled)),
weak AS (SELECT run_id, pkey, file_slug AS cand, 0 AS pos FROM spelled),
own AS (SELECT run_id, 1 AS stage, pos, r.* FROM strong s JOIN resolved r ON s.pkey = r.provider AND s.cand = r.model
  UNION ALL SELECT run_id, 3, pos, r.* FROM weak s JOIN resolved r ON s.pkey = r.provider AND s.cand = r.model),
foreign_hits AS (SELECT run_id, 2 AS stage, 0 AS pos, max(r.provider) AS provider, arg_max(s.cand, s.pos) AS model, max(r.resolved) AS resolved, max(r.kind) AS kind
  FROM strong s JOIN resolved r ON s.cand = r.model GROUP BY run_id HAVING count(DISTINCT r.provider || '::' || r.resolved) = 1),
matches AS (SELECT run_id, provider AS price_provider, model AS matched_key, resolved AS resolved_key, kind FROM
  (SELECT run_id, stage, pos, provider, model, resolved, kind FROM own UNION ALL SELECT run_id, stage, pos, provider, model, resolved, kind FROM foreign_hits)
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY stage, pos) = 1)"""

VIEWS = (PRICES, USAGE, ENTRIES, MATCHES)


@query(
    "price_matches", "J11 J13 J15 W13 P17 P18",
    with_views(*VIEWS, select="""
SELECT u.run_id, price_provider, matched_key, resolved_key, kind FROM usage u LEFT JOIN matches USING (run_id)"""),
)
def price_matches(spark, sf_dir):
    runs = fx.usage(spark, sf_dir)
    found = pricing.match_prices(runs, fx.prices(spark, sf_dir))
    return pricing.join_matches(runs, found).select("run_id", "price_provider", "matched_key", "resolved_key", "kind")


COSTS = """
tiered AS (SELECT u.*, price_provider, resolved_key, kind,
    CASE lower(service_tier) WHEN 'flex' THEN 'flex' WHEN 'batch' THEN 'batch' WHEN 'priority' THEN 'priority' ELSE 'standard' END AS pricing_tier,
    coalesce(cached_tokens, 0) AS t_cached, coalesce(non_cached_tokens, greatest(coalesce(input_tokens, 0) - coalesce(cached_tokens, 0), 0)) AS t_input, output_tokens AS t_output
  FROM usage u LEFT JOIN matches USING (run_id)),
rated AS (SELECT t.*, p.input_rate, p.cached_rate, p.output_rate, p.provider IS NOT NULL AS has_tier FROM tiered t
  LEFT JOIN prices p ON p.provider = price_provider AND p.model = resolved_key AND p.tier = pricing_tier),
missed AS (SELECT *, concat_ws(',', CASE WHEN t_input > 0 AND input_rate IS NULL THEN 'input' END, CASE WHEN t_cached > 0 AND cached_rate IS NULL THEN 'cached_input' END,
    CASE WHEN t_output > 0 AND output_rate IS NULL THEN 'output' END) AS missing FROM rated),
costs AS (SELECT *, CASE WHEN kind IS NULL THEN 'model_missing' WHEN kind IN ('unsupported', 'unpriced') THEN kind WHEN NOT has_tier THEN 'tier_unavailable'
    WHEN missing <> '' THEN 'rate_missing' ELSE 'priced' END AS pricing_status FROM missed)"""


def costs(spark, sf_dir):
    return pricing.estimate_costs(fx.usage(spark, sf_dir), fx.prices(spark, sf_dir))


@query(
    "run_costs", "D13 A39 P19",
    with_views(*VIEWS, COSTS, select=f"""
SELECT run_id, pricing_status, pricing_tier, CASE WHEN pricing_status = 'rate_missing' THEN missing ELSE '' END AS missing_buckets,
  {rd("CASE WHEN pricing_status = 'priced' THEN t_input * coalesce(input_rate, 0) / 1000000 END")} AS cost_input,
  {rd("CASE WHEN pricing_status = 'priced' THEN t_cached * coalesce(cached_rate, 0) / 1000000 END")} AS cost_cached,
  {rd("CASE WHEN pricing_status = 'priced' THEN t_output * coalesce(output_rate, 0) / 1000000 END")} AS cost_output,
  {rd("CASE WHEN pricing_status = 'priced' THEN (t_input * coalesce(input_rate, 0) + t_cached * coalesce(cached_rate, 0) + t_output * coalesce(output_rate, 0)) / 1000000 END")} AS estimated_cost_usd
FROM costs"""),
)
def run_costs(spark, sf_dir):
    return rounded(costs(spark, sf_dir).select(
        "run_id", "pricing_status", "pricing_tier", "missing_buckets", "cost_input", "cost_cached", "cost_output", "estimated_cost_usd"
    ))


@query(
    "legend_prices", "A42",
    with_views(*VIEWS, COSTS, select="""
SELECT requested AS model, count(*) AS runs, count(*) FILTER (WHERE pricing_status = 'priced') AS priced_runs,
  coalesce(string_agg(DISTINCT resolved_key, ', ' ORDER BY resolved_key), '') AS entries, string_agg(DISTINCT pricing_tier, ', ' ORDER BY pricing_tier) AS tiers,
  string_agg(DISTINCT pricing_status, ', ' ORDER BY pricing_status) AS statuses FROM costs GROUP BY requested"""),
)
def legend_prices(spark, sf_dir):
    return pricing.legend_prices(costs(spark, sf_dir).withColumn("model", F.col("requested")))


@query(
    "tier_fallback", "D20",
    with_views(*VIEWS, select=f"""
, wanted AS (SELECT DISTINCT provider, model, CAST(unnest(['flex', 'priority', 'standard']) AS VARCHAR) AS tier FROM entries WHERE kind = 'priced')
SELECT w.provider, w.model, w.tier, CASE WHEN a.provider IS NOT NULL THEN w.tier WHEN b.provider IS NOT NULL THEN 'standard' END AS tier_used,
  CASE WHEN a.provider IS NOT NULL THEN a.input_rate ELSE b.input_rate END AS input_rate, CASE WHEN a.provider IS NOT NULL THEN a.cached_rate ELSE b.cached_rate END AS cached_rate,
  CASE WHEN a.provider IS NOT NULL THEN a.output_rate ELSE b.output_rate END AS output_rate
FROM wanted w LEFT JOIN prices a ON a.provider = w.provider AND a.model = w.model AND a.tier = w.tier
LEFT JOIN prices b ON b.provider = w.provider AND b.model = w.model AND b.tier = 'standard'"""),
)
def tier_fallback(spark, sf_dir):
    catalog = fx.prices(spark, sf_dir)
    priced = pricing.classify_entries(catalog).filter("kind = 'priced'").select("provider", "model")
    wanted = priced.select("*", F.explode(F.array(F.lit("flex"), F.lit("priority"), F.lit("standard"))).alias("tier"))
    return pricing.tier_with_fallback(wanted, catalog)


# Outputs of the batch report: one per line item row group, most of them with metrics.
OUTPUTS = """
outputs AS (SELECT l_orderkey || '-' || l_partkey AS base_name, lower(p_brand) AS provider,
    CASE WHEN l_partkey % 7 = 0 THEN 'not listed' WHEN l_partkey % 2 = 0 THEN lower(p_type) ELSE 'new ' || p_name END AS model,
    CASE WHEN min(l_linenumber) > 3 THEN 'flex' ELSE 'standard' END AS service_tier, max(l_linenumber) % 2 = 1 AS has_metrics
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey, p_brand, p_type, p_name),
tier_counts AS (SELECT provider, model, service_tier, count(*) AS n, count(*) FILTER (WHERE has_metrics) AS m, min(base_name) AS seen FROM outputs GROUP BY ALL),
used AS (SELECT provider, model, CAST(sum(n) AS BIGINT) AS output_count, CAST(sum(m) AS BIGINT) AS metrics_count,
  string_agg(service_tier || ':' || n, '; ' ORDER BY n DESC, seen) AS observed_service_tiers, list(service_tier) AS tiers FROM tier_counts GROUP BY ALL)"""


def outputs(spark, sf_dir):
    li, p = fx.table(spark, sf_dir, "lineitem"), fx.table(spark, sf_dir, "part")
    key = F.col("l_partkey")
    model = F.when(key % 7 == 0, "not listed").when(key % 2 == 0, F.lower("p_type")).otherwise(F.concat(F.lit("new "), "p_name"))
    return (
        li.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
        .join(p, key == F.col("p_partkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_partkey").alias("base_name"), F.lower("p_brand").alias("provider"), model.alias("model"),
            F.when(F.col("lo") > 3, "flex").otherwise("standard").alias("service_tier"), (F.col("hi") % 2 == 1).alias("has_metrics"),
        )
    )


@query(
    "model_usage", "A20",
    with_views(OUTPUTS, select="SELECT provider, model, output_count, metrics_count, observed_service_tiers FROM used"),
)
def model_usage(spark, sf_dir):
    return pricing.model_usage(outputs(spark, sf_dir)).drop("tiers")


PRICE_ROWS = """
keyed AS (SELECT u.*, r.resolved, e.reason FROM used u LEFT JOIN resolved r USING (provider, model) LEFT JOIN entries e ON e.provider = r.provider AND e.model = r.resolved),
price_rows AS (SELECT k.provider, k.model, coalesce(resolved, '') AS pricing_key, coalesce(p.tier, '') AS service_tier_used_for_price, observed_service_tiers, output_count, metrics_count,
  p.input_rate, p.cached_rate, p.output_rate, p.provider IS NOT NULL AS priced,
  concat_ws(' | ', CASE WHEN resolved IS NULL THEN 'missing_pricing_entry' WHEN p.provider IS NULL THEN coalesce(k.reason, 'no_usable_price_values') END,
    CASE WHEN p.tier IS NOT NULL AND NOT list_contains(tiers, p.tier) THEN 'tier_not_observed_in_outputs' END, CASE WHEN p.tier IS NULL THEN 'missing_standard_or_flex_tier' END) AS notes
  FROM keyed k LEFT JOIN prices p ON p.provider = k.provider AND p.model = k.resolved AND p.tier IS NOT NULL)"""


def price_rows_of(spark, sf_dir):
    return pricing.price_rows(pricing.model_usage(outputs(spark, sf_dir)), fx.prices(spark, sf_dir))


@query(
    "price_rows", "D14 J12 S18 A20",
    with_views(PRICES, ENTRIES, OUTPUTS, PRICE_ROWS, select="SELECT * FROM price_rows"),
)
def price_rows(spark, sf_dir):
    return price_rows_of(spark, sf_dir)


@query(
    "price_coverage", "A34",
    with_views(PRICES, ENTRIES, OUTPUTS, PRICE_ROWS, select="""
SELECT count(*) AS price_rows, count(*) FILTER (WHERE priced) AS priced_rows, count(*) FILTER (WHERE NOT priced) AS unpriced_rows FROM price_rows"""),
)
def price_coverage(spark, sf_dir):
    return pricing.price_coverage(price_rows_of(spark, sf_dir))


@query(
    "price_plot_rows", "A30 O6",
    with_views(PRICES, ENTRIES, OUTPUTS, PRICE_ROWS, select=f"""
SELECT provider, model, service_tier_used_for_price, {rd('max(input_rate + output_rate) OVER (PARTITION BY provider, model)')} AS group_total FROM price_rows
WHERE priced AND input_rate IS NOT NULL AND output_rate IS NOT NULL"""),
)
def price_plot_rows(spark, sf_dir):
    out = pricing.price_plot_rows(price_rows_of(spark, sf_dir))
    return rounded(out.select("provider", "model", "service_tier_used_for_price", "group_total"))


@query(
    "artifact_configs", "P9 P17 P4",
    with_views(RUNS, select="""
SELECT run_stem AS base_name, CASE WHEN run_id % 4 = 3 THEN provider WHEN run_id % 3 = 0 THEN 'e-infra' ELSE 'google' END AS provider,
  CASE WHEN run_id % 4 = 3 THEN model WHEN run_id % 3 = 0 THEN 'models/gemini35flash' ELSE 'gemini-3.5-flash' END AS model,
  CASE WHEN run_id % 4 < 2 AND run_id % 5 = 1 THEN 'flex' ELSE 'standard' END AS service_tier, run_id % 4 < 2 AS has_metrics FROM runs"""),
)
def artifact_configs(spark, sf_dir):
    """Half of the outputs have metrics, a quarter only a log, a quarter only a name."""
    r = fx.runs(spark, sf_dir)
    key = F.col("run_id")
    none = F.lit(None).cast("string")
    facts = r.select(
        "run_id", F.col("run_stem").alias("base_name"), F.when(key % 3 == 0, "einfra").alias("config_provider"), none.alias("config_model"),
        F.when((key % 4 < 2) & (key % 5 == 1), "flex").alias("service_tier"), F.lit(" vertex ").alias("details_provider"), F.lit("").alias("model_requested"),
        F.lit("models/gemini35flash").alias("model_for_requests"),
    )
    return pricing.artifact_config(r.select(F.col("run_stem").alias("base_name")), facts.filter("run_id % 4 < 2"), facts.filter("run_id % 4 = 2"))


ROUTES = """
brands AS (SELECT *, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS w FROM part),
routes AS (SELECT DISTINCT CASE b % 6 WHEN 0 THEN 'policy' WHEN 1 THEN 'bedrock' WHEN 2 THEN 'vertex' WHEN 3 THEN 'openai-responses' WHEN 4 THEN 'azure' ELSE 'coding' END AS prefix,
    CASE b % 6 WHEN 0 THEN 100 WHEN 1 THEN 40 WHEN 2 THEN 30 WHEN 3 THEN 20 ELSE 0 END AS rank, replace(p_name, ' ', '-') AS name, CASE WHEN p_size % 3 = 0 THEN '@eu' WHEN p_size % 3 = 1 THEN '@us' ELSE '' END AS region
  FROM (SELECT *, CASE WHEN w % 6 >= p_partkey % 6 THEN w ELSE 5 END AS b FROM brands)),
tailed AS (SELECT prefix || '/' || name || region AS model, rank, CASE WHEN region <> '' THEN 1 ELSE 0 END AS regional, unnest(list_distinct([name || region, name])) AS tail FROM routes),
best AS (SELECT *, count(*) OVER (PARTITION BY tail, rank, regional) AS ties, rank() OVER (PARTITION BY tail ORDER BY rank, regional) AS r FROM tailed)"""


@query("route_choice", "J14", with_views(ROUTES, select="SELECT tail, model AS key FROM best WHERE r = 1 AND ties = 1"))
def route_choice(spark, sf_dir):
    """Part names as model tails that several routes of one reseller offer, some with a region."""
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int")
    p = fx.table(spark, sf_dir, "part").withColumn("b", F.when(brand % 6 >= F.col("p_partkey") % 6, brand).otherwise(5))
    names = F.array(*[F.lit(x) for x in ("policy", "bedrock", "vertex", "openai-responses", "azure", "coding")])
    region = F.when(F.col("p_size") % 3 == 0, "@eu").when(F.col("p_size") % 3 == 1, "@us").otherwise("")
    rows = p.select(F.lit("requesty").alias("provider"), F.concat(F.get(names, (F.col("b") % 6).cast("int")), F.lit("/"), F.translate("p_name", " ", "-"), region).alias("model")).distinct()
    listed = rows.select(
        "provider", "model", F.lit("standard").alias("tier"), F.lit(1.0).alias("input_rate"), F.lit(None).cast("double").alias("cached_rate"), F.lit(1.0).alias("output_rate"),
        F.lit(None).cast("string").alias("pricing_ref"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("needs_manual"),
    )
    resolved = pricing.resolve_aliases(pricing.classify_entries(listed))
    return pricing.route_candidates(resolved).select("tail", "key")
