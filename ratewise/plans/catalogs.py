"""Queries on building and syncing the price catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.operators import catalog as cat, pricing
from ratewise.plans import fixtures as fx
from ratewise.plans.costs import ENTRIES
from ratewise.plans.oracle import PRICES, with_views
from ratewise.plans.registry import query
from ratewise.plans.scores import rd, rounded

PRICED = """
priced AS (SELECT provider, model FROM entries WHERE kind = 'priced')"""

# Configured models: types and names of all parts, some of which the catalogue lacks; metadata for a part of them.
CONFIG = """
config AS (SELECT DISTINCT lower(p_brand) AS provider, unnest([lower(p_type), p_name, 'fresh-' || p_size]) AS model FROM part),
metadata AS (SELECT lower(p_brand) AS provider, 'fresh-' || p_size AS model, min(p_retailprice) / 1000000000 AS i, CASE WHEN min(p_size) % 2 = 0 THEN max(p_retailprice) / 1000000000 END AS o
  FROM part WHERE p_size % 3 = 0 GROUP BY ALL
  UNION ALL SELECT provider, 'promo', 0.000002, 0.000004 FROM promo),
meta_prices AS (SELECT provider, model, 'standard' AS tier, i * 1000000 AS input_rate, CAST(NULL AS DOUBLE) AS cached_rate, o * 1000000 AS output_rate FROM metadata)"""


def config(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    names = F.array(F.lower("p_type"), F.col("p_name"), F.concat(F.lit("fresh-"), F.col("p_size").cast("string")))
    return p.select(F.lower("p_brand").alias("provider"), F.explode(names).alias("model")).distinct()


def metadata(spark, sf_dir, some="p_size % 3 = 0"):
    """Metadata of the models; by default some configured models have none."""
    p = fx.table(spark, sf_dir, "part")
    brand = F.lower("p_brand").alias("provider")
    none = F.lit(None).cast("double")
    fresh = p.filter(some).groupBy(brand, F.col("p_size")).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).select(
        "provider", F.concat(F.lit("fresh-"), F.col("p_size").cast("string")).alias("model"), (F.col("lo") / 1e9).alias("input_cost"), none.alias("cached_cost"),
        F.when(F.col("p_size") % 2 == 0, F.col("hi") / 1e9).alias("output_cost"),
    )
    promo = p.filter("p_type = 'PROMO'").select(brand).distinct().select(
        "provider", F.lit("promo").alias("model"), F.lit(0.000002).alias("input_cost"), none.alias("cached_cost"), F.lit(0.000004).alias("output_cost")
    )
    return fresh.unionByName(promo)


@query(
    "metadata_prices", "D18",
    with_views(PRICES, CONFIG.replace("WHERE p_size % 3 = 0 ", ""), select=f"""
SELECT provider, model, tier, {rd('input_rate')} AS input_rate, cached_rate, {rd('output_rate')} AS output_rate FROM meta_prices"""),
)
def metadata_prices(spark, sf_dir):
    return rounded(cat.metadata_prices(metadata(spark, sf_dir, "true")))


@query(
    "models_without_entry", "J22",
    with_views(PRICES, CONFIG, select="SELECT DISTINCT provider, model, true AS needs_manual FROM config ANTI JOIN prices USING (provider, model)"),
)
def models_without_entry(spark, sf_dir):
    return cat.missing_models(config(spark, sf_dir), fx.prices(spark, sf_dir)).select("provider", "model", "needs_manual")


SLUGS = """
all_keys AS (SELECT DISTINCT provider, model FROM {src}),
slugged AS (SELECT provider, model, CASE WHEN s = '' THEN 'model' ELSE s END AS slug FROM (SELECT *, regexp_replace(lower(model), '[^0-9a-z]+', '', 'g') AS s FROM all_keys)),
slugs AS (SELECT provider, slug AS model, min(model) AS pricing_ref FROM slugged WHERE slug <> model AND (provider, slug) NOT IN (SELECT (provider, model) FROM all_keys) GROUP BY ALL)"""


@query("slug_aliases", "J28 P18", with_views(PRICES, SLUGS.format(src="prices"), select="SELECT * FROM slugs"))
def slug_aliases(spark, sf_dir):
    return cat.slug_aliases(fx.prices(spark, sf_dir)).select("provider", "model", "pricing_ref")


@query(
    "synced_catalogue", "U6 U4 D18 J22 J28",
    with_views(PRICES, ENTRIES, PRICED, CONFIG, """
fresh AS (SELECT * FROM meta_prices SEMI JOIN config USING (provider, model) ANTI JOIN priced USING (provider, model)),
kept AS (SELECT * FROM prices ANTI JOIN fresh USING (provider, model)),
synced AS (SELECT provider, model, tier, input_rate, cached_rate, output_rate, pricing_ref, reason, needs_manual FROM kept
  UNION ALL SELECT provider, model, tier, input_rate, cached_rate, output_rate, NULL, NULL, false FROM fresh),
added AS (SELECT DISTINCT provider, model FROM config ANTI JOIN synced USING (provider, model)),
whole AS (FROM synced UNION ALL SELECT provider, model, 'standard', NULL, NULL, NULL, NULL, 'Added by --update-models; fill in pricing manually.', true FROM added)""",
        SLUGS.format(src="whole"), select=f"""
SELECT provider, model, tier, {rd('input_rate')} AS input_rate, {rd('output_rate')} AS output_rate, pricing_ref, reason, needs_manual FROM whole
UNION ALL SELECT provider, model, NULL, NULL, NULL, pricing_ref, NULL, false FROM slugs"""),
)
def synced_catalogue(spark, sf_dir):
    out = cat.sync_catalog(fx.prices(spark, sf_dir), config(spark, sf_dir), metadata(spark, sf_dir))
    return rounded(out.select("provider", "model", "tier", "input_rate", "output_rate", "pricing_ref", "reason", "needs_manual"))


# Entries of three sources per model with gaps; the first source with a value decides.
MERGE_ROWS = """
ranked AS (SELECT lower(p_brand) AS provider, p_name AS model, CASE WHEN p_size % 5 = 0 THEN 'long' ELSE 'base' END AS context, CASE WHEN p_size % 2 = 0 THEN 'standard' ELSE 'flex' END AS tier,
  p_partkey AS rank, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS input_rate, CASE WHEN p_partkey % 4 <> 1 THEN p_retailprice / 10 END AS cached_rate,
  CASE WHEN p_partkey % 7 <> 2 THEN p_retailprice * 4 END AS output_rate, 'page ' || (p_partkey % 4) AS label, p_type AS note FROM part)"""


def ranked_rows(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    return p.select(
        F.lower("p_brand").alias("provider"), F.col("p_name").alias("model"), F.when(F.col("p_size") % 5 == 0, "long").otherwise("base").alias("context"),
        F.when(F.col("p_size") % 2 == 0, "standard").otherwise("flex").alias("tier"), k.alias("rank"),
        F.when(k % 3 != 0, price).alias("input_rate"), F.when(k % 4 != 1, price / 10).alias("cached_rate"), F.when(k % 7 != 2, price * 4).alias("output_rate"),
        F.array(F.struct(F.concat(F.lit("page "), (k % 4).cast("string")).alias("label"), F.lit("u").alias("url")), F.struct(F.lit(" ").alias("label"), F.lit("u").alias("url"))).alias("sources"),
        F.array("p_type").alias("notes"),
    )


@query(
    "merged_price_tiers", "U5",
    with_views(MERGE_ROWS, select=f"""
, kept AS (SELECT * FROM ranked WHERE context = 'base' OR (provider, model, rank) IN (SELECT (provider, model, min(rank)) FROM ranked WHERE context = 'long' GROUP BY provider, model))
SELECT provider, model, context, tier, {rd('arg_min(input_rate, rank) FILTER (WHERE input_rate IS NOT NULL)')} AS input_rate,
  {rd('arg_min(cached_rate, rank) FILTER (WHERE cached_rate IS NOT NULL)')} AS cached_rate, {rd('arg_min(output_rate, rank) FILTER (WHERE output_rate IS NOT NULL)')} AS output_rate FROM kept GROUP BY ALL"""),
)
def merged_price_tiers(spark, sf_dir):
    return rounded(cat.merge_tiers(ranked_rows(spark, sf_dir)))


@query(
    "merged_price_sources", "U5",
    with_views(MERGE_ROWS, select="""
, firsts AS (SELECT provider, model, label, min(rank) AS r FROM ranked GROUP BY ALL)
SELECT provider, model, string_agg(label, ',' ORDER BY r) AS sources, (SELECT string_agg(DISTINCT note, ',' ORDER BY note) FROM ranked x WHERE x.provider = f.provider AND x.model = f.model) AS notes
FROM firsts f GROUP BY provider, model"""),
)
def merged_price_sources(spark, sf_dir):
    m = cat.merge_facts(ranked_rows(spark, sf_dir))
    return m.select("provider", "model", F.array_join(F.transform("sources", lambda s: s["label"]), ",").alias("sources"), F.array_join("notes", ",").alias("notes"))


@query(
    "derived_flex_tiers", "J25",
    with_views(PRICES, ENTRIES, PRICED, select=f"""
SELECT provider, model, 'flex' AS tier, {rd('input_rate * 0.5')} AS input_rate, {rd('cached_rate * 0.5')} AS cached_rate, {rd('output_rate * 0.5')} AS output_rate
FROM prices SEMI JOIN priced USING (provider, model) WHERE tier = 'standard' AND (provider, model) NOT IN (SELECT (provider, model) FROM prices WHERE tier = 'flex' AND model NOT IN ('medium', 'large'))"""),
)
def derived_flex_tiers(spark, sf_dir):
    lacking = fx.prices(spark, sf_dir).filter("tier is null or tier <> 'flex' or model not in ('medium', 'large')")
    return rounded(cat.derived_flex(lacking))


# A reseller that routes to the brands: its entries are aliases of nothing and have no rates.
ROUTES = [("b1/", "e", [("brand#1", ""), ("brand#2", "")]), ("b2/", "m", [("brand#nowhere", ""), ("brand#2", "")]), ("b3/", "", [("brand#3", "")])]
RESELLER = """
tails AS (SELECT DISTINCT model AS tail FROM prices UNION SELECT 'missing'),
routed AS (SELECT 'b' || b || '/' || tail AS model, b, tail FROM tails CROSS JOIN range(1, 5) t(b)),
fits AS (SELECT r.model, s.up, s.pos, tail FROM routed r JOIN (VALUES (1, 'e', 'brand#1', 0), (1, 'e', 'brand#2', 1), (2, 'm', 'brand#2', 1), (3, '', 'brand#3', 0)) s(b, family, up, pos)
  ON r.b = s.b AND starts_with(tail, family)),
hits AS (SELECT f.model, f.up, r.resolved FROM fits f JOIN resolved r ON r.provider = f.up AND r.model = f.tail AND r.kind = 'priced' QUALIFY row_number() OVER (PARTITION BY f.model ORDER BY f.pos) = 1)"""


def reseller_catalog(spark, sf_dir):
    base = fx.prices(spark, sf_dir)
    extra = fx.table(spark, sf_dir, "region").limit(1).select(F.lit("missing").alias("tail"))
    tails = base.select(F.col("model").alias("tail")).union(extra).distinct()
    none, rate = F.lit(None).cast("string"), F.lit(None).cast("double")
    routed = tails.select(F.explode(F.array(*[F.concat(F.lit(f"b{b}/"), "tail") for b in range(1, 5)])).alias("model"))
    rows = routed.select(
        F.lit("seller").alias("provider"), "model", none.alias("tier"), rate.alias("input_rate"), rate.alias("cached_rate"), rate.alias("output_rate"),
        none.alias("pricing_ref"), none.alias("reason"), F.lit(False).alias("needs_manual"),
    )
    return base.unionByName(rows)


@query(
    "inherited_rates", "J23",
    with_views(PRICES, ENTRIES, RESELLER, select="""
SELECT 'seller' AS provider, h.model, p.tier, p.input_rate, p.cached_rate, p.output_rate, h.up AS inherited_from FROM hits h JOIN prices p ON p.provider = h.up AND p.model = h.resolved AND p.tier IS NOT NULL"""),
)
def inherited_rates(spark, sf_dir):
    full = reseller_catalog(spark, sf_dir)
    resolved = pricing.resolve_aliases(pricing.classify_entries(full), None)
    return cat.inherited_rates(full, resolved, "seller", ROUTES)


@query(
    "copied_flex_tiers", "J24",
    with_views(PRICES, ENTRIES, select="""
, targets AS (SELECT DISTINCT provider AS up, model AS key FROM prices WHERE tier = 'standard')
SELECT 'seller' AS provider, up || '/' || key AS model, 'flex' AS tier, p.input_rate * f AS input_rate, p.cached_rate * f AS cached_rate, p.output_rate * f AS output_rate, context,
  up AS inherited_from, key AS inherited_model, 'own,' || up AS sources, 'flex from upstream' AS notes
FROM targets t JOIN prices p ON p.provider = t.up AND p.model = t.key AND p.tier = 'flex', (VALUES ('base', 1), ('long', 2)) c(context, f)"""),
)
def copied_flex_tiers(spark, sf_dir):
    base = fx.prices(spark, sf_dir)
    mine = base.filter("tier = 'standard'").withColumn("model", F.concat_ws("/", "provider", "model")).withColumn("provider", F.lit("seller"))
    full = base.unionByName(mine).withColumn("context", F.lit("base"))
    # Beyond a threshold the brands charge twice as much; the seller says nothing of that.
    twice = [(F.col(r) * 2).alias(r) for r in cat.RATES]
    long = base.filter("tier is not null").select(*[c for c in base.columns if c not in cat.RATES], *twice, F.lit("long").alias("context"))
    resolved = pricing.resolve_aliases(pricing.classify_entries(full))
    copied = cat.copied_tiers(full.unionByName(long), resolved, "flex", [("seller", f"brand#{i}/", f"brand#{i}", "") for i in range(1, 26)])
    label = F.when(F.col("provider") == "seller", "own").otherwise(F.col("provider"))
    facts = full.select("provider", "model").distinct().select("provider", "model", F.array(F.struct(label.alias("label"), F.lit("u").alias("url"))).alias("sources"), F.array().cast("array<string>").alias("notes"))
    said = cat.copied_facts(facts, copied, "flex from upstream")
    named = said.select("provider", "model", F.array_join(F.transform("sources", lambda s: s["label"]), ",").alias("sources"), F.array_join("notes", ",").alias("notes"))
    return copied.join(named, ["provider", "model"])


@query(
    "equivalent_entries", "J27",
    with_views(PRICES, ENTRIES, PRICED, """
keyed AS (SELECT provider, 'x-' || model AS candidate, model AS target FROM priced),
copies AS (SELECT provider, 'x-' || model AS model, tier, input_rate, cached_rate, CASE WHEN output_rate > 3.9 THEN output_rate + 1 ELSE output_rate END AS output_rate FROM prices SEMI JOIN priced USING (provider, model) WHERE tier IS NOT NULL)""",
        select="""
SELECT k.provider, k.candidate, k.target FROM keyed k JOIN copies c ON c.provider = k.provider AND c.model = k.candidate
LEFT JOIN prices p ON p.provider = k.provider AND p.model = k.target AND p.tier = c.tier
GROUP BY ALL HAVING bool_and(p.tier IS NOT NULL AND c.input_rate IS NOT DISTINCT FROM p.input_rate AND c.cached_rate IS NOT DISTINCT FROM p.cached_rate AND c.output_rate IS NOT DISTINCT FROM p.output_rate)"""),
)
def equivalent_entries(spark, sf_dir):
    base = fx.prices(spark, sf_dir)
    priced = cat.priced_models(base)
    copies = base.join(priced, ["provider", "model"], "left_semi").filter("tier is not null").withColumn("model", F.concat(F.lit("x-"), "model")).withColumn(
        "output_rate", F.when(F.col("output_rate") > 3.9, F.col("output_rate") + 1).otherwise(F.col("output_rate"))
    )
    pairs = priced.select("provider", F.concat(F.lit("x-"), "model").alias("candidate"), F.col("model").alias("target"))
    return cat.equivalent_entries(pairs, base.unionByName(copies))


@query(
    "built_catalogue", "D17 D19 P47",
    with_views(PRICES, ENTRIES, PRICED, CONFIG, """
wanted AS (SELECT DISTINCT provider, model FROM config),
alias_of AS (SELECT provider, model, min(target) AS target FROM (SELECT DISTINCT provider, model, target FROM (SELECT provider, model, target FROM named WHERE (provider, target) IN (SELECT (provider, model) FROM prices))) GROUP BY ALL)""",
        select=f"""
SELECT w.provider, w.model, CASE WHEN a.model IS NOT NULL THEN NULL ELSE coalesce(p.tier, m.tier) END AS tier,
  CASE WHEN a.model IS NOT NULL THEN NULL WHEN p.tier IS NOT NULL THEN p.input_rate ELSE {rd('m.input_rate')} END AS input_rate, a.target AS pricing_ref,
  CASE WHEN a.model IS NULL AND p.tier IS NULL AND m.tier IS NULL THEN 'No compatible official per-token pricing was found for this model.' END AS reason
FROM wanted w LEFT JOIN alias_of a USING (provider, model) LEFT JOIN (SELECT * FROM prices WHERE tier IS NOT NULL) p ON p.provider = w.provider AND p.model = w.model
LEFT JOIN meta_prices m ON m.provider = w.provider AND m.model = w.model"""),
)
def built_catalogue(spark, sf_dir):
    base = fx.prices(spark, sf_dir)
    aliases = base.filter("pricing_ref is not null and size(split(model, ' ')) = 2").select("provider", "model", F.col("pricing_ref").alias("target"))
    built = cat.build_catalog(config(spark, sf_dir), base, metadata(spark, sf_dir), aliases)
    rate = F.when(F.startswith("model", F.lit("fresh-")) | (F.col("model") == "promo"), F.round(F.col("input_rate") + 1e-9, 6)).otherwise(F.col("input_rate"))
    return built.select("provider", "model", "tier", rate.alias("input_rate"), "pricing_ref", "reason")


@query(
    "page_source_entries", "D19 U4",
    with_views(MERGE_ROWS, """
kept AS (SELECT * FROM ranked WHERE context = 'base' OR (provider, model, rank) IN (SELECT (provider, model, min(rank)) FROM ranked WHERE context = 'long' GROUP BY provider, model)),
firsts AS (SELECT provider, model, context, tier, arg_min(input_rate, rank) FILTER (WHERE input_rate IS NOT NULL) AS input_rate FROM kept GROUP BY ALL)""",
        select=f"""
SELECT provider, model, context, tier, {rd('input_rate')} AS input_rate, CAST(NULL AS VARCHAR) AS pricing_ref, CAST(NULL AS VARCHAR) AS reason FROM firsts WHERE model NOT IN ('red ring', 'blue gear')
UNION ALL SELECT DISTINCT provider, 'red ring', NULL, 'standard', 1.0, NULL, NULL FROM ranked
UNION ALL SELECT DISTINCT provider, 'ring', NULL, NULL, NULL, 'red ring', NULL FROM ranked
UNION ALL SELECT DISTINCT provider, 'blue gear', NULL, NULL, NULL, NULL, 'no token price' FROM ranked"""),
)
def page_source_entries(spark, sf_dir):
    ranked = ranked_rows(spark, sf_dir)
    brands = ranked.select("provider").distinct()
    none, rate = F.lit(None).cast("string"), F.lit(None).cast("double")
    over = brands.select(
        "provider", F.lit("red ring").alias("model"), F.lit("standard").alias("tier"), F.lit(1.0).alias("input_rate"), rate.alias("cached_rate"), F.lit(2.0).alias("output_rate"),
        none.alias("pricing_ref"), none.alias("reason"), F.lit(False).alias("needs_manual"),
    )
    aliases = brands.select("provider", F.lit("ring").alias("model"), F.lit("red ring").alias("target")).unionByName(
        brands.select("provider", F.lit("lost").alias("model"), F.lit("nothing").alias("target"))
    )
    closed = brands.select(
        "provider", F.lit("blue gear").alias("model"), none.alias("tier"), rate.alias("input_rate"), rate.alias("cached_rate"), rate.alias("output_rate"),
        none.alias("pricing_ref"), F.lit("no token price").alias("reason"), F.lit(False).alias("needs_manual"),
    )
    out = cat.page_entries(ranked, over, aliases, closed)
    return rounded(out.select("provider", "model", "context", "tier", "input_rate", "pricing_ref", "reason"))
