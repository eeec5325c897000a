"""Queries on names, prompts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions import html, names, text
from ratewise.functions.nested import drop_key
from ratewise.functions.numbers import whole_number
from ratewise.operators import catalog as cat, prompts
from ratewise.plans import fixtures as fx
from ratewise.plans.oracle import RUNS, with_views
from ratewise.plans.registry import query
from ratewise.sources import delimited

# Run files in new, old and foreign styles, with and without a provider or an ending.
FILES_SQL = """
files AS (SELECT run_id, CASE run_id % 6
    WHEN 0 THEN run_stem || '__metrics.json'
    WHEN 1 THEN 'data\\metrics\\' || task || '__part__' || provider || '__' || model || '__' || stamp || '__extra__metrics.json'
    WHEN 2 THEN task || '_out_openai_' || model || '_x_' || stamp || '_metrics.json'
    WHEN 3 THEN './' || task || '_out_' || provider || '_' || model || '_' || stamp || '_metrics.json'
    WHEN 4 THEN '/abs/metrics/' || task || '____' || model || '__' || stamp || '__metrics.json'
    ELSE 'metrics/' || task || '.' || model || '__heatmap.png' END AS path, task, provider, model, stamp, run_stem FROM runs)"""


def files(spark, sf_dir):
    r = fx.runs(spark, sf_dir)
    case = F.col("run_id") % 6
    c = F.concat
    lit = F.lit
    path = (
        F.when(case == 0, c("run_stem", lit("__metrics.json")))
        .when(case == 1, c(lit("data\\metrics\\"), "task", lit("__part__"), "provider", lit("__"), "model", lit("__"), "stamp", lit("__extra__metrics.json")))
        .when(case == 2, c("task", lit("_out_openai_"), "model", lit("_x_"), "stamp", lit("_metrics.json")))
        .when(case == 3, c(lit("./"), "task", lit("_out_"), "provider", lit("_"), "model", lit("_"), "stamp", lit("_metrics.json")))
        .when(case == 4, c(lit("/abs/metrics/"), "task", lit("____"), "model", lit("__"), "stamp", lit("__metrics.json")))
        .otherwise(c(lit("metrics/"), "task", lit("."), "model", lit("__heatmap.png")))
    )
    return r.select("run_id", path.alias("path"), "task", "provider", "model", "stamp", "run_stem")


@query(
    "parsed_run_names", "P1 P2 P6",
    with_views(RUNS, FILES_SQL, select="""
SELECT run_id, CASE run_id % 6 WHEN 1 THEN task || '__part' WHEN 5 THEN task || '.' || model ELSE task END AS task,
  CASE run_id % 6 WHEN 0 THEN provider WHEN 1 THEN provider WHEN 2 THEN 'openai' ELSE '' END AS provider,
  CASE run_id % 6 WHEN 2 THEN model || '_x' WHEN 3 THEN provider || '_' || model WHEN 5 THEN 'unknown' ELSE model END AS model,
  CASE WHEN run_id % 6 <> 5 THEN stamp END AS timestamp, CASE WHEN run_id % 6 = 1 THEN 'extra' ELSE '' END AS extra FROM files"""),
)
def parsed_run_names(spark, sf_dir):
    f = files(spark, sf_dir)
    n = names.parse_run_name(names.run_stem(names.file_name(F.col("path"))))
    return f.select("run_id", n.alias("n")).select("run_id", "n.*")


@query(
    "split_run_names", "P3 P4 P5",
    with_views(RUNS, FILES_SQL, select="""
, named AS (SELECT run_id, task, provider, model, stamp, regexp_replace(regexp_replace(split_part(replace(path, '\\', '/'), '/', -1), '__metrics.json$', ''), '_metrics.json$', '') AS base FROM files)
SELECT run_id, base, CASE run_id % 6 WHEN 1 THEN task || '__part__' || provider WHEN 2 THEN base WHEN 3 THEN base WHEN 5 THEN base ELSE task END AS task,
  CASE run_id % 6 WHEN 0 THEN provider WHEN 1 THEN model END AS provider, CASE run_id % 6 WHEN 0 THEN model WHEN 1 THEN stamp WHEN 4 THEN model END AS model,
  CASE run_id % 6 WHEN 0 THEN stamp WHEN 1 THEN 'extra' WHEN 4 THEN stamp END AS timestamp,
  CASE run_id % 6 WHEN 0 THEN provider WHEN 1 THEN 'part' WHEN 4 THEN '' ELSE '' END AS left_provider,
  CASE run_id % 6 WHEN 0 THEN model WHEN 1 THEN provider WHEN 4 THEN model ELSE base END AS left_model,
  CASE WHEN run_id % 6 IN (0, 1, 4) THEN stamp ELSE '' END AS stamp FROM named"""),
)
def split_run_names(spark, sf_dir):
    f = files(spark, sf_dir).select("run_id", names.file_name(F.col("path")).alias("file"))
    base = F.when(F.col("file").endswith(".json"), names.metrics_base(F.col("file"))).otherwise(F.col("file"))
    f = f.select("run_id", base.alias("base"))
    left = names.provider_and_model_from_left(F.col("base"))
    return f.select(
        "run_id", "base", names.split_stem_from_right(F.col("base")).alias("n"), left["provider"].alias("left_provider"), left["model"].alias("left_model"),
        names.stamp_in_name(F.col("base")).alias("stamp"),
    ).select("run_id", "base", "n.*", "left_provider", "left_model", "stamp")


@query(
    "artifact_paths", "P7",
    with_views(RUNS, FILES_SQL, select="""
SELECT run_id, CASE run_id % 6 WHEN 1 THEN '../data/metrics/' || replace(path, '\\', '/') WHEN 3 THEN '../data/metrics/' || substr(path, 3) WHEN 4 THEN path ELSE '../data/metrics/' || path END AS metrics_path,
  CASE run_id % 6 WHEN 1 THEN replace(replace(path, '\\', '/'), '/metrics/', '/logs/') WHEN 4 THEN replace(path, '/metrics/', '/logs/') WHEN 5 THEN replace(path, 'metrics/', 'logs/')
    ELSE '../data/logs/' || split_part(path, '/', -1) END AS log_path FROM files"""),
)
def artifact_paths(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("run_id", names.metrics_path(F.col("path")).alias("metrics_path"), names.sibling_path(F.col("path"), "logs").alias("log_path"))


# Prompts: turns of conversations, some with marked spans in the present or the older markers.
PROMPTS_SQL = """
prompts AS (SELECT conv_id, turn, text AS raw,
  CASE (conv_id + turn) % 4 WHEN 0 THEN '⟦' || substr(text, 1, 20) || '⟧ and ⟦ ' || substr(text, 21, 5) || '⟧ ⟦  ⟧' WHEN 1 THEN 'xâź¦' || substr(text, 1, 9) || 'âź§y' ELSE text END AS node,
  CASE WHEN turn % 2 = 0 THEN role || ' ' ELSE role || ':' END AS left_context, CASE WHEN turn % 3 = 0 THEN '' ELSE ' ' || role END AS right_context FROM conversations),
trimmed AS (SELECT *, regexp_replace(node, '^\\s+|\\s+$', '', 'g') AS t,
  CASE (conv_id + turn) % 4 WHEN 0 THEN concat_ws(' ', nullif(regexp_replace(substr(raw, 1, 20), '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_replace(substr(raw, 21, 5), '^\\s+|\\s+$', '', 'g'), ''))
    WHEN 1 THEN regexp_replace(substr(raw, 1, 9), '^\\s+|\\s+$', '', 'g') ELSE '' END AS spans FROM prompts)"""


def prompt_rows(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    t = F.col("text")
    node = (
        F.when(kind == 0, F.concat(F.lit("⟦"), F.substring(t, 1, 20), F.lit("⟧ and ⟦ "), F.substring(t, 21, 5), F.lit("⟧ ⟦  ⟧")))
        .when(kind == 1, F.concat(F.lit("xâź¦"), F.substring(t, 1, 9), F.lit("âź§y"))).otherwise(t)
    )
    return c.select(
        "conv_id", "turn", node.alias("node"),
        F.concat("role", F.when(F.col("turn") % 2 == 0, " ").otherwise(":")).alias("left_context"),
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "role")).alias("right_context"), F.lit("").alias("info"),
    )


@query(
    "prompt_targets", "P32",
    with_views(PROMPTS_SQL, select="""
SELECT conv_id, turn, CASE WHEN spans <> '' THEN 'marked_subspan' ELSE 'node' END AS focus, CASE WHEN spans <> '' THEN spans ELSE t END AS target FROM trimmed"""),
)
def prompt_targets(spark, sf_dir):
    p = prompt_rows(spark, sf_dir)
    return p.select("conv_id", "turn", text.target_focus(F.col("node")).alias("focus"), text.target_text(F.col("node")).alias("target"))


@query(
    "prompts_in_context", "P33 P31",
    with_views(PROMPTS_SQL, select="""
, marked AS (SELECT conv_id, turn, regexp_replace(regexp_replace(left_context, '\\s+$', '') || CASE WHEN turn % 2 = 0 THEN '' ELSE ' ' END
    || CASE WHEN (conv_id + turn) % 4 <= 1 THEN node ELSE '⟦' || node || '⟧' END || ltrim(right_context), '^\\s+|\\s+$', '', 'g') AS marked_example FROM prompts)
SELECT *, greatest(1, CAST(floor(length(marked_example) / 4.0 + 0.5) AS BIGINT)) AS tokens_mid, greatest(1, CAST(floor(length(marked_example) / 4.5::DOUBLE + 0.5) AS BIGINT)) AS tokens_low,
  greatest(1, CAST(floor(length(marked_example) / 3.5::DOUBLE + 0.5) AS BIGINT)) AS tokens_high FROM marked"""),
)
def prompts_in_context(spark, sf_dir):
    p = prompt_rows(spark, sf_dir)
    marked = text.mark_in_context(F.col("left_context"), F.col("node"), F.col("right_context")).alias("marked_example")
    return prompts.with_token_estimates(p.select("conv_id", "turn", marked), "marked_example")


@query(
    "prompt_payloads", "P34",
    with_views(PROMPTS_SQL, select="""
SELECT conv_id, turn, left_context, CASE WHEN spans <> '' THEN 'marked_subspan' ELSE 'node' END AS focus, CASE WHEN spans <> '' THEN spans ELSE t END AS target, length(node) AS node_chars FROM trimmed"""),
)
def prompt_payloads(spark, sf_dir):
    """Payloads written as JSON and read again."""
    p = prompt_rows(spark, sf_dir).select("conv_id", "turn", prompts.payload_json("standard").alias("json"))
    get = lambda path: F.get_json_object("json", path)
    return p.select(
        "conv_id", "turn", get("$.left_context").alias("left_context"), get("$.classification_target.focus").alias("focus"),
        get("$.classification_target.text").alias("target"), F.length(get("$.node")).cast("long").alias("node_chars"),
    )


@query(
    "evenly_sampled_prompts", "W12",
    """WITH numbered AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS i, count(*) OVER () AS n FROM conversations),
wanted AS (SELECT CAST(floor(k * (SELECT count(*) FROM conversations) / 100.0::DOUBLE) AS BIGINT) AS i FROM range(100) t(k))
SELECT conv_id, turn FROM numbered SEMI JOIN wanted USING (i)""",
)
def evenly_sampled_prompts(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    return prompts.sample_evenly(c, prompts.SAMPLE, ["conv_id", "turn", "role", "text"]).select("conv_id", "turn")


@query(
    "imported_settings", "P35 P9",
    with_views(RUNS, select="""
SELECT run_stem, CASE WHEN run_id % 3 = 0 THEN task ELSE 'stored ' || task END AS task_name, CASE WHEN run_id % 2 = 0 THEN provider ELSE 'configured' END AS provider, 'fixed' AS model FROM runs"""),
)
def imported_settings(spark, sf_dir):
    r = fx.runs(spark, sf_dir)
    stored = r.select(
        "run_stem", F.when(F.col("run_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("stored "), "task")).alias("config_task"), F.col("task").alias("payload_task"),
        F.when(F.col("run_id") % 2 == 1, "configured").alias("config_provider"), F.col("provider").alias("details_provider"), F.col("model").alias("config_model"),
    )
    fields = {"task_name": ["config_task", "payload_task"], "provider": ["config_provider", "details_provider"], "model": ["config_model"]}
    return prompts.import_config(stored, fields, {"model": "fixed"})


@query(
    "normalised_example_rows", "S16 S17",
    """SELECT c_custkey AS custkey, trim(c_mktsegment) AS node FROM customer WHERE c_custkey % 3 <> 0""",
)
def normalised_example_rows(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    blank = F.col("c_custkey") % 3 == 0
    wide = c.select(
        F.when(~blank, F.col("c_custkey")).alias(" Cust-Key "), F.when(blank, " ").otherwise(F.col("c_mktsegment")).alias("Node!"), F.lit(None).cast("string").alias("node")
    )
    return delimited.drop_blank_rows(delimited.normalised_columns(wide))


# Page texts. RE2 has no back-references, so scripts and styles go one after the other.
PAGE_SQL = """
stripped AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
    '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
page_texts AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), chr(160), ' '), '\\s+', ' ', 'g')) AS text FROM stripped)"""


@query("page_texts", "P41", with_views(PAGE_SQL, select="SELECT page_id, text, length(text) AS chars FROM page_texts"))
def page_texts(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages").select("page_id", html.page_text(F.col("html")).alias("text"))
    return p.withColumn("chars", F.length("text").cast("long"))


@query(
    "page_links", "P42",
    """SELECT page_id, unnest(list_sort(list_distinct(regexp_extract_all(html, '(?i)href="([^"]+)"', 1)))) AS href FROM pages""",
)
def page_links(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href"))


@query(
    "detail_links", "J26",
    """
WITH hrefs AS (SELECT page_id, unnest(list_sort(list_distinct(regexp_extract_all(html, '(?i)href="/([^"]+)"', 1)))) AS h FROM pages),
rests AS (SELECT page_id, h, regexp_replace(lower(h), '[^a-z0-9]+', '', 'g') AS tail FROM hrefs),
firsts AS (SELECT page_id, tail, min(h) AS h FROM rests WHERE tail <> '' GROUP BY ALL),
terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
SELECT 'p' || page_id || '/' || w AS model, 'https://www.requesty.ai/models/p' || page_id || '/' || h AS url FROM terms JOIN firsts ON w = tail""",
)
def detail_links(spark, sf_dir):
    """Links of every page read as a provider's model list; the models asked for are the words of the benchmark."""
    pages = fx.table(spark, sf_dir, "pages")
    provider = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    listed = pages.select(provider.alias("provider"), F.regexp_replace("html", '(?i)href="/', F.concat(F.lit('href="/models/'), provider, F.lit("/"))).alias("html"))
    words = fx.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    # Only words that some page links to can match, so pages and words meet on the word.
    linked = listed.select("provider", F.explode(html.links(F.col("html"))).alias("h")).select(
        "provider", F.regexp_replace(F.lower(F.regexp_extract("h", "^/models/[^/]+/(.*)$", 1)), "[^a-z0-9]+", "").alias("w")
    ).distinct()
    models = linked.join(words, "w").select(F.concat_ws("/", "provider", "w").alias("model"))
    return cat.detail_links(listed, models)


# Price pages written from the part table, one per brand and type.
PRICE_PAGES_SQL = """
stats AS (SELECT lower(p_brand) AS provider, lower(p_type) AS model, round(min(p_retailprice) / 100 + 1e-9, 2) AS a, round(avg(p_retailprice) / 100 + 1e-9, 2) AS b,
  round(max(p_retailprice) / 100 + 1e-9, 2) AS c, count(*) AS n FROM part GROUP BY ALL)"""


def price_stats(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    cents = lambda agg: F.round(agg("p_retailprice") / 100 + 1e-9, 2)
    return p.groupBy(F.lower("p_brand").alias("provider"), F.lower("p_type").alias("model")).agg(
        cents(F.min).alias("a"), cents(F.avg).alias("b"), cents(F.max).alias("c"), F.count("*").alias("n")
    )


def dollars(c: str):
    return F.concat(F.lit("$"), F.format_string("%.2f", F.col(c)))


@query(
    "labelled_page_prices", "P43",
    with_views(PRICE_PAGES_SQL, select="""
SELECT provider, model, 'standard' AS tier, a AS input_rate, CASE WHEN n % 2 = 0 THEN b END AS cached_rate, c AS output_rate FROM stats
UNION ALL SELECT provider, model, 'batch', b, a, c FROM stats WHERE n % 3 = 0"""),
)
def labelled_page_prices(spark, sf_dir):
    s = price_stats(spark, sf_dir)
    first = F.concat(F.lit("Intro Text tokens Per 1M tokens Input "), dollars("a"), F.when(F.col("n") % 2 == 0, F.concat(F.lit(" Cached input "), dollars("b"))).otherwise(""), F.lit(" Output "), dollars("c"))
    second = F.when(F.col("n") % 3 == 0, F.concat(F.lit(" text tokens per 1M tokens ∙ Batch API price Input "), dollars("b"), F.lit(" Cached input "), dollars("a"), F.lit(" Output "), dollars("c"))).otherwise("")
    pages = s.select("provider", "model", F.concat(first, second).alias("text"))
    return pages.select("provider", "model", F.explode(html.labelled_prices(F.col("text"))).alias("p")).select("provider", "model", "p.tier", "p.rates.*")


@query(
    "routed_page_prices", "P43",
    with_views(PRICE_PAGES_SQL, select="SELECT provider, model, a AS input_rate, CASE WHEN n % 2 = 0 THEN b END AS cached_rate, c AS output_rate FROM stats WHERE n % 5 <> 0"),
)
def routed_page_prices(spark, sf_dir):
    s = price_stats(spark, sf_dir)
    read = F.when(F.col("n") % 2 == 0, F.concat(F.lit(" Cache write $9.99 Cache read "), dollars("b"))).otherwise("")
    page = F.when(F.col("n") % 5 != 0, F.concat(F.lit("x Pricing per 1M tokens Input "), dollars("a"), F.lit(" Output "), dollars("c"), read)).otherwise("nothing")
    return s.select("provider", "model", html.routed_prices(page).alias("r")).filter("r is not null").select("provider", "model", "r.*")


@query(
    "table_page_prices", "P43b",
    with_views(PRICE_PAGES_SQL, select="""
SELECT provider, model, 'base' AS context, a AS input_rate, b AS cached_rate, c AS output_rate FROM stats
UNION ALL SELECT provider, model, 'long', c, CASE WHEN n % 2 = 1 THEN NULL ELSE a END, b FROM stats"""),
)
def table_page_prices(spark, sf_dir):
    """One page per brand with a table of its types: 8 cells for even counts, 6 with a dash for odd ones."""
    s = price_stats(spark, sf_dir)
    cells = F.when(F.col("n") % 2 == 0, F.concat_ws(" ", dollars("a"), dollars("b"), F.lit("$7.77"), dollars("c"), dollars("c"), dollars("a"), F.lit("$8.88"), dollars("b"))).otherwise(
        F.concat_ws(" ", dollars("a"), dollars("b"), dollars("c"), dollars("c"), F.lit("-"), dollars("b"))
    )
    pages = s.groupBy("provider").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.upper("model"), cells))), " ").alias("text"))
    hits = s.select("provider", "model").join(pages, "provider").select("provider", "model", html.table_row(F.col("text"), F.col("model")).alias("r")).filter("r is not null")
    both = hits.select("provider", "model", F.explode(F.array(F.struct(F.lit("base").alias("context"), F.col("r.base").alias("v")), F.struct(F.lit("long").alias("context"), F.col("r.long").alias("v")))).alias("x"))
    return both.filter("x.v is not null").select("provider", "model", "x.context", "x.v.*")


@query(
    "labelled_row_prices", "P43b",
    with_views(PRICE_PAGES_SQL, select="""
SELECT provider, model, 'row' AS form, a AS input_rate, b AS cached_rate, CASE WHEN n % 2 = 0 THEN c END AS output_rate FROM stats
UNION ALL SELECT provider, model, 'label', a, b, CASE WHEN n % 2 = 0 THEN c END FROM stats"""),
)
def labelled_row_prices(spark, sf_dir):
    """Rows of three cells, found right after the name and after a few words."""
    s = price_stats(spark, sf_dir)
    cells = F.concat_ws(" ", dollars("a"), dollars("b"), F.when(F.col("n") % 2 == 0, dollars("c")).otherwise("-"))
    pages = s.select("provider", "model", F.concat(F.lit("x-"), "model", F.lit(" - "), F.upper("model"), F.lit(" "), cells).alias("row"), F.concat(F.lit("pro-"), "model", F.lit(" a, "), "model", F.lit(" for long texts: "), cells).alias("label"))
    forms = F.array(
        F.struct(F.lit("row").alias("form"), html.three_cells(F.col("row"), F.col("model")).alias("r")),
        F.struct(F.lit("label").alias("form"), html.cells_near_label(F.col("label"), F.col("model")).alias("r")),
    )
    return pages.select("provider", "model", F.explode(forms).alias("f")).filter("f.r is not null").select("provider", "model", "f.form", "f.r.*")


HEADINGS = ["Standard Type", "Economy Type", "Small Type", "Medium Type", "Large Type", "Promo Type"]


@query(
    "tier_block_prices", "P43c P44",
    with_views(PRICE_PAGES_SQL, select="""
SELECT provider, model, 'standard' AS tier, 'base' AS context, a AS input_rate, b AS cached_rate, c AS output_rate FROM stats WHERE n % 4 <> 0
UNION ALL SELECT provider, model, 'standard', 'long', c, NULL, NULL FROM stats WHERE n % 4 <> 0
UNION ALL SELECT provider, model, 'batch', 'base', b, NULL, a FROM stats WHERE n % 4 <> 0"""),
)
def tier_block_prices(spark, sf_dir):
    """One page per brand with a section per type; a repeated tier ends a section, sections without standard have no prices."""
    s = price_stats(spark, sf_dir)
    heading = F.concat(F.initcap("model"), F.lit(" Type"))
    first = F.when(F.col("n") % 4 != 0, "### Standard ").otherwise("### Flex ")
    body = F.concat(
        heading, F.lit(" "), first, F.lit("Input price "), dollars("a"), F.lit(" "), dollars("c"), F.lit(" Output price "), dollars("c"), F.lit(" Context caching price "), dollars("b"),
        F.lit(" Batch Free Tier Paid Tier Input price "), dollars("b"), F.lit(" Output price "), dollars("a"), F.lit(" "), first, F.lit("Input price $1 Output price $2"),
    )
    pages = s.groupBy("provider").agg(F.array_join(F.array_sort(F.collect_list(body)), " ").alias("text"))
    sections = F.array(*[F.struct(F.lit(h.split()[0].lower()).alias("model"), html.section(F.col("text"), h, HEADINGS).alias("s")) for h in HEADINGS])
    rows = pages.select("provider", F.explode(sections).alias("x")).filter("x.s is not null")
    blocks = rows.select("provider", "x.model", F.explode(html.tier_blocks(F.col("x.s"))).alias("b"))
    priced = blocks.select("provider", "model", "b.tier", html.block_prices(F.col("b.block")).alias("p"))
    both = priced.select("provider", "model", "tier", F.explode(F.array(F.struct(F.lit("base").alias("context"), F.col("p.base").alias("v")), F.struct(F.lit("long").alias("context"), F.col("p.long").alias("v")))).alias("x"))
    return both.filter("x.v is not null").select("provider", "model", "tier", "x.context", "x.v.*")


@query(
    "dated_model_names", "P47 P49",
    with_views(RUNS, select="""
SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'gpt-5.1-mini' END AS base, run_id % 5 <> 4 AND run_id % 3 <> 2 AS candidate FROM runs"""),
)
def dated_model_names(spark, sf_dir):
    r = fx.runs(spark, sf_dir)
    key = F.col("run_id")
    day = F.substring("stamp", 1, 10)
    name = F.when(key % 3 == 0, F.concat(F.lit("GPT-5.1-mini-"), day)).when(key % 3 == 1, F.concat(F.lit("gpt-4o-"), day)).otherwise(F.concat(F.lit("claude-"), day))
    asked = F.when(key % 5 == 4, F.concat(name, F.lit("-tts"))).otherwise(name)
    return r.select("run_id", text.snapshot_base(name).alias("base"), text.text_model_candidate(asked).alias("candidate"))


@query(
    "entries_without_status", "P50",
    """SELECT p_partkey, '{"model":"' || p_name || '","tiers":[{"rate":' || p_size || '},{"rate":' || (p_size + 1) || '}],"extras":{"a":{"size":' || p_size || '}}}' AS entry FROM part""",
)
def entries_without_status(spark, sf_dir):
    """Price entries that carry a status at every level, without it."""
    p = fx.table(spark, sf_dir, "part")
    status = F.lit("ok").alias("status")
    tier = lambda n: F.struct(status, (F.col("p_size") + n).alias("rate"))
    extras = F.create_map(F.lit("a"), F.struct(F.col("p_size").alias("size"), status), F.lit("status"), F.struct(F.col("p_size").alias("size"), status))
    rows = p.select("p_partkey", F.struct(status, F.col("p_name").alias("model"), F.array(tier(0), tier(1)).alias("tiers"), extras.alias("extras")).alias("e"))
    return rows.select("p_partkey", F.to_json(drop_key(F.col("e"), rows.schema["e"].dataType, "status")).alias("entry"))


@query(
    "whole_numbers", "P11",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(l_extendedprice AS BIGINT) END AS whole,
  CASE WHEN l_tax = floor(l_tax) THEN CAST(l_tax AS BIGINT) END AS tax FROM lineitem""",
)
def whole_numbers(spark, sf_dir):
    """Amounts that are whole numbers, others as null."""
    rows = fx.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", whole_number(F.col("l_extendedprice")).alias("whole"), whole_number(F.col("l_tax")).alias("tax"))
