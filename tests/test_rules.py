"""Hand-computed cases of the rules that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from ratewise.functions import html, names, numbers, text, times
from ratewise.functions.nested import drop_key
from ratewise.operators import catalog, interrater, leaderboard as lb, pricing, prompts, quality
from ratewise.operators.quantiles import exact_quantiles
from ratewise.operators.skew import join_group_facts


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def test_percent_scaling(spark):
    assert [one(spark, numbers.to_percent(F.lit(x))) for x in (0.5, 1.0, 55.0)] == [50.0, 100.0, 55.0]


def test_numbers_in_text(spark):
    assert [one(spark, numbers.text_to_int(F.lit(x))) for x in (" 3.9 ", "-2.5", "x", "", "NaN", "1e3")] == [3, -2, None, None, None, 1000]
    assert [one(spark, numbers.price_text(F.lit(x))) for x in ("$1,200.5", "-", "—", "N/A", "0.3")] == [1200.5, None, None, None, 0.3]
    assert [one(spark, numbers.optional_rate(F.lit(x))) for x in ("0.5", "0.5*", "", "inf")] == [0.5, None, None, None]
    assert one(spark, numbers.price_value(F.lit("-1"))) is None


def test_interval_needs_a_metric_and_two_examples(spark):
    df = spark.createDataFrame([(50.0, 100), (None, 100), (50.0, 1), (100.0, 10)], "m double, n long")
    rows = df.select(numbers.wald_low(F.col("m"), F.col("n")).alias("lo"), numbers.wald_high(F.col("m"), F.col("n")).alias("hi")).collect()
    assert rows[0].lo == pytest.approx(40.2) and rows[0].hi == pytest.approx(59.8)
    assert rows[1].lo is None and rows[2].hi is None
    assert (rows[3].lo, rows[3].hi) == (100.0, 100.0)


def test_t_quantiles(spark):
    assert [one(spark, numbers.t_critical(F.lit(n))) for n in (1, 2, 21, 22)] == [None, 12.706, 2.086, 1.96]


def test_distance_limit_rises_from_the_third_attempt(spark):
    limit = lambda a, cut=False: one(spark, numbers.effective_limit(1.25, 0.5, F.lit(a), cut))
    assert [limit("1"), limit("2"), limit("3"), limit("5"), limit("x")] == [1.25, 1.25, 1.75, 2.75, 1.25]
    assert limit("4", True) == 2.0
    assert one(spark, numbers.effective_limit(0, 0.5, F.lit("9"))) == 0.0


def test_run_names_by_each_reader(spark):
    parse = lambda s: tuple(one(spark, names.parse_run_name(F.lit(s))))
    assert parse("a__b__p__m__2026-01-02-03-04") == ("a__b", "p", "m", "2026-01-02-03-04", "")
    assert parse("t____m__2026-01-02-03-04__x") == ("t", "", "m", "2026-01-02-03-04", "x")
    assert parse("t_out_OpenAI_gpt_4_2026-01-02-03-04") == ("t", "OpenAI", "gpt_4", "2026-01-02-03-04", "")
    assert parse("t_out_gpt_2026-01-02-03-04") == ("t", "", "gpt", "2026-01-02-03-04", "")
    assert parse("plain") == ("plain", "", "unknown", None, "")
    right = lambda s: tuple(one(spark, names.split_stem_from_right(F.lit(s))))
    assert right("a__b__p__m__t") == ("a__b", "p", "m", "t")
    assert right("a__p__m") == ("a", "p", "m", None)
    assert right("a____m__t") == ("a", None, "m", "t")
    assert right("a__b") == ("a__b", None, None, None)
    assert tuple(one(spark, names.provider_and_model_from_left(F.lit("a__b__p__m")))) == ("b", "p")


def test_marked_spans(spark):
    assert one(spark, text.target_text(F.lit("a ⟦ b ⟧ c ⟦⟧ ⟦d"))) == "b"
    assert one(spark, text.target_text(F.lit("âź¦xâź§ ⟦ ⟧"))) == "x"
    assert one(spark, text.target_focus(F.lit("a ⟦ ⟧"))) == "node"
    mark = lambda l, n, r: one(spark, text.mark_in_context(F.lit(l), F.lit(n), F.lit(r)))
    # A context that ends in a blank loses it and gets none back.
    assert mark("left ", "n", " right") == "left⟦n⟧right"
    assert mark("left\t", "n", "right") == "left ⟦n⟧ right"
    assert mark("", "a ⟦b⟧", None) == "a ⟦b⟧"


def test_hours_and_times(spark):
    assert [one(spark, times.hour_bucket(F.lit(h))) for h in (0, 5, 6, 17, 18, None)] == ["00-05", "00-05", "06-11", "12-17", "18-23", None]
    shown = lambda s: one(spark, F.date_format(times.run_time(F.lit(s)), "yyyy-MM-dd HH:mm"))
    assert [shown(s) for s in ("2026-05-14-10-30", "2026-05-14T10:30", "2026-05-14", "2026-05-14T10:30:00Z", "1778754600000", "soon")] == [
        "2026-05-14 10:30", "2026-05-14 10:30", "2026-05-14 00:00", "2026-05-14 10:30", "2026-05-14 10:30", None,
    ]
    winter, summer = F.lit("2026-01-10 12:00").cast("timestamp"), F.lit("2026-07-10 12:00").cast("timestamp")
    assert [one(spark, times.zone_offset(t, times.local_time(t))) for t in (winter, summer)] == ["+01:00", "+02:00"]


def test_table_sort_puts_unknown_first_when_falling(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "file_name string, accuracy double").withColumn("started", F.current_timestamp())
    order = lambda *o: [r.file_name for r in df.orderBy(*o).collect()]
    assert order(*lb.table_order("accuracy", "desc")) == ["b", "c", "a"]
    assert order(*lb.table_order("accuracy", "asc")) == ["a", "c", "b"]
    assert order(lb.metric_order("accuracy")) == ["c", "a", "b"]


def test_unit_without_metric_loses_its_price(spark):
    rows = [("m", "t1", 50.0, 1.0), ("m", "t1", 70.0, 3.0), ("m", "t2", 20.0, None), ("m", "t3", None, 100.0)]
    r = lb.balanced_aggregate(spark.createDataFrame(rows, "model string, task string, a double, p double"), ["model"], "task", "a", "p").head()
    assert (r.metric_value, r.price_value, r.unit_count, r.priced_unit_count, r.item_count) == (40.0, 2.0, 2, 1, 4)


def test_ratio_of_missing_values(spark):
    ratio = lambda m, v: one(spark, numbers.profile_ratio(F.lit(v).cast("double"), F.lit(10.0), m))
    assert (ratio("calibration_ece", None), ratio("accuracy", None), ratio("cohen_kappa", 0.0), ratio("accuracy", 5.0)) == (1.0, 0.0, 0.5, 0.5)


def test_best_run_takes_zero_like_unknown(spark):
    rows = [("a", "m", 0.0, "valid", 0.0, "2"), ("b", "m", 0.0, "valid", None, "1"), ("c", "m", 1.0, "valid", 0.4, "1")]
    df = spark.createDataFrame(rows, "base_name string, model string, temperature double, status string, accuracy double, stamp string").withColumns(
        {"macro_f1": F.lit(0.5), "cohen_kappa": F.lit(None).cast("double")}
    )
    got = {r.temperature: r for r in interrater.model_temperature_summary(df).collect()}
    assert got[0.0].best_run == "b"
    assert (got[1.0].accuracy_sd, got[1.0].accuracy_ci95) == (0.0, None)


def test_status_reasons(spark):
    cols = interrater.status_columns(F.lit(None).cast("int"), F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("double"), 115)
    assert tuple(spark.range(1).select(*cols).head()) == ("fail", "output_rows=None; missing_metrics")


def test_quantiles_of_large_groups_are_exact(spark):
    df = spark.range(60_001).select((F.col("id") % 2).alias("g"), (F.pmod(F.col("id") * 7919, F.lit(60_001)) % 977).cast("double").alias("v"))
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 1.0}
    got = sorted(tuple(r) for r in exact_quantiles(df, ["g"], "v", probs).collect())
    want = sorted(tuple(r) for r in df.groupBy("g").agg(F.count("*"), *[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect())
    assert got == want


def test_quantiles_are_narrowed_where_one_group_has_most_rows(spark):
    """Group 0 holds nine tenths of the rows, a third of them one value; rounds end at 600 values a group."""
    place = F.pmod(F.col("id") * 7919, F.lit(200_003))
    v = F.when(place % 3 == 0, F.lit(5000.5)).when(place == 1, F.lit(float("inf"))).otherwise(F.exp(place / 20_000.0) * 50)
    g = F.when(F.col("id") % 10 > 0, F.lit("0")).when(F.col("id") % 20 == 0, F.lit(None)).otherwise(F.lit("1"))
    df = spark.range(200_003).select(g.alias("g"), v.alias("v"))
    probs = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.501, "f": 0.95}
    for small, task_rows in ((600, 5_000), (0, 1_000), (20_000, 4_000_000)):
        got = {r.g: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "v", probs, small, task_rows).collect()}
        want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(F.count("*"), *[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect()}
        assert got.keys() == want.keys()
        for key, row in want.items():
            assert got[key] == pytest.approx(row, rel=1e-12)


def test_quantiles_of_few_nothing_and_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 4.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in exact_quantiles(df, ["g"], "v", {"q": 0.5, "p": 1.0}).collect()] == [("a", 2, 2.5, 4.0)]
    assert exact_quantiles(df.filter("g = 'c'"), ["g"], "v", {"q": 0.5}).collect() == []


@pytest.mark.parametrize("null_safe", [False, True])
def test_facts_reach_the_rows_of_hot_and_other_groups(spark, null_safe):
    key = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 3_000).cast("string"))
    rows = spark.range(30_000).select(F.when(F.col("id") % 7 > 0, key).alias("g"), "id")
    facts = rows.groupBy("g").agg(F.count("*").alias("n"))
    got = join_group_facts(rows, facts, ["g"], F.col("id"), null_safe=null_safe, count="n", task_rows=5)
    assert got.columns == ["g", "id", "n"]
    want = rows.join(facts.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")) if null_safe else F.col("g") == F.col("h")).drop("h")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


CATALOG = "provider string, model string, tier string, input_rate double, cached_rate double, output_rate double, pricing_ref string, reason string, needs_manual boolean"


def priced(p, m, rate=1.0):
    return (p, m, "standard", rate, None, rate, None, None, False)


def alias(p, m, to):
    return (p, m, None, None, None, None, to, None, False)


def test_alias_chains(spark):
    rows = [priced("p", "end"), alias("p", "c1", "c2"), alias("p", "c2", "c1"), alias("p", "dead", "gone")]
    rows += [alias("p", f"n{i}", f"n{i + 1}" if i < 12 else "end") for i in range(13)]
    entries = pricing.classify_entries(spark.createDataFrame(rows, CATALOG))
    short = {r.model for r in pricing.resolve_aliases(entries, 12).collect()}
    # Twelve entries at most: n2..n12 reach the end within them, n0 and n1 do not.
    assert short == {"end"} | {f"n{i}" for i in range(2, 13)}
    assert {r.model for r in pricing.resolve_aliases(entries).collect()} == {"end"} | {f"n{i}" for i in range(13)}


def test_price_matching_order(spark):
    rows = [
        priced("google", "models/g-1"), priced("openai", "gpt-5"), alias("openai", "gpt5", "gpt-5"), priced("other", "only-here"), priced("a", "twice"), priced("b", "twice"),
        priced("requesty", "vertex/x@eu"), priced("requesty", "openai/x"), priced("requesty", "bedrock/x"), priced("requesty", "azure/y"), priced("requesty", "coding/y"),
    ]
    runs = [
        ("1", "Google", "g-1", "", "", ""), ("2", "openai", "GPT-5", "", "", ""), ("3", "openai", "only-here", "", "", "gpt5"), ("4", "openai", "twice", "", "", ""),
        ("5", "openai", "nope", "", "", "gpt5"), ("6", "requesty", "x", "", "", ""), ("7", "requesty", "y", "", "", ""), ("8", "requesty", "only-here", "", "", ""),
        ("9", "", "", "", "", "only-here"), ("10", "einfra", "z", "", "", "only-here"),
    ]
    df = spark.createDataFrame(runs, "run string, provider string, requested string, for_requests string, model string, file_slug string")
    found = pricing.match_prices(df, spark.createDataFrame(rows, CATALOG))
    got = {r.run: (r.price_provider, r.matched_key, r.resolved_key) for r in df.join(found, pricing.IDENTITY).collect()}
    assert got["1"] == ("google", "models/g-1", "models/g-1")
    assert got["2"] == ("openai", "gpt5", "gpt-5")
    assert got["3"] == ("other", "only-here", "only-here")
    assert got["4"][0] is None and got["7"][0] is None and got["8"][0] is None and got["10"][0] is None
    assert got["5"] == ("openai", "gpt5", "gpt-5")
    assert got["6"] == ("requesty", "openai/x", "openai/x")
    assert got["9"] == ("other", "only-here", "only-here")


def test_cost_statuses(spark):
    rows = [priced("p", "m", 2.0), ("p", "u", None, None, None, None, None, "no price", False), ("p", "w", None, None, None, None, None, "later", True)]
    runs = [(m, "p", m, "", "", "", t, i, c, None, o) for m, t, i, c, o in [
        ("m", "standard", 1e6, 0.0, 5e5), ("u", "", 1.0, 0.0, 0.0), ("w", "", 1.0, 0.0, 0.0), ("x", "", 1.0, 0.0, 0.0)]]
    runs += [("flex", "p", "m", "", "", "", "flex", 1.0, 0.0, None, 0.0), ("cached", "p", "m", "", "", "", "", 5.0, 2.0, None, 0.0)]
    schema = "run string, provider string, requested string, for_requests string, model string, file_slug string, service_tier string, input_tokens double, cached_tokens double, non_cached_tokens double, output_tokens double"
    got = {r.run: r for r in pricing.estimate_costs(spark.createDataFrame(runs, schema), spark.createDataFrame(rows, CATALOG)).collect()}
    assert (got["m"].pricing_status, got["m"].estimated_cost_usd) == ("priced", 3.0)
    assert [got[k].pricing_status for k in ("u", "w", "x", "flex")] == ["unsupported", "unpriced", "model_missing", "tier_unavailable"]
    assert (got["cached"].pricing_status, got["cached"].missing_buckets) == ("rate_missing", "cached_input")


def test_token_rows(spark):
    rows = [("r", 10, 5, 20), ("r", 10, 5, None), ("r", None, None, None), ("r", 30, None, 20)]
    t = quality.token_totals(spark.createDataFrame(rows, "run_id string, prompt_tokens int, completion_tokens int, total_tokens int")).head()
    assert (t.row_count, t.rows_with_token_usage, t.rows_with_output_tokens, t.prompt_tokens_total, t.output_tokens_total) == (4, 3, 2, 50, 15)


def test_even_sample_and_small_tables(spark):
    df = spark.range(250).select((249 - F.col("id")).alias("x"))
    assert sorted(r.x for r in prompts.sample_evenly(df, 100, ["x"]).collect()) == [i * 250 // 100 for i in range(100)]
    assert prompts.sample_evenly(df, 300, ["x"]).count() == 250


def test_page_prices(spark):
    page = "A <b>x</b>&nbsp;&lt;<script>no</script ><!-- c -->"
    assert one(spark, html.page_text(F.lit("<p>a&nbsp; &eacute;</p><script>x</script><STYLE>y</STYLE><!-- z -->b"))) == "a é b"
    assert one(spark, html.page_text(F.lit(page))).startswith("A x <")
    row = one(spark, html.table_row(F.lit("m-1 $1 $2 $3 - $5 $6 rest"), F.lit("m-1")))
    assert tuple(row.base) == (1.0, 2.0, 3.0) and tuple(row.long) == (None, 5.0, 6.0)
    eight = one(spark, html.table_row(F.lit("m-1 $1 $2 $9 $3 - - - - rest"), F.lit("m-1")))
    assert tuple(eight.base) == (1.0, 2.0, 3.0) and eight.long is None
    assert one(spark, html.section(F.lit("x A one B two A"), "B", ["A", "B"])) == "B two "


def test_closing_steps_of_a_build(spark):
    rows = [
        ("openai", "gpt 1", "standard", 2.0, None, 8.0), ("openai", "gpt 1", "batch", 1.0, None, 3.0), ("openai", "gpt-2", "standard", 4.0, 1.0, None),
        ("requesty", "openai/gpt-2", "standard", 5.0, None, None), ("requesty", "openai-responses/gpt-2", None, None, None, None),
    ]
    base = spark.createDataFrame([(*r, None, None, False, "base") for r in rows] + [("openai", "gpt-2", "flex", 9.0, None, 9.0, None, None, False, "long")], CATALOG + ", context string")
    flagship = spark.createDataFrame([("openai", "gpt 1"), ("openai", "gpt-2")], "provider string, model string")
    got = {(r.provider, r.model, r.tier, r.context): (r.input_rate, r.output_rate, r.pricing_ref) for r in catalog.finish_catalog(base, flagship).collect()}
    assert got["openai", "gpt 1", "flex", "base"] == (1.0, 3.0, None)
    assert got["openai", "gpt-2", "flex", "base"] == (2.0, None, None)
    assert got["openai", "gpt1", None, "base"] == (None, None, "gpt 1")
    assert got["requesty", "openai/gpt-2", "flex", "base"] == (2.0, None, None)
    assert got["requesty", "openai/gpt-2", "flex", "long"] == (9.0, 9.0, None)
    assert {t for p, m, t, c in got if m == "openai-responses/gpt-2" and c == "base"} == {"standard", "flex"}


def test_keys_dropped_at_any_depth(spark):
    df = spark.sql("select named_struct('status', 1, 'a', array(named_struct('status', 2, 'b', map('status', 3, 'c', 4)), null), 'd', cast(null as struct<status: int, e: int>)) as v")
    got = df.select(F.to_json(drop_key(F.col("v"), df.schema["v"].dataType, "status")).alias("j")).first().j
    assert got == '{"a":[{"b":{"c":4}},null]}'
