"""Building and syncing the price catalogue.

Rows as in ``pricing.py`` plus ``context`` (``base`` or ``long``) where long-context rates are kept. Entry facts
(aliases, reasons, sources, notes) are a table of their own: ``provider, model, sources, notes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratewise.functions import html
from ratewise.functions.numbers import optional_rate
from ratewise.functions.text import slug, snapshot_base
from ratewise.operators.pricing import classify_entries, resolve_aliases
from ratewise.session import cut_lineage

RATES = ["input_rate", "cached_rate", "output_rate"]
# Routes of a reseller and the upstream catalogues (provider, key prefix) whose rates they share.
SHARED_ROUTES = [
    ("openai-responses/", "gpt-", [("openai", ""), ("openrouter", "openai/")]),
    ("openai/", "gpt-", [("openai", ""), ("openrouter", "openai/")]),
    ("google/", "gemini-", [("google", "models/"), ("openrouter", "google/")]),
    ("vertex/", "gemini-", [("vertex", "")]),
]
# Fixed values: (provider, route, upstream provider, upstream prefix) for tiers copied to a reseller.
FLEX_ROUTES = [
    ("openrouter", "openai/", "openai", ""), ("openrouter", "google/", "google", "models/"), ("requesty", "openai/", "openai", ""),
    ("requesty", "openai-responses/", "openai", ""), ("requesty", "google/", "google", "models/"), ("requesty", "vertex/", "vertex", ""),
]
# Reason texts.
ADDED_REASON = "Added by --update-models; fill in pricing manually."
NO_PRICE_REASON = "No compatible official per-token pricing was found for this model."


def in_context(catalog: DataFrame, context: str = "base") -> DataFrame:
    """Rows of one context; a catalogue without that column has base rates only."""
    if "context" not in catalog.columns:
        return catalog if context == "base" else catalog.filter(F.lit(False))
    return catalog.filter(F.coalesce("context", F.lit("base")) == context)


def rated(df: DataFrame) -> Column:
    return F.coalesce(*RATES).isNotNull()


def priced_models(catalog: DataFrame) -> DataFrame:
    """Entries with a rate and without an alias."""
    per = catalog.groupBy("provider", "model").agg(F.max("pricing_ref").alias("ref"), F.bool_or(rated(catalog)).alias("has"))
    return per.filter(F.col("ref").isNull() & F.col("has")).select("provider", "model")


def metadata_prices(metadata: DataFrame) -> DataFrame:
    """Standard tier from per-token costs of provider metadata; models without any cost are left out."""
    per_million = [(optional_rate(F.col(c)) * 1_000_000).alias(r) for c, r in zip(("input_cost", "cached_cost", "output_cost"), RATES)]
    rows = metadata.select("provider", "model", F.lit("standard").alias("tier"), *per_million)
    return rows.filter(F.coalesce(*RATES).isNotNull())


def merge_tiers(rows: DataFrame) -> DataFrame:
    """One row per model and tier from ranked sources: each rate from the first source that has it.

    ``rows``: ``provider, model, context, tier, rank`` and the rates. Long-context tiers come from one source, the
    first that has any.
    """
    first_long = rows.filter("context = 'long'").groupBy("provider", "model").agg(F.min("rank").alias("__long"))
    kept = rows.join(first_long, ["provider", "model"], "left").filter((F.col("context") != "long") | (F.col("rank") == F.col("__long")))
    def first(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct("rank", c)))[c].alias(c)

    return kept.groupBy("provider", "model", "context", "tier").agg(*[first(c) for c in RATES])


def merge_facts(facts: DataFrame) -> DataFrame:
    """Sources of all ranked entries in order without repeats, notes sorted without repeats.

    ``facts``: ``provider, model, rank, sources array<struct<label, url>>, notes array<string>``.
    """
    src = facts.select("provider", "model", "rank", F.posexplode("sources").alias("pos", "s"))
    src = src.filter((F.trim(F.col("s.label")) != "") & (F.trim(F.col("s.url")) != ""))
    once = src.groupBy("provider", "model", F.trim(F.col("s.label")).alias("label"), F.trim(F.col("s.url")).alias("url")).agg(F.min(F.struct("rank", "pos")).alias("o"))
    sources = once.groupBy("provider", "model").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "label", "url"))), lambda x: F.struct(x["label"].alias("label"), x["url"].alias("url"))).alias("sources")
    )
    notes = facts.select("provider", "model", F.explode("notes").alias("n")).groupBy("provider", "model").agg(F.array_sort(F.collect_set("n")).alias("notes"))
    return sources.join(notes, ["provider", "model"], "full")


def missing_models(config: DataFrame, catalog: DataFrame) -> DataFrame:
    """Configured models the catalogue lacks, as unpriced entries."""
    have = catalog.select("provider", "model").distinct()
    return config.select("provider", "model").distinct().join(have, ["provider", "model"], "left_anti").select(
        "provider", "model", F.lit("standard").alias("tier"), *[F.lit(None).cast("double").alias(r) for r in RATES],
        F.lit(None).cast("string").alias("pricing_ref"), F.lit(ADDED_REASON).alias("reason"), F.lit(True).alias("needs_manual"),
    )


def slug_aliases(catalog: DataFrame) -> DataFrame:
    """Alias rows from the slug of a model to its key, where the slug is free; the first key in order gets it."""
    keys = catalog.select("provider", "model").distinct()
    s = keys.withColumn("slug", slug(F.col("model"))).filter(F.col("slug") != F.col("model"))
    free = s.join(keys.select("provider", F.col("model").alias("slug")), ["provider", "slug"], "left_anti")
    first = free.groupBy("provider", "slug").agg(F.min("model").alias("pricing_ref"))
    return first.select(
        "provider", F.col("slug").alias("model"), F.lit(None).cast("string").alias("tier"), *[F.lit(None).cast("double").alias(r) for r in RATES],
        "pricing_ref", F.lit(None).cast("string").alias("reason"), F.lit(False).alias("needs_manual"),
    )


def overlay(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """Catalogue in which the models of ``rows`` replace entries of the same key."""
    keys = rows.select("provider", "model").distinct()
    return catalog.join(keys, ["provider", "model"], "left_anti").unionByName(rows, allowMissingColumns=True)


def sync_catalog(catalog: DataFrame, config: DataFrame, metadata: DataFrame) -> DataFrame:
    """Existing entries, metadata prices for entries without a price, open entries for missing models, slug aliases."""
    meta = metadata_prices(metadata).join(config.select("provider", "model").distinct(), ["provider", "model"], "left_semi")
    fresh = meta.join(priced_models(catalog), ["provider", "model"], "left_anti")
    none = F.lit(None).cast("string")
    # Both stages are read several times, so each is written once.
    synced = cut_lineage(overlay(catalog, fresh.select("*", none.alias("pricing_ref"), none.alias("reason"), F.lit(False).alias("needs_manual"))), "synced")
    full = cut_lineage(synced.unionByName(missing_models(config, synced), allowMissingColumns=True), "catalogue")
    return full.unionByName(slug_aliases(full), allowMissingColumns=True)


def inherited_rates(catalog: DataFrame, resolved: DataFrame, reseller: str = "requesty", routes=SHARED_ROUTES) -> DataFrame:
    """Tiers that unpriced routed models of a reseller take from the first upstream catalogue that prices them.

    The first route whose prefix fits decides. A vertex name with a region is tried without it too.
    ``resolved``: result of ``resolve_aliases``.
    """
    done = priced_models(catalog).unionByName(catalog.filter(F.col("pricing_ref").isNotNull()).select("provider", "model").distinct())
    open_ = catalog.filter(F.col("provider") == reseller).select("provider", "model").distinct().join(done, ["provider", "model"], "left_anti")
    table = F.array(*[
        F.struct(F.lit(prefix).alias("prefix"), F.lit(family).alias("family"), F.array(*[
            F.struct(F.lit(p).alias("provider"), F.lit(x).alias("lead")) for p, x in sources
        ]).alias("sources")) for prefix, family, sources in routes
    ])
    fit = F.filter(table, lambda r: F.startswith(F.col("model"), r["prefix"]))
    routed = open_.withColumn("route", F.get(fit, F.lit(0))).filter(F.col("route").isNotNull())
    tail = F.substring(F.col("model"), F.length("route.prefix") + 1, F.length("model"))
    routed = routed.withColumn("tail", tail).filter(F.startswith(F.col("tail"), F.col("route.family")))
    tries = routed.select("provider", "model", "tail", F.posexplode("route.sources").alias("pos", "s"))
    base = F.regexp_replace("tail", "@(eu|us)$", "")
    names = F.when((F.col("s.provider") == "vertex") & (base != F.col("tail")), F.array(F.col("tail"), base)).otherwise(F.array("tail"))
    tries = tries.select("provider", "model", "pos", F.col("s.provider").alias("up"), F.col("s.lead").alias("lead"), F.posexplode(names).alias("sub", "name"))
    keyed = tries.withColumn("key", F.concat("lead", "name"))
    hits = keyed.join(resolved.filter("kind = 'priced'").select(F.col("provider").alias("up"), F.col("model").alias("key"), "resolved"), ["up", "key"])
    best = hits.groupBy("provider", "model").agg(F.min(F.struct("pos", "sub", "up", "resolved")).alias("b")).select(
        "provider", "model", F.col("b.up").alias("up"), F.col("b.resolved").alias("resolved")
    )
    tiers = in_context(catalog).filter(F.col("tier").isNotNull()).select(F.col("provider").alias("up"), F.col("model").alias("resolved"), "tier", *RATES)
    return best.join(tiers, ["up", "resolved"]).select("provider", "model", "tier", *RATES, F.col("up").alias("inherited_from"))


def copied_tiers(catalog: DataFrame, resolved: DataFrame, tier: str = "flex", routes=FLEX_ROUTES) -> DataFrame:
    """A tier taken over from upstream by priced, routed models that lack it, in both contexts.

    The long-context rates of the tier come along where the model has none of its own. Rows carry ``context``, ``inherited_from`` and
    ``inherited_model``; :func:`copied_facts` brings the sources and notes.
    """
    long = in_context(catalog, "long")
    catalog = in_context(catalog)
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("to", "prefix", "up", "lead"))]) for r in routes])
    have = catalog.filter(F.col("tier") == tier).select("provider", "model").distinct()
    targets = priced_models(catalog).join(have, ["provider", "model"], "left_anti")
    fit = F.filter(table, lambda r: (r["to"] == F.col("provider")) & F.startswith(F.col("model"), r["prefix"]))
    t = targets.select("provider", "model", F.explode(fit).alias("r"))
    t = t.select("provider", "model", F.col("r.up").alias("up"), F.concat(F.col("r.lead"), F.substring(F.col("model"), F.length("r.prefix") + 1, F.length("model"))).alias("key"))
    hits = t.join(resolved.filter("kind = 'priced'").select(F.col("provider").alias("up"), F.col("model").alias("key"), "resolved"), ["up", "key"])
    # Several routes may lead to one upstream entry; the first name in order stands for them.
    hits = hits.groupBy("provider", "model").agg(F.min(F.struct("up", "resolved")).alias("h")).select("provider", "model", "h.*")

    def rates(of: DataFrame, context: str) -> DataFrame:
        return of.filter(F.col("tier") == tier).select(F.col("provider").alias("up"), F.col("model").alias("resolved"), "tier", *RATES, F.lit(context).alias("context"))

    copied = hits.join(rates(catalog, "base"), ["up", "resolved"])
    own_long = long.filter(F.col("tier") == tier).select("provider", "model").distinct()
    longer = copied.select("provider", "model", "up", "resolved").join(own_long, ["provider", "model"], "left_anti").join(rates(long, "long"), ["up", "resolved"])
    return copied.unionByName(longer).select(
        "provider", "model", "tier", *RATES, "context", F.col("up").alias("inherited_from"), F.col("resolved").alias("inherited_model"),
    )


def copied_facts(facts: DataFrame, copied: DataFrame, note: str | None = None) -> DataFrame:
    """Sources and notes of models that took a tier over: their own, then the upstream entry's sources, and a note."""
    models = copied.select("provider", "model", "inherited_from", "inherited_model").distinct()
    own = models.join(facts, ["provider", "model"]).select("provider", "model", F.lit(0).alias("rank"), "sources", "notes")
    up = facts.select(F.col("provider").alias("inherited_from"), F.col("model").alias("inherited_model"), "sources")
    said = F.array(F.lit(note)) if note else F.array().cast("array<string>")
    theirs = models.join(up, ["inherited_from", "inherited_model"], "left").select("provider", "model", F.lit(1).alias("rank"), "sources", said.alias("notes"))
    return merge_facts(own.unionByName(theirs))


def derived_flex(catalog: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Flex tier of priced models that lack it: the batch tier, else half of standard."""
    catalog = in_context(catalog)
    base = priced_models(catalog)
    if models is not None:
        base = base.join(models.select("provider", "model"), ["provider", "model"], "left_semi")
    t = catalog.filter(F.col("tier").isNotNull())
    rate = F.struct(*RATES)
    wide = t.join(base, ["provider", "model"], "left_semi").groupBy("provider", "model").agg(
        F.max(F.when(F.col("tier") == "flex", F.lit(True))).alias("flex"),
        F.max(F.when(F.col("tier") == "batch", rate)).alias("batch"),
        F.max(F.when(F.col("tier") == "standard", rate)).alias("standard"),
    )
    open_ = wide.filter(F.col("flex").isNull() & (F.col("batch").isNotNull() | F.col("standard").isNotNull()))
    value = [F.when(F.col("batch").isNotNull(), F.col(f"batch.{r}")).otherwise(F.col(f"standard.{r}") * 0.5).alias(r) for r in RATES]
    return open_.select("provider", "model", F.lit("flex").alias("tier"), *value)


def equivalent_entries(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs ``provider, candidate, target`` where every tier of the candidate equals the target's."""
    catalog = in_context(catalog)
    t = catalog.filter(F.col("tier").isNotNull())
    a = t.select("provider", F.col("model").alias("candidate"), "tier", *[F.col(r).alias(f"a_{r}") for r in RATES])
    b = t.select("provider", F.col("model").alias("target"), "tier", *[F.col(r).alias(f"b_{r}") for r in RATES], F.lit(True).alias("found"))
    same = F.coalesce(F.col("found"), F.lit(False))
    for r in RATES:
        same = same & F.col(f"a_{r}").eqNullSafe(F.col(f"b_{r}"))
    priced = priced_models(catalog)
    both = pairs.join(priced.withColumnRenamed("model", "candidate"), ["provider", "candidate"], "left_semi").join(
        priced.withColumnRenamed("model", "target"), ["provider", "target"], "left_semi"
    )
    judged = both.join(a, ["provider", "candidate"]).join(b, ["provider", "target", "tier"], "left")
    return judged.groupBy("provider", "candidate", "target").agg(F.bool_and(same).alias("same")).filter("same").drop("same")


def build_catalog(config: DataFrame, sources: DataFrame, metadata: DataFrame, aliases: DataFrame) -> DataFrame:
    """Catalogue of the configured models: dated name of an equal entry, fixed alias, page price, metadata price, unsupported.

    ``sources`` are catalogue rows from pages, ``aliases`` are ``provider, model, target`` used only if the target
    has an entry.
    """
    # Both are read by every stage: written once, they are scanned instead of derived again.
    models = cut_lineage(config.select("provider", "model").distinct(), "models")
    sources = cut_lineage(in_context(sources), "sources")
    known = sources.select("provider", "model").distinct()
    dated = models.withColumn("target", snapshot_base(F.col("model"))).filter(F.col("target").isNotNull()).join(
        known.withColumnRenamed("model", "target"), ["provider", "target"], "left_semi"
    )
    own = dated.join(known, ["provider", "model"], "left_semi")
    equal = equivalent_entries(own.select("provider", F.col("model").alias("candidate"), "target"), sources).select(
        "provider", F.col("candidate").alias("model"), "target"
    )
    by_date = dated.join(known, ["provider", "model"], "left_anti").select("provider", "model", "target").unionByName(equal).withColumn("stage", F.lit(1)).withColumn("alias_kind", F.lit("snapshot"))
    by_name = aliases.join(known.withColumnRenamed("model", "target"), ["provider", "target"], "left_semi").select(
        "provider", "model", "target"
    ).withColumn("stage", F.lit(2)).withColumn("alias_kind", F.lit("provider_alias"))
    none, zero = F.lit(None).cast("string"), [F.lit(None).cast("double").alias(r) for r in RATES]
    alias_rows = by_date.unionByName(by_name).select(
        "provider", "model", "stage", none.alias("tier"), *zero, F.col("target").alias("pricing_ref"), "alias_kind", none.alias("reason"), F.lit(False).alias("needs_manual")
    )
    from_pages = sources.join(priced_models(sources), ["provider", "model"], "left_semi").filter(F.col("tier").isNotNull()).select(
        "provider", "model", F.lit(3).alias("stage"), "tier", *RATES, none.alias("pricing_ref"), none.alias("alias_kind"), none.alias("reason"), F.lit(False).alias("needs_manual")
    )
    from_meta = metadata_prices(metadata).select(
        "provider", "model", F.lit(4).alias("stage"), "tier", *RATES, none.alias("pricing_ref"), none.alias("alias_kind"), none.alias("reason"), F.lit(False).alias("needs_manual")
    )
    unsupported = models.select(
        "provider", "model", F.lit(5).alias("stage"), none.alias("tier"), *zero, none.alias("pricing_ref"), none.alias("alias_kind"), F.lit(NO_PRICE_REASON).alias("reason"), F.lit(False).alias("needs_manual")
    )
    options = alias_rows.unionByName(from_pages).unionByName(from_meta).unionByName(unsupported)
    wanted = cut_lineage(options.join(models, ["provider", "model"], "left_semi"), "options")
    first = wanted.groupBy("provider", "model").agg(F.min("stage").alias("stage"))
    return wanted.join(first, ["provider", "model", "stage"], "left_semi").drop("stage")


def finish_catalog(catalog: DataFrame, flagship: DataFrame, reseller: str = "requesty", shared=SHARED_ROUTES, flex=FLEX_ROUTES) -> DataFrame:
    """Closing steps of a build: slug aliases, flex tiers, rates shared by a reseller's routes, and flex tiers once more.

    ``flagship``: ``provider, model`` whose flex tier may be derived from the batch or standard tier.
    """
    def with_flex(rows: DataFrame) -> DataFrame:
        rows = cut_lineage(rows.unionByName(derived_flex(rows, flagship), allowMissingColumns=True), "flex")
        resolved = resolve_aliases(classify_entries(in_context(rows)))
        return cut_lineage(rows.unionByName(copied_tiers(rows, resolved, "flex", flex).drop("inherited_from", "inherited_model"), allowMissingColumns=True), "copied")

    if "context" not in catalog.columns:
        catalog = catalog.withColumn("context", F.lit("base"))
    full = with_flex(catalog.unionByName(slug_aliases(catalog), allowMissingColumns=True))
    found = inherited_rates(full, resolve_aliases(classify_entries(in_context(full))), reseller, shared).drop("inherited_from")
    done = with_flex(cut_lineage(overlay(full, found), "shared"))
    return done.withColumn("context", F.coalesce("context", F.lit("base"))).withColumn("needs_manual", F.coalesce("needs_manual", F.lit(False)))


def detail_links(pages: DataFrame, models: DataFrame) -> DataFrame:
    """Detail page per routed model: the first link of the provider's page with the same normalised tail.

    ``pages``: ``provider, html``; ``models``: ``model`` as ``provider/tail``.
    """
    tails = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "")
    hrefs = pages.select("provider", F.posexplode(html.links(F.col("html"))).alias("pos", "href"))
    rest = F.regexp_extract("href", r"^(?:https://www\.requesty\.ai)?/models/([^/]+)/(.*)$", 2)
    route = F.regexp_extract("href", r"^(?:https://www\.requesty\.ai)?/models/([^/]+)/(.*)$", 1)
    found = hrefs.filter(route == F.col("provider")).select("provider", "pos", "href", tails(rest).alias("tail")).filter(F.col("tail") != "")
    first = found.groupBy("provider", "tail").agg(F.min(F.struct("pos", "href")).alias("f"))
    m = models.filter(F.contains("model", F.lit("/"))).select(
        "model", F.lower(F.trim(F.split("model", "/")[0])).alias("provider"), tails(F.regexp_extract("model", "^[^/]*/(.*)$", 1)).alias("tail")
    )
    href = F.col("f.href")
    full = F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit("https://www.requesty.ai"), href))
    return m.join(first, ["provider", "tail"]).select("model", full.alias("url"))


def page_entries(priced: DataFrame, overrides: DataFrame, aliases: DataFrame, unsupported: DataFrame) -> DataFrame:
    """Source entries of a provider: merged page prices (base and long context), replaced by overrides, aliases to existing
    entries, unsupported last.

    ``priced``: as for :func:`merge_tiers`; others are catalogue rows (``aliases``: ``provider, model, target``).
    """
    none = F.lit(None).cast("string")
    base = merge_tiers(priced).select(
        "*", none.alias("pricing_ref"), none.alias("reason"), F.lit(False).alias("needs_manual")
    )
    full = overlay(base, overrides)
    known = full.select("provider", F.col("model").alias("target")).distinct()
    links = aliases.join(known, ["provider", "target"], "left_semi").select(
        "provider", "model", none.alias("tier"), *[F.lit(None).cast("double").alias(r) for r in RATES], F.col("target").alias("pricing_ref"), none.alias("reason"), F.lit(False).alias("needs_manual")
    )
    return overlay(overlay(full, links), unsupported)
