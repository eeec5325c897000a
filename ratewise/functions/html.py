"""Text, links and prices of web pages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ratewise.functions.numbers import price_text
from ratewise.functions.text import strip

MONEY = r"\$[0-9.]+"


# Character references resolved in the JVM, the ampersand last so that no new reference comes about.
COMMON = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]
RARE = r"&(?!(?:lt|gt|quot|#39|nbsp|amp);)[#\w]"
MARKUP = r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]+>"


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    # The table of names is the standard library's.
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else x)


def _resolved(text: Column) -> Column:
    """Character references resolved; only texts with other than the common ones pass through Python."""
    rare = F.regexp_like(text, F.lit(RARE))
    plain = text
    for name, value in COMMON:
        plain = F.replace(plain, F.lit(name), F.lit(value))
    return F.when(rare, _unescape(F.when(rare, text))).otherwise(plain)


def page_text(raw: Column) -> Column:
    """Readable text: scripts, styles, comments and tags out in one pass, character references resolved, white space single."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), MARKUP, " ")
    return strip(F.regexp_replace(_resolved(bare), r"(?U)\s+", " "))


def links(raw: Column) -> Column:
    """Sorted distinct link targets."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit('(?i)href="([^"]+)"'), F.lit(1))))


def money(text: Column, pattern: str, group: int) -> Column:
    """Price in a regex group; null where the pattern or the group is absent."""
    return price_text(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))


def rates(input_: Column, cached: Column, output: Column) -> Column:
    return F.struct(input_.alias("input_rate"), cached.alias("cached_rate"), output.alias("output_rate"))


# Fixed value: wording of a price block on a model page; the second such block holds batch prices.
LABELLED = (
    r"(?i)Text tokens\s+Per\s+1M tokens(?:\s+∙\s+Batch API price)?\s+Input\s+(\$[0-9.]+)"
    r"(?:\s+Cached input\s+(\$[0-9.]+))?\s+Output\s+(\$[0-9.]+)"
)
# Fixed value: the wording of route pages, output before cached input.
ROUTED = (
    r"(?i)Pricing per 1M tokens\s+Input\s+(\$[0-9.]+)\s+Output\s+(\$[0-9.]+)(?:\s+Cache write\s+\$[0-9.]+)?(?:\s+Cache read\s+(\$[0-9.]+))?"
)


def labelled_prices(text: Column) -> Column:
    """``array<struct<tier, rates>>`` of a model page: first block standard, second batch."""
    blocks = F.regexp_extract_all(text, F.lit(LABELLED), F.lit(0))
    tiers = F.transform(
        F.slice(blocks, 1, 2),
        lambda b, i: F.struct(
            F.when(i == 0, "standard").otherwise("batch").alias("tier"), rates(money(b, LABELLED, 1), money(b, LABELLED, 2), money(b, LABELLED, 3)).alias("rates")
        ),
    )
    return tiers


def routed_prices(text: Column) -> Column:
    """Rates of a route page, or null."""
    found = F.regexp_like(text, F.lit(ROUTED))
    return F.when(found, rates(money(text, ROUTED, 1), money(text, ROUTED, 3), money(text, ROUTED, 2)))


def section(text: Column, heading: str, others: list[str]) -> Column:
    """Text from a heading up to the nearest other heading; null without the heading."""
    start = F.locate(heading, text)
    after = start + len(heading)
    stops = [F.nullif(_locate_from(text, o, after), F.lit(0)) for o in others if o != heading]
    end = F.array_min(F.array(*stops)) if stops else F.lit(None).cast("int")
    size = F.coalesce(end, F.length(text) + 1) - start
    return F.when(start > 0, F.substring(text, start, size))


def _locate_from(text: Column, needle: str, start: Column) -> Column:
    """Position of ``needle`` at or after a position, 0 if there is none."""
    return F.call_function("locate", F.lit(needle), text, F.greatest(start, F.lit(1)))


def series_between(block: Column, label: str, stops: list[str], take: int = 2) -> Column:
    """First prices between a label and the nearest of the stop labels, letter case ignored."""
    low = F.lower(block)
    start = F.locate(label.lower(), low)
    ends = [F.nullif(_locate_from(low, s.lower(), start + len(label)), F.lit(0)) for s in stops]
    end = F.coalesce(F.array_min(F.array(*ends)), F.length(block) + 1) if ends else F.length(block) + 1
    part = F.substring(block, start, end - start)
    return F.when(start > 0, F.slice(F.regexp_extract_all(part, F.lit(f"({MONEY})"), F.lit(1)), 1, take)).otherwise(F.array().cast("array<string>"))


def block_prices(block: Column) -> Column:
    """``struct<base, long>`` of a tier block: first and second value of the input, cache and output series."""
    inp = series_between(block, "Input price", ["Output price", "Context caching price"])
    out = series_between(block, "Output price", ["Context caching price"])
    cache = series_between(block, "Context caching price", [])

    def at(i: int) -> Column:
        return rates(*[price_text(F.get(c, F.lit(i))) for c in (inp, cache, out)])

    more = (F.size(inp) > 1) | (F.size(out) > 1) | (F.size(cache) > 1)
    return F.struct(at(0).alias("base"), F.when(more, at(1)).alias("long"))


# Fixed value: how a tier starts inside a model section.
TIER_MARK = r"(?i)(?:###\s*(?:Standard|Batch|Flex|Priority)\b|(?:Standard|Batch|Flex|Priority)\s+Free Tier Paid Tier\b)"


def tier_blocks(section_text: Column) -> Column:
    """``array<struct<tier, block>>`` in order, ending where a tier comes a second time; empty without a standard tier."""
    marks = F.regexp_extract_all(section_text, F.lit(f"({TIER_MARK})"), F.lit(1))
    names = F.transform(marks, lambda m: F.lower(F.regexp_extract(m, r"(?i)(Standard|Batch|Flex|Priority)", 1)))
    bodies = F.slice(F.split(section_text, TIER_MARK, -1), 2, F.greatest(F.size(marks), F.lit(1)))
    zipped = F.transform(names, lambda n, i: F.struct(n.alias("tier"), F.get(bodies, i).alias("block"), (F.array_position(names, n) - 1 < i).alias("again"), i.alias("i")))
    first_repeat = F.coalesce(F.array_min(F.transform(F.filter(zipped, lambda z: z["again"]), lambda z: z["i"])), F.size(marks))
    kept = F.transform(F.filter(zipped, lambda z: z["i"] < first_repeat), lambda z: F.struct(z["tier"].alias("tier"), z["block"].alias("block")))
    ok = F.exists(kept, lambda z: z["tier"] == "standard")
    return F.when(ok, kept).otherwise(F.filter(kept, lambda z: F.lit(False)))


def _quoted(name: Column) -> Column:
    return F.regexp_replace(name, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


CELL = r"(?:\$[0-9.]+|-)"
DASHED = r"(?:\$[0-9.]+|-|—)"


def cells_after(text: Column, name: Column, run: str, cell: str = CELL, before: str = "", after: str = "") -> Column:
    """Price cells of the first run of cells behind a name; empty where there is none. A dash is a cell without a price.

    The run is taken from the end of what was found, since a name may itself hold dashes.
    """
    found = F.regexp_substr(text, F.concat(F.lit("(?is)" + before), _quoted(name), F.lit(after + run)))
    return F.coalesce(F.regexp_extract_all(F.regexp_extract(found, f"({run})$", 1), F.lit(f"({cell})"), F.lit(1)), F.array().cast("array<string>"))


def _rates_at(cells: Column, *places: int) -> Column:
    return rates(*[price_text(F.get(cells, F.lit(p))) for p in places])


def _three(cells: Column) -> Column:
    return F.when(F.size(cells) == 3, _rates_at(cells, 0, 1, 2))


def table_row(text: Column, model: Column) -> Column:
    """``struct<base, long>`` of a table row with 6 to 8 price cells after a model name.

    Eight cells hold cache-write prices at the third and seventh place, which are left out.
    """
    cells = cells_after(text, model, rf"(?:\s*{CELL}){{6,8}}")
    eight = F.size(cells) >= 8
    base = F.when(eight, _rates_at(cells, 0, 1, 3)).otherwise(_rates_at(cells, 0, 1, 2))
    long = F.when(eight, _rates_at(cells, 4, 5, 7)).otherwise(_rates_at(cells, 3, 4, 5))
    some = F.coalesce(long["input_rate"], long["cached_rate"], long["output_rate"]).isNotNull()
    return F.when(F.size(cells) >= 6, F.struct(base.alias("base"), F.when(some, long).alias("long")))


def three_cells(text: Column, model: Column) -> Column:
    """Rates of a row of three cells right after a model name, or null."""
    return _three(cells_after(text, model, rf"(?:\s+{CELL}){{3}}"))


def cells_near_label(text: Column, label: Column) -> Column:
    """Rates of the first three cells within 120 characters after a label that stands alone, or null."""
    return _three(cells_after(text, label, rf"{DASHED}(?:\s+{DASHED}){{2}}", DASHED, before=r"(?<![A-Za-z0-9.])", after=r"(?![A-Za-z0-9.-]).{0,120}?"))
