"""Text normalising: identifiers, tags, names, marked spans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the data formats read.
PROVIDER_ALIASES = {"einfra": "e-infra"}
BATCH_PROVIDER_ALIASES = {"einfra": "e-infra", "vertex": "google"}
GOOGLE_SLUG_ALIASES = {
    "gemini3flashpreview": "gemini-3-flash-preview",
    "gemini31propreview": "gemini-3.1-pro-preview",
    "gemini31flashlitepreview": "gemini-3.1-flash-lite-preview",
    "gemini35flash": "gemini-3.5-flash",
}
SERVICE_TIERS = ["standard", "flex", "priority", "batch"]
MARK_LEFT, MARK_RIGHT = "⟦", "⟧"
OLD_MARK_LEFT, OLD_MARK_RIGHT = "âź¦", "âź§"
SNAPSHOT_PREFIXES = [
    "gpt-4.1", "gpt-5", "gpt-5.1", "gpt-5.2", "gpt-5.5", "gpt-5.4", "o1-pro", "o3", "o4-mini",
]
NON_TEXT_MARKERS = [
    "audio", "image", "transcribe", "tts", "search", "moderation", "embedding", "whisper",
    "dall-e", "sora", "deep-research", "computer-use",
]


# Fixed value: the characters that count as white space at the ends of a text.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim any Unicode white space."""
    return F.trim(c, F.lit(WHITE))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Replace by a small fixed table, other values pass."""
    out = c
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def blank_to_null(c: Column) -> Column:
    t = strip(c)
    return F.when(t != "", t)


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def slug(c: Column, default: str | None = "model") -> Column:
    """Lower case, only ASCII letters and digits; blank becomes ``default``."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z]+", "")
    return s if default is None else F.when(s == "", F.lit(default)).otherwise(s)


def provider_key(c: Column) -> Column:
    return lookup(F.lower(strip(F.coalesce(c, F.lit("")))), PROVIDER_ALIASES)


def batch_provider(c: Column) -> Column:
    return lookup(strip(F.coalesce(c, F.lit(""))), BATCH_PROVIDER_ALIASES)


def batch_model(provider: Column, model: Column) -> Column:
    m = strip(model)
    bare = F.regexp_replace(m, "^models/", "")
    return F.when(provider == "google", lookup(bare, GOOGLE_SLUG_ALIASES)).otherwise(m)


def service_tier(c: Column) -> Column:
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(*SERVICE_TIERS), t).otherwise(F.lit("standard"))


def split_tags(c: Column) -> Column:
    """``a; b;;c`` to ``[a, b, c]``."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip)
    return F.filter(parts, lambda x: x != "")


def unique_non_empty(c: Column) -> Column:
    """Distinct trimmed strings in first-seen order."""
    trimmed = F.transform(c, lambda x: strip(F.coalesce(x, F.lit(""))))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def allowed_selection(chosen: Column, allowed: Column) -> Column:
    """Distinct non-blank choices that the data offers."""
    return F.array_intersect(unique_non_empty(chosen), allowed)


def effort_suffix(thinking: Column, reasoning: Column, effort: Column) -> Column:
    """``[thinking:x, effort:y]``; empty without controls. Reasoning effort goes before effort."""
    t = blank_to_null(thinking)
    e = first_non_blank(reasoning, effort)
    parts = F.concat_ws(", ", F.concat(F.lit("thinking:"), t), F.concat(F.lit("effort:"), e))
    return F.when(parts != "", F.concat(F.lit("["), parts, F.lit("]"))).otherwise(F.lit(""))


def display_name(model: Column, suffix: Column) -> Column:
    return F.when(suffix != "", F.concat_ws(" ", model, suffix)).otherwise(model)


def header_name(name: str) -> str:
    """Normalised column header: lower case, letters and digits only."""
    return "".join(ch for ch in name.strip().lower() if ch.isascii() and ch.isalnum())


def header_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]", "")


def lexicon_norm(c: Column, lowercase: bool = True, strip_punct: bool = False) -> Column:
    v = strip(c)
    if lowercase:
        v = F.lower(v)
    if strip_punct:
        v = F.regexp_replace(v, r"(?U)[\W_]+", "")
    return v


def pos_from_info(info: Column, pattern: str, whitelist: list[str] | None = None) -> Column:
    """First regex group, else the whole text if it is a listed tag, else null."""
    text = strip(F.coalesce(info, F.lit("")))
    found = F.regexp_like(text, F.lit(pattern))
    value = blank_to_null(F.regexp_extract(text, pattern, 1))
    whole = F.when(text.isin(*whitelist), text) if whitelist else F.lit(None).cast("string")
    return F.when(text == "", F.lit(None).cast("string")).when(found, value).otherwise(whole)


def clean_pos(c: Column) -> Column:
    """Part before ``^`` and ``$``, trimmed."""
    return strip(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)^([^\^$]*)", 1))


def fold_thorn(c: Column) -> Column:
    return F.regexp_replace(c, "þ", "ð")


def drop_negation(c: Column) -> Column:
    return F.regexp_replace(c, "^ne_", "")


def _spans(node: Column, left: str, right: str) -> Column:
    found = F.regexp_extract_all(node, F.lit(f"(?s){left}(.*?){right}"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def marked_spans(node: Column) -> Column:
    """Trimmed texts between markers; the older marker pair is read only where the usual one finds nothing."""
    n = F.coalesce(node, F.lit(""))
    new = _spans(n, MARK_LEFT, MARK_RIGHT)
    return F.when(F.size(new) > 0, new).otherwise(_spans(n, OLD_MARK_LEFT, OLD_MARK_RIGHT))


def target_focus(node: Column) -> Column:
    return F.when(F.size(marked_spans(node)) > 0, F.lit("marked_subspan")).otherwise(F.lit("node"))


def target_text(node: Column) -> Column:
    spans = marked_spans(node)
    return F.when(F.size(spans) > 0, F.array_join(spans, " ")).otherwise(strip(F.coalesce(node, F.lit(""))))


def has_marker(node: Column) -> Column:
    n = F.coalesce(node, F.lit(""))
    return F.regexp_like(n, F.lit("|".join([MARK_LEFT, MARK_RIGHT, OLD_MARK_LEFT, OLD_MARK_RIGHT])))


def mark_in_context(left: Column, node: Column, right: Column) -> Column:
    """Node in brackets between its contexts, with a blank only where the context did not end in one."""
    l, n, r = (F.coalesce(c, F.lit("")) for c in (left, node, right))
    l_cut = F.regexp_replace(l, r"(?U)\s+$", "")
    r_cut = F.regexp_replace(r, r"(?U)^\s+", "")
    l_gap = F.when((l_cut == "") | F.regexp_like(l, F.lit("(?s).*[ \\n]\\z")), F.lit("")).otherwise(F.lit(" "))
    r_gap = F.when((r_cut == "") | F.regexp_like(r, F.lit("^[ \\n]")), F.lit("")).otherwise(F.lit(" "))
    body = F.when(has_marker(n), n).otherwise(F.concat(F.lit(MARK_LEFT), n, F.lit(MARK_RIGHT)))
    return strip(F.concat(l_cut, l_gap, body, r_gap, r_cut))


def snapshot_base(model: Column) -> Column:
    """Model name without its date, for families whose dated names share the undated price; else null."""
    m = F.lower(strip(model))
    dated = F.regexp_like(m, F.lit(r"-\d{4}-\d{2}-\d{2}$"))
    base = F.regexp_replace(m, r"-\d{4}-\d{2}-\d{2}$", "")
    prefixes = "|".join(p.replace(".", r"\.") for p in SNAPSHOT_PREFIXES)
    safe = F.regexp_like(base, F.lit(f"^(?:{prefixes})")) & ~F.startswith(base, F.lit("gpt-4o"))
    return F.when(dated & safe, base)


def text_model_candidate(model: Column) -> Column:
    """True for names of text models with a price page of their own."""
    m = F.lower(strip(F.coalesce(model, F.lit(""))))
    marked = F.regexp_like(m, F.lit("|".join(NON_TEXT_MARKERS)))
    return m.isin("babbage-002", "davinci-002") | (F.regexp_like(m, F.lit("^(?:gpt|o)")) & ~marked)
