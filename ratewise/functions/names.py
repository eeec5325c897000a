"""Run names and artefact paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Provider slugs that may lead the tail of an old-style name, and the metrics folder.
OLD_STYLE_PROVIDERS = [
    "openai", "anthropic", "cohere", "google", "huggingface", "einfra", "requesty", "vertex",
]
METRICS_DIR = "../data/metrics"

_STAMP = r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2})"
_NEW_STYLE = rf"(?i)^(.*)__(.*?)__(.*?)__{_STAMP}(?:__(.+))?$"
_OLD_STYLE = rf"(?i)^(.*)_out_(.+)_{_STAMP}(?:__(.+))?$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(forward_slashes(path), "/"), -1)


def forward_slashes(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")


def run_stem(file: Column) -> Column:
    """File name without its metrics, calibration or heat-map ending."""
    cut = F.regexp_replace(file, r"(?i)__(metrics|calibration|heatmap)\.(json|png)$", "")
    return F.regexp_replace(cut, r"(?i)_(metrics|calibration|confusion_heatmap)\.(json|png)$", "")


def metrics_base(file: Column) -> Column:
    """Stem used by the consistency checks: metrics ending, else the last extension."""
    return (
        F.when(file.endswith("__metrics.json"), F.regexp_replace(file, r"__metrics\.json$", ""))
        .when(file.endswith("_metrics.json"), F.regexp_replace(file, r"_metrics\.json$", ""))
        .otherwise(F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""))
    )


def parse_run_name(stem: Column) -> Column:
    """Struct ``task, provider, model, timestamp, extra`` from a run stem, new style before old style."""
    is_new = F.regexp_like(stem, F.lit(_NEW_STYLE))
    is_old = F.regexp_like(stem, F.lit(_OLD_STYLE))

    def new(i: int) -> Column:
        return F.regexp_extract(stem, _NEW_STYLE, i)

    def old(i: int) -> Column:
        return F.regexp_extract(stem, _OLD_STYLE, i)

    tail = old(2)
    tokens = F.filter(F.split(tail, "_"), lambda x: x != "")
    known = F.lower(F.get(tokens, F.lit(0))).isin(*OLD_STYLE_PROVIDERS) & (F.size(tokens) > 1)
    rest = F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), "_")
    old_model = F.when(F.size(tokens) == 1, F.get(tokens, F.lit(0))).when(known, rest).otherwise(tail)
    new_model = F.when(new(3) == "", F.lit("unknown")).otherwise(new(3))
    return F.struct(
        F.when(is_new, new(1)).when(is_old, old(1)).otherwise(stem).alias("task"),
        F.when(is_new, new(2)).when(is_old & known, F.get(tokens, F.lit(0))).otherwise(F.lit("")).alias("provider"),
        F.when(is_new, new_model).when(is_old, old_model).otherwise(F.lit("unknown")).alias("model"),
        F.when(is_new, new(4)).when(is_old, old(3)).alias("timestamp"),
        F.when(is_new, new(5)).when(is_old, old(4)).otherwise(F.lit("")).alias("extra"),
    )


def split_stem_from_right(stem: Column) -> Column:
    """Struct ``task, provider, model, timestamp`` counted from the last ``__``; parts that are missing or empty are null."""
    parts = F.split(stem, "__", -1)
    n = F.size(parts)
    lead = F.array_join(F.slice(parts, 1, F.greatest(n - 3, F.lit(1))), "__")

    def part(from_end: int) -> Column:
        p = F.get(parts, n - from_end)
        return F.when(p != "", p)

    four, three = n >= 4, n == 3
    return F.struct(
        F.when(four, lead).when(three, F.get(parts, F.lit(0))).otherwise(stem).alias("task"),
        F.when(four, part(3)).when(three, part(2)).alias("provider"),
        F.when(four, part(2)).when(three, part(1)).alias("model"),
        F.when(four, part(1)).alias("timestamp"),
    )


def provider_and_model_from_left(stem: Column) -> Column:
    """Struct ``provider, model``: second and third part, or the whole stem as model."""
    parts = F.split(stem, "__", -1)
    enough = F.size(parts) >= 3
    return F.struct(
        F.when(enough, F.get(parts, F.lit(1))).otherwise(F.lit("")).alias("provider"),
        F.when(enough, F.get(parts, F.lit(2))).otherwise(stem).alias("model"),
    )


def stamp_in_name(name: Column) -> Column:
    """Compact timestamp in a file name, or an empty string."""
    return F.regexp_extract(name, rf"__{_STAMP}", 1)


def metrics_path(path: Column) -> Column:
    """Path below the metrics folder; URLs and absolute paths stay as they are."""
    p = F.trim(forward_slashes(path))
    keep = (
        (p == "")
        | F.regexp_like(p, F.lit(r"(?i)^(https?:)?//"))
        | F.startswith(p, F.lit("/"))
        | F.regexp_like(p, F.lit("^[A-Za-z]:/"))
        | F.contains(p, F.lit("/data/metrics/"))
        | F.startswith(p, F.lit("../data/metrics/"))
    )
    bare = F.regexp_replace(p, r"^\.?/", "")
    return F.when(keep, p).otherwise(F.concat(F.lit(METRICS_DIR + "/"), bare))


def sibling_path(path: Column, sibling: str) -> Column:
    """The matching path in another artefact folder (first ``/metrics/`` replaced)."""
    p = forward_slashes(path)
    inner = F.regexp_replace(p, r"^(.*?)/metrics/", f"$1/{sibling}/")
    return (
        F.when(F.contains(p, F.lit("/metrics/")), inner)
        .when(F.startswith(p, F.lit("metrics/")), F.regexp_replace(p, "^metrics/", f"{sibling}/"))
        .otherwise(F.concat(F.lit(f"../data/{sibling}/"), file_name(p)))
    )
