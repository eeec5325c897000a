"""One registered query per operator: thin digests of what the operators return over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratewise.llm import alignment, contamination, counts, fingerprints, idfiles, jaccard, language, packing, pii, scoring, substrings, urls, whitening
from ratewise.session import scratch_path

Plan = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as shard files and read back from them."""
    root = scratch_path(spark, "ids")
    idfiles.write_ids(table(spark, sf_dir, "documents"), root, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    back = idfiles.read_ids(spark, root, arrays=False)
    return back.select(F.when(F.col("doc") != idfiles.NO_ID, F.col("doc")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in bins of 4096 ids, one text per source and copy group in a bin."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    found = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    edited = F.sha2(F.col("edited"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in 20-word passages that start earlier are removed."""
    done = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a network trained on all of them."""
    return scoring.fit_and_score(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text."""
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the four folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    fitted = language.train(docs.filter(~language.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    return language.identify(docs, fitted, others={"held_out": language.held_out()})


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all 13-word windows of the benchmark."""
    found = contamination.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    named = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), "contaminated")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, similarity 0.8 or more."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, size=5)


# The tables hold neither fetch days nor lists. A page's fetch day and a pattern's three dated entries come from digests of their text.
FETCHED = "date_add(date'2024-01-01', cast(conv(substr(md5(url), 1, 4), 16, 10) as int) % 730)"
LISTED = "date_add(date'2024-01-01', cast(conv(substr(md5(concat(pattern, k)), 1, 4), 16, 10) as int) % 730)"
ACTION = "element_at(array('block', 'allow', 'remove'), cast(conv(substr(md5(concat(pattern, k)), 5, 4), 16, 10) as int) % 3 + 1)"


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the dated entries of all hosts, parent domains and first path segments."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    name = urls.host(F.col("url"))
    patterns = F.array(name, F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1), F.concat_ws("/", name, urls.path_segments(F.col("url"))[0]))
    entries = pages.select(F.explode(patterns).alias("pattern")).distinct().withColumn("k", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))))
    entries = entries.select("pattern", F.expr(ACTION).alias("action"), F.expr(LISTED).alias("listed_on"))
    return urls.evaluate(pages.withColumn("fetched_on", F.expr(FETCHED)), entries).select("page_id", F.col("fetched_on").cast("string").alias("fetched_on"), "pattern", "action", "blocked")


OP10 = """
WITH shots AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(('0x' || substr(md5(url), 1, 4)) AS INT) % 730 AS fetched,
         lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
cut AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM shots),
listed AS (
  SELECT pattern, DATE '2024-01-01' + CAST(('0x' || substr(md5(pattern || k), 1, 4)) AS INT) % 730 AS day,
         ['block', 'allow', 'remove'][CAST(('0x' || substr(md5(pattern || k), 5, 4)) AS INT) % 3 + 1] AS action
  FROM (SELECT DISTINCT unnest([host, array_to_string(labels[-2:], '.'), host || coalesce('/' || segments[1], '')]) AS pattern FROM cut), (VALUES ('0'), ('1'), ('2')) v(k)
),
days AS (SELECT pattern, day, max(action) AS action FROM listed GROUP BY ALL),
asked AS (
  SELECT page_id, fetched, host, segments, unnest(list_distinct(
    list_concat(list_transform(range(1, greatest(len(labels), 2)), lambda i: array_to_string(labels[i:], '.')),
                list_transform(range(1, least(len(segments), 2) + 1), lambda i: host || '/' || array_to_string(segments[1:i], '/'))))) AS pattern
  FROM cut
),
latest AS (
  SELECT page_id, a.pattern, arg_max(action, day) AS action FROM asked a JOIN days d ON a.pattern = d.pattern AND d.day <= a.fetched GROUP BY ALL
),
verdict AS (SELECT page_id, max((length(pattern), pattern, action)) AS e FROM latest WHERE action <> 'remove' GROUP BY ALL)
SELECT page_id, CAST(fetched AS VARCHAR) AS fetched_on, e[2] AS pattern, e[3] AS action, coalesce(e[3] = 'block', false) AS blocked
FROM shots LEFT JOIN verdict USING (page_id)
"""

def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the byte-level tokens (A) and pieces (B) of every whole text."""
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    return alignment.align(table(spark, sf_dir, "documents"), *files, pattern=public_tokenizers.PATTERN)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the plain forms, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    plain = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter(plain, lambda s: s["kind"] == k)
    counts_of = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *counts_of, F.sha2(named(plain), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on its table's first 32 whitening components."""
    rows, found = whitening.whiten(table(spark, sf_dir, "embeddings"), most=32)
    if found is None:
        n, share, error = 0, F.array().cast("array<double>"), None
    else:
        n, share, error = found.n, F.array(*[F.lit(float(e)) for e in found.explained[:32]]), whitening.identity_error(rows, found)
    each = rows.select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


QUERIES: dict[str, Plan] = {
    "op1_token_id_output": op1_token_id_output,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_url_filters": op10_url_filters,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_pii": op12_pii,
    "op13_embedding_whitening": op13_embedding_whitening,
}
SQL: dict[str, str] = {"op10_url_filters": OP10}
