"""The registered queries and the pipeline over the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from ratewise.llm import queries

from llm_data import frame, rows
from test_texts import contaminated, linked, removed

SF = "/root/testdata/sf0.001"


def test_registration():
    names = [n for n in entry_module.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry_module.queries()["pipeline"] is corpus_pipeline.run
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_stages_against_plain_definitions(spark, tmp_path):
    data = [(r[0], r[1], r[2], r[3], r[4]) for r in rows(12, 70)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame([(1, data[1][1]), (2, "nothing of it")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.createDataFrame(data, schema), data
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        got = docs.collect()
        if name == "language_id":
            kept = [r for r in kept if r[1] is not None and any(c.isalpha() for c in r[1])]
        elif name == "jaccard_join":
            label, _ = linked(kept)
            kept = [r for r, k in zip(kept, label) if r[0] == k]
        elif name == "substring_dedup":
            cut = removed([(r[0], r[1]) for r in kept], 20)
            kept = [r if len(w) == n else (*r[:1], " ".join(w), *r[2:4], len(" ".join(w))) for r, (n, w) in zip(kept, cut.values())]
        elif name == "decontamination":
            items = [("1", data[1][1]), ("2", "nothing of it")]
            kept = [r for r in kept if not contaminated(r[1], items, 13)[-1]]
        else:
            assert sorted({r.doc_id for r in got}) == sorted(r[0] for r in kept)
            continue
        assert docs.columns == corpus_pipeline.COLUMNS
        assert sorted(map(tuple, got)) == sorted(kept)
        assert kept


def test_repeated_rows_and_null_ids_in_every_stage(spark, tmp_path):
    text = "der und die nicht mit das ist ein " * 3
    data = [(1, text, "de", "a", 1), (1, text, "de", "a", 1), (2, text + "x", "de", "a", 1), (None, "one more text of its own here", "en", None, None), (None, None, None, None, None), (3, "", None, "a", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "not found anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() >= 0
    once = corpus_pipeline.jaccard_join(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in once) == ["1", "3", "None", "None"]


def test_rows_without_or_with_a_shared_id_are_judged_by_themselves(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(30))
    clean = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    named = lambda pairs: spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in pairs], schema)
    left = lambda df: sorted((repr(r.doc_id), r.text) for r in df.collect())
    data = [(None, item), (None, clean[0]), (7, item), (7, clean[1]), (8, clean[2])]
    assert left(corpus_pipeline.decontamination(spark, named(data), str(tmp_path))) == [("7", clean[1]), ("8", clean[2]), ("None", clean[0])]
    # Namesakes with texts of their own stay, also where one of them is a copy of an earlier row; equal rows stay once.
    # Of a class whose rows all lack an id one stays as well.
    data = [(1, clean[0]), (2, clean[0]), (2, clean[1]), (3, clean[2]), (3, clean[3]), (3, clean[3]), (None, clean[0]), (None, item), (None, item), (None, item + " x")]
    kept = left(corpus_pipeline.jaccard_join(spark, named(data), str(tmp_path)))
    assert kept[-1][0] == "None" and kept[-1][1].startswith(item)
    kept, want = kept[:-1], [("1", clean[0]), ("2", clean[1]), ("3", clean[2]), ("3", clean[3])]
    assert kept == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, rel.fetchall()))


def test_empty_tables(spark, tmp_path):
    empty = frame(spark, [])
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, plan in {**queries.QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert plan(spark, str(tmp_path)).count() == 0, name
