"""Tables that grow by micro-batches and stay in few folders.

The rows of batches ``a`` to ``b - 1`` lie in the folder ``a-b``. Which folders count after ``n`` batches follows from ``n`` alone:
they are the digits of ``n`` to the base ``fan_in``, largest first, so there are less than ``fan_in`` for every digit. A batch that
completes a span of ``fan_in`` folders merges them into one. A commit names ``n`` once all folders of ``n`` are written.

A batch that is run again writes the same folders anew from the same inputs, and changes nothing: inputs of a merge stay until
``grace`` more batches have run. A reader takes the folders of the newest commit; none of them goes while fewer than ``grace``
batches follow. Batches are numbered from 0 without gaps, as a stream does, and a table belongs to one stream checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FAN_IN = 8
GRACE = 4
Span = tuple[int, int]


def level_spans(n: int, fan_in: int = FAN_IN) -> list[Span]:
    """Spans of batches that hold the first ``n`` batches."""
    size = 1
    while size * fan_in <= n:
        size *= fan_in
    spans, start = [], 0
    while start < n:
        while start + size > n:
            size //= fan_in
        spans.append((start, start + size))
        start += size
    return spans


def merged_spans(n: int, fan_in: int = FAN_IN) -> list[Span]:
    """Spans that the ``n``-th batch merges into the last span of :func:`level_spans`; none if it completes no span."""
    start, _ = level_spans(n, fan_in)[-1]
    return [] if start == n - 1 else [s for s in level_spans(n - 1, fan_in) if s[0] >= start] + [(n - 1, n)]


def add_batch(batch: DataFrame, batch_id: int, path: str, merge: Callable[[DataFrame], DataFrame], fan_in: int = FAN_IN, grace: int = GRACE) -> None:
    """Adds the rows of a batch, merges a span that is now complete, commits, and lets old folders go.

    ``merge`` makes one folder's rows out of those of several; it has to give rows of the same columns that can be merged again.
    """
    spark, n = batch.sparkSession, batch_id + 1
    batch.write.mode("overwrite").parquet(_folder(path, (batch_id, n)))
    inputs = merged_spans(n, fan_in)
    if inputs:
        rows = merge(_read(spark, path, inputs, batch.schema)).select(*batch.columns)
        rows.write.mode("overwrite").parquet(_folder(path, (inputs[0][0], n)))
    commit(spark, path, n)
    old = n - grace
    if old > 0:
        _delete(spark, [_folder(path, s) for s in merged_spans(old, fan_in)] + [_commit_folder(path, old - 1)])


def commit(spark: SparkSession, path: str, n: int) -> None:
    """Says that the folders of the first ``n`` batches are whole."""
    spark.range(n, n + 1, 1, 1).write.mode("overwrite").parquet(_commit_folder(path, n))


def committed(spark: SparkSession, path: str) -> int:
    """Number of batches in the table; the folder needs a commit, that of 0 batches at least."""
    rows = spark.read.schema("id long").option("recursiveFileLookup", True).parquet(f"{path}/commits")
    return rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).head()["n"]


def read_table(spark: SparkSession, path: str, schema: T.StructType, fan_in: int = FAN_IN) -> DataFrame:
    """Rows of all folders of the newest commit."""
    return _read(spark, path, level_spans(committed(spark, path), fan_in), schema)


def _read(spark: SparkSession, path: str, spans: list[Span], schema: T.StructType) -> DataFrame:
    if not spans:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[_folder(path, s) for s in spans])


def _folder(path: str, span: Span) -> str:
    return f"{path}/rows/{span[0]}-{span[1]}"


def _commit_folder(path: str, n: int) -> str:
    return f"{path}/commits/{n}"


def _delete(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders on whatever file system they are; one that is gone already is no error."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(conf).delete(place, True)
