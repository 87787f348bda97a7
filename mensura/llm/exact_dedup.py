"""Exact dedup: digest runs merged in a tree, DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, hot_keys, spread_join

#: The tree has this many levels at most, whatever the number of runs.
LEVELS = 3


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row a document: its digest, a second, independent hash that verifies it, its length and its run.

    The text is read once and goes no further. A null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.regexp_replace(text, SPACE, "")
    return docs.select(
        F.col(id_col).alias("id"),
        F.sha2(plain, 256).alias("digest"),
        F.xxhash64(plain).alias("check"),
        F.char_length(text).cast("long").alias("n"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(rows: DataFrame, runs: int, levels: int = LEVELS) -> DataFrame:
    """The winner and the size of each group of equal (digest, check), by merging runs level after level.

    A level joins 2**k runs, k binomial rounds in one exchange; inside a task, Spark's sort aggregation
    merges the sorted runs. After the first level, a key has one row a run left, however many rows
    share it. The rows stay verified at each level: digest and check must both be equal.
    """
    step = 2 ** max(1, math.ceil(math.log2(max(2, runs)) / levels))
    level = rows.select("run", "digest", "check", F.struct("n", (-F.col("id")).alias("neg_id")).alias("best"), F.lit(1).cast("long").alias("size"))
    while runs > 1:
        runs = math.ceil(runs / step)
        level = level.groupBy((F.col("run") / step).cast("int").alias("run"), "digest", "check").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    return level.select("digest", "check", (-F.col("best.neg_id")).alias("keep_id"), F.col("size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after all ASCII white space is deleted; a null text counts as empty,
    and so all empty texts are one group. The longest original (in code points) of a group stays, then the
    smallest id; a null id loses to any other. Rows that repeat an id are all marked kept if that id
    stays. No rows in, no rows out; other columns of docs are not read.
    """
    rows = cut(digests(docs, id_col, text_col))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    best = cut(merge_runs(rows, max(2, runs)))
    return spread_join(rows, best, ["digest", "check"], hot_keys(best, "digest", "group_size")).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
