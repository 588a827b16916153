"""Exact de-duplication by content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.llm.common import SPACES


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after each run of white space became one space.
    Grouping is by 128-bit hash first and the normalised text second, so texts that
    share a hash are still told apart by their bytes.  Partial aggregation collapses
    copies inside each map task: a text that makes up a third of all rows costs one
    row per task.  The way back to the documents is a join on (hash, sha256), with one
    row per text on one side; adaptive execution splits a hot key on the other.

    Nulls and corner cases: null text counts as empty; empty texts equal each other; a
    null id never stays while its group has another id, and stays where it has none;
    rows that repeat both id and text are all flagged as staying (they are the same
    document); other columns of `docs` are ignored; an empty table gives no rows.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    keyed = rows.select("doc_id", F.unhex(F.md5("norm")).alias("hash"), "norm")
    groups = (
        keyed.groupBy("hash", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    marked = keyed.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    return marked.join(groups, ["hash", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
