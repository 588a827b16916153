"""Exact top-k search by inner product, with vectors stored dimension by dimension."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, BLOCK_QUERIES, DIMENSIONS_AT_ONCE = 2048, 2048, 16


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """vec_id, vector: floor(scale * x) of each component.

    Null vectors and vectors that hold a null, NaN or infinite component are left out,
    and so are rows without an id.
    """
    x = F.col(vector_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("vector")
    )


def search_block(ids, vectors, query_ids, queries, k, at_once=DIMENSIONS_AT_ONCE):
    """The k best of a block for each query, by branch and bound over dimension blocks.

    Vectors lie dimension by dimension, dimensions of large spread first.  After each
    dimension block a candidate's score lies within (norm of the query's remaining
    part) * (norm of its own) of what has been added up; whoever cannot reach the k-th
    best lower end is dropped and the others are moved together.  Scores are exact:
    sums of integers below 2^53, or 64-bit integers where that could be exceeded.
    """
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1] < 2**52
    kind = np.float64 if exact else np.int64
    order = np.argsort(-vectors.astype(float).std(axis=0), kind="stable")
    columns = np.ascontiguousarray(vectors[:, order].T.astype(kind))
    queries = queries[:, order].astype(kind)
    cuts = [*range(0, len(order), at_once), len(order)]
    rest = [np.sqrt((columns[c:].astype(float) ** 2).sum(axis=0)) for c in cuts[1:]]
    out = []
    for name, q in zip(query_ids, queries):
        wanted = k + int((ids == name).sum())  # the query's own row is taken out at the end
        at, table, score = np.arange(len(ids)), columns, np.zeros(len(ids), kind)
        for step, (a, b) in enumerate(zip(cuts, cuts[1:])):
            score = score + q[a:b] @ table[a:b]
            if len(at) <= wanted:
                continue
            slack = float(np.sqrt((q[b:].astype(float) ** 2).sum())) * rest[step][at] * (1 + 1e-9)
            low = np.partition(score - slack, len(at) - wanted)[len(at) - wanted]
            near = score + slack >= low - 1e-6
            if near.mean() < 0.8:
                at, score, table = at[near], score[near], table[:, near]
        fine = ids[at] != name
        at, score = at[fine], score[fine]
        best = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(best), name), ids[at[best]], score[best].astype(np.int64)))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best, ties to the smaller vec_id.

    vectors and queries: vec_id, vector (whole numbers).  Both are dealt by hash into
    blocks of bounded size; each pair of blocks is one task's work, so memory stays
    the same at any size and equal vectors spread like others.  A block hands on only
    its k best for a query.  Vectors of another length than the query's and the row of
    the query's own id are no candidates; ids that repeat are separate rows; an empty
    side gives no rows.
    """
    counts = vectors.agg(F.count(F.lit(1))).crossJoin(queries.agg(F.count(F.lit(1)))).first()
    row_blocks, query_blocks = -(-counts[0] // block_rows) or 1, -(-counts[1] // block_queries) or 1

    def dealt(df, own, own_blocks, other, other_blocks):
        spread = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
        return df.select("*", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(own_blocks)).cast("int").alias(own), spread.alias(other))

    left = dealt(vectors, "row_block", row_blocks, "query_block", query_blocks)
    right = dealt(queries, "query_block", query_blocks, "row_block", row_blocks)

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asked):
            length = rows["vector"].map(len)
            asked_length = asked["vector"].map(len)
            for n in set(asked_length) & set(length):
                mine, theirs = rows[length == n], asked[asked_length == n]
                a, b = (np.stack(x["vector"].to_list()).astype(np.int64) if n else np.zeros((len(x), 0), np.int64) for x in (mine, theirs))
                found += search_block(mine["vec_id"].to_numpy(), a, theirs["vec_id"].to_numpy(), b, k)
        if not found:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query_id", "vec_id", "score"), zip(*found))})

    keys = ["row_block", "query_block"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
