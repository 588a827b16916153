"""Exact quantiles and ranks without sorting one group in one task.

Values fall into buckets by an order-preserving formula: 2^20 buckets per doubling of
magnitude, at every magnitude.  Counting buckets is a small partial aggregate; only the
buckets a quantile falls into are looked at value by value, and equal values are counted
first.  Running counts have two levels, doublings and the buckets inside one, so that no
task sees more than about 4,300 or a million rows, with or without keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.session import row_sized


def bucket(value: Column) -> Column:
    """Non-decreasing in `value`; its integer part by 2^20 is the doubling.

    Doubles reach from 2^-1074 to 2^1024, so the shifted logarithm is positive.
    """
    scaled = F.floor((F.log2(F.abs(value)) + 1075) * 1048576)
    return F.when(value == 0, 0).otherwise(F.signum(value) * F.least(F.greatest(scaled, F.lit(1)), F.lit(2100 << 20))).cast("long")


def running(counts: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Adds `_start` (rows in smaller buckets) and `_total` to counts per bucket `_b`."""
    level = F.shiftright("_b", 20)
    coarse = counts.groupBy(*keys, level.alias("_c")).agg(F.sum(n).alias("_cn"))
    before = Window.partitionBy(*_keyed(keys)).orderBy("_c")
    coarse = coarse.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_c").alias("_c_c"),
        (F.sum("_cn").over(before) - F.col("_cn")).alias("_before_c"),
        F.sum("_cn").over(Window.partitionBy(*_keyed(keys))).alias("_total"),
    )
    same = F.col("_c") == F.col("_c_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    fine = Window.partitionBy(*keys, "_c").orderBy("_b")
    inside = F.sum(n).over(fine) - F.col(n)
    return (
        counts.withColumn("_c", level)
        .withColumn("_inside", inside)
        .join(row_sized(coarse), same)
        .withColumn("_start", F.col("_before_c") + F.col("_inside"))
        .drop("_c", "_c_c", "_inside", "_before_c", *[f"_k_{k}" for k in keys])
    )


def _keyed(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys] or [F.lit(0)]


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per key: one row per key, one column per name.
    weight: column that says how many times a row's value occurs."""
    keys = list(keys)
    times = F.lit(1) if weight is None else F.col(weight)
    base = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), times.cast("long").alias("_w")
    )
    base = base.withColumn("_b", bucket(F.col("_v")))
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    )
    counts = running(base.groupBy(*keys, "_b").agg(F.sum("_w").alias("_n")), keys, "_n").withColumn("_q", wanted)
    place = (F.col("_total") - 1) * F.col("_q.p")
    targets = (
        counts.withColumn("_frac", place - F.floor(place))
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_rank", F.when(F.col("_side") == 0, F.floor(place)).otherwise(F.ceil(place)))
        .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_n")))
        .select(
            *keys,
            "_b",
            F.col("_q.name").alias("_name"),
            "_frac",
            "_side",
            (F.col("_rank") - F.col("_start")).alias("_local"),
        )
    )
    hit = targets.select(*keys, "_b").distinct()
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v")
    values = (
        base.join(hit, [*keys, "_b"], "left_semi")
        .groupBy(*keys, "_b", "_v")
        .agg(F.sum("_w").alias("_m"))
        .withColumn("_to", F.sum("_m").over(in_bucket))
    )
    found = targets.join(values, [*keys, "_b"]).where(
        (F.col("_local") < F.col("_to")) & (F.col("_local") >= F.col("_to") - F.col("_m"))
    )
    pair = found.groupBy(*keys, "_name").agg(
        F.max("_frac").alias("_frac"),
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_hi"),
    )
    result = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    return pair.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, result)).alias(n) for n in probs]
    )


def share_at_most(
    df: DataFrame, value: str, reference: DataFrame, ref_value: str, out: str, keys: Sequence[str] = ()
) -> DataFrame:
    """100 * share of reference values <= value, for each row of `df`."""
    keys = list(keys)
    counted = (
        reference.where(F.col(ref_value).isNotNull())
        .groupBy(*keys, F.col(ref_value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    asked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    points = (
        counted.unionByName(asked.distinct().withColumn("_n", F.lit(0).cast("long")))
        .groupBy(*keys, "_v")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_b", bucket(F.col("_v")))
    )
    offsets = running(points.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn")), keys, "_bn")
    offsets = offsets.withColumnsRenamed({"_start": "_before", "_total": "_refs"})
    ranked = (
        points.withColumn("_in", F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v")))
        .join(offsets, [*keys, "_b"])
        .select(
            *keys,
            F.col("_v").alias("_w"),
            ((F.col("_before") + F.col("_in")) / F.col("_refs") * 100.0).alias(out),
        )
    )
    on = F.col(value).cast("double") == F.col("_w")
    right = ranked.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_w", out)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(right, on, "left").drop("_w", *[f"_k_{k}" for k in keys])
