"""Ordered work on station series without one task per station.

A plain ``Window.partitionBy(station)`` puts a whole station in one task; a station
that holds a third of all rows then stalls the job.  `Timeline` cuts every station
into blocks of about ``spark.fieldwatch.block.rows`` consecutive rows and gives each block
the few rows before and after it that a bounded frame needs.  Windows run per
(station, block).  What must flow over the whole series (running counts, last seen
value) is computed per block and handed on through one small row per block.

Cost: one narrow count of rows per station and time bucket, two shuffles of the rows (to
their bucket's place in the plan, and to their block).  Neither side of a join with the plan
or with what blocks hand on is ever collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.session import BLOCK_BUCKET, BLOCK_ROWS, conf, row_sized

_UNDATED = 1 << 40  # first bucket of rows without a timestamp: they sort last
_UNDATED_BUCKETS = 4096  # undated rows of a station are dealt over so many buckets by hash
_HELPERS = ("_blk", "_core", "_at", "_all", "_rn", "_tie")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(3.6e9)


def _tie_break(df: DataFrame) -> Column:
    """A hash of the row: orders rows of the same time alike in every evaluation."""
    return F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])


#: Columns that spread rows without a time; the others need not be read to count rows.
SPREAD_BY = ("temperature", "pressure", "humidity", "value", "id", "event_id")


def _spread(df: DataFrame) -> Column:
    """Number of the bucket among those of rows without a time.

    Counting rows per bucket is a pass of its own over the input, so this touches few of
    its columns.
    """
    return F.pmod(F.xxhash64(F.lit(0), *[F.col(c) for c in SPREAD_BY if c in df.columns]), F.lit(_UNDATED_BUCKETS))


def _bucket(df: DataFrame, ts: Column, unit: str) -> Column:
    """Time bucket of a row."""
    day = F.unix_date(F.to_date(ts)).cast("long")
    number = {
        "day": day,
        "hour": day * 24 + F.hour(ts),
        "minute": (day * 24 + F.hour(ts)) * 60 + F.minute(ts),
    }[unit]
    return F.coalesce(number, F.lit(_UNDATED) + _spread(df))


class Timeline:
    """A frame cut into blocks.

    lookback / lookahead: how many rows before / after a row the caller's frames reach.
    Rows of one time are ordered by `tie` (undated rows by a hash first), then by a hash of
    the row, so the order is the same in every evaluation; undated rows are spread over
    many buckets.
    ``df`` is the working frame, ``w`` the window spec over a block.  Rows with
    ``_core`` false are copies from neighbouring blocks; `done` drops them.
    """

    def __init__(
        self,
        df: DataFrame,
        station: str = "station_id",
        ts: str = "timestamp",
        tie: Sequence[str] = (),
        lookback: int = 1,
        lookahead: int = 0,
    ):
        spark = df.sparkSession
        size = int(conf(spark, BLOCK_ROWS, "65536"))
        unit = conf(spark, BLOCK_BUCKET, "day")
        self.station, self.ts = station, ts
        df = df.withColumn("_tie", F.struct(_spread(df).alias("part"), _tie_break(df).alias("hash")))
        key, bucket = F.col(station), _bucket(df, F.col(ts), unit)

        by_time = Window.partitionBy("_st").orderBy("_bk")
        start, end, blk = F.col("_c"), F.col("_c") + F.col("_n"), F.col("_b")
        plan = (
            df.groupBy(key.alias("_st"), bucket.alias("_bk"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_c", F.sum("_n").over(by_time) - F.col("_n"))
            .withColumn("_all", F.sum("_n").over(Window.partitionBy("_st")))
            .withColumn("_b", F.floor(start / size).cast("long"))
            .withColumn("_at", F.min("_c").over(Window.partitionBy("_st", "_b")))
        )
        targets = [F.array(blk)]
        if lookback:
            # Blocks that open within `lookback` rows after this bucket ends.
            first = F.greatest(blk + 1, F.floor(end / size).cast("long"))
            last = F.floor((end + (lookback - 1)) / size).cast("long")
            targets.append(
                F.when(last >= first, F.sequence(first, last)).otherwise(
                    F.array().cast("array<bigint>")
                )
            )
        if lookahead:
            # Blocks that closed within `lookahead` rows before this bucket starts.
            before = by_time.rowsBetween(-lookahead, -1)
            plan = plan.withColumn(
                "_prev", F.collect_list(F.struct(end.alias("e"), blk.alias("b"))).over(before)
            )
            targets.append(
                F.array_distinct(
                    F.transform(
                        F.filter(
                            "_prev",
                            lambda p: (p["e"] > F.col("_c") - lookahead) & (p["b"] != F.col("_b")),
                        ),
                        lambda p: p["b"],
                    )
                )
            )
        plan = plan.withColumn("_to", F.concat(*targets)).select(
            "_st", "_bk", "_b", "_at", "_all", "_to"
        )
        self.df = (
            df.join(row_sized(plan), key.eqNullSafe(F.col("_st")) & (bucket == F.col("_bk")))
            .withColumn("_blk", F.explode("_to"))
            .withColumn("_core", F.col("_blk") == F.col("_b"))
            .drop("_st", "_bk", "_b", "_to")
        )
        undated = F.when(F.col(ts).isNull(), F.col("_tie.part"))
        order = [F.col(ts).asc_nulls_last(), undated, *tie, "_tie"]
        self.w = Window.partitionBy(station, "_blk").orderBy(*order)
        self.upto = self.w.rowsBetween(Window.unboundedPreceding, 0)

    # -- within reach of the halo -------------------------------------------------
    def lag(self, col: str, n: int = 1) -> Column:
        return F.lag(col, n).over(self.w)

    def lead(self, col: str, n: int = 1) -> Column:
        return F.lead(col, n).over(self.w)

    def hours(self) -> Column:
        """Hours since the station's previous row; null on the first."""
        return hours_between(self.lag(self.ts), F.col(self.ts))

    def rows(self, before: int, after: int = 0):
        return self.w.rowsBetween(-before, after)

    # -- over the whole series ----------------------------------------------------
    def position(self) -> Column:
        """0-based row number within the station (valid on core rows)."""
        return (
            F.col("_at") + F.sum(F.when(F.col("_core"), 1).otherwise(0)).over(self.upto) - 1
        ).cast("long")

    def local(self, fn: Callable[[Column], Column], value: Column) -> Column:
        """Running aggregate from the start of the block, over its own rows only."""
        return fn(F.when(F.col("_core"), value)).over(self.upto)

    def carry(
        self,
        df: DataFrame,
        aggs: dict[str, tuple[Column, Callable[[Column], Column]]],
        backward: bool = False,
    ) -> DataFrame:
        """Attach, to each block, what the blocks before it (after it if `backward`) add up to.

        aggs: name -> (aggregate over one block's rows, aggregate over the block results).
        The result holds core rows only; a name is null where there is no such block.
        """
        names = list(aggs)
        frame = (
            Window.partitionBy(self.station)
            .orderBy(F.col("_blk").desc() if backward else F.col("_blk"))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        core = df.where("_core")
        per_block = core.groupBy(self.station, "_blk").agg(
            *[aggs[n][0].alias(n) for n in names]
        )
        handed = per_block.select(
            F.col(self.station).alias("_key_st"),
            F.col("_blk").alias("_key_blk"),
            *[aggs[n][1](F.col(n)).over(frame).alias(n) for n in names],
        )
        return core.join(
            row_sized(handed), F.col(self.station).eqNullSafe(F.col("_key_st")) & (F.col("_blk") == F.col("_key_blk"))
        ).drop("_key_st", "_key_blk")

    def running_sum(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """Add station-wide running sums; `df` must stem from this timeline."""
        inputs = {f"_x{i}": c for i, c in enumerate(columns.values())}
        df = df.withColumns({k: F.coalesce(c, F.lit(0)) for k, c in inputs.items()})
        df = df.withColumns({f"_l{k}": self.local(F.sum, F.col(k)) for k in inputs})
        df = self.carry(df, {f"_c{k}": (F.sum(k), F.sum) for k in inputs})
        for name, k in zip(columns, inputs):
            df = df.withColumn(name, F.coalesce(F.col(f"_c{k}"), F.lit(0)) + F.col(f"_l{k}"))
        return df.drop(*[p + k for k in inputs for p in ("", "_l", "_c")])

    def running_max(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """Add station-wide running maxima (null until a first value is seen)."""
        inputs = {f"_m{i}": c for i, c in enumerate(columns.values())}
        df = df.withColumns(inputs)
        df = df.withColumns({f"_l{k}": self.local(F.max, F.col(k)) for k in inputs})
        df = self.carry(df, {f"_c{k}": (F.max(k), F.max) for k in inputs})
        for name, k in zip(columns, inputs):
            df = df.withColumn(name, F.greatest(F.col(f"_c{k}"), F.col(f"_l{k}")))
        return df.drop(*[p + k for k in inputs for p in ("", "_l", "_c")])

    def running_cusum(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """Add station-wide one-sided cumulative sums s = max(0, s + x).

        s is the running sum of x less its running minimum (at most 0); a block hands on its
        total and its lowest partial sum, and the minimum over blocks needs the totals first.
        """
        inputs = {f"_u{i}": c for i, c in enumerate(columns.values())}
        df = df.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in inputs.items()})
        df = df.withColumns({f"_s{k}": self.local(F.sum, F.col(k)) for k in inputs})
        df = df.withColumns({f"_d{k}": self.local(F.min, F.col(f"_s{k}")) for k in inputs})
        core = df.where("_core")
        blocks = core.groupBy(F.col(self.station).alias("_key_st"), F.col("_blk").alias("_key_blk")).agg(
            *[F.sum(k).alias(f"_t{k}") for k in inputs], *[F.min(f"_s{k}").alias(f"_m{k}") for k in inputs]
        )
        prior = Window.partitionBy("_key_st").orderBy("_key_blk").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumns(
            {f"_b{k}": F.coalesce(F.sum(f"_t{k}").over(prior), F.lit(0.0)) for k in inputs}
        )
        blocks = blocks.withColumns(
            {f"_f{k}": F.min(F.col(f"_b{k}") + F.col(f"_m{k}")).over(prior) for k in inputs}
        )
        keep = [f"_{p}{k}" for k in inputs for p in "bf"]
        out = core.join(
            row_sized(blocks.select("_key_st", "_key_blk", *keep)),
            F.col(self.station).eqNullSafe(F.col("_key_st")) & (F.col("_blk") == F.col("_key_blk")),
        )
        for name, k in zip(columns, inputs):
            start = F.col(f"_b{k}")
            low = F.least(F.lit(0.0), F.col(f"_f{k}"), start + F.col(f"_d{k}"))
            out = out.withColumn(name, start + F.col(f"_s{k}") - low)
        return out.drop("_key_st", "_key_blk", *inputs, *[f"_{p}{k}" for k in inputs for p in "sd"], *keep)

    def done(self, df: DataFrame) -> DataFrame:
        return df.where("_core").drop(*_HELPERS)


def run_at_least(tl: Timeline, df: DataFrame, same: dict[str, Column], rows: int) -> DataFrame:
    """For each name: true on every row of a run of at least `rows` rows, where the condition
    says that a row continues the run of the row before it.  Needs a halo of `rows - 1`
    rows on both sides."""
    reach = rows - 1
    eq = {n: f"_eq{i}" for i, n in enumerate(same)}
    df = df.withColumns(
        {
            "_rn": F.row_number().over(tl.w),
            **{eq[n]: F.coalesce(c, F.lit(False)) for n, c in same.items()},
        }
    )
    after = tl.w.rowsBetween(1, reach)
    ends = {"_after": F.count(F.lit(1)).over(after)}
    for n, e in eq.items():
        broken = F.when(~F.col(e), F.col("_rn"))
        ends[f"{e}_b"] = F.max(broken).over(tl.rows(reach - 1))
        ends[f"{e}_a"] = F.min(broken).over(after)
    df = df.withColumns(ends)
    out = {}
    for n, e in eq.items():
        back = F.coalesce(F.col("_rn") - F.col(f"{e}_b"), F.lit(reach))
        ahead = F.coalesce(F.col(f"{e}_a") - F.col("_rn") - 1, F.col("_after"))
        out[n] = back + ahead >= reach
    return df.withColumns(out).drop(
        "_rn", "_after", *[x for e in eq.values() for x in (e, f"{e}_b", f"{e}_a")]
    )
