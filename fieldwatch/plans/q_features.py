"""Queries: features, scaling, sequence windows, joint consistency."""


from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS, FEATURES, SEQUENCE_ERROR_THRESHOLD
from fieldwatch.operators import cleaning, features, multivariate, sequences
from fieldwatch.operators.hourly_qc import hourly_qc, rate_flags
from fieldwatch.operators.qc import quality_control
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import HOLED, clean_sparse, dense, holed, table
from fieldwatch.plans.sqltext import DENSE, SPARSE, W, hourly_ctes, service_ctes, sql, steps
from fieldwatch.session import cut
from fieldwatch.ranks import quantiles, share_at_most

cat = Catalog()
KEYS = ["station_id", "timestamp"]
SRC = {"temperature": ("temperature", "pt"), "pressure": ("pressure", "pp"), "humidity": ("humidity", "ph")}


def r6(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def features_sql(src, fill=True, min_rows=1):
    parts = ["station_id", '"timestamp"', "temperature", "pressure", "humidity"]
    for c, (v, p) in SRC.items():
        change = f"CASE WHEN h = 1 THEN {v} - {p} END"
        parts.append(f"{'coalesce(' + change + ', 0)' if fill else change} AS {c}_change")
    for c in CHANNELS:
        n = f"count({c}) OVER r"
        std = f"stddev_samp({c}) OVER r"
        parts.append(f"CASE WHEN {n} >= {min_rows} THEN avg({c}) OVER r END AS {c}_mean3")
        parts.append((f"coalesce({std}, 0)" if min_rows == 1 else f"CASE WHEN {n} >= {min_rows} THEN {std} END") + f" AS {c}_std3")
    parts += [
        """sin(2 * pi() * hour("timestamp") / 24) AS hour_sin""",
        """cos(2 * pi() * hour("timestamp") / 24) AS hour_cos""",
        """sin(2 * pi() * dayofyear("timestamp") / 365.25::DOUBLE) AS day_sin""",
        """cos(2 * pi() * dayofyear("timestamp") / 365.25::DOUBLE) AS day_cos""",
    ]
    return [
        steps(src),
        "feat AS (SELECT "
        + ", ".join(parts)
        + ' FROM steps WINDOW r AS (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))',
    ]


def rounded(columns):
    return ", ".join(f"round({c}, 6) + 0 AS {c}" for c in columns)


CHANGE_COLS = [f"{c}_change" for c in CHANNELS]
ROLL_COLS = [f"{c}_{k}" for c in CHANNELS for k in ("mean3", "std3")]
CYCLE_COLS = ["hour_sin", "hour_cos", "day_sin", "day_cos"]


@cat.query(sql(SPARSE, *features_sql("sparse"), body=f'SELECT station_id, "timestamp", {rounded(CHANGE_COLS)} FROM feat'))
def step_changes(spark, d):
    return features.step_changes(clean_sparse(spark, d)).select(*KEYS, *CHANGE_COLS)


@cat.query(
    sql(SPARSE, *features_sql("sparse", fill=False), body=f'SELECT station_id, "timestamp", {rounded(CHANGE_COLS)} FROM feat')
)
def step_changes_null(spark, d):
    return features.step_changes(clean_sparse(spark, d), fill=False).select(*KEYS, *CHANGE_COLS)


@cat.query(sql(SPARSE, *features_sql("sparse"), body=f'SELECT station_id, "timestamp", {rounded(ROLL_COLS)} FROM feat'))
def rolling_3_stats(spark, d):
    return r6(features.rolling_3_stats(clean_sparse(spark, d)).select(*KEYS, *ROLL_COLS), ROLL_COLS)


@cat.query(
    sql(SPARSE, *features_sql("sparse", min_rows=3), body=f'SELECT station_id, "timestamp", {rounded(ROLL_COLS)} FROM feat')
)
def rolling_3_stats_full(spark, d):
    return r6(features.rolling_3_stats(clean_sparse(spark, d), 3).select(*KEYS, *ROLL_COLS), ROLL_COLS)


@cat.query(sql(DENSE, *features_sql("dense"), body=f'SELECT station_id, "timestamp", {rounded(CYCLE_COLS)} FROM feat'))
def cyclic_time(spark, d):
    return r6(features.cyclic_time(dense(spark, d)).select(*KEYS, *CYCLE_COLS), CYCLE_COLS)


ALL_VALID = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)


@cat.query(
    sql(HOLED, *features_sql("holed"), body=f'SELECT station_id, "timestamp", {rounded(FEATURES)}, {ALL_VALID} AS valid_features FROM feat')
)
def feature_vector_16(spark, d):
    return r6(features.feature_table(holed(spark, d)), FEATURES)


SPLIT = """split AS (SELECT *, CASE WHEN i < floor(n * 0.70::DOUBLE) THEN 'train' WHEN i < floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY "timestamp") - 1 AS i, count(*) OVER (PARTITION BY station_id) AS n FROM {0}))"""

FIT = (
    "fit AS (SELECT "
    + ", ".join(f"avg({f}) AS {f}__m, stddev_pop({f}) AS {f}__s" for f in FEATURES)
    + " FROM split WHERE split = 'train')"
)


def z(f):
    return f"({f} - {f}__m) / CASE WHEN {f}__s = 0 THEN 1 ELSE {f}__s END"


def split_features(spark, d):
    return cut(cleaning.split_by_fraction(features.feature_table(dense(spark, d))))


@cat.query(
    sql(
        DENSE,
        *features_sql("dense"),
        SPLIT.format("feat"),
        FIT,
        body='SELECT station_id, "timestamp", ' + ", ".join(f"round({z(f)}, 6) + 0 AS {f}_z" for f in FEATURES) + " FROM split, fit",
    )
)
def standard_scale(spark, d):
    rows = split_features(spark, d)
    scaler = features.fit_scaler(rows.where("split = 'train'"), FEATURES)
    names = [f"{f}_z" for f in FEATURES]
    return r6(features.scale(rows, scaler, FEATURES).select(*KEYS, *names), names)


@cat.query(
    sql(
        DENSE,
        *features_sql("dense"),
        SPLIT.format("feat"),
        FIT,
        "z AS (" + " UNION ALL ".join(f"""SELECT station_id, "timestamp", '{f}' AS feature, {z(f)} AS z FROM split, fit""" for f in FEATURES) + ")",
        body="""SELECT * FROM (SELECT station_id, "timestamp", CAST(row_number() OVER (PARTITION BY station_id, "timestamp"
  ORDER BY abs(z) DESC, feature) AS INTEGER) AS rank, feature, round(z, 6) + 0 AS z FROM z) WHERE rank <= 10""",
    )
)
def feature_attribution_topk(spark, d):
    rows = split_features(spark, d)
    scaler = features.fit_scaler(rows.where("split = 'train'"), FEATURES)
    return r6(features.attribution_topk(rows, scaler), ["z"])


@cat.query(
    sql(
        DENSE,
        SPLIT.format("dense"),
        body="""SELECT split, count(*) AS rows, CAST(count(*) FILTER (temperature > -10) AS BIGINT) AS anomalies,
  round(count(*) FILTER (temperature > -10) / count(*) * 100.0::DOUBLE, 2) AS anomaly_pct FROM split GROUP BY split""",
    )
)
def anomaly_rates_by_split(spark, d):
    rows = cleaning.split_by_fraction(dense(spark, d)).withColumn("hot", F.col("temperature") > -10)
    return features.anomaly_rates_by_split(rows, "hot")


# -- scores over any column -----------------------------------------------------------
SCORE = "score AS (SELECT *, (-temperature + pressure / 7 - humidity / 11) / 100 AS score FROM split)"


def scored(spark, d):
    rows = cleaning.split_by_fraction(dense(spark, d))
    return rows.withColumn(
        "score", (-F.col("temperature") + F.col("pressure") / 7 - F.col("humidity") / 11) / 100
    )


@cat.query(
    sql(
        DENSE,
        SPLIT.format("dense"),
        SCORE,
        "cal AS (SELECT quantile_cont(score, 0.005) AS lo, quantile_cont(score, 0.995) AS hi FROM score WHERE split = 'train')",
        body="""SELECT station_id, "timestamp", round(least(greatest((hi - score) / greatest(hi - lo, 1e-6), 0), 1), 6) AS anomaly_score
FROM score, cal""",
    )
)
def iforest_normalize(spark, d):
    from fieldwatch.operators.forest import normalize_scores, score_bounds

    rows = scored(spark, d)
    bounds = score_bounds(rows.where("split = 'train'"), "score")
    return r6(normalize_scores(rows, bounds, "score", "anomaly_score").select(*KEYS, "anomaly_score"), ["anomaly_score"])


@cat.query(
    sql(
        DENSE,
        SPLIT.format("dense"),
        body="""SELECT a.station_id, a."timestamp", round(100.0::DOUBLE * count(*) FILTER (b.v <= -a.temperature) / count(*), 6) AS severity
FROM split a, (SELECT -temperature AS v FROM split WHERE split = 'train') b GROUP BY ALL""",
    )
)
def percentile_rank_severity(spark, d):
    rows = cleaning.split_by_fraction(dense(spark, d)).withColumn("v", -F.col("temperature"))
    out = share_at_most(rows, "v", rows.where("split = 'train'").withColumnRenamed("v", "r"), "r", "severity")
    return r6(out.select(*KEYS, "severity"), ["severity"])


@cat.query(
    """WITH r AS (SELECT l_extendedprice AS v, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT v, sum(n) OVER (ORDER BY v) / sum(n) OVER () * 100.0::DOUBLE AS p FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(p, 6) AS severity FROM lineitem JOIN c ON v = l_extendedprice"""
)
def percentile_rank_large(spark, d):
    """The same over a long series: each line's price among all prices."""
    rows = table(spark, d, "lineitem")
    ref = rows.select(F.col("l_extendedprice").alias("r"))
    out = share_at_most(rows, "l_extendedprice", ref, "r", "severity")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round("severity", 6).alias("severity")
    )


# -- windows --------------------------------------------------------------------------
def windows_sql(step, clean=""):
    bad = "temperature IS NULL OR pressure IS NULL OR humidity IS NULL" + clean
    return f"""marked AS (SELECT *, CASE WHEN {step} THEN 1 ELSE 0 END AS broken, CASE WHEN {bad} THEN 1 ELSE 0 END AS bad FROM src0),
segs AS (SELECT *, sum(broken) OVER {W.replace('WINDOW w AS ', '')} AS seg FROM marked),
win AS (SELECT *, count(*) OVER x AS n, sum(bad) OVER x AS bads, sum(temperature) OVER x AS st, sum(pressure) OVER x AS sp, sum(humidity) OVER x AS sh
  FROM segs WINDOW x AS (PARTITION BY station_id, seg ORDER BY "timestamp" ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
windows AS (SELECT * FROM win WHERE n = 24 AND bads = 0)"""


def window_sums(windows):
    def total(field):
        return F.aggregate("window", F.lit(0.0), lambda a, x: a + x[field])

    return windows.select(
        *KEYS,
        F.size("window").alias("rows"),
        total("temperature").alias("sum_t"),
        total("pressure").alias("sum_p"),
        total("humidity").alias("sum_h"),
    )


WINDOW_OUT = 'SELECT station_id, "timestamp", CAST(n AS INTEGER) AS rows, st AS sum_t, sp AS sum_p, sh AS sum_h FROM windows'


@cat.query(sql(HOLED, steps("holed", "src0"), windows_sql("h > 1.5"), body=WINDOW_OUT))
def sequence_windows(spark, d):
    return window_sums(sequences.sequence_windows(holed(spark, d)))


@cat.query(
    sql(
        *hourly_ctes(DENSE, "dense"),
        "src0 AS (SELECT *, p_range OR t_range OR h_range OR t_flat OR p_flat AS dirty FROM hq)",
        windows_sql("h <> 1", " OR dirty"),
        body=WINDOW_OUT,
    )
)
def sequence_windows_clean(spark, d):
    rows = hourly_qc(dense(spark, d))
    dirty = F.lit(False)
    for c in ("temperature_range", "pressure_range", "humidity_range", "temperature_flatline", "pressure_flatline"):
        dirty = dirty | F.col(f"{c}_flag")
    out = sequences.sequence_windows(rows.withColumn("dirty", dirty), exact_hour=True, clean_flag="dirty")
    return window_sums(out)


THR = repr(SEQUENCE_ERROR_THRESHOLD)
ERR = "err AS (SELECT *, (humidity - 20) / 700 AS mse FROM dense)"


def errors(spark, d):
    """An error column derived from the observations stands in for a model's."""
    return dense(spark, d).withColumn("mse", (F.col("humidity") - 20) / 700)


@cat.query(
    sql(
        DENSE,
        ERR,
        body=f"""SELECT station_id, "timestamp", mse > {THR}::DOUBLE AS sequence_flag,
  round(least(greatest(1 - exp(-ln(2) * mse / {THR}::DOUBLE), 0), 1), 6) AS sequence_score FROM err""",
    )
)
def lstm_flag_score(spark, d):
    out = sequences.flag_errors(errors(spark, d), "mse")
    return r6(out.select(*KEYS, "sequence_flag", "sequence_score"), ["sequence_score"])


@cat.query(sql(DENSE, ERR, body="SELECT round(quantile_cont(mse, 0.99), 9) AS threshold FROM err"))
def fit_error_threshold(spark, d):
    return sequences.error_threshold(errors(spark, d), "mse").select(F.round("threshold", 9).alias("threshold"))


def _window_errors(spark, d):
    out = window_sums(sequences.sequence_windows(holed(spark, d)))
    return out.select(*KEYS, (-F.col("sum_t") / 24).alias("error"), (F.col("sum_h") > 24 * 27).alias("flag"))


WIN_ERR = 'werr AS (SELECT station_id, "timestamp", -st / 24 AS error, sh > 24 * 27 AS flag FROM windows)'


@cat.query(
    sql(
        HOLED,
        steps("holed", "src0"),
        windows_sql("h > 1.5"),
        WIN_ERR,
        body="""SELECT station_id, hour AS "timestamp", round(max(error), 6) + 0 AS error, bool_or(flag) AS flag FROM (
  SELECT station_id, unnest(generate_series("timestamp" - INTERVAL 23 HOUR, "timestamp", INTERVAL 1 HOUR)) AS hour, error, flag FROM werr)
GROUP BY ALL""",
    )
)
def spread_sequence_evidence(spark, d):
    return r6(sequences.spread_to_rows(_window_errors(spark, d), ["error", "flag"]), ["error"])


@cat.query(
    sql(
        HOLED,
        steps("holed", "src0"),
        windows_sql("h > 1.5"),
        WIN_ERR,
        body="""SELECT station_id, "timestamp", round(error, 6) + 0 AS error, flag FROM holed LEFT JOIN werr USING (station_id, "timestamp")""",
    )
)
def map_error_to_end(spark, d):
    out = sequences.map_to_end(holed(spark, d), _window_errors(spark, d), ["error", "flag"])
    return r6(out.select(*KEYS, "error", "flag"), ["error"])


# -- joint consistency ----------------------------------------------------------------
UNGATED = ["t_change", "p_change", "h_change"]
BATCH_MV = """mv0 AS (SELECT *, avg(t_change) OVER s AS tm, stddev_samp(t_change) OVER s AS ts_, avg(p_change) OVER s AS pm,
    stddev_samp(p_change) OVER s AS ps_, avg(h_change) OVER s AS hm_, stddev_samp(h_change) OVER s AS hs_
  FROM hq WINDOW s AS (PARTITION BY station_id)),
mv AS (SELECT *, sqrt(pow((t_change - tm) / nullif(ts_, 0), 2) + pow((p_change - pm) / nullif(ps_, 0), 2)
    + pow((h_change - hm_) / nullif(hs_, 0), 2)) AS mscore FROM mv0)"""


@cat.query(
    sql(
        *hourly_ctes(DENSE, "dense", gated=False, spikes=False),
        BATCH_MV,
        body="""SELECT station_id, "timestamp", round(mscore, 6) + 0 AS multivariate_score, coalesce(mscore > 3, false) AS multivariate_anomaly FROM mv""",
    )
)
def multivariate_batch(spark, d):
    out = multivariate.multivariate_batch(rate_flags(dense(spark, d), gated=False))
    return r6(out.select(*KEYS, "multivariate_score", "multivariate_anomaly"), ["multivariate_score"])


EXPANDING = """ex0 AS (SELECT *, temperature - lag(temperature) OVER w AS dt, pressure - lag(pressure) OVER w AS dp, humidity - lag(humidity) OVER w AS dh
  FROM {0} WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp")),
ex1 AS (SELECT *, count(*) OVER u AS k, count(*) FILTER (temperature IS NULL OR pressure IS NULL OR humidity IS NULL) OVER u AS holes,
    avg(dt) OVER u AS mt, stddev_samp(dt) OVER u AS st, avg(dp) OVER u AS mp, stddev_samp(dp) OVER u AS sp, avg(dh) OVER u AS mh, stddev_samp(dh) OVER u AS sh
  FROM ex0 WINDOW u AS (PARTITION BY station_id ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING)),
ex AS (SELECT *, CASE WHEN k >= 3 AND holes = 0 {1} THEN sqrt(pow(coalesce((dt - mt) / nullif(st, 0), 0), 2)
    + pow(coalesce((dp - mp) / nullif(sp, 0), 0), 2) + pow(coalesce((dh - mh) / nullif(sh, 0), 0), 2)) END AS escore FROM ex1)"""


@cat.query(
    sql(
        *service_ctes("dense"),
        EXPANDING.format("qc", "AND qc_flag <> 'PASSED'"),
        body="""SELECT station_id, "timestamp", round(escore, 6) + 0 AS multivariate_score, coalesce(escore > 3, false) AS multivariate_anomaly FROM ex""",
    )
)
def multivariate_expanding(spark, d):
    out = multivariate.multivariate_expanding(cut(quality_control(dense(spark, d))))
    return r6(out.select(*KEYS, "multivariate_score", "multivariate_anomaly"), ["multivariate_score"])


TRAINED = """tr AS (SELECT *, coalesce(t_change, 0) AS t0, coalesce(p_change, 0) AS p0, coalesce(h_change, 0) AS h0, split = 'train' AS is_train FROM split),
sc AS (SELECT avg(t_change) AS tm, stddev_pop(t_change) AS ts_, avg(p_change) AS pm, stddev_pop(p_change) AS ps_, avg(h_change) AS hm_, stddev_pop(h_change) AS hs_
  FROM tr WHERE is_train AND t_change IS NOT NULL AND p_change IS NOT NULL AND h_change IS NOT NULL),
ms AS (SELECT tr.*, sqrt(pow((t0 - tm) / ts_, 2) + pow((p0 - pm) / ps_, 2) + pow((h0 - hm_) / hs_, 2)) AS mscore FROM tr, sc),
cut AS (SELECT quantile_cont(mscore, 0.99) AS threshold FROM ms WHERE is_train)"""


@cat.query(
    sql(
        *hourly_ctes(DENSE, "dense"),
        SPLIT.format("hq"),
        TRAINED,
        body="""SELECT station_id, "timestamp", round(mscore, 6) + 0 AS multivariate_score, round(threshold, 6) + 0 AS threshold,
  mscore > threshold AS multivariate_anomaly FROM ms, cut""",
    )
)
def multivariate_trained(spark, d):
    rows = cleaning.split_by_fraction(rate_flags(dense(spark, d)))
    rows = cut(rows.withColumn("is_train", F.col("split") == "train"))
    out = multivariate.multivariate_trained(rows)
    score = ["multivariate_score", "threshold"]
    return r6(out.select(*KEYS, *score, "multivariate_anomaly"), score)


@cat.query(
    sql(
        DENSE,
        steps("dense"),
        """ref AS (SELECT stddev_samp(temperature - pt) FILTER (h = 1) AS a, stddev_samp(pressure - pp) FILTER (h = 1) AS b, stddev_samp(humidity - ph) FILTER (h = 1) AS c FROM steps)""",
        body="""SELECT station_id, "timestamp", round(s, 6) + 0 AS multivariate_score, coalesce(s > 4.5, false) AS multivariate_anomaly FROM (
  SELECT *, abs((temperature - pt) / a) + abs((pressure - pp) / b) + abs((humidity - ph) / c) AS s FROM steps, ref)""",
    )
)
def multivariate_l1(spark, d):
    rows = dense(spark, d)
    out = multivariate.multivariate_l1(
        rate_flags(rows, gated=False), rate_flags(rows, gated=True), 4.5
    )
    return r6(out.select(*KEYS, "multivariate_score", "multivariate_anomaly"), ["multivariate_score"])


