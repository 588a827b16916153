"""Queries: rule checks of the hourly profile."""

from fieldwatch.config import CHANNELS
from fieldwatch.operators import hourly_qc as hq
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import HOLED, clean_sparse, dense, holed
from fieldwatch.plans.sqltext import DENSE, SPARSE, hourly_ctes, sql

cat = Catalog()
KEYS = ["station_id", "timestamp"]
SHORT = {"temperature": "t", "pressure": "p", "humidity": "h"}


def pick(kind, suffix):
    return ", ".join(f"{SHORT[c]}_{kind} AS {c}_{suffix}" for c in CHANNELS)


def cols(suffix):
    return [f"{c}_{suffix}" for c in CHANNELS]


@cat.query(sql(*hourly_ctes(SPARSE, "sparse"), body=f'SELECT station_id, "timestamp", {pick("range", "range_flag")} FROM hq'))
def nb_range_flags(spark, d):
    return hq.range_flags(clean_sparse(spark, d)).select(*KEYS, *cols("range_flag"))


def _rates(gated):
    return sql(
        *hourly_ctes(SPARSE, "sparse", gated),
        body=f'SELECT station_id, "timestamp", {pick("change", "change")}, {pick("rate", "rate_flag")} FROM hq',
    )


@cat.query(_rates(True))
def nb_rate_flags(spark, d):
    return hq.rate_flags(clean_sparse(spark, d)).select(*KEYS, *cols("change"), *cols("rate_flag"))


@cat.query(_rates(False))
def nb_rate_flags_ungated(spark, d):
    out = hq.rate_flags(clean_sparse(spark, d), gated=False)
    return out.select(*KEYS, *cols("change"), *cols("rate_flag"))


@cat.query(
    sql(
        *hourly_ctes(HOLED, "holed"),
        body="""SELECT station_id, "timestamp", t_median AS temperature_local_median,
  t_spike AS temperature_spike_flag FROM hq""",
    )
)
def nb_local_spike(spark, d):
    return hq.local_spike(holed(spark, d)).select(*KEYS, "temperature_local_median", "temperature_spike_flag")


def _centered():
    parts = []
    for c, limit in (("temperature", 3.5), ("pressure", 2.7), ("humidity", 20)):
        s = SHORT[c]
        m = f"CASE WHEN p{s} IS NOT NULL AND {c} IS NOT NULL AND n{s} IS NOT NULL THEN greatest(least(p{s}, {c}), least(greatest(p{s}, {c}), n{s})) END"
        parts.append(f"{m} AS {c}_local_median, coalesce(abs({c} - {m}) > {limit}, false) AS {c}_spike_flag")
    return sql(*hourly_ctes(HOLED, "holed"), body='SELECT station_id, "timestamp", ' + ", ".join(parts) + " FROM hq")


@cat.query(_centered())
def centered_median_spike(spark, d):
    out = hq.centered_median_spike(holed(spark, d))
    return out.select(*KEYS, *cols("local_median"), *cols("spike_flag"))


@cat.query(sql(*hourly_ctes(DENSE, "dense"), body=f'SELECT station_id, "timestamp", {pick("flat", "flatline_flag")} FROM hq'))
def nb_flatline(spark, d):
    return hq.flatline_flags(dense(spark, d)).select(*KEYS, *cols("flatline_flag"))


@cat.query(sql(*hourly_ctes(SPARSE, "sparse"), body='SELECT station_id, "timestamp", gap_flag FROM hq'))
def nb_gap_flag(spark, d):
    return hq.gap_flag(clean_sparse(spark, d)).select(*KEYS, "gap_flag")


@cat.query(sql(*hourly_ctes(SPARSE, "sparse"), body='SELECT station_id, "timestamp", qc_flag, qc_reasons FROM hq'))
def nb_qc_flag_reasons(spark, d):
    return hq.hourly_qc(clean_sparse(spark, d)).select(*KEYS, "qc_flag", "qc_reasons")


@cat.query(
    sql(
        *hourly_ctes(DENSE, "dense", gated=False, spikes=False),
        body=f"""SELECT station_id, "timestamp", temperature, pressure, humidity, {pick("range", "range_flag")},
  {pick("change", "change")}, {pick("rate", "rate_flag")}, {pick("flat", "flatline_flag")}, gap_flag, qc_flag FROM hq""",
    )
)
def nb_pipeline_qc(spark, d):
    out = hq.hourly_qc(dense(spark, d), gated=False, spikes=False)
    return out.drop("station_no", "qc_reasons")
