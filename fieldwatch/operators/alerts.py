"""The observation / alert log: keys, upsert, filters, pages, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.functions.text import maintenance_action, maintenance_status
from fieldwatch.sources import logstore

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
CLASSES = ("NORMAL", "LIKELY_GENUINE_WEATHER_EVENT", "LIKELY_SENSOR_DATA_FAULT", "UNCERTAIN")
SPANS = {"24H": "24 hours", "7D": "7 days"}
MAX_PAGE = 50

# The payload fields the log reads, nested under `decision` or flat.
PAYLOAD_SCHEMA = """
  station_id string, timestamp string, severity string, classification string,
  final_classification string, primary_parameter string, parameter string, anomaly_type string,
  evidence_confidence double, root_cause string, primary_root_cause string,
  maintenance_status string, recommended_operator_action string,
  decision struct<severity: string, classification: string, primary_classification: string,
    primary_parameter: string, probable_cause: string, primary_root_cause: string,
    evidence_confidence: double, calibrated_confidence: double, maintenance_status: string,
    recommended_operator_action: string>,
  qc_result struct<temperature_spike: boolean, pressure_spike: boolean, humidity_spike: boolean,
    temperature_flatline: boolean, pressure_flatline: boolean, humidity_flatline: boolean>
"""


def first_text(*options: Column) -> Column:
    """First option that is neither null nor empty."""
    return F.coalesce(*[F.when(o != "", o) for o in options])


def parse_payload(text: Column) -> Column:
    """The payload as a struct; null where the text is not valid JSON."""
    return F.when(F.get_json_object(text, "$").isNotNull(), F.from_json(text, PAYLOAD_SCHEMA))


def with_payload(log: DataFrame) -> DataFrame:
    """Add the parsed payload as `_p`, parsed once per row: behind a generator, a later filter
    on a derived column is not rewritten into many copies of the parse."""
    return log.withColumn("_p", F.explode(F.array(parse_payload(F.col("payload_json")))))


def alert_key(
    station: Column, timestamp: Column, parameters: list[Column], causes: list[Column]
) -> dict[str, Column]:
    """`alert_key`, `parameter` and `anomaly_type`: the first usable parameter and cause, in
    lower case, joined with the station and the UTC time."""
    parameter = F.lower(F.trim(first_text(*parameters, F.lit("observation"))))
    cause = F.lower(F.trim(first_text(*causes, F.lit("NORMAL"))))
    time = F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss")
    return {
        "alert_key": F.concat_ws("|", F.trim(station), F.coalesce(time, F.lit("")), parameter, cause),
        "parameter": parameter,
        "anomaly_type": cause,
    }


def payload_key(payload: Column, station: Column, timestamp: Column, parameter: Column, cause: Column) -> dict[str, Column]:
    """Key parts of a log row from its payload, falling back to its columns."""
    d, qc = payload["decision"], payload["qc_result"]

    def by_flag(c):
        hit = F.coalesce(qc[f"{c}_spike"], F.lit(False)) | F.coalesce(qc[f"{c}_flatline"], F.lit(False))
        return F.when(hit, F.lit(c))

    return alert_key(
        first_text(payload["station_id"], station),
        F.coalesce(F.try_to_timestamp(payload["timestamp"]).cast("timestamp_ntz"), timestamp),
        [
            d["primary_parameter"],
            payload["primary_parameter"],
            payload["parameter"],
            parameter,
            *[by_flag(c) for c in ("temperature", "pressure", "humidity")],
        ],
        [
            d["primary_root_cause"],
            d["probable_cause"],
            payload["primary_root_cause"],
            payload["anomaly_type"],
            cause,
            d["classification"],
            payload["final_classification"],
        ],
    )


def with_alert_keys(log: DataFrame, only_missing: bool = False) -> DataFrame:
    """Set the key columns; only_missing: just on rows whose key is null or empty."""
    rows = with_payload(log)
    parts = payload_key(
        F.col("_p"), F.col("station_id"), F.col("timestamp"), F.col("parameter"), F.col("anomaly_type")
    )
    if only_missing:
        has = F.coalesce(F.col("alert_key") != "", F.lit(False))
        parts = {k: F.when(has, F.col(k)).otherwise(v) for k, v in parts.items()}
    return rows.withColumns(parts).drop("_p")


def dedup_alerts(log: DataFrame) -> DataFrame:
    """The row with the lowest id per key; rows without a key go too.  A partial aggregate:
    a key repeated millions of times never meets in one task."""
    row = F.struct(*log.columns)
    return (
        log.where(F.coalesce(F.col("alert_key") != "", F.lit(False)))
        .groupBy(F.col("alert_key").alias("_k"))
        .agg(F.min_by(row, F.col("id")).alias("_r"))
        .select("_r.*")
    )


# Set once, when a key is first stored.
KEPT = ("id", "created_at", "previous_observation_timestamp", "next_observation_timestamp")


def merge_versions(rows: DataFrame, order: str) -> DataFrame:
    """One row per key of rows in several versions: the first id and `created_at`, all other
    fields of the latest version.  Within a version (`order`), a higher id is later."""
    has_key = F.coalesce(F.col("alert_key") != "", F.lit(False))
    columns = [c for c in rows.columns if c != order]
    kept = [c for c in KEPT if c in columns]
    other = [c for c in columns if c not in (*kept, "alert_key")]
    when = F.struct(order, "id")
    merged = (
        rows.where(has_key)
        .groupBy("alert_key")
        .agg(
            F.min_by(F.struct(*kept), when).alias("_first"),
            F.max_by(F.struct(*other), when).alias("_last"),
        )
        .select("alert_key", "_first.*", "_last.*")
    )
    return merged.select(*columns).unionByName(rows.where(~has_key).select(*columns))


def upsert(log: DataFrame, new: DataFrame) -> DataFrame:
    """Merge new rows into the log: a known key keeps its first id and `created_at`, all other
    fields come from its latest row.  Within `new`, a higher id is later."""
    both = log.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return merge_versions(both, "_src")


# The day of log rows that have no time; a null partition would be lost when days are rewritten.
UNDATED = "0001-01-01"


def log_day() -> Column:
    """Day a log row is stored under: that of its key's time, else of its own time, else UNDATED.

    Every row of a key thus lies in one partition, whatever its time column says.
    """
    in_key = F.regexp_extract(F.coalesce("alert_key", F.lit("")), r"\|(\d{4}-\d{2}-\d{2}) \d{2}:\d{2}:\d{2}\|", 1)
    return F.coalesce(F.try_to_timestamp(in_key, F.lit("yyyy-MM-dd")).cast("date"), F.to_date("timestamp"), F.lit(UNDATED).cast("date"))


def _merge(rows: DataFrame) -> DataFrame:
    return merge_versions(rows, "commit")


def upsert_table(spark: SparkSession, path: str, new: DataFrame, token: str | None = None) -> None:
    """Commit rows to the log at `path`; known keys are overwritten but for their first identity.

    A key always belongs to one day (see log_day), so its versions meet there.  The commit
    writes the new rows only and becomes visible in one step (sources.logstore); a day with
    many versions is folded afterwards.  token: name of a micro-batch, committed once.
    """
    rows = merge_versions(new.withColumn("_src", F.lit(0)), "_src").withColumn(logstore.DAY, log_day())
    if logstore.append(spark, path, rows, token):
        logstore.compact(spark, path, _merge)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log, one row per key."""
    return logstore.read(spark, path, _merge)


def newest_days(spark: SparkSession, path: str, wanted: int, keep) -> list[dict]:
    """The days that hold the newest `wanted` rows that `keep` lets through.

    Opens the latest days, twice as many each time, until they have enough rows and no day
    left can hold a later one.  Of the rows only their number and lowest time are fetched.
    """
    days, take = logstore.days(logstore.entries(spark, path)), 1
    while take < len(days):
        rows = keep(logstore.read(spark, path, _merge, days[:take])).orderBy(F.desc("timestamp"), F.desc("id")).limit(wanted)
        n, low = rows.agg(F.count(F.lit(1)), F.min(F.coalesce("timestamp", F.lit("0001-01-01").cast("timestamp_ntz")))).first()
        rest = days[take]["high"]
        if n >= wanted and (rest is None or low > rest):
            break
        take *= 2
    return days[:take]


def log_page(spark: SparkSession, path: str, page: int = 1, page_size: int = 10, **filters) -> DataFrame:
    """alerts_page of a stored log: its items come from the newest days only; the totals read
    the filter columns of all."""
    page, size = max(1, int(page)), max(1, min(MAX_PAGE, int(page_size)))

    def keep(rows):
        return alert_filter(anomalies(rows), **filters)

    recent_days = newest_days(spark, path, page * size, keep)
    items = keep(logstore.read(spark, path, _merge, recent_days)).orderBy(F.desc("timestamp"), F.desc("id")).offset((page - 1) * size).limit(size)
    total = keep(read_log(spark, path)).agg(F.count(F.lit(1)).alias("total"))
    return _paged(items, total, size)


def log_row(spark: SparkSession, path: str, alert_id: int) -> DataFrame:
    """The row of a stored log with this id: entries name the files that may hold it, their
    filters and row ranges the ones that do, and its key the one day to merge."""
    listed = logstore.entries(spark, path)
    schema = logstore.schema_of(spark, path)
    days = logstore.days(listed)
    likely = logstore.days(listed.where((F.col("low_id") <= alert_id) & (F.col("high_id") >= alert_id)))
    found = logstore._read(spark, path, schema, likely).where(F.col("id") == alert_id).select(logstore.DAY, "alert_key").distinct().collect()
    chosen = [d for d in days if d["day"] in {r[logstore.DAY] for r in found}]
    keys = [r["alert_key"] for r in found if r["alert_key"]]
    mine = (F.col("id") == alert_id) if not keys else (F.col("alert_key").isin(keys) | (F.col("id") == alert_id))
    return logstore.read(spark, path, _merge, chosen, mine).where(F.col("id") == alert_id)


def alert_filter(
    log: DataFrame,
    severity: str | None = None,
    classification: str | None = None,
    station_id: str | None = None,
    parameter: str | None = None,
    time_range: str | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Optional filters; `now` is given, so that a result can be repeated."""
    if classification:
        log = log.where(F.col("classification") == classification.upper())
    if severity:
        log = log.where(F.col("severity") == severity.upper())
    if station_id:
        log = log.where(F.col("station_id") == station_id)
    if parameter:
        log = log.where(F.lower(F.coalesce("parameter", F.lit(""))) == parameter.lower())
    if time_range in SPANS:
        log = log.where(F.col("timestamp") >= now - F.expr(f"interval {SPANS[time_range]}"))
    return log


def anomalies(log: DataFrame) -> DataFrame:
    return log.where(F.col("classification") != "NORMAL")


def alerts_page(log: DataFrame, page: int = 1, page_size: int = 10, **filters) -> DataFrame:
    """One page of anomalies, newest first, with the total and the number of pages.

    A top-k over page * size rows, not a numbering of the whole log; for deep pages take
    alerts_before.  A page past the end is one row with the totals and no item.
    """
    page, size = max(1, int(page)), max(1, min(MAX_PAGE, int(page_size)))
    rows = alert_filter(anomalies(log), **filters)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    items = rows.orderBy(F.desc("timestamp"), F.desc("id")).offset((page - 1) * size).limit(size)
    return _paged(items, total, size)


def _paged(items: DataFrame, total: DataFrame, size: int) -> DataFrame:
    paged = total.withColumn("total_pages", F.floor((F.col("total") + size - 1) / size))
    return paged.join(F.broadcast(items), F.lit(True), "left").select(*items.columns, "total", "total_pages")  # at most a page


def alerts_before(log: DataFrame, timestamp, id_, page_size: int = 10, **filters) -> DataFrame:
    """The next page after a known last item: the newest anomalies before (timestamp, id).

    Costs the same at any depth, since rows in front of the page are filtered at the scan.
    Undated anomalies follow all dated ones.
    """
    size = max(1, min(MAX_PAGE, int(page_size)))
    when = F.lit(timestamp).cast("timestamp_ntz")
    older = (F.col("timestamp") < when) | F.col("timestamp").isNull() | ((F.col("timestamp") == when) & (F.col("id") < id_))
    if timestamp is None:
        older = F.col("timestamp").isNull() & (F.col("id") < id_)
    rows = alert_filter(anomalies(log), **filters).where(older)
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(size)


def severity_counts(log: DataFrame) -> DataFrame:
    """Anomalies per alert severity, zeros included; page filters do not apply."""
    counts = anomalies(log).groupBy("severity").agg(F.count(F.lit(1)).alias("_n"))
    listed = _listed(log.sparkSession, "severity", SEVERITIES)
    return listed.join(counts, "severity", "left").select(
        "severity", F.coalesce("_n", F.lit(0)).alias("alerts")
    )


def alert_statistics(log: DataFrame) -> DataFrame:
    """Rows per class, the four known classes always present, and the number of anomalies."""
    counts = log.groupBy("classification").agg(F.count(F.lit(1)).alias("_n"))
    total = anomalies(log).agg(F.count(F.lit(1)).alias("buffer_size"))
    return (
        _listed(log.sparkSession, "classification", CLASSES)
        .join(counts, "classification", "full_outer")
        .select("classification", F.coalesce("_n", F.lit(0)).alias("rows"))
        .crossJoin(F.broadcast(total))  # one row
    )


def _listed(spark: SparkSession, name: str, values) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def normalize_payload(log: DataFrame) -> DataFrame:
    """Class, severity, confidence in percent, cause and maintenance of each row, from
    whichever spelling its payload uses."""
    p = F.col("_p")
    d = p["decision"]
    rows = with_payload(log)
    raw = F.coalesce(p["evidence_confidence"], d["evidence_confidence"], d["calibrated_confidence"])
    return rows.withColumns(
        {
            "payload_class": first_text(
                p["final_classification"], d["primary_classification"], d["classification"], p["classification"], F.lit("NORMAL")
            ),
            "payload_severity": F.upper(first_text(p["severity"], d["severity"], F.lit("NORMAL"))),
            "payload_confidence": F.when(raw <= 1, raw * 100).otherwise(raw),
            "payload_cause": first_text(
                p["primary_root_cause"], d["primary_root_cause"], d["probable_cause"], p["root_cause"], F.lit("No significant anomaly")
            ),
            "payload_maintenance": F.coalesce(p["maintenance_status"], d["maintenance_status"], F.lit("—")),
        }
    ).drop("_p")


def with_maintenance(log: DataFrame) -> DataFrame:
    """Maintenance status and action by today's policy, from the payload; rows whose payload
    is not valid JSON drop out."""
    rows = with_payload(log).where(F.col("_p").isNotNull())
    p = F.col("_p")
    d = p["decision"]
    severity = F.coalesce(d["severity"], p["severity"], F.lit("NONE"))
    cause = F.coalesce(
        d["probable_cause"], d["primary_root_cause"], p["primary_root_cause"], p["root_cause"], F.lit("")
    )
    fallback = F.coalesce(d["recommended_operator_action"], p["recommended_operator_action"], F.lit(""))
    return rows.withColumns(
        {
            "maintenance_status": maintenance_status(severity),
            "maintenance_action": maintenance_action(cause, fallback),
        }
    ).drop("_p")


def alert_by_id(log: DataFrame, alert_id: int) -> DataFrame:
    return with_maintenance(log.where(F.col("id") == alert_id))


def recent(log: DataFrame, limit: int = 2000, only_anomalies: bool = False, **filters) -> DataFrame:
    """The newest rows by id."""
    rows = alert_filter(anomalies(log) if only_anomalies else log, **filters)
    return rows.orderBy(F.desc("id")).limit(limit)


def payload_fields(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Typed fields of a JSON column; rows that are not valid JSON drop out."""
    schema = ", ".join(f"{k} {t}" for k, t in fields.items())
    valid = F.get_json_object(column, "$").isNotNull()
    return df.where(valid).withColumn("_j", F.from_json(column, schema)).select(
        *df.columns, *[F.col(f"_j.{k}").alias(k) for k in fields]
    )


def merge_prefer_new(old: DataFrame, fetched: DataFrame, key: str = "alert_key") -> DataFrame:
    """Both sets by key; where both have a key, the fetched row wins."""
    both = old.withColumn("_src", F.lit(0)).unionByName(fetched.withColumn("_src", F.lit(1)))
    row = F.struct(*old.columns)
    return both.groupBy(F.col(key).alias("_k")).agg(
        F.max_by(row, F.struct("_src", "id")).alias("_r")
    ).select("_r.*")


def clear_log(spark: SparkSession, path: str) -> int:
    """Empty the log; returns how many rows it held."""
    deleted = read_log(spark, path).count()
    logstore.clear(spark, path)
    return deleted
