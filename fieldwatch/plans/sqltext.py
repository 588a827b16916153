"""SQL fragments shared by the DuckDB twins of the queries."""

from fieldwatch.plans.driver_views import DENSE, RAW_ROWS, SPARSE, STATIONS


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


W = 'WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp")'


def steps(src: str, name: str = "steps") -> str:
    """Each row with the hours since the previous row and its previous values."""
    return f"""{name} AS (
  SELECT *, date_diff('microsecond', lag("timestamp") OVER w, "timestamp") / 3.6e9 AS h,
    lag(temperature) OVER w AS pt, lag(pressure) OVER w AS pp, lag(humidity) OVER w AS ph
  FROM {src} {W})"""


def flat_runs(src: str, name: str, rows: int, tol: str, max_gap: float | None) -> str:
    """Runs of equal values: needs `steps` columns; adds t_flat, p_flat, h_flat."""
    gap = f" AND h <= {max_gap}" if max_gap is not None else ""

    def same(v, p):
        test = f"abs({v} - {p}) <= {tol}" if tol != "0" else f"{v} = {p}"
        return f"CASE WHEN {test}{gap} THEN 0 ELSE 1 END"

    return f"""{name}_b AS (
  SELECT *, sum({same('temperature', 'pt')}) OVER w AS bt,
    sum({same('pressure', 'pp')}) OVER w AS bp, sum({same('humidity', 'ph')}) OVER w AS bh
  FROM {src} {W}),
{name} AS (
  SELECT *, count(*) OVER (PARTITION BY station_id, bt) >= {rows} AS t_flat,
    count(*) OVER (PARTITION BY station_id, bp) >= {rows} AS p_flat,
    count(*) OVER (PARTITION BY station_id, bh) >= {rows} AS h_flat
  FROM {name}_b)"""


# Service-profile checks over a steps+flat table called `src`.
def service_qc(src: str, name: str = "qc") -> str:
    return f"""{name}_f AS (
  SELECT *,
    coalesce(temperature < -60 OR temperature > 25, false) AS t_bad,
    coalesce(pressure < 850 OR pressure > 1080, false) AS p_bad,
    coalesce(humidity < 2 OR humidity > 100, false) AS h_bad,
    CASE WHEN h > 0 AND h <= 1.5 THEN abs(temperature - pt) / h END AS t_rate,
    CASE WHEN h > 0 AND h <= 1.5 THEN abs(pressure - pp) / h END AS p_rate,
    CASE WHEN h > 0 AND h <= 1.5 THEN abs(humidity - ph) / h END AS h_rate,
    temperature IS NULL OR pressure IS NULL OR humidity IS NULL AS missing_flag,
    coalesce(h > 1.0, false) AS gap_flag
  FROM {src}),
{name}_s AS (
  SELECT *, coalesce(t_rate > 8, false) AS t_spike, coalesce(p_rate > 6, false) AS p_spike,
    coalesce(h_rate > 30, false) AS h_spike FROM {name}_f),
{name} AS (
  SELECT *,
    CASE WHEN t_bad OR p_bad OR h_bad OR t_spike OR p_spike OR h_spike OR t_flat OR p_flat OR h_flat THEN 'SUSPECT'
         WHEN missing_flag THEN 'MISSING' WHEN gap_flag THEN 'GAP' ELSE 'PASSED' END AS qc_flag,
    concat_ws('; ',
      CASE WHEN temperature IS NULL THEN 'temperature_missing' END,
      CASE WHEN pressure IS NULL THEN 'pressure_missing' END,
      CASE WHEN humidity IS NULL THEN 'humidity_missing' END,
      CASE WHEN gap_flag THEN printf('time_gap_detected: %.1f hrs since previous observation (> 1.0 hrs)', h) END,
      CASE WHEN temperature < -60 THEN printf('temperature_plausibility_violation: %.2f < -60.00', temperature)
           WHEN temperature > 25 THEN printf('temperature_plausibility_violation: %.2f > 25.00', temperature) END,
      CASE WHEN pressure < 850 THEN printf('pressure_plausibility_violation: %.2f < 850.00', pressure)
           WHEN pressure > 1080 THEN printf('pressure_plausibility_violation: %.2f > 1080.00', pressure) END,
      CASE WHEN humidity < 2 THEN printf('humidity_plausibility_violation: %.2f < 2.00', humidity)
           WHEN humidity > 100 THEN printf('humidity_plausibility_violation: %.2f > 100.00', humidity) END,
      CASE WHEN t_spike THEN printf('temperature_spike: step rate of %.2f/hr exceeded threshold of 8.00/hr (delta=%.2f in %.1fh)', t_rate, abs(temperature - pt), h) END,
      CASE WHEN p_spike THEN printf('pressure_spike: step rate of %.2f/hr exceeded threshold of 6.00/hr (delta=%.2f in %.1fh)', p_rate, abs(pressure - pp), h) END,
      CASE WHEN h_spike THEN printf('humidity_spike: step rate of %.2f/hr exceeded threshold of 30.00/hr (delta=%.2f in %.1fh)', h_rate, abs(humidity - ph), h) END,
      CASE WHEN t_flat THEN 'temperature_flatline: persistent identical readings' END,
      CASE WHEN p_flat THEN 'pressure_flatline: persistent identical readings' END,
      CASE WHEN h_flat THEN 'humidity_flatline: persistent identical readings' END) AS reasons
  FROM {name}_s)"""


QC_COLUMNS = """station_id, "timestamp", temperature, pressure, humidity, qc_flag, reasons,
  t_spike AS temperature_spike, p_spike AS pressure_spike, h_spike AS humidity_spike,
  t_flat AS temperature_flatline, p_flat AS pressure_flatline, h_flat AS humidity_flatline,
  missing_flag, gap_flag"""


def service_ctes(src: str) -> list[str]:
    base = SPARSE if src == "sparse" else DENSE
    return [base, steps(src), flat_runs("steps", "flat", 4, "1e-4", 1.5), service_qc("flat")]


__all__ = ["DENSE", "RAW_ROWS", "SPARSE", "STATIONS", "W", "sql", "steps", "flat_runs", "service_qc", "service_ctes", "QC_COLUMNS"]


def hourly_ctes(base: str, src: str, gated: bool = True, spikes: bool = True) -> list[str]:
    """Hourly-profile checks; the result table is `hq`."""
    gate = "h = 1 AND " if gated else ""
    med = "list_sort([x FOR x IN [pt, temperature, nt] IF x IS NOT NULL])"
    spike_text = "CASE WHEN t_spike THEN 'Temperature spike' END," if spikes else ""
    spike_or = "t_spike OR" if spikes else ""
    return [
        base,
        steps(src),
        flat_runs("steps", "flat", 5, "0", None),
        f"""hf AS (
  SELECT *, coalesce(temperature < -40 OR temperature > 70, false) AS t_range,
    coalesce(pressure < 300 OR pressure > 1250, false) AS p_range,
    coalesce(humidity < 0 OR humidity > 100, false) AS h_range,
    CASE WHEN {gate} true THEN temperature - pt END AS t_change,
    CASE WHEN {gate} true THEN pressure - pp END AS p_change,
    CASE WHEN {gate} true THEN humidity - ph END AS h_change,
    lead(temperature) OVER w AS nt, lead(pressure) OVER w AS np, lead(humidity) OVER w AS nh,
    date_diff('microsecond', "timestamp", lead("timestamp") OVER w) / 3.6e9 AS nexth,
    coalesce(h > 1, false) AS gap_flag FROM flat {W})""",
        f"""hs AS (
  SELECT *, coalesce(abs(t_change) > 3.5, false) AS t_rate, coalesce(abs(p_change) > 2.7, false) AS p_rate,
    coalesce(abs(h_change) > 20, false) AS h_rate,
    CASE WHEN h = 1 AND nexth = 1 AND len({med}) > 0 THEN
      ({med}[(len({med}) + 1) // 2] + {med}[len({med}) // 2 + 1]) / 2 END AS t_median FROM hf),
hm AS (SELECT *, coalesce(abs(temperature - t_median) > 3.5, false) AS t_spike FROM hs)""",
        f"""hq AS (
  SELECT *, t_range OR p_range OR h_range OR t_rate OR p_rate OR h_rate OR {spike_or} t_flat OR p_flat OR h_flat OR gap_flag AS qc_flag,
    concat_ws('; ', CASE WHEN t_range THEN 'Temperature range' END, CASE WHEN p_range THEN 'Pressure range' END,
      CASE WHEN h_range THEN 'Humidity range' END, CASE WHEN t_rate THEN 'Temperature rate-of-change' END,
      CASE WHEN p_rate THEN 'Pressure rate-of-change' END, CASE WHEN h_rate THEN 'Humidity rate-of-change' END,
      {spike_text} CASE WHEN t_flat THEN 'Temperature flatline' END, CASE WHEN p_flat THEN 'Pressure flatline' END,
      CASE WHEN h_flat THEN 'Humidity flatline' END, CASE WHEN gap_flag THEN 'Time gap' END) AS qc_reasons
  FROM hm)""",
    ]
