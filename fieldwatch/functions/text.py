"""Names, units, labels and action texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the three channels and their units.
ALIASES = {
    "temperature": ("temperature", "temp", "air temperature"),
    "pressure": ("pressure", "air pressure", "barometric pressure", "press"),
    "humidity": ("humidity", "relative humidity", "relative_humidity", "rh"),
}
UNITS = {"temperature": "°C", "pressure": "hPa", "humidity": "%"}

# Display names of the classes.
CLASS_LABELS = {
    "LIKELY_SENSOR_DATA_FAULT": "Likely Sensor/Data Fault",
    "LIKELY_GENUINE_WEATHER_EVENT": "Likely Genuine Weather Event",
    "UNCERTAIN": "Uncertain",
}

# Maintenance status per severity.
STATUS_BY_SEVERITY = {
    "CRITICAL": "Inspection Recommended",
    "HIGH": "Inspection Recommended",
    "MEDIUM": "Monitor Closely",
    "LOW": "Monitor",
}

# Operator actions, and the cause keywords that select them (first hit wins).
PRESSURE_ACTION = "Flag observation as invalid and inspect the pressure sensor/transducer, signal cable, and A/D converter."
TEMPERATURE_ACTION = "Flag observation as invalid and inspect the temperature sensor/transducer, signal cable, and A/D converter."
HUMIDITY_ACTION = "Flag observation as invalid and inspect the humidity sensor/transducer and signal connection."
LINK_ACTION = "Check station communication, power supply, logger, and data transmission path."
MULTI_ACTION = "Inspect the affected sensors, station power, logger, communication link, and signal connections."
DEFAULT_ACTION = "Review the observation and inspect the affected station components."
ACTION_LADDER = (
    (("pressure plausibility",), PRESSURE_ACTION),
    (("rapid temperature", "temperature plausibility"), TEMPERATURE_ACTION),
    (("humidity anomaly", "humidity plausibility"), HUMIDITY_ACTION),
    (("communication", "data gap", "transmission dropout"), LINK_ACTION),
    (("multiple sensor", "multivariate"), MULTI_ACTION),
    (("pressure",), PRESSURE_ACTION),
    (("temperature",), TEMPERATURE_ACTION),
    (("humidity",), HUMIDITY_ACTION),
)


def ladder(rules, default) -> Column:
    """CASE WHEN over (condition, value) pairs, in order."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def normalize_parameter(name: Column) -> Column:
    """Channel for a spelling; else by substring; else null."""
    t = F.lower(F.trim(name))
    rules = [(t.isin(*spellings), channel) for channel, spellings in ALIASES.items()]
    rules += [
        (t.contains("temperature"), "temperature"),
        (t.contains("pressure"), "pressure"),
        (t.contains("humidity") | t.contains("relative"), "humidity"),
    ]
    return ladder(rules, F.lit(None).cast("string"))


def parameter_unit(channel: Column) -> Column:
    return ladder([(channel == c, u) for c, u in UNITS.items()], F.lit(None).cast("string"))


def classification_label(name: Column) -> Column:
    t = F.upper(name)
    return ladder([(t == k, v) for k, v in CLASS_LABELS.items()], "Normal")


def maintenance_status(severity: Column, classification: Column | None = None) -> Column:
    """Status label by severity; a CRITICAL or HIGH sensor fault is never less than an
    inspection, which the severity table already guarantees."""
    s = F.upper(F.coalesce(severity, F.lit("NONE")))
    return ladder([(s == k, v) for k, v in STATUS_BY_SEVERITY.items()], "Normal")


def maintenance_action(cause: Column, fallback: Column | None = None) -> Column:
    t = F.lower(F.trim(F.coalesce(cause, F.lit(""))))
    rules = []
    for words, action in ACTION_LADDER:
        hit = F.lit(False)
        for word in words:
            hit = hit | t.contains(word)
        rules.append((hit, action))
    default = F.lit(DEFAULT_ACTION)
    if fallback is not None:
        default = F.coalesce(F.when(fallback != "", fallback), default)
    return ladder(rules, default)


def joined(parts: list[tuple[Column, str]], empty: str | None, sep: str = "; ") -> Column:
    """Texts whose condition holds, joined; `empty` when there is none."""
    text = F.concat_ws(sep, *[F.when(cond, F.lit(t)) for cond, t in parts])
    return text if empty is None else F.when(text == "", empty).otherwise(text)


def tie_even(x: Column, digits: int) -> Column:
    """Prepare a value for `%.<digits>f`, so that it prints as IEEE printing does.

    Java's formatter rounds the shortest decimal text half up; this rounds by the exact
    binary value.  Only values whose double at twice the scale is an odd whole number can
    differ; for those the product's rounding error (exact by splitting x in two halves)
    tells which side of the tie the value is on, and a true tie goes to the even digit.
    """
    k = float(2 * 10**digits)
    product = x * k
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * k - product) + (x - high) * k
    up, down = (product + 1) / 2, (product - 1) / 2
    even = F.when(F.pmod(up, F.lit(2.0)) == 0, up).otherwise(down)
    nearest = F.when(error > 0, up).when(error < 0, down).otherwise(even) / float(10**digits)
    return F.when(F.pmod(product, F.lit(2.0)) == 1.0, nearest).otherwise(x)


def round_even(x: Column, digits: int) -> Column:
    """Round the exact binary value, ties to the even digit; `F.round` rounds the shortest
    decimal text half up, so 6.005, which is a little less in binary, would become 6.01."""
    return F.round(tie_even(x, digits), digits)


def compact_texts(*texts: Column) -> Column:
    """Array of the texts that are not null, in order.  Joined and split again: unlike a
    lambda over an array, this stays inside generated code."""
    text = F.concat_ws("\u0001", *texts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\u0001"))
