"""Rule constants. All values here are fixed: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, field

CHANNELS = ("temperature", "pressure", "humidity")

# Numbers a logger writes in place of a missing reading.
SENTINELS = (-999.0, -9999.0)

# Column layout of a raw observation file and its canonical names.
RAW_COLUMNS = (
    "TimeStamp",
    "Air Temperature",
    "Air Pressure",
    "Wind Speed",
    "Wind Direction",
    "Relative Humidity",
)
CANONICAL_NAMES = {
    "TimeStamp": "timestamp",
    "Air Temperature": "temperature",
    "Air Pressure": "pressure",
    "Wind Speed": "wind_speed",
    "Wind Direction": "wind_direction",
    "Relative Humidity": "relative_humidity",
}

# Text layouts accepted for a timestamp, tried in this order.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy h:mm a",
    "yyyy-MM-dd",
)
DAY_FIRST_FORMATS = ("d/M/yyyy H:mm", "d-M-yyyy H:mm", "yyyy-MM-dd HH:mm:ss")


@dataclass(frozen=True)
class Profile:
    """Limits of one rule set; every operator takes it as a parameter."""

    ranges: dict = field(
        default_factory=lambda: {
            "temperature": (-60.0, 25.0),
            "pressure": (850.0, 1080.0),
            "humidity": (2.0, 100.0),
        }
    )
    rates: dict = field(
        default_factory=lambda: {"temperature": 8.0, "pressure": 6.0, "humidity": 30.0}
    )
    nominal_hours: float = 1.0
    rate_gap_hours: float = 1.5
    flatline_rows: int = 4
    flatline_tolerance: float = 1e-4


SERVICE = Profile()
HOURLY = Profile(
    ranges={
        "temperature": (-40.0, 70.0),
        "pressure": (300.0, 1250.0),
        "humidity": (0.0, 100.0),
    },
    rates={"temperature": 3.5, "pressure": 2.7, "humidity": 20.0},
    rate_gap_hours=1.0,
    flatline_rows=5,
    flatline_tolerance=0.0,
)

SPIKE_LIMIT = 3.5
SEQUENCE_ROWS = 24
SEQUENCE_ERROR_THRESHOLD = 0.07097852191878912

# The sixteen model features, in model order.
FEATURES = (
    "temperature",
    "pressure",
    "humidity",
    "temperature_change",
    "pressure_change",
    "humidity_change",
    "temperature_mean3",
    "temperature_std3",
    "pressure_mean3",
    "pressure_std3",
    "humidity_mean3",
    "humidity_std3",
    "hour_sin",
    "hour_cos",
    "day_sin",
    "day_cos",
)
