from datetime import datetime, timedelta

START = datetime(2015, 1, 1)
SCHEMA = "station_id string, timestamp timestamp_ntz, temperature double, pressure double, humidity double"


def at(text):
    return datetime.strptime(text, "%Y-%m-%d %H:%M")


def series(spark, rows, station="A"):
    """rows: (hour offset or datetime, temperature, pressure, humidity)."""
    data = []
    for when, t, p, h in rows:
        ts = when if isinstance(when, datetime) else START + timedelta(hours=when)
        data.append((station, ts, t, p, h))
    return spark.createDataFrame(data, SCHEMA)


def ordered(df):
    return df.orderBy("station_id", "timestamp").collect()


def column(df, name):
    return [r[name] for r in ordered(df)]
