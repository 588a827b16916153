"""What the operators of this package share: inputs, stored tables and text rules."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.session import work_path

#: White space of the word rules: a word is a run of anything else.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Slots of the bounded filter: one bit each, 1 MB.
SLOTS = 1 << 23
#: Paths written by `stored` in this process and not dropped since.
_written: list[str] = []


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a frame to the folder all executors share and read it back.

    The lineage ends at the written files, so a lost executor costs a re-read and
    no task sees two different evaluations of the same rows.
    """
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str):
    """The file system a path lies in, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def drop(paths: list[str]) -> None:
    """Remove stored tables that nothing reads any more.

    Where the shared folder is of a kind that cannot be reached from here, they stay.
    """
    import pyarrow as pa

    for path in paths:
        _written.remove(path)
        try:
            system, folder = file_system(path)
        except pa.ArrowInvalid:
            continue
        if system.get_file_info(folder).type.name == "Directory":
            system.delete_dir(folder)


def written() -> list[str]:
    """Stored tables so far, oldest first."""
    return list(_written)


def unread(paths: list[str], frame: DataFrame) -> list[str]:
    """Those of some stored tables that a frame does not read."""
    read = [unquote(f) for f in frame.inputFiles()]
    return [p for p in paths if not any(p.rsplit("/fieldwatch/", 1)[-1] + "/" in f for f in read)]


def likely_in(rows: DataFrame, key: Column, keys: DataFrame, their: Column) -> DataFrame:
    """The rows whose key may be among some keys: all that are, and few others while the keys are few.

    A bitmap of the keys' hashes, 131,072 rows of 64 bits whatever their number, is
    broadcast, so most rows that a join would drop are dropped before they are shuffled.
    The join itself follows.
    """
    columns, own = rows.columns, "_slot"
    while any(c.startswith(own) for c in columns):
        own = "_" + own
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    word, bit = lambda c: F.shiftright(c, 6), lambda c: F.pmod(c, F.lit(64)).cast("int")
    places = keys.select(slot(their).alias(own))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(own)))
    bits = places.groupBy(word(F.col(own)).alias(f"{own}_word")).agg(F.bit_or(one).alias(f"{own}_bits"))
    tested = rows.withColumn(own, slot(key)).join(F.broadcast(bits), word(F.col(own)) == F.col(f"{own}_word"))
    return tested.where(F.getbit(f"{own}_bits", bit(F.col(own))) == 1).select(*columns)


def unsigned_hex(col):
    """A 64-bit value as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
