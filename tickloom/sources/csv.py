"""Bars from CSV files of any of the usual headers and time formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import numbered

#: The headers that stand for each field, in lower case.
ALIASES = {
    "timestamp": ("timestamp", "time", "date", "datetime", "ts"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c", "adj close"),
    "volume": ("volume", "vol", "v", "tickvol", "tick_volume"),
}
#: Time formats in the order in which they are tried, after numbers and ISO.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy",
)
FIELDS = ("timestamp", "open", "high", "low", "close", "volume")


class BadBars(ValueError):
    """Rows that are no bars, with the first reason found."""


def header_map(headers: list[str]) -> dict[str, str]:
    """Field -> header. Two headers for one field, or none for a required one, raise."""
    found: dict[str, str] = {}
    for h in headers:
        field = next((f for f, names in ALIASES.items() if h.strip().lower() in names), None)
        if field and field in found:
            raise BadBars(f"both {found[field]!r} and {h!r} are {field}")
        if field:
            found[field] = h
    if missing := [f for f in FIELDS[:5] if f not in found]:
        raise BadBars(f"missing columns: {missing}")
    return found


def parsed_time(text: Column) -> Column:
    """A number is seconds since 1970 (milliseconds above 1e12); else ISO, its own offset left out; else the first format that fits."""
    t = F.trim(text)
    number = t.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000.0).otherwise(number)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?$"), F.regexp_replace(t, r"(Z|(?<=:\d{2})[+-]\d{2}:\d{2})$", "").try_cast("timestamp"))
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in FORMATS]
    return F.coalesce(F.when(number.isNotNull() & ~F.isnan(number), F.timestamp_micros((seconds * 1e6).cast("long"))), iso, *tries)


def checked(raw: DataFrame, order: Column) -> DataFrame:
    """The fields of raw, all text, as bars with error: the first thing wrong with a row, or null. order: the rows' place in the file."""
    cols = header_map(raw.columns)
    number = lambda f: F.trim(F.col(f"`{cols[f]}`")).try_cast("double")
    volume_text = F.col(f"`{cols['volume']}`") if "volume" in cols else F.lit(None).cast("string")
    out = raw.select(parsed_time(F.col(f"`{cols['timestamp']}`")).alias("timestamp"), *[number(f).alias(f) for f in FIELDS[1:5]], F.when(F.trim(volume_text) != "", F.trim(volume_text)).alias("_v"), order.alias("_at"))
    out = out.withColumn("volume", F.when(F.col("_v").isNull(), 0.0).otherwise(F.col("_v").try_cast("double")))
    bad = lambda c: c.isNull() | F.isnan(c)
    o, h, lo, c, v = (F.col(f) for f in FIELDS[1:])
    error = F.when(F.col("timestamp").isNull(), "time").when(bad(o) | bad(h) | bad(lo) | bad(c) | bad(v), "number").when(h < lo, "high below low")
    error = error.when((F.least(o, h, lo, c) < 0) | (v < 0), "negative").when(~(o.between(lo, h) & c.between(lo, h)), "open or close outside the range")
    return out.withColumn("error", error).drop("_v")


def unique(rows: DataFrame) -> DataFrame:
    """The first row in the file of each time. rows: timestamp and _at."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("symbol", "timestamp").orderBy("_at"))).filter("_n = 1").drop("_n")


def read_bars(spark: SparkSession, path: str, symbol: str = "SAMPLE", strict: bool = True) -> DataFrame:
    """Bars of a CSV file or folder. strict: a bad row raises; else bad rows are left out (checked() tells them)."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = checked(raw, place)
    if strict and (wrong := rows.filter("error is not null").select("error", "timestamp").first()):
        raise BadBars(f"{wrong['error']} at {wrong['timestamp']}")
    rows = unique(rows.filter("error is null").withColumn("symbol", F.lit(symbol)))
    return numbered(rows.select("symbol", *FIELDS)).select("symbol", "i", *FIELDS)


def write_bars(bars: DataFrame, path: str) -> None:
    """The bars as CSV with the fixed header, in order of time."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    bars.orderBy("symbol", "timestamp").select(stamp.alias("timestamp"), *FIELDS[1:]).write.mode("overwrite").csv(path, header=True)
