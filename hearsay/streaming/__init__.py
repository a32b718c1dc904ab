"""Encoders in streams. They keep no state, so they run in any streaming query; grouping by code does keep some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_codes(stream: DataFrame, time: str, text: str, encode: Callable[[Column], Column], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, end, code, n_rows) for each window of event time; rows later than ``late`` behind the newest are dropped with their state."""
    counted = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), encode(F.col(text)).alias("code")).agg(F.count("*").alias("n_rows"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "code", "n_rows")


def first_of_each_code(stream: DataFrame, time: str, text: str, encode: Callable[[Column], Column], late: str = "1 hour") -> DataFrame:
    """The first row of each code within the watermark."""
    return stream.withColumn("code", encode(F.col(text))).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["code"])
