"""The same reading on streams: scans hold no state; alerts per window do, under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import scan, scan_keys, verdicts


def scan_stream(stream: DataFrame, text: str = "text", ignore: tuple[str, ...] = ()) -> DataFrame:
    """Every row of a stream with its findings; legal in append mode."""
    return scan(stream, text, ignore)


def verdict_stream(stream: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return verdicts(stream, key, text)


def alerts(stream: DataFrame, time: str, text: str = "text", window: str = "5 minutes", late: str = "10 minutes", least: int = 3) -> DataFrame:
    """Per window: texts, those at least as severe as ``least``, and the worst; rows later than ``late`` are not waited for."""
    read = scan_keys(stream.withWatermark(time, late), time, text=text)
    return read.groupBy(F.window(time, window)).agg(F.count("*").alias("n_docs"), F.count_if(F.col("severity") >= least).alias("n_alerts"), F.max("severity").alias("worst"))
