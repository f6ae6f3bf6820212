"""Host figures before and after a run."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def host_memory(spark: SparkSession) -> DataFrame:
    """One row: total, available and used GiB of the driver's host and the used percentage."""
    lines = dict(x.split(":", 1) for x in Path("/proc/meminfo").read_text().splitlines() if ":" in x)
    total, free = (int(lines[k].split()[0]) / 1024**2 for k in ("MemTotal", "MemAvailable"))
    return spark.createDataFrame([(total, free, total - free, 100 * (total - free) / total)], "total_gib double, available_gib double, used_gib double, used_percent double")


def utilization(metrics_before: DataFrame, metrics_after: DataFrame, memory_before: DataFrame, memory_after: DataFrame, gib_before: DataFrame, gib_after: DataFrame) -> DataFrame:
    """One row with the counters (`name`, `value`), the host's memory and the size of the cache folder before and after a run, and the folder's growth."""
    spark = metrics_before.sparkSession
    figures = lambda df: {r["name"]: r["value"] for r in df.collect()}  # noqa: E731 - a handful of named counters
    memory = [df.first().asDict() for df in (memory_before, memory_after)]
    before, after = (df.first()["gib"] for df in (gib_before, gib_after))
    host = "struct<total_gib:double,available_gib:double,used_gib:double,used_percent:double>"
    schema = f"metrics_before map<string,double>, metrics_after map<string,double>, host_memory_before {host}, host_memory_after {host}, folder_gib_before double, folder_gib_after double, folder_gib_delta double"
    return spark.createDataFrame([(figures(metrics_before), figures(metrics_after), *[tuple(m[k] for k in ("total_gib", "available_gib", "used_gib", "used_percent")) for m in memory], before, after, after - before)], schema)
