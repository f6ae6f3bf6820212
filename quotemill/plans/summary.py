"""Averages over prediction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The timings and metrics of a prediction row.
TIMINGS = ("retrieval_sec", "ttft_sec", "generation_sec", "total_sec")
METRICS = ("em", "f1", "retrieval_recall", "judge_correct", "judge_score", "judge_faithful", "judge_faithfulness_score")


def summarize(rows: DataFrame, *by: str) -> DataFrame:
    """Count and averages; a metric is averaged over the rows that have it, and is null where none has. No rows: count 0 and nulls."""
    cols = [F.avg(f"timing.{t}").alias(f"avg_{t}") for t in TIMINGS] + [F.avg(f"metrics.{m}").alias(f"avg_{m}") for m in METRICS]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("num_examples"), *cols)


def labelled(summary: DataFrame, mode: str, keep_ratio: float) -> DataFrame:
    """The summary of one run with its mode and ratio."""
    return summary.withColumns({"pruning_mode": F.lit(mode), "pruning_keep_ratio": F.lit(float(keep_ratio))})


def as_json(summary: DataFrame) -> DataFrame:
    """(`json`): one document per summary. The count and the four times are always there, null where there are none; a metric or label only where it has a value."""
    always = ["num_examples", *[f"avg_{t}" for t in TIMINGS]]
    sparse = [c for c in summary.columns if c not in always]
    head = F.to_json(F.struct(*always), {"ignoreNullFields": "false"})
    tail = F.to_json(F.struct(*sparse)) if sparse else F.lit("{}")
    both = summary.select(head.alias("_h"), tail.alias("_t"))
    return both.select(F.when(F.col("_t") == "{}", F.col("_h")).otherwise(F.concat(F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(","), F.expr("substring(_t, 2)"))).alias("json"))
