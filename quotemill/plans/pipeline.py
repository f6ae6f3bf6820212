"""From examples to scored prediction rows, and the judging of saved rows, with models as exchangeable stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions import judge, text
from quotemill.operators import prompting, pruning, request, retrieval
from quotemill.operators.encoders import Chat, Encoder
from quotemill.plans import summary

TIMING = "struct<retrieval_sec:double,request_build_sec:double,ttft_sec:double,generation_sec:double,total_sec:double>"
#: The columns of a prediction row.
ROW = ("q_id", "question", "gold_answer", "pred_answer", "gold_quotes", "retrieved_quote_ids", "selected_text_quotes", "selected_img_quotes", "pruning", "visual_pruning", "timing")


@dataclass(frozen=True)
class Config:
    """Parameters of a run."""

    text_k: int = 4
    image_k: int = 2
    mode: str = "model_internal_visual_pruning"
    keep_ratio: float = 0.5
    rows: int = 4
    cols: int = 4
    least_tokens: int = 4
    out_dir: str = "pruned_images"


@dataclass(frozen=True)
class Stages:
    """The models of a run. `tiles` gives, from the question and the selected images, `scores`, `width` and `height` per image."""

    text_encoder: Encoder
    image_query_encoder: Encoder
    image_encoder: Encoder
    answer: Chat
    tiles: Callable[[Column, Column], Column] | None = None


def prepare(examples: DataFrame, config: Config, stages: Stages) -> DataFrame:
    """The examples with evidence retrieved and pruned, and the `prompt`; one projection, no row leaves its partition."""
    if "visual_pruning" not in examples.schema["img_quotes"].dataType.elementType.names:
        examples = examples.withColumn("img_quotes", F.transform("img_quotes", lambda q: q.withField("visual_pruning", F.lit(None).cast(pruning.META))))
    chosen = retrieval.retrieve(examples, stages.text_encoder, stages.image_query_encoder, stages.image_encoder, config.text_k, config.image_k)
    if config.mode in pruning.PATCH_MODES and stages.tiles is None:
        raise ValueError(f"{config.mode} needs a stage that scores tiles")
    tiles = stages.tiles(F.col("question"), F.col("selected_img_quotes")) if stages.tiles else None
    chosen = chosen.withColumn("_tiles", tiles) if tiles is not None else chosen
    kept = pruning.apply_policy(config.mode, config.keep_ratio, F.col("selected_text_quotes"), F.col("selected_img_quotes"), None if tiles is None else F.col("_tiles"), config.out_dir, F.col("q_id"), config.rows, config.cols, config.least_tokens)
    pruned = chosen.withColumn("_kept", kept).withColumns({c: F.col(f"_kept.{c}") for c in ("selected_text_quotes", "selected_img_quotes", "pruning")}).drop("_kept", "_tiles")
    return pruned.withColumn("prompt", prompting.build_prompt(F.col("question"), F.col("selected_text_quotes"), F.col("selected_img_quotes")))


def prediction_rows(answered: DataFrame, *carried: str) -> DataFrame:
    """The columns of a prediction row, those `carried` along first; `pred_answer` must be there, and `timing` may."""
    images = F.col("selected_img_quotes")
    meta = request.visual_meta(images)
    made = {
        "gold_answer": F.coalesce("answer_short", F.lit("")), "retrieved_quote_ids": prompting.retrieved_ids(F.col("selected_text_quotes"), images), "visual_pruning": meta,
        "timing": F.col("timing") if "timing" in answered.columns else F.lit(None).cast(TIMING),
    }
    return answered.select(*carried, *[made[c].alias(c) if c in made else F.col(c) for c in ROW])


def with_metrics(rows: DataFrame) -> DataFrame:
    """The prediction rows with `metrics`: answer scores, and recall over the evidence left after pruning. Other metrics a row has are kept."""
    scored = text.answer_scores(rows, "pred_answer", "gold_answer").withColumn("_r", text.retrieval_recall(F.col("retrieved_quote_ids"), F.col("gold_quotes")))
    old = rows.schema["metrics"].dataType.names if "metrics" in rows.columns else []
    new = {"em": F.col("em"), "f1": F.col("f1"), "retrieval_recall": F.col("_r")}
    kept = [F.col(f"metrics.{c}").alias(c) for c in old if c not in new]
    return scored.withColumn("metrics", F.struct(*[v.alias(k) for k, v in new.items()], *kept)).drop("em", "f1", "_r")


def run(examples: DataFrame, config: Config, stages: Stages, *carried: str) -> DataFrame:
    """Retrieve, prune, prompt, answer, score: a prediction row with metrics per example."""
    answered = prepare(examples, config, stages)
    answered = answered.withColumn("pred_answer", F.coalesce(stages.answer(F.col("prompt")), F.lit("")))
    return with_metrics(prediction_rows(answered, *carried))


def judged(rows: DataFrame, judge_model: Chat) -> DataFrame:
    """Saved rows with `judge`, `evidence_text` and the judge's metrics merged into `metrics`. The model is asked once per row."""
    asked = rows.withColumn("evidence_text", prompting.evidence_text(F.col("selected_text_quotes"), F.col("selected_img_quotes")))
    asked = asked.withColumn("_reply", judge_model(judge.judge_prompt(F.col("question"), F.col("gold_answer"), F.col("pred_answer"), F.col("evidence_text"))))
    asked = asked.withColumn("judge", judge.judge_verdict(F.col("_reply"))).drop("_reply")
    new = {f"judge_{k}": F.col(f"judge.{k}").cast("long") for k in ("correct", "score", "faithful", "faithfulness_score")}
    old = [c for c in rows.schema["metrics"].dataType.names if c not in new] if "metrics" in rows.columns else []
    return asked.withColumn("metrics", F.struct(*[F.col(f"metrics.{c}").alias(c) for c in old], *[v.alias(k) for k, v in new.items()]))


def summarized(rows: DataFrame, config: Config) -> DataFrame:
    """The labelled summary of a run's rows; metrics no row can have yet are null."""
    have = rows.schema["metrics"].dataType.names
    full = F.struct(*[(F.col(f"metrics.{m}") if m in have else F.lit(None).cast("double")).alias(m) for m in summary.METRICS])
    return summary.labelled(summary.summarize(rows.withColumn("metrics", full)), config.mode, config.keep_ratio)
