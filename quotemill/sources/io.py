"""Annotation files, images, saved results, metrics text and folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions import pixels
from quotemill.plans import summary

_TEXT = "array<struct<quote_id:string,text:string,page_id:long,layout_id:long>>"
_IMAGE = "array<struct<quote_id:string,img_path:string,img_description:string,page_id:long,layout_id:long>>"
EXAMPLE = f"q_id string, doc_name string, domain string, question string, question_type string, evidence_modality_type array<string>, text_quotes {_TEXT}, img_quotes {_IMAGE}, gold_quotes array<string>, answer_short string"
_IMAGES = pa.schema([("path", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("content", pa.binary())])
REQUIRED = ("q_id", "doc_name", "question")
#: The counters kept of a serving engine's metrics text.
WANTED = (
    "vllm:kv_cache_usage_perc", "vllm:prompt_tokens_cached", "vllm:prompt_tokens_recomputed",
    "lmcache:num_requested_tokens", "lmcache:num_hit_tokens", "lmcache:num_stored_tokens", "lmcache:retrieve_hit_rate",
)


def resolve_path(root: str, path: Column) -> Column:
    """root/path; an absolute path replaces the root. A null path stays null."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def read_examples(spark: SparkSession, path: str, images_root: str, limit: int | None = None) -> DataFrame:
    """JSON lines of examples with defaults and `local_img_path`; a missing required key raises; `limit` takes the first rows in file order."""
    raw = spark.read.schema(EXAMPLE).option("mode", "FAILFAST").json(path)
    if limit is not None:  # files by name, their parts by offset; within a part the number rises line by line
        place = ("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        raw = raw.select("*", F.struct(*[F.col(p) if isinstance(p, str) else p for p in place]).alias("_o")).orderBy("_o").limit(limit).drop("_o")
    for key in REQUIRED:
        raw = raw.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"missing {key}"))).otherwise(F.col(key)))
    return normalize(raw, images_root)


def normalize(examples: DataFrame, images_root: str) -> DataFrame:
    none = F.array().cast
    return examples.select(
        "q_id", "doc_name", "domain", "question", "question_type",
        F.coalesce("evidence_modality_type", none("array<string>")).alias("evidence_modality_type"),
        F.coalesce("text_quotes", none(_TEXT)).alias("text_quotes"),
        F.transform(F.coalesce("img_quotes", none(_IMAGE)), lambda q: q.withField("local_img_path", resolve_path(images_root, q["img_path"]))).alias("img_quotes"),
        F.coalesce("gold_quotes", none("array<string>")).alias("gold_quotes"), F.coalesce("answer_short", F.lit("")).alias("answer_short"),
    )


def row_json(rows: DataFrame) -> DataFrame:
    """(`value`): a JSON object per prediction row; absent parts are left out, but `timing` keeps its nulls."""
    rest = F.to_json(F.struct(*[c for c in rows.columns if c != "timing"]))
    timing = F.to_json("timing", {"ignoreNullFields": "false"}) if "timing" in rows.columns else F.lit(None)
    both = rows.select(rest.alias("_r"), timing.alias("_t"))
    close = F.expr("substring(_r, 1, length(_r) - 1)")
    comma = F.when(F.col("_r") == "{}", "").otherwise(",")
    return both.select(F.when(F.col("_t").isNull(), F.col("_r")).otherwise(F.concat(close, comma, F.lit('"timing":'), "_t", F.lit("}"))).alias("value"))


def write_results(rows: DataFrame, totals: DataFrame, path: str) -> None:
    """The rows as JSON lines under `rows`, the summary of the run, one document, under `summary`."""
    row_json(rows).write.mode("overwrite").text(f"{path}/rows")
    summary.as_json(totals).coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def write_report(rows: DataFrame, totals: DataFrame, utilization: DataFrame, path: str) -> None:
    """Rows and summary as `write_results` has them, and the figures of the system before and after under `system_utilization`."""
    write_results(rows, totals, path)
    utilization.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/system_utilization")


def read_rows(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of saved results; the saved summary is not read."""
    return spark.read.schema(schema).json(f"{path}/rows")


def encode_files(spark: SparkSession, path: str) -> DataFrame:
    """(`path`, `base64`) without line breaks."""
    return spark.read.format("binaryFile").load(path).select("path", F.regexp_replace(F.base64("content"), r"[\r\n]", "").alias("base64"))


def _is_there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def folder_gib(spark: SparkSession, path: str) -> DataFrame:
    """One row with the size of all files below a folder, 0 if there is none; the content is not read."""
    if not _is_there(spark, path):
        return spark.createDataFrame([(0.0,)], "gib double")
    return list_files(spark, path).agg((F.coalesce(F.sum("length"), F.lit(0)) / 1024**3).alias("gib"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(`name`, `length`) of all files below a folder, named from there; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    bare = F.url_decode(F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", ""), r"\+", "%2B"))
    return files.select(F.element_at(F.split(bare, F.concat(F.lit(r"\Q"), base, F.lit(r"\E"))), -1).alias("name"), "length")


def with_existing(examples: DataFrame, files: DataFrame, key: str, images: str = "img_quotes", path: str = "local_img_path") -> DataFrame:
    """The examples with `existing`: which of their images' paths are in `files` (`path`). Empty and null paths are missing."""
    asked = examples.select(key, F.explode(F.array_distinct(F.transform(images, lambda q: q[path]))).alias("path")).where("path <> ''")
    there = asked.join(files.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.collect_set("path").alias("existing"))  # of one example
    return examples.join(there, key, "left").withColumn("existing", F.coalesce("existing", F.array().cast("array<string>")))


def scan_images(spark: SparkSession, root: str, decode: Callable[[bytes], np.ndarray] = pixels.decode) -> DataFrame:
    """(`path`, `width`, `height`, `content`) of the images below a folder; files that can't be decoded are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    h, w = decode(content).shape[:2]
                    rows.append({"path": path, "width": w, "height": h, "content": content})
                except Exception:  # noqa: BLE001, S112 - whatever a decoder says of a broken file
                    continue
            yield pa.RecordBatch.from_pylist(rows, _IMAGES)

    return files.mapInArrow(read, "path string, width long, height long, content binary")


def render_montages(images: DataFrame, tile: int = 224, decode: Callable[[bytes], np.ndarray] = pixels.decode) -> DataFrame:
    """The rows of `images` (`content`, `keep_boxes`) with `montage`, a PNG of the kept tiles; null without tiles or a readable image."""

    @F.pandas_udf("binary")
    def draw(contents: pd.Series, boxes: pd.Series) -> pd.Series:
        def one(content: bytes | None, kept: np.ndarray | None) -> bytes | None:
            try:
                return pixels.encode_png(pixels.montage(decode(content), [list(b) for b in kept], tile))
            except Exception:  # noqa: BLE001
                return None

        return pd.Series([one(c, k) for c, k in zip(contents, boxes)])

    return images.withColumn("montage", draw("content", "keep_boxes"))


def write_montages(rendered: DataFrame, path_col: str = "path") -> DataFrame:
    """Writes each montage to its path on a file system all workers share; (`path`, `written`). Paths must be distinct: tasks may be tried again, and write the same bytes."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is not None:
                    Path(path).parent.mkdir(parents=True, exist_ok=True)
                    Path(path).write_bytes(data)
                rows.append({"path": path, "written": data is not None})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("written", pa.bool_())]))

    return rendered.select(path_col, "montage").mapInArrow(save, "path string, written boolean")


def metrics_text(lines: DataFrame, line: str = "line", order: str = "ord", wanted: tuple[str, ...] | None = WANTED) -> DataFrame:
    """(`name`, `value`): the last value of each wanted counter; blank, comment and unparsable lines are ignored."""
    parts = F.split(F.trim(line), r"\s+")
    named = lines.where((F.trim(line) != "") & ~F.trim(F.col(line)).startswith("#")).select(
        F.substring_index(parts[0], "{", 1).alias("name"), parts[F.size(parts) - 1].try_cast("double").alias("value"), F.col(order).alias("_o")
    )
    named = named.where("value is not null")
    if wanted is not None:
        named = named.where(F.col("name").isin(*wanted))
    return named.groupBy("name").agg(F.max_by("value", "_o").alias("value"))


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def chunk_ttft(chunks: DataFrame, key: str, seq: str, at: str, text: str, started: str) -> DataFrame:
    """From a chunk log: time to the first non-empty chunk, and the answer in order. The chunks of one answer come together in one row."""
    return chunks.groupBy(key).agg(
        (F.min(F.when(F.col(text) != "", F.col(at))) - F.min(started)).alias("ttft"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), "").alias("answer"),
    )
