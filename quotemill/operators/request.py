"""What is sent to the served model, and what became of token pruning inside a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def request_extras(mode: str, keep_ratio: float, images: Column) -> Column:
    """The kept indices of every pruned image, and the ratio for pruning inside the model; null fields are not sent."""
    indices = F.transform(F.filter(images, lambda q: q["visual_pruning"]["keep_indices"].isNotNull()), lambda q: q["visual_pruning"]["keep_indices"])
    ratio = F.lit(float(keep_ratio)) if mode == "model_internal_visual_pruning" else F.lit(None).cast("double")
    return F.struct(F.when(F.size(indices) > 0, indices).alias("image_keep_indices"), ratio.alias("image_keep_ratio"))


def message_parts(prompt: Column, encoded: Column) -> Column:
    """The text part and one data URL per image that exists (`encoded`: base64 texts, null for a missing image)."""
    urls = F.transform(F.filter(encoded, lambda b: b.isNotNull()), lambda b: F.struct(F.lit("image_url").alias("type"), F.concat(F.lit("data:image/jpeg;base64,"), b).alias("content")))
    text = F.array(F.struct(F.lit("text").alias("type"), prompt.alias("content")))
    return F.concat(text, F.coalesce(urls, F.array().cast("array<struct<type:string,content:string>>")))


def visual_meta(images: Column) -> Column:
    """(`quote_id`, `visual_pruning`) of the images that have the latter."""
    return F.transform(F.filter(images, lambda q: q["visual_pruning"].isNotNull()), lambda q: F.struct(q["quote_id"].alias("quote_id"), q["visual_pruning"].alias("visual_pruning")))


def timings(start: Column, retrieved: Column, sent: Column, first: Column, end: Column) -> Column:
    """Seconds between the marks; building the request includes pruning, no first token gives a null."""
    return F.struct((retrieved - start).alias("retrieval_sec"), (sent - retrieved).alias("request_build_sec"), (first - sent).alias("ttft_sec"), (end - sent).alias("generation_sec"), (end - start).alias("total_sec"))


def probe_outcome(image_exists: Column, patches: Column, kept: Column) -> Column:
    """Why fine patches were not pruned, or `applied`."""
    side = F.sqrt(patches.cast("double"))
    return F.when(~image_exists, "missing_image").when(side != F.floor(side), "non_square_patch_grid").when(F.coalesce(F.size(kept), F.lit(0)) <= 0, "empty_keep_indices").otherwise("applied")


def mapped_patches(patches: Column, kept: Column, rows: Column, cols: Column) -> Column:
    """The fine patches of a square grid of `patches` under the kept coarse cells; empty where the grid isn't square or nothing is kept."""
    side = F.floor(F.sqrt(patches.cast("double"))).cast("int")
    edge = lambda j, n: F.rint(j * side.cast("double") / n).cast("int")
    none = F.array().cast("array<int>")
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)

    def cell(x: Column) -> Column:
        r, c = F.floor(x / cols).cast("int"), (x % cols).cast("int")
        return F.flatten(F.transform(span(edge(r, rows), edge(r + 1, rows)), lambda a: F.transform(span(edge(c, cols), edge(c + 1, cols)), lambda b: a * side + b)))

    inside = F.filter(F.coalesce(kept, none.cast("array<long>")), lambda x: (x >= 0) & (x < rows * cols))
    return F.when(side * side == patches, F.array_distinct(F.flatten(F.transform(inside, cell)))).otherwise(none)


def probe(exists: Column, hidden_shape: Column, meta: Column) -> Column:
    """What pruning the output of a vision encoder comes to: outcome, counts and the patches kept.

    `hidden_shape` is the shape of its hidden states (batch, 1 + patches, width), null if the model has none; `meta` the
    image's `visual_pruning`. `exists` is null where no file is involved.
    """
    n = F.get(hidden_shape, F.lit(1)).cast("long") - 1
    rows, cols = (F.coalesce(meta[c].cast("long"), F.lit(1).cast("long")) for c in ("grid_rows", "grid_cols"))
    unexpected = (F.size(hidden_shape) != 3) | (F.get(hidden_shape, F.lit(0)) != 1) | (n < 1)

    def outcome(m: Column) -> Column:
        reason = F.when(~exists, "missing_image").when(hidden_shape.isNull(), "no_last_hidden_state").when(unexpected, "unexpected_hidden_shape")
        reason = reason.when(F.sqrt(n.cast("double")) != F.floor(F.sqrt(n.cast("double"))), "non_square_patch_grid").when(F.coalesce(F.size(m), F.lit(0)) == 0, "empty_keep_indices")
        known = reason.isNull() | reason.isin("non_square_patch_grid", "empty_keep_indices")
        pruned = F.transform(hidden_shape, lambda x, i: F.when(i == 1, F.size(m) + 1).otherwise(x).cast("long"))
        return F.struct(
            reason.isNull().alias("applied"), reason.alias("reason"), F.when(reason.isNull(), F.lit("after_vision_encoder")).alias("hook_point"), F.when(known, n).alias("tokens_before"),
            F.when(reason.isNull(), F.size(m).cast("long")).alias("tokens_after"), F.when(reason.isNull() | (reason == "unexpected_hidden_shape"), hidden_shape).alias("shape"),
            F.when(reason.isNull(), pruned).alias("pruned_shape"), F.when(reason.isNull(), m).alias("mapped_patch_indices"),
        )

    return F.transform(F.array(mapped_patches(n, meta["keep_indices"], rows, cols)), outcome)[0]


def prune_hidden(hidden: Column, mapped: Column) -> Column:
    """Hidden states (the class token, then the patches) pruned to the class token and the mapped patches."""
    return F.concat(F.slice(hidden, 1, 1), F.transform(mapped, lambda i: F.get(hidden, i + 1)))


def image_parts(paths: Column, encoded: Column) -> Column:
    """The base64 texts of some paths in their order; `encoded` maps the paths of files that exist. For `message_parts`."""
    return F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.try_element_at(encoded, p))
