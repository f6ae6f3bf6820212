"""Evidence pruning: prefixes of ranked lists, grid tiles, patch selection, and the map from coarse to fine grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("no_pruning", "uniform_pruning", "visual_only_pruning", "visual_patch_pruning", "model_internal_visual_pruning")


PATCH_MODES = MODES[3:]
#: Fixed value: where a model-side hook takes up the kept indices.
HOOK_POINT = "after vision encoder patch embeddings, before projector / multimodal merge"
META = (
    "struct<mode:string,skipped:boolean,reason:string,tokens_before:long,tokens_after:long,grid_rows:long,grid_cols:long,keep_indices:array<long>,"
    "keep_boxes:array<array<long>>,scores:array<double>,rendered_image_path:string,hook_required:boolean,hook_point:string>"
)


def check(mode: str, keep_ratio: float, rows: int = 4, cols: int = 4, model: str | None = "") -> None:
    """Raises ValueError for parameters no policy takes; the two patch modes need the name of a scoring model."""
    if mode not in MODES:
        raise ValueError(f"unknown pruning mode {mode}")
    if not 0 < keep_ratio <= 1:
        raise ValueError("keep_ratio must be over 0 and at most 1")
    if rows <= 0 or cols <= 0:
        raise ValueError("the grid must be positive")
    if mode in PATCH_MODES and model is None:
        raise ValueError(f"{mode} needs a model for the scores of tiles")


def keep_count(n: Column, ratio: float) -> Column:
    """Truncated n*ratio, at least 1 of a non-empty list."""
    return F.when(n == 0, 0).otherwise(F.least(n, F.greatest(F.lit(1), (n * F.lit(float(ratio))).cast("int"))))


def keep_prefix(items: Column, ratio: float) -> Column:
    return F.slice(items, F.lit(1), keep_count(F.size(items), ratio))


def visual_tokens(images: Column, rows: int = 4, cols: int = 4) -> Column:
    return F.aggregate(images, F.lit(0).cast("long"), lambda a, q: a + F.coalesce(q["visual_pruning"]["tokens_after"], F.lit(rows * cols).cast("long")))


def patch_keep(scores: Column, ratio: float, least: int = 4) -> Column:
    """Indices (from 0, ascending) of the best scored tiles; ties go to the lower index, NaN ranks last."""
    n = F.size(scores)
    k = F.least(F.greatest(F.lit(1), F.lit(least), (n * F.lit(float(ratio))).cast("int")), n)
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct(F.isnan(s).alias("nan"), (-s).alias("s"), i.alias("i"))))
    return F.array_sort(F.slice(F.transform(ranked, lambda x: x["i"]), F.lit(1), k))


def _edge(i: Column, n: int, size: Column) -> Column:
    return F.when(i == n, size).otherwise(F.floor(i * (size.cast("double") / n)).cast("int"))


def grid_boxes(width: Column, height: Column, rows: int = 4, cols: int = 4) -> Column:
    """Row-major [left, top, right, bottom] of a rows x cols grid with truncated edges."""

    def box(k: Column) -> Column:
        r, c = F.floor(k / cols).cast("int"), k % cols
        return F.array(_edge(c, cols, width), _edge(r, rows, height), _edge(c + 1, cols, width), _edge(r + 1, rows, height))

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), box)


def coarse_to_fine(kept: Column, fine: int, rows: int = 4, cols: int = 4) -> Column:
    """Distinct fine patches under the kept coarse cells, in the order kept, then row-major; cells out of range are skipped, edges round half to even."""
    edge = lambda j, n: F.rint(j * float(fine) / n).cast("int")
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))

    def cell(x: Column) -> Column:
        r, c = F.floor(x / cols).cast("int"), (x % cols).cast("int")
        return F.flatten(F.transform(span(edge(r, rows), edge(r + 1, rows)), lambda a: F.transform(span(edge(c, cols), edge(c + 1, cols)), lambda b: a * fine + b)))

    return F.array_distinct(F.flatten(F.transform(F.filter(kept, lambda x: (x >= 0) & (x < rows * cols)), cell)))


def montage_layout(n: Column, tile: int = 224) -> Column:
    cols = F.least(F.lit(4), n)
    rows = F.ceil(n / cols).cast("int")
    return F.struct(cols.alias("cols"), rows.alias("rows"), (cols * tile).alias("width"), (rows * tile).alias("height"))


def montage_name(path: Column, mode: str, ratio: float, *key: Column) -> Column:
    """The rendered file's name: the image's stem with mode and percentage, and in front of it a key, as stems repeat between questions."""
    base = F.element_at(F.split(path, "/"), -1)
    stem, suffix = F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(base, r"(?<=.)(\.[^.]*)$", 1)
    return F.concat(*[F.concat(F.coalesce(k.cast("string"), F.lit("None")), F.lit("_")) for k in key], stem, F.lit(f"_pruned_{mode}_{int(ratio * 100)}"), suffix)


def patch_meta(mode: str, ratio: float, scores: Column, width: Column, height: Column, rendered: Column | None = None, rows: int = 4, cols: int = 4, least: int = 4) -> Column:
    """The metadata of one image under a patch mode: which tiles are kept, with boxes and scores in the order of their index.

    `scores` has one value per tile in row-major order and is null for a missing image, which is skipped and keeps its tokens.
    """
    before = F.lit(rows * cols).cast("long")
    nothing = lambda kind: F.lit(None).cast(kind)
    skipped = F.struct(F.lit(mode), F.lit(True), F.lit("missing_image"), before, before, *[nothing(t) for t in ("long", "long", "array<long>", "array<array<long>>", "array<double>", "string", "boolean", "string")])

    def kept(x: Column) -> Column:
        hook = mode == "model_internal_visual_pruning"
        return F.struct(
            F.lit(mode), nothing("boolean"), nothing("string"), before, F.size(x["k"]).cast("long"), F.lit(rows).cast("long"), F.lit(cols).cast("long"), x["k"].cast("array<long>"),
            F.transform(x["k"], lambda i: F.get(x["boxes"], i)).cast("array<array<long>>"), F.transform(x["k"], lambda i: F.get(x["scores"], i).cast("double")),
            nothing("string") if hook or rendered is None else rendered, F.lit(True) if hook else nothing("boolean"), F.lit(HOOK_POINT) if hook else nothing("string"),
        )

    made = F.struct(patch_keep(scores, ratio, least).alias("k"), grid_boxes(width, height, rows, cols).alias("boxes"), scores.alias("scores"))
    chosen = F.transform(F.array(made), kept)[0]  # bound, so that it is made once
    return F.when(scores.isNull(), skipped.cast(META)).otherwise(chosen.cast(META))


def apply_policy(mode: str, ratio: float, texts: Column, images: Column, tiles: Column | None = None, out_dir: str = "pruned_images", key: Column | None = None, rows: int = 4, cols: int = 4, least: int = 4) -> Column:
    """`selected_text_quotes`, `selected_img_quotes` and `pruning` (the stats) after a policy, as one struct.

    The list modes keep prefixes. The patch modes keep both lists and give each image its `visual_pruning`; `tiles` goes
    with the images by place and has, per image, `scores`, `width` and `height`, scores null for a missing image. With
    visual_patch_pruning `local_img_path` becomes that of the rendered montage, named by `key` and quote. Null lists are empty.
    """
    check(mode, ratio, rows, cols, None if tiles is None else "")
    texts, images = F.coalesce(texts, F.array()), F.coalesce(images, F.array())
    after_texts = keep_prefix(texts, ratio) if mode == "uniform_pruning" else texts
    after_images = keep_prefix(images, ratio) if mode in ("uniform_pruning", "visual_only_pruning") else images
    if mode in PATCH_MODES:

        def rewritten(q: Column, i: Column) -> Column:
            t = F.get(tiles, i)
            path = F.concat(F.lit(out_dir.rstrip("/") + "/"), montage_name(q["local_img_path"], mode, ratio, *([key] if key is not None else []), q["quote_id"]))
            meta = patch_meta(mode, ratio, t["scores"], t["width"], t["height"], path, rows, cols, least)
            out = q.withField("visual_pruning", meta)
            return out.withField("local_img_path", F.when(t["scores"].isNull(), q["local_img_path"]).otherwise(path)) if mode == "visual_patch_pruning" else out

        after_images = F.transform(images, rewritten)
    stats = pruning_stats(mode, texts, images, after_texts, after_images, rows, cols)
    return F.struct(after_texts.alias("selected_text_quotes"), after_images.alias("selected_img_quotes"), stats.alias("pruning"))


def pruning_stats(mode: str, texts: Column, images: Column, after_texts: Column, after_images: Column, rows: int = 4, cols: int = 4) -> Column:
    size = lambda c: F.size(c).cast("long")
    return F.struct(
        F.lit(mode).alias("mode"), size(texts).alias("text_before"), size(after_texts).alias("text_after"), size(images).alias("images_before"), size(after_images).alias("images_after"),
        visual_tokens(images, rows, cols).alias("visual_tokens_before"), visual_tokens(after_images, rows, cols).alias("visual_tokens_after"),
    )
