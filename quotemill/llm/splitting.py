"""Cutting oversized texts into overlapping pieces at natural boundaries.

Each text becomes one sorted array of boundary offsets per level (paragraph, sentence, word) and the prefix sums of
its stretches. A piece starts at an offset; a binary search finds the last boundary under the limit, first among
paragraphs, then sentences, then words, and without any the cut is hard. The next piece steps back by up to the
overlap, again to a boundary. Short texts never leave the JVM.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 1500
OVERLAP = 150
LEVELS = ("paragraph", "sentence", "word")

_BREAK = r"(?:\r\n|\n|\r(?!\n))"
_BLANK_LINES = re.compile(rf"{_BREAK}(?:[ \t]*{_BREAK})+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_WHITE = re.compile(r"\s+")


def boundaries(text: str) -> dict[str, np.ndarray]:
    """For each level the sorted offsets where a new stretch may begin, 0 and the length included; each level holds the coarser ones."""
    ends = {0, len(text)}
    out = {}
    for level, pattern in zip(LEVELS, (_BLANK_LINES, _SENTENCE_END, _WHITE)):
        ends |= {m.end() for m in pattern.finditer(text)}
        out[level] = np.array(sorted(ends), dtype=np.int64)
    return out


def sufficient_level(text: str, cuts: dict[str, np.ndarray], limit: int) -> str:
    """The first level whose stretches, without white space at their ends, all fit the limit; otherwise `none`."""
    for level in LEVELS:
        at = cuts[level]
        prefix = np.diff(at)  # raw length of each stretch; only those over the limit need their white space looked at
        if all(len(text[at[i] : at[i + 1]].strip()) <= limit for i in np.flatnonzero(prefix > limit)):
            return level
    return "none"


def piece_offsets(text: str, cuts: dict[str, np.ndarray], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, level of the cut at its end) of every piece; pieces cover the text and each begins at most `overlap` before the end of the one before."""
    n, start, out = len(text), 0, []
    covered = 0
    while covered < n:
        if n - start <= limit:
            out.append((start, n, "end"))
            break
        end, level = start + limit, "hard"
        for name in LEVELS:
            at = cuts[name]
            k = int(np.searchsorted(at, start + limit, side="right")) - 1
            if at[k] > covered:
                end, level = int(at[k]), name
                break
        out.append((start, end, level))
        covered = end
        words = cuts["word"]
        k = int(np.searchsorted(words, end - overlap, side="left"))
        start = int(words[k]) if words[k] < end else end - min(overlap, limit - 1)
        start = max(start, out[-1][0] + 1)
    return out


_PIECES = "struct<boundary:string,pieces:array<struct<start:int,stop:int,cut:string>>>"


def _cutter(limit: int, overlap: int):
    @F.pandas_udf(_PIECES)
    def cut(texts: pd.Series) -> pd.DataFrame:
        names, lists = [], []
        for text in texts:
            at = boundaries(text)
            names.append(sufficient_level(text, at, limit))
            lists.append([{"start": a, "stop": b, "cut": c} for a, b, c in piece_offsets(text, at, limit, overlap)])
        return pd.DataFrame({"boundary": names, "pieces": lists})

    return cut


def oversized(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The rows whose text is over the limit, with `boundary` and `pieces` (offsets in code points). Null and short texts have no row."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    plan = _cutter(limit, overlap)(F.col(text))
    return df.where(F.char_length(text) > limit).withColumn("_plan", plan).withColumns({"boundary": F.col("_plan.boundary"), "pieces": F.col("_plan.pieces")}).drop("_plan")


def split_oversized(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: the columns of df but for the text, and `piece_no`, `start`, `stop`, `cut`, `boundary`, `piece`.

    A text within the limit is one piece with boundary `whole`; a null or empty text too, its piece being itself.
    Columns of df that are named like one of the result are left out.
    """
    df = df.drop(*[c for c in ("piece_no", "start", "stop", "cut", "boundary", "piece", "pieces", "_plan", "_p") if c != text])
    long = oversized(df, text, limit, overlap).select("*", F.posexplode("pieces").alias("piece_no", "_p")).select(
        "*", F.col("_p.start").alias("start"), F.col("_p.stop").alias("stop"), F.col("_p.cut").alias("cut")
    )
    long = long.withColumn("piece", F.substring(F.col(text), F.col("start") + 1, F.col("stop") - F.col("start"))).drop("_p", "pieces")
    short = df.where((F.char_length(text) <= limit) | F.col(text).isNull()).withColumns({
        "boundary": F.lit("whole"), "piece_no": F.lit(0), "start": F.lit(0), "stop": F.coalesce(F.char_length(text), F.lit(0)), "cut": F.lit("end"), "piece": F.col(text),
    })
    return long.unionByName(short).drop(text)


def quotes(examples: DataFrame, field: str = "text_quotes") -> DataFrame:
    """One row per text quote of every example."""
    return examples.select("example_no", F.explode(field).alias("q")).select("example_no", "q.quote_id", "q.text", "q.page_id", "q.layout_id")


def rebuilt(pieces: DataFrame, *key: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Per text, what its pieces of `split_oversized` say of it; `key` must tell the texts apart.

    `digest` and `chars` are of the text put together again, `fits` and `repeats` tell whether every piece keeps the
    limit and repeats at most `overlap` characters of the one before, `times` is 1. A null text counts as an empty one.
    """
    before = F.lag("stop").over(Window.partitionBy(*key).orderBy("start"))
    new = pieces.select(*key, "start", "piece", (F.coalesce(before, F.lit(0)) - F.col("start")).alias("again")).withColumn("part", F.expr("substring(coalesce(piece, ''), again + 1)"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "")  # of one text
    fits, repeats = F.max(F.coalesce(F.char_length("piece"), F.lit(0))) <= limit, (F.min("again") >= 0) & (F.max("again") <= overlap)
    whole = new.groupBy(*key).agg(text.alias("text"), fits.alias("fits"), repeats.alias("repeats"))
    return whole.select(*key, F.md5("text").alias("digest"), F.char_length("text").cast("long").alias("chars"), "fits", "repeats", F.lit(1).cast("long").alias("times"))
