"""What a model outside supplies, as exchangeable stages, and doubles that need no model.

An encoder takes an array of texts (or paths) and gives an array of vectors, null for what it could not read; a chat
model takes a prompt (and extras) and gives text. Both are functions from columns to columns, so that a double can be a
plain expression and a real model a vectorised function that is loaded once per worker.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[Column], Column]
Chat = Callable[[Column], Column]


def letters(texts: Column) -> Column:
    """A double: per text the counts of the letters a to z, of unit length; a null or letterless text has the zero vector."""

    def one(t: Column) -> Column:
        low = F.lower(F.coalesce(t, F.lit("")))
        counts = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in string.ascii_lowercase])
        sized = F.transform(F.array(counts), lambda v: F.struct(v.alias("v"), F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-300)).alias("n")))
        return F.transform(sized, lambda z: F.transform(z["v"], lambda x: x / z["n"]))[0]  # bound, so that the length is made once

    return F.transform(texts, one)


def model(load: Callable[[], Callable[[Sequence[str | None]], Sequence[Sequence[float] | None]]]) -> Encoder:
    """An encoder from a model: `load` runs once per worker and gives a function from texts to vectors; each distinct text of a batch is encoded once."""
    loaded: list = []

    @F.pandas_udf("array<array<float>>")
    def encode(lists: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(load())
        every = list(dict.fromkeys(t for ts in lists if ts is not None for t in ts))
        known = dict(zip(every, loaded[0](every))) if every else {}
        return pd.Series([None if ts is None else [known[t] for t in ts] for ts in lists])

    return encode


def hashed(dim: int = 64) -> Encoder:
    """A double of a learned encoder: words hashed to places of a vector of unit length."""

    def load():
        import xxhash

        def encode(texts: Sequence[str | None]) -> list[list[float]]:
            out = np.zeros((len(texts), dim))
            for row, t in zip(out, texts):
                for w in (t or "").lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    row[h % dim] += 1.0 if h >> 63 else -1.0
            return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

        return encode

    return model(load)


def chat(load: Callable[[], Callable[[str], str]]) -> Chat:
    """A served or local model as a column: `load` runs once per worker; a null prompt has a null reply."""
    loaded: list = []

    @F.pandas_udf("string")
    def reply(prompts: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(load())
        return prompts.map(loaded[0], na_action="ignore")

    return reply


def first_evidence(prompt: Column) -> Column:
    """A double of the answering model: the first eight words of the first quote in the prompt, with its citation, else a fixed text."""
    line = F.regexp_extract(prompt, r"(?m)^- \[([^\]]*)\] \(page [^)]*\): ([^\n]*)", 2)
    cited = F.regexp_extract(prompt, r"(?m)^- \[([^\]]*)\] \(page [^)]*\): ", 1)
    words = F.array_join(F.slice(F.filter(F.split(line, " "), lambda w: w != ""), 1, 8), " ")
    return F.when(prompt.isNull(), None).when(cited == "", "The evidence is insufficient.").otherwise(F.concat(words, F.lit(" ["), cited, F.lit("]")))


def same_words(prompt: Column) -> Column:
    """A double of the judge: correct if the reference answer stands in the prediction, faithful if the prediction stands in the evidence."""
    after = lambda c, mark: F.substring_index(c, mark, -1)
    upto = lambda c, mark: F.substring_index(c, mark, 1)
    gold = F.lower(F.trim(after(upto(prompt, "\n\n    Predicted answer:\n    "), "\n    Gold answer:\n    ")))
    said = F.lower(F.trim(after(upto(prompt, "\n\n    Evidence:\n    "), "\n    Predicted answer:\n    ")))
    shown = F.lower(after(prompt, "\n    Evidence:\n    "))
    correct = F.when(F.contains(said, gold) & (gold != ""), 1).otherwise(0)
    faithful = F.when(F.contains(shown, said), 1).otherwise(0)
    return F.to_json(F.struct(correct.alias("correct"), (correct * 5).alias("score"), F.lit("words").alias("reason"), faithful.alias("faithful"), (faithful * 5).alias("faithfulness_score"), F.lit("words").alias("faithfulness_reason")))
