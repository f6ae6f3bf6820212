"""Text normalisation and answer metrics as columns; Unicode white space and word characters are spelled out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what counts as white space.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, white space collapsed, then everything but word characters and spaces deleted. Null stays null."""
    return F.regexp_replace(collapse(F.lower(c)), r"[^\p{L}\p{N}_ ]", "")


def strip_citations(c: Column) -> Column:
    """Non-empty brackets deleted, white space collapsed."""
    return collapse(F.regexp_replace(c, r"\[[^\]]+\]", ""))


def tokens(c: Column) -> Column:
    """The words of a text in normal form, sorted. Project them before counting: an expression is evaluated wherever it stands."""
    return F.array_sort(F.filter(F.split(normalize_text(c), " +"), lambda t: t != ""))


def _numbered(sorted_tokens: Column) -> Column:
    """Each token with the number of its occurrence, so that a multiset becomes a set."""
    return F.transform(sorted_tokens, lambda t, i: F.concat(t, F.lit(" "), (i + 1 - F.array_position(sorted_tokens, t)).cast("string")))


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalize_text(pred) == normalize_text(gold)).cast("double")


def shared_tokens(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two sorted token arrays."""
    return F.size(F.array_intersect(_numbered(p), _numbered(g)))


def f1_of(n: Column, m: Column, shared: Column) -> Column:
    """F1 of two texts of n and m tokens; null if a count is, 1 if both are empty, 0 if one is or nothing is shared."""
    a, b, s = n.cast("double"), m.cast("double"), shared.cast("double")
    return F.when(a.isNull() | b.isNull(), None).when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0) | (s == 0), 0.0).otherwise(2 * (s / a) * (s / b) / (s / a + s / b))


def token_f1(pred: Column, gold: Column) -> Column:
    """Multiset overlap of two short texts in one expression; `answer_scores` takes texts of any length."""
    p, g = tokens(pred), tokens(gold)
    return f1_of(F.size(p), F.size(g), shared_tokens(p, g))


def retrieval_recall(pred: Column, gold: Column) -> Column:
    """Share of the distinct gold ids that were retrieved; 0 without gold."""
    g = F.array_distinct(gold)
    return F.when(F.coalesce(F.size(g), F.lit(0)) <= 0, 0.0).otherwise(F.size(F.array_intersect(pred, g)) / F.size(g).cast("double"))


def lexical_metrics(pred: Column, gold: Column) -> Column:
    """Citations are stripped from the prediction only."""
    clean = strip_citations(pred)
    return F.struct(exact_match(clean, gold).alias("em"), token_f1(clean, gold).alias("f1"))


def _begins(s: Column) -> Column:
    """Where each distinct token begins in a sorted array."""
    return F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)), lambda i: i.isNotNull())


def _occurrences(s: Column, begins: Column) -> Column:
    """Each token with the number of its occurrence, in linear time; both arguments must be projected columns."""
    count = lambda i, j: F.coalesce(F.get(begins, j + 1), F.size(s)) - i
    return F.flatten(F.transform(begins, lambda i, j: F.transform(F.sequence(F.lit(1), count(i, j)), lambda k: F.concat(F.get(s, i), F.lit(" "), k.cast("string")))))


def answer_scores(rows: DataFrame, pred: str, gold: str) -> DataFrame:
    """The rows with `em` and `f1`; citations are stripped from the prediction only. A null text on either side gives nulls.

    Every step is projected once, and none costs more than the sort of a row's tokens, however long its texts are.
    """
    split = lambda c: F.array_sort(F.filter(F.split(c, " +"), lambda t: t != ""))
    step = rows.withColumns({"_p": normalize_text(strip_citations(F.col(pred))), "_g": normalize_text(F.col(gold))})
    step = step.withColumns({"_em": (F.col("_p") == F.col("_g")).cast("double"), "_p": split(F.col("_p")), "_g": split(F.col("_g"))})
    step = step.withColumns({"_pb": _begins(F.col("_p")), "_gb": _begins(F.col("_g"))})
    step = step.withColumns({"_po": _occurrences(F.col("_p"), F.col("_pb")), "_go": _occurrences(F.col("_g"), F.col("_gb"))})
    f1 = f1_of(F.size("_p"), F.size("_g"), F.size(F.array_intersect("_po", "_go")))
    return step.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_em").alias("em"), f1.alias("f1"))
