"""Prompts and evidence blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lines of the prompt.
HEAD = ("Answer the question using only the retrieved evidence.", "If the evidence is insufficient, say that clearly.", "Cite quote IDs you used in brackets, e.g. [text3] [image2].")
TEXTS, IMAGES, LAST = "Retrieved text evidence:", "Retrieved image evidence:", "Return a short answer."


def _shown(c: Column, missing: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(missing))


def _block(title: str, quotes: Column, field: str) -> Column:
    lines = F.transform(quotes, lambda q: F.concat(F.lit("- ["), _shown(q["quote_id"], "None"), F.lit("] (page "), _shown(q["page_id"], "None"), F.lit(", layout "), _shown(q["layout_id"], "None"), F.lit("): "), _shown(q[field], "")))
    return F.when(F.coalesce(F.size(quotes), F.lit(0)) > 0, F.concat(F.array(F.lit(title)), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def build_prompt(question: Column, texts: Column, images: Column) -> Column:
    head = F.array(*map(F.lit, HEAD), F.lit(""), F.concat(F.lit("Question: "), _shown(question, "None")), F.lit(""))
    return F.array_join(F.concat(head, _block(TEXTS, texts, "text"), _block(IMAGES, images, "img_description"), F.array(F.lit(LAST))), "\n")


def evidence_text(texts: Column, images: Column) -> Column:
    none = F.array().cast("array<string>")
    line = lambda kind, field: lambda q: F.concat(F.lit("["), _shown(q["quote_id"], "None"), F.lit(f"] {kind}: "), _shown(q[field], ""))
    return F.array_join(F.concat(F.coalesce(F.transform(texts, line("TEXT", "text")), none), F.coalesce(F.transform(images, line("IMAGE", "img_description")), none)), "\n")


def retrieved_ids(texts: Column, images: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.transform(texts, lambda q: q["quote_id"]), none), F.coalesce(F.transform(images, lambda q: q["quote_id"]), none))
