"""Judge prompts and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotemill.functions.text import WS, strip_citations

#: Fixed value: the rubric the judge model is given.
RUBRIC = """
    You are evaluating a multimodal RAG system output.
    Judge two things:
    1. Correctness: whether the predicted answer is semantically correct with respect to the gold answer.
    2. Faithfulness: whether the predicted answer is supported by the provided evidence.

    Rules:
    - Focus on semantic equivalence, not exact wording.
    - Ignore citation formatting like [text3] or [image2].
    - Ignore extra explanation if the core answer is correct.
    - Treat numerically equivalent answers as correct only when they mean the same thing.
    - Be careful to distinguish percent from percentage point, and absolute from relative change.
    - If the prediction includes the correct answer plus unsupported extra claims, correctness may still be high but faithfulness should be lower.

    Correctness score rubric:
    5 = fully correct
    4 = correct but slightly imprecise
    3 = partially correct
    2 = mostly incorrect
    1 = incorrect but related
    0 = completely incorrect

    Faithfulness score rubric:
    5 = fully supported by evidence
    4 = mostly supported with minor unsupported detail
    3 = partially supported
    2 = weakly supported
    1 = mostly unsupported
    0 = contradicted or unsupported

    Return ONLY valid JSON with this schema:
    {
    "correct": 0 or 1,
    "score": integer 0-5,
    "reason": "short explanation",
    "faithful": 0 or 1,
    "faithfulness_score": integer 0-5,
    "faithfulness_reason": "short explanation"
    }
"""
NO_EVIDENCE = "No evidence provided."
INVALID = "Judge returned invalid JSON"


def judge_prompt(question: Column, gold: Column, pred: Column, evidence: Column) -> Column:
    blank = F.regexp_replace(F.coalesce(evidence, F.lit("")), WS + "+", "") == ""
    slots = {"Question": question, "Gold answer": gold, "Predicted answer": strip_citations(pred), "Evidence": F.when(blank, NO_EVIDENCE).otherwise(evidence)}
    parts = [F.lit(RUBRIC)]
    for name, value in slots.items():
        parts += [F.lit(f"\n    {name}:\n    "), F.coalesce(value, F.lit("")), F.lit("\n")]
    return F.concat(*parts)


def judge_verdict(reply: Column) -> Column:
    """The six fields of a reply, white space around it aside.

    What is no JSON object, or more than one, gives zeros and the reason with the first 200 characters; a field that is
    absent or no number gives 0, an absent text an empty one.
    """
    text = F.regexp_replace(F.coalesce(reply, F.lit("")), f"^{WS}+|{WS}+$", "")
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))  # so that what follows the object is seen
    v = F.try_variant_get(listed, "$[0]", "variant")
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & text.endswith("}")
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & alone

    def number(name: str) -> Column:
        return F.when(ok, F.coalesce(F.try_variant_get(v, f"$.{name}", "int"), F.lit(0))).otherwise(0).alias(name)

    def words(name: str, otherwise: Column) -> Column:
        return F.when(ok, F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))).otherwise(otherwise).alias(name)

    return F.struct(
        number("correct"), number("score"), words("reason", F.concat(F.lit(INVALID + ": "), F.substring(text, 1, 200))),
        number("faithful"), number("faithfulness_score"), words("faithfulness_reason", F.lit(INVALID)),
    )
