"""Reading level of each text, from unigram language models per level.

One additively smoothed unigram distribution a level over the words of a text and the ends of its sentences. The models
are fitted on texts seeded by a formula (words per sentence and letters per word), a bounded and documented sample
(`fit_rows`, chosen by hash); fitted on at most half of the texts, the other half tells how far to trust them
(`agreement`). Every text is then scored and gets the level of the highest posterior; the formula has no part in that.
`clear_cases` takes the texts by what the models say of easy against hard, and lets through those whose figures bear it out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.textkit import VOTES

LEVELS = ("easy", "medium", "hard")
FIT_ROWS = 4000
SMOOTHING = 0.5

_NOT_PROSE = re.compile(
    r"""\s*(?:
        .*\|.*\|                                                                  # a table row
      | (?:table|chart|figure|map|exhibit|fig|plate)\.?\s+\d+\s*[.:]\s.*[^.!?\s]\s*$   # a caption
      | [*•‣▪◦·+–-]\s | \(?\d{1,3}[.)]\s | [a-z]\)\s                            # a list point
      | \d+(?:\.\d+)+\.?\s+\S.*[^.!?:;,\s]\s*$ | \#{1,6}\s                      # a heading
    )""",
    re.I | re.X,
)
_LINK = re.compile(r"\b[a-z][a-z0-9+.-]*://\S+|\bwww\.\S+", re.I)
_QUOTE_ID = re.compile(r"\[(?:text|image|img|quote)\s*\d+\](?:\s*\((?:page|p)[^)]*\))?", re.I)
_LINE_END = re.compile(r"\r\n|[\n\r\v\f\x85\u2028\u2029]")
_WORD = re.compile(r"[^\W\d_]+(?:['’‐-][^\W\d_]+)*")
_END = re.compile(r"[.!?…][\"'”’»)\]]*$")
_SENTENCE = "\0end"
_TERMINAL = re.compile(r"[.!?…:;,][\"'”’»)\]]*$")


def prose_paragraphs(text: str) -> list[str]:
    """The running text, a string per paragraph: without tables, captions, headings, list points, links and quote ids."""
    out: list[str] = []
    lines: list[str] = []

    def close() -> None:
        if len(lines) > 1 or lines and (_TERMINAL.search(lines[0]) or len(lines[0].split()) > 8):  # else a heading of its own
            out.append(" ".join(lines))
        lines.clear()

    if "://" in text or "www." in text:
        text = _LINK.sub(" ", text)
    if "[" in text:
        text = _QUOTE_ID.sub(" ", text)
    for line in _LINE_END.split(text):
        line = line.strip()
        if not line or _NOT_PROSE.match(line):
            close()
        else:
            lines.append(line.lstrip("> ") if line[0] == ">" else line)
    close()
    return out


def figures(paragraphs: list[str]) -> tuple[list[int], list[str], int]:
    """The words of each sentence as a count, all words in lower case, and the letters of all words. The end of a paragraph ends its sentence."""
    lengths: list[int] = []
    words: list[str] = []
    marks = before = 0
    for p in paragraphs:
        for token in p.lower().split():
            if token.isalpha():
                words.append(token)
                continue
            for word in _WORD.findall(token):
                words.append(word)
                marks += 0 if word.isalpha() else sum(not c.isalpha() for c in word)
            if _END.search(token) and len(words) > before:
                lengths.append(len(words) - before)
                before = len(words)
        if len(words) > before:
            lengths.append(len(words) - before)
            before = len(words)
    return lengths, words, sum(map(len, words)) - marks


def formula_level(sentences: int, words: int, letters: int) -> str:
    """The level by formula, the seed of the models and the exact check."""
    per_sentence, per_word = words / sentences, letters / words
    if per_sentence <= 15 and per_word <= 4.0:
        return "easy"
    if per_sentence >= 20 and per_word >= 5.5:
        return "hard"
    return "medium"


def _tokens(sentences: int, counts: Counter) -> list[tuple[str, int]]:
    return [*counts.items(), (_SENTENCE, sentences)]


def _english(counts: Counter) -> bool:
    votes = dict.fromkeys(("en", "de", "fr", "es"), 0.0)
    for w in counts.keys() & VOTES.keys():
        for lang, v in VOTES[w]:
            votes[lang] += v * counts[w]
    return votes["en"] > max(votes["de"], votes["fr"], votes["es"])


def _measured(text: str | None, least_words: int):
    """(lengths of the sentences, words, their counts, letters), or None for what isn't English prose of enough words."""
    if not text:
        return None
    lengths, words, letters = figures(prose_paragraphs(text))
    if len(words) < least_words:
        return None
    counts = Counter(words)
    return (lengths, words, counts, letters) if _english(counts) else None


def _sampled(documents: DataFrame, fit_rows: int, most: float = 1.0) -> Column:
    """Whether a text belongs to those the models are fitted on: about `fit_rows`, and at most the share `most`."""
    share = min(most, fit_rows / max(1, documents.count()))
    return F.pmod(F.xxhash64("doc_id"), F.lit(2**62)) < int(share * 2**62)


def fit(documents: DataFrame, fit_rows: int = FIT_ROWS, least_words: int = 30, most: float = 1.0) -> dict[str, tuple[float, ...]]:
    """Log-probabilities of each token by level, and under '' those of an unseen token. Priors are equal.

    The vocabulary is bounded by the sample, so it may go to the driver.
    """
    sample = documents.where(_sampled(documents, fit_rows, most)).select("text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                if m := _measured(text, least_words):
                    level = formula_level(len(m[0]), len(m[1]), m[3])
                    for token, n in _tokens(len(m[0]), m[2]):
                        total[level, token] += n
        yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["level", "token", "n"])

    counted = sample.mapInPandas(count, "level string, token string, n long").groupBy("token").pivot("level", list(LEVELS)).agg(F.sum("n"))
    table = {r["token"]: [r[x] or 0 for x in LEVELS] for r in counted.collect()}
    totals = [sum(v[i] for v in table.values()) + SMOOTHING * (len(table) + 1) for i in range(len(LEVELS))]
    model = {t: tuple(math.log((n + SMOOTHING) / total) for n, total in zip(v, totals)) for t, v in table.items()}
    return model | {"": tuple(math.log(SMOOTHING / total) for total in totals)}


def graded(documents: DataFrame, fit_rows: int = FIT_ROWS, least_words: int = 30, most: float = 1.0) -> DataFrame:
    """(`doc_id`, `level`, `posterior`, `lean`, `sentences`, `words`, `letters`) of each English text with enough prose.

    `level` has the highest posterior, `lean` is the likelier of easy and hard; a tie goes to the easier. Null, empty,
    short and foreign texts have no row, nor have rows without an id; a level without a text in the sample is as likely as its smoothing makes it.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, fit_rows, least_words, most))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs = model.value
        unseen = logs[""]
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                m = _measured(text, least_words)
                if not m:
                    continue
                a = b = c = 0.0
                for token, n in _tokens(len(m[0]), m[2]):
                    x, y, z = logs.get(token, unseen)
                    a, b, c = a + n * x, b + n * y, c + n * z
                each = (a, b, c)
                top = max(each)
                out.append((doc_id, LEVELS[each.index(top)], 1 / sum(math.exp(v - top) for v in each), "easy" if a >= c else "hard", len(m[0]), len(m[1]), m[3]))
            yield pd.DataFrame(out, columns=["doc_id", "level", "posterior", "lean", "sentences", "words", "letters"])

    schema = "doc_id long, level string, posterior double, lean string, sentences long, words long, letters long"
    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(score, schema)


def _by_formula() -> Column:
    per_sentence, per_word = F.col("words") / F.col("sentences"), F.col("letters") / F.col("words")
    return F.when((per_sentence <= 15) & (per_word <= 4.0), "easy").when((per_sentence >= 20) & (per_word >= 5.5), "hard").otherwise("medium")


def clear_cases(documents: DataFrame, **kw) -> DataFrame:
    """(`doc_id`, `level`): the texts the models find easy rather than hard, or the reverse, and whose figures say that they are."""
    return graded(documents, **kw).where(_by_formula() == F.col("lean")).select("doc_id", F.col("lean").alias("level")).distinct()


def agreement(documents: DataFrame, fit_rows: int = FIT_ROWS, most: float = 0.5) -> DataFrame:
    """(`formula`, `level`, `lean`, `texts`): how the models grade the texts they were not fitted on, against the formula."""
    held_out = documents.where(~_sampled(documents, fit_rows, most)).select("doc_id")
    told = graded(documents, fit_rows, most=most).join(held_out, "doc_id", "left_semi")
    return told.groupBy(_by_formula().alias("formula"), "level", "lean").agg(F.count("*").alias("texts"))
