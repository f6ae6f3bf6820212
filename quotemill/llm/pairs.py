"""Defects of prompt and response pairs.

A suffix automaton of the prompt measures which part of the response is copied from it; an automaton of refusal
phrases (Aho-Corasick) finds refusals; a stack of delimiters and the way the last sentence ends find what breaks off;
votes of stopwords tell the language of each sentence. Whether a word may end a sentence is learned from all
responses: how often it stands before a full stop, against how often it stands anywhere.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.llm.textkit import STOPWORDS, language_votes

#: Phrases of declining, or of saying that one cannot answer, in lower case without punctuation.
REFUSALS = """
unable to answer | unable to help | unable to provide | unable to assist | not able to answer | not able to help | not able to provide | not able to read | be able to read | be able to answer | be able to help
cannot provide | cannot help | cannot answer | cannot assist | cannot comment | cannot discuss | cannot read | can not provide | can not answer | can not help
can't provide | can't help | can't answer | can't assist | can't comment | can't discuss | can't read | not possible for me | impossible for me | no answer can be
not have enough context | not have enough information | don't have enough | not have sufficient | must decline | have to decline | decline to | i refuse | don't allow me | do not allow me | not allowed to | not permitted to
beyond what i can | outside of what i may | outside what i can | outside of what i can | rather not say | rather not answer | prefer not to | not comfortable
evidence is insufficient | insufficient to determine | insufficient evidence | insufficient information | not contain this | not contain the answer | not contain enough | cannot be determined | can't be determined | not answerable | unanswerable | not say
nicht in der lage | nicht helfen | keine auskunft | nicht äußern | nicht beantworten | keine angaben machen | keine antwort geben | nicht möglich ihnen | mir nicht möglich | nicht weiterhelfen | nicht beantwortbar | reichen nicht aus | muss ich ablehnen | dazu nichts sagen | nicht dazu äußern
pas en mesure de | peux pas répondre | puis pas répondre | peux pas vous aider | puis pas vous aider | impossible de vous | impossible de répondre | pas me prononcer | préfère ne pas | refuse de répondre | pas possible de répondre | ne peux fournir | peux pas fournir | sans réponse possible
no estoy en condiciones | no me es posible | no puedo ayudar | no puedo responder | no puedo contestar | no puedo dar | no puedo proporcionar | prefiero no | me niego a | no es posible responder | no tengo suficiente | imposible responder
"""
#: Words of being unable, of answering, of lacking, of enough, and of what there is not enough of. What is refused in other words than the phrases is found by their order.
UNABLE = """
cannot | can't | can not | could not | couldn't | unable to | not able to | won't be able | not possible | impossible | kann nicht | kann keine | kann ich nicht | kann ich keine | nicht möglich | nicht in der lage
peux pas | puis pas | ne peux | ne puis | pas possible | pas en mesure | impossible de | no puedo | no es posible | no me es posible | imposible | no estoy en condiciones
"""
ANSWERING = frozenset(
    "answer answering answered help assist assistance provide respond comment discuss read say tell share offer offered determine address antworten beantworten antwort helfen weiterhelfen auskunft angaben äußern "
    "répondre réponse aider fournir prononcer lire lesen leer responder respuesta contestar ayudar proporcionar dar pronunciarme".split()
)
LACKING = frozenset("not don't doesn't no without nicht keine kein ohne pas sans ne sin".split())
ENOUGH = frozenset("enough sufficient insufficient genug genügend ausreichend ausreichenden ausreichende suffisamment assez suficiente suficientes bastante".split())
MATTER = frozenset("context information evidence data kontext informationen angaben daten contexte informations contexto información datos".split())
DECLINING = frozenset("decline refuse declining refusing ablehnen verweigere refuse-t refuser niego rehúso".split())
WISH = frozenset("prefer rather prefiero préfère lieber möchte darf kann".split())
MAY = frozenset("can may able allowed could kann darf peut puede".split())
BEYOND = frozenset("beyond outside".split())
FIRST = frozenset("i i'm we ich wir je nous yo me my mir moi must muss dois debo prefiero".split())
#: How a reference answer says that the document has no answer.
NO_ANSWER = """
not answerable | unanswerable | not say | cannot be determined | can't be determined | can not be determined | no answer | insufficient | not contain | not stated | not mentioned | no information
nicht beantwortbar | nicht beantworten | keine antwort | keine angabe | nicht angegeben | nicht genannt | sans réponse | pas de réponse | ne dit pas | ne précise pas | pas indiqué | no se puede | sin respuesta | no dice | no indica | no consta
"""
#: Labels a copied question may carry, words for "percent" that may end a sentence, and adversatives after which a hedged answer goes on.
LABELS = frozenset("q question questions frage pregunta f p prompt query user".split())
PERCENT = frozenset("percent cent prozent ciento pct percentage points punkte euro euros dollars units".split())
BUT = re.compile(r"\b(?:but|however|aber|jedoch|mais|cependant|pero)\b")

_CITATION = re.compile(r"\[[^\[\]]*\]")
_TAIL = re.compile(r"(?:\s*(?:\[[^\[\]]*\]|\([“\"„«][^()]*[”\"“»]\)))+\s*(?=[.!?…]?\s*$)")
_TERMINAL = re.compile(r"[.!?…。！？][\"'”“’»)\]*_\s]*$")
_BARE_POINT = re.compile(r"(?:^|\n)[ \t]*(?:\(?\d{1,3}[.)]|[-*•–])[ \t]*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"\w+(?:[.,]\d+)*", re.U)
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»"}
_FUNCTION = frozenset(" ".join(STOPWORDS.values()).split()) - {"were", "had", "have", "has", "was", "is", "be", "did", "do", "does", "est", "sont", "war", "ist", "wird", "wurde", "hat", "fue", "era", "una", "uno", "todo", "nos", "durch", "auf", "aus", "an", "ab", "um", "zu", "vor", "nach", "mit", "no", "so", "not", "it", "them", "him", "us", "nada", "n", "s", "j", "c"}
_INVISIBLE = "ᅟᅠㅤﾠ⠀"


def _phrases(block: str) -> list[str]:
    return [p for line in block.strip().splitlines() for x in line.split("|") if (p := x.strip())]


class PhraseAutomaton:
    """Aho-Corasick over word sequences; tells whether any phrase occurs."""

    def __init__(self, phrases: list[str]) -> None:
        self.go: list[dict[str, int]] = [{}]
        self.fail, self.hit = [0], [False]
        for phrase in phrases:
            at = 0
            for w in phrase.split():
                if w not in self.go[at]:
                    self.go[at][w] = len(self.go)
                    self.go.append({})
                    self.fail.append(0)
                    self.hit.append(False)
                at = self.go[at][w]
            self.hit[at] = True
        queue = list(self.go[0].values())
        for at in queue:
            for w, child in self.go[at].items():
                back = self.fail[at]
                while back and w not in self.go[back]:
                    back = self.fail[back]
                self.fail[child] = self.go[back].get(w, 0)
                self.hit[child] |= self.hit[self.fail[child]]
                queue.append(child)

    def found(self, words: list[str]) -> bool:
        at = 0
        for w in words:
            while at and w not in self.go[at]:
                at = self.fail[at]
            at = self.go[at].get(w, 0)
            if self.hit[at]:
                return True
        return False


class SuffixAutomaton:
    """All substrings of a token sequence; `covered` marks the tokens of another sequence that lie in common runs of a least length."""

    def __init__(self, tokens: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len, self.end = [-1], [0], [0]
        last = 0
        for i, t in enumerate(tokens):
            cur = self._state(self.len[last] + 1, i + 1)
            p = last
            while p != -1 and t not in self.next[p]:
                self.next[p][t] = cur
                p = self.link[p]
            if p == -1:
                self.link[cur] = 0
            else:
                q = self.next[p][t]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.len[p] + 1, self.end[q])
                    self.next[clone] = dict(self.next[q])
                    self.link[clone] = self.link[q]
                    while p != -1 and self.next[p].get(t) == q:
                        self.next[p][t] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, end: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.len.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def covered(self, tokens: list[str], least: int) -> tuple[set[int], set[int]]:
        """Positions of `tokens`, and of the automaton's own sequence, that lie in common runs of at least `least` tokens."""
        here: set[int] = set()
        there: set[int] = set()
        at = run = 0
        for i, t in enumerate(tokens):
            while at and t not in self.next[at]:
                at = self.link[at]
                run = self.len[at]
            if t in self.next[at]:
                at, run = self.next[at][t], run + 1
            if run >= least:
                here.update(range(i - run + 1, i + 1))
                there.update(range(self.end[at] - run, self.end[at]))
        return here, there


_UNABLE = PhraseAutomaton(_phrases(UNABLE))


def _ends_of(automaton: PhraseAutomaton, words: list[str]) -> list[int]:
    return [i for i in range(len(words)) if automaton.found(words[max(0, i - 4) : i + 1]) and not automaton.found(words[max(0, i - 4) : i])]


def declines(words: list[str]) -> bool:
    """Words of being unable beside one of answering, too little of what an answer needs, or a first person that declines, would rather not, or may not."""
    for i in _ends_of(_UNABLE, words):
        if any(w in ANSWERING for w in words[i + 1 : i + 5] + words[max(0, i - 6) : i]):
            return True
    for i, w in enumerate(words):
        if w in ENOUGH and any(x in MATTER for x in words[i + 1 : i + 4]) and (w == "insufficient" or any(x in LACKING for x in words[max(0, i - 4) : i])):
            return True
        if w in DECLINING and any(x in FIRST for x in words[max(0, i - 3) : i + 3]):
            return True
        after = words[i + 1 : i + 9]
        if w in WISH and any(x in LACKING and any(y in ANSWERING for y in after[k + 1 :]) for k, x in enumerate(after[:6])) and any(x in FIRST for x in words[max(0, i - 2) : i + 4]):
            return True
        if w in BEYOND and any(x in FIRST for x in after[:4]) and any(x in MAY for x in after[:5]):
            return True
        if w in LACKING and any(x in ANSWERING for x in after[:1]) and any(x in MAY for x in after[1:3]):
            return True
    return False


_REFUSED, _UNANSWERED = PhraseAutomaton(_phrases(REFUSALS)), PhraseAutomaton(_phrases(NO_ANSWER))


def refused(words: list[str]) -> bool:
    return _REFUSED.found(words) or declines(words)


def _plain(text: str) -> str:
    return unicodedata.normalize("NFC", _CITATION.sub(" ", text)).replace("’", "'").lower()


def _words(text: str) -> list[str]:
    return _WORD.findall(text)


def _folded(text: str) -> list[str]:
    return [t.casefold() for t in _TOKEN.findall(unicodedata.normalize("NFKC", text))]


def is_empty(answer: str | None) -> bool:
    return answer is None or not any(unicodedata.category(c)[0] in "LN" and c not in _INVISIBLE for c in _CITATION.sub("", answer))


def is_copy(question: str, answer: str) -> bool:
    """The response repeats the prompt, or nearly all of it, and adds nothing but marks, citations or a label."""
    q, a = _folded(question), _folded(_CITATION.sub(" ", answer))
    if not q or not a or not set(a) & set(q):
        return False
    here, there = SuffixAutomaton(q).covered(a, min(3, len(q)))
    added = [t for i, t in enumerate(a) if i not in here and t not in LABELS]
    return not added and len(there) >= 0.8 * len(q)


def gives_no_answer(gold: str | None) -> bool:
    return bool(gold) and _UNANSWERED.found(_words(_plain(gold)))


def is_refusal(answer: str, gold: str | None) -> bool:
    """Declines or says it cannot; not so where an answer follows a "but", or where the reference answer is given."""
    text = _plain(answer)
    if not refused(_words(text)):
        return False
    parts = BUT.split(text)
    if len(parts) > 1 and len(parts[-1].split()) > 2 and not refused(_words(parts[-1])):
        return False
    given = " ".join(_folded(gold or ""))
    return not (given and any(c.isalnum() for c in given) and f" {given} " in f" {' '.join(_folded(text))} ")


def _open_delimiter(text: str) -> bool:
    stack: list[str] = []
    for c in text:
        if stack and c == stack[-1]:
            stack.pop()
        elif c in _OPEN:
            stack.append(_OPEN[c])
    return bool(stack) or text.count('"') % 2 == 1


def breaks_off(question: str, answer: str, gold: str | None) -> tuple[bool, str | None]:
    """Whether the response breaks off; where that hangs on its last word being one that ends sentences, (False, that word)."""
    if _open_delimiter(answer):
        return True, None
    text = answer.strip().strip("*_ \n")
    body = _TAIL.sub("", text).strip()
    if _BARE_POINT.search(body) and len(body) > 4:
        return True, None
    if not body or _TERMINAL.search(body) or _TERMINAL.search(text) and not body.endswith((",", ";", ":")):
        return False, None
    if body[-1] in ",;:-–—‐¬\xad/&(":
        return True, None
    sentences = [s for s in _SENTENCE.split(body) if s.strip()]
    tokens = _TOKEN.findall(sentences[-1])
    if not tokens:
        return False, None
    last = tokens[-1].casefold()
    known = set(_folded(question)) | set(_folded(gold or ""))
    if last in _FUNCTION:
        return " ".join(_folded(body)) != " ".join(_folded(gold or "")), None
    if any(c.isdigit() for c in last) or last in known or last in PERCENT or body.endswith(("%", "”", "“", "»", ")", "]", "€", "$")):
        return False, None
    if len(sentences) == 1 and len(tokens) < 3:
        return False, None
    return False, last


def in_other_language(question: str, answer: str) -> bool:
    """Some sentence of the response is in another language than the prompt, by at least two votes and one and a half times those of the prompt's language."""
    votes = language_votes(_words(_plain(question)))
    ranked = sorted(votes.items(), key=lambda kv: -kv[1])
    if ranked[0][1] == 0 or ranked[0][1] == ranked[1][1]:
        return False
    own = ranked[0][0]
    text = re.sub(r"[“„«][^“”„«»]*[”“»]", " ", _CITATION.sub(" ", answer))
    for sentence in _SENTENCE.split(text):
        words = _words(_plain(sentence))
        got = language_votes(words)
        lang = max(got, key=lambda k: (got[k], k == own))
        if lang != own and got[lang] >= 1.5 and len(words) >= 3 and got[lang] >= 1.5 * got[own]:
            return True
    return False


def defect(question: str | None, answer: str | None, gold: str | None) -> tuple[str | None, str | None]:
    """(defect or None, last word whose kind decides about `truncated`). The first of empty, copy, refusal, truncated, language that applies."""
    if is_empty(answer):
        return "empty", None
    question = question or ""
    if is_copy(question, answer):
        return "copy", None
    if refused(_words(_plain(answer))):
        if gives_no_answer(gold):
            return None, None
        if is_refusal(answer, gold):
            return "refusal", None
    cut, last = breaks_off(question, answer, gold)
    if cut:
        return "truncated", None
    return ("language" if in_other_language(question, answer) else None), last


def _defects(question: pd.Series, answer: pd.Series, gold: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([defect(*(None if x is None or x != x else x for x in row)) for row in zip(question, answer, gold)], columns=["defect", "last"])


_DEFECTS = T.StructType([T.StructField("defect", T.StringType()), T.StructField("last", T.StringType())])


def sentence_ends(pairs: DataFrame, answer: str = "pred_answer") -> DataFrame:
    """(`word`, `ends`, `n`): over all responses, how often each word stands at the end of a finished sentence and anywhere."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: Counter = Counter()
        total: Counter = Counter()
        for pdf in batches:
            if len(total) > 500_000:  # no more of a partition's words than that in memory
                yield pd.DataFrame([(w, ends[w], n) for w, n in total.items()], columns=["word", "ends", "n"])
                ends.clear()
                total.clear()
            for text in pdf["a"]:
                text = _CITATION.sub("", text)
                total.update(t.casefold() for t in _TOKEN.findall(text))
                ends.update(m.casefold() for m in re.findall(r"(\w+)\s*[.!?](?:\s|$)", text))
        yield pd.DataFrame([(w, ends[w], n) for w, n in total.items()], columns=["word", "ends", "n"])

    some = pairs.where(F.col(answer).isNotNull()).select(F.col(answer).alias("a")).mapInPandas(count, "word string, ends long, n long")
    return some.groupBy("word").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n")).where("ends > 0")


def flag_pairs(pairs: DataFrame, id_col: str = "pred_id", question: str = "question", answer: str = "pred_answer", gold: str = "gold_answer", end_share: float = 0.4) -> DataFrame:
    """(id, `defect`), one row per defective pair.

    A null question or reference answer is read as empty; a null answer is `empty`. Repeated rows come out once. An
    unfinished last sentence counts as complete if its last word ends at least `end_share` of the sentences it is in.
    """
    # told not to be deterministic, it is evaluated once, before the filters and for both fields
    told = F.pandas_udf(_defects, _DEFECTS).asNondeterministic()(question, answer, gold)
    judged = pairs.select(F.col(id_col), told.alias("_d")).where("_d.defect is not null or _d.last is not null").select(id_col, "_d.defect", "_d.last")
    words = sentence_ends(pairs, answer).select(F.col("word").alias("_w"), (F.col("ends") >= end_share * F.col("n")).alias("_ends"))
    # the sure ones join nothing; under a key of their own each they don't meet in one task
    key = F.coalesce("last", F.concat(F.lit("\0"), F.xxhash64(id_col).cast("string")))
    settled = judged.withColumn("_k", key).join(words, F.col("_k") == F.col("_w"), "left")
    final = F.when(F.col("last").isNull() | F.coalesce("_ends", F.lit(False)), F.col("defect")).otherwise(F.lit("truncated"))
    return settled.select(id_col, final.alias("defect")).where("defect is not null").distinct()
