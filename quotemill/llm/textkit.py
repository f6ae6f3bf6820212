"""Text helpers the operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Frequent function words that tell English, German, French and Spanish apart.
STOPWORDS = {
    "en": "the of and to in a is that it was for on are with as by at from this be an or not were which but have has had they their its his her our you your we i he she them there than then what when where how who will would can could do did does if so no near after before while during as",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei kein keine seit doch ob obwohl wer welche welcher welches dieser diese nahe ich",
    "fr": "le la les de des du un une et est dans que qui en pour sur au aux par plus ne pas ce cette ces son sa ses se avec il elle ils elles sont ont été était mais ou où si nous vous je leur leurs lui comme entre sans sous bien être fait vers ni quel quelle depuis selon d l c qu j n s",
    "es": "el la los las de del un una y es en que por para con se su sus al lo como más pero sus le ha han fue era muy sin sobre también me hasta hay donde quien desde todo nos durante uno ni contra ese eso entre cuando si no porque esta este según cuál qué junto cuánto",
}
_SETS = {lang: frozenset(words.split()) for lang, words in STOPWORDS.items()}
#: How much one occurrence of a word votes for each language: a word of several languages votes less for each.
VOTES: dict[str, tuple[tuple[str, float], ...]] = {
    w: tuple((lang, 1 / sum(w in s for s in _SETS.values())) for lang, s in _SETS.items() if w in s) for w in frozenset().union(*_SETS.values())
}
WORD = re.compile(r"[^\W\d_]+")


def language_votes(words: Iterable[str]) -> dict[str, float]:
    """Stopword votes of lower-case words."""
    out = {"en": 0.0, "de": 0.0, "fr": 0.0, "es": 0.0}
    get = VOTES.get
    for w in words:
        for lang, n in get(w, ()):
            out[lang] += n
    return out


def language_of(words: Iterable[str], least: float = 1.0, lead: float = 1.5) -> str | None:
    """The language with the most votes, if it has at least `least` and `lead` times those of the next; None otherwise."""
    ranked = sorted(language_votes(words).items(), key=lambda kv: -kv[1])
    (lang, n), (_, second) = ranked[0], ranked[1]
    return lang if n >= least and n >= lead * second else None
