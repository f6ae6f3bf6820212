"""Noise in text from scanned pages, and its repair.

Misread words come from the whole corpus by anagram hashing: the hash of a word is the sum of a value per letter, so a
confusion such as `cl` for `d` changes it by a fixed difference, whatever the word. Rare words, with the differences of
the confusions they could hold added, are joined on the hash with the frequent words; the candidates are ranked and the
best that really differs by the confusions is the correction; words with figures in them that differ by more are joined
on a folded form. Running headers are lines that stand at the edges of quotes of several pages of a document, carry its
title, or, seen once, have the form of a chapter title; page numbers are those of the quote's page. A hyphen at a break
is kept or dropped by how often the corpus has the word with and without; continuations are read from how quotes end
and begin.

The corpus is counted once, in the JVM, into a table of its distinct tokens; all evidence on words comes from that table.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.llm.splits import document_key
from quotemill.llm.textkit import VOTES
from quotemill.session import cut

#: Fixed values: (as scanned, as printed).
CONFUSIONS = (("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("6", "b"), ("6", "g"), ("9", "g"), ("8", "b"), ("@", "a"), ("c", "e"), ("rn", "m"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("vv", "w"), ("l", "i"), ("i", "l"))
HYPHENS = "-‐‑¬\xad"

_LINES = re.compile(r"\r\n|[\n\r\v\f\x85\u2028\u2029]")
_BROKEN = re.compile(rf"[{HYPHENS}](?<=\w.)[ \t]*(?:\r\n|[\n\r\v\f\x85\u2028\u2029])\s*(?=\w)")
#: The same pattern for the JVM, which puts MARK in place of a break.
_BROKEN_JVM = rf"[{HYPHENS}](?<=[\p{{L}}\p{{N}}_].)[ \t]*(?:\r\n|[\n\r\x0B\f\x85\u2028\u2029])\s*(?=[\p{{L}}\p{{N}}_])"
MARK = "\x01"
_LEFT = re.compile(r"\w+$")
_WORD = re.compile(r"\w+")
_HYPHENED_JVM = r"([\p{L}\p{N}_]+)[-‐‑](?=([\p{L}\p{N}_]+))"
_CORE = re.compile(r"^([^\w@]*)(.*?)([^\w@]*)$", re.S)
_EDGES = re.compile(r"^[^\w@]+|[^\w@]+$")
_INNER = re.compile(rf"([{HYPHENS}'’–—/])")
_ROMAN = re.compile(r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_PAGE = re.compile(r"^[\W_]*(?:([^\W\d_@]{1,7})[.:]?\s+|)(\d{1,4}|[ivxlc]{1,7})(?:\s*(?:/|of|sur|von|de|di|aus)\s*\d{1,4})?[\W_]*$", re.I)
_WITH_NUMBER = re.compile(r"^\s*(?:(\d{1,4}|[ivxlc]{1,7})\s{2,}(\S.*?)|(\S.*?)(?:\s+[–—-]\s+|\s{2,})(\d{1,4}|[ivxlc]{1,7}))\s*$")
_PAGE_WORDS = ("page", "seite", "pagina", "p", "s", "pag")
_SMALL = frozenset("and of the und der die das y e de del la el los las et du des le les in on for zu von a an al".split())
_JOINING = frozenset("and und y e et &".split())
_FOLD = str.maketrans("0156@98c", "olsbagbe")
_STOP = re.compile(r"[.!?…。！？:][\"'”’»)\]]*$")
_TABLE = re.compile(r"\|")
_NOT_IN_HEADER = re.compile(r"[|:;,.]")
_HEADING = re.compile(r"^\s*\d+(?:\.\d+)+\s+\S")


def anagram_hash(word: str) -> int:
    """The sum of the fifth powers of the letters' codes, in 63 bits; the same for all orders of the letters."""
    return sum(pow(ord(c), 5) for c in word) & 0x7FFFFFFFFFFFFFFF


def fold(text: str) -> str:
    """A form in which a text and its misread copies are mostly the same."""
    out = "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum() or c == "@").translate(_FOLD)
    for wrong, right in (("rn", "m"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("vv", "w")):
        out = out.replace(wrong, right)
    return out.replace("el", "d").replace("g", "b").replace("i", "l")


def _near(a: str, b: str, most: int) -> bool:
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= most


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def _is_page(number: str, page: int | None) -> bool:
    if page is None:
        return True
    return number.lower() in (str(page), _roman(page) if 0 < page < 400 else "")


def is_page_number(line: str, page: int | None) -> bool:
    """A line with nothing but the printed page number, in any of its usual dresses."""
    m = _PAGE.match(line)
    if not m or line.rstrip().endswith((".", ",", ";", "%")):
        return False
    word = m.group(1)
    return _is_page(m.group(2), page) and (not word or any(_near(fold(word), fold(w), 1 if len(w) > 3 else 0) for w in _PAGE_WORDS))


def _bare_number(line: str) -> bool:
    """A number without any dress, which on an unnumbered page might be anything."""
    return line.strip().isdigit()


def split_number(line: str, page: int | None) -> tuple[str, bool]:
    """A line without the page number that stands beside a header, and whether it had one."""
    m = _WITH_NUMBER.match(line)
    if m:
        number, rest = (m.group(1), m.group(2)) if m.group(1) else (m.group(4), m.group(3))
        if _is_page(number, page) and any(c.isalpha() for c in rest):
            return rest.strip(), True
    return line.strip(), False


def is_title(line: str, key: str | None) -> bool:
    """Whether a line is the title that the document's name begins with; one without its year must be in title case."""
    if not key or not 6 <= len(line) <= 90 or line.endswith((".", ",", ";")):
        return False
    words = line.split()
    whole = len(words) > 1 and len(words[-1]) == 4 and sum(c.isdigit() for c in words[-1]) >= 2
    if not whole and any(w[0].islower() for w in words if len(w) > 3):
        return False
    a = fold(line)
    b = fold(key)[: len(a)]
    return len(a) >= 8 and (a == b or _near(a, b, 1 + len(a) // 12))


def header_key(rest: str, key: str | None) -> str | None:
    """What tells a document's header lines apart: its key and the folded line, which comes without its page number; None for a line that is none."""
    if not key or not 6 <= len(rest) <= 60 or not rest[-1].isalnum() or not (rest[0].isupper() or rest[0].isdigit()) or _NOT_IN_HEADER.search(rest) or _HEADING.match(rest):
        return None
    words = rest.split()
    if len(words) < 2 or 2 * sum(w[0].isupper() or not w[0].isalpha() for w in words) < len(words) or not any(c.isalpha() for c in rest):
        return None
    return f"{key}\x1f{fold(rest)}"


def looks_like_chapter(line: str) -> bool:
    """A short line in title case or capitals, without figures or a full stop."""
    if len(line) > 60 or not line or not line[-1].isalpha() and line[-1] not in "015@69" or any(c in line for c in ",;:|()[]„“\""):
        return False
    words = line.split()
    if not 3 <= len(words) <= 7 or "." in line:
        return False
    big = [w for w in words if w.casefold().translate(_FOLD) not in _JOINING and fold(w) not in ("and", "und")]
    return len(big) == len(words) - 1 and len(big) >= 2 and all((w[0].isupper() or w[0] in "015@69" and w[1:2].isalpha()) and w.casefold() not in _SMALL for w in big)


def page_of(page: object, layout: object) -> int | None:
    """The page, or what the layout number says of it."""
    if page is not None:
        return int(page)
    return int(layout) // 100 if layout is not None else None


def read_quotes(quotes: list[dict], name: str | None, repeated: Container[str] = ()) -> list[dict]:
    """Per quote: the noise that can be seen within its example, and its text without headers and page numbers.

    `repeated` has the `header_key` of lines that several pages carry.
    """
    key = document_key(name)
    out = []
    for q in quotes:
        text = q["text"] or ""
        page = page_of(q["page_id"], q["layout_id"])
        found: set[str] = set()
        lines = _LINES.split(text)
        kept = lines
        if len(lines) > 1 or len(text) < 100:
            kept = []
            for i, line in enumerate(lines):
                bare = line.strip()
                if not bare or len(bare) > 90 or _TABLE.search(bare):
                    kept.append(line)
                    continue
                if is_page_number(bare, page) and (page is not None or i in (0, 1, len(lines) - 1) and not _bare_number(bare)):
                    found.add("pageno")
                    continue
                rest, numbered = split_number(line, page)
                if is_title(rest, key):
                    found.add("header")
                    if numbered:
                        found.add("pageno")
                    continue
                if looks_like_chapter(rest) or repeated and (k := header_key(rest, key)) and k in repeated:
                    found.add("header")
                    if numbered:
                        found.add("pageno")
                    continue
                kept.append(line)
        clean = "\n".join(kept)
        if _BROKEN.search(clean):
            found.add("hyphen")
        out.append({"quote_id": q["quote_id"], "page": page, "layout": q["layout_id"], "found": found, "clean": clean})
    order = sorted(range(len(out)), key=lambda i: (out[i]["page"] is None, out[i]["page"] or 0, out[i]["layout"] is None, out[i]["layout"] or 0, i))
    for a, b in zip(order, order[1:]):
        if goes_on(out[a]["clean"], out[b]["clean"]):
            out[a]["found"].add("continues")
            if out[a]["clean"].rstrip()[-1] in HYPHENS:
                out[a]["found"].add("hyphen")
    return out


def goes_on(text: str, after: str) -> bool:
    """Whether the last sentence of a text is unfinished and the next text takes it up."""
    end, begin = text.rstrip(), after.lstrip()
    if not end or not begin:
        return False
    last = end.rsplit("\n", 1)[-1]
    if _STOP.search(end) or _TABLE.search(last) or _HEADING.match(last) and "\n" not in end or re.match(r"^\s*[•*]", last):
        return False
    word = re.search(r"(\S+)$", end).group(1)
    if not word[-1].isalnum() and word[-1] not in HYPHENS + ",;–—'’@%)":
        return False
    if len(word) > 40 or ord(max(word)) > 0x2FFF or _HEADING.match(begin) or _TABLE.search(begin.split("\n", 1)[0]):
        return False
    first = begin[0]
    if first.islower() or first in "–—(" or first.isdigit():
        return not (last.count(";") > 1 or re.search(r"\d[.,\d]*$", end) and not re.search(r"[.!?]", end))
    tail = re.split(r"(?<=[.!?])\s+", end)[-1].split()
    known = sum(w.lower() in VOTES for w in tail)
    return not end[-1].isdigit() and (known > 0 or len(tail) <= 3) and "\n" in end


def is_code(token: str) -> bool:
    """Whether a part of the token is in neither small nor capital letters nor begins with its only capital: no running text is written so."""
    for part in _INNER.split(token)[::2]:
        letters = "".join(c for c in part if c.isalpha())
        if not letters.islower() and not letters.isupper() and letters[1:].lower() != letters[1:]:
            return True
    return False


def words_in(token: str) -> list[str]:
    """The words of a token in small letters; those of a code are none."""
    if is_code(token):
        return []
    return [w for part in _INNER.split(_EDGES.sub("", token))[::2] if len(w := _EDGES.sub("", part).lower()) >= 2]


def mended(text: str, keep: Container[str]) -> str:
    """The text with broken words put together; the hyphen stays in the compounds of `keep`."""
    return _BROKEN.sub(lambda m: "-" if _around(m) in keep else "", text)


def _around(m: re.Match) -> str:
    """The words around a break, with a plain hyphen between them."""
    left = _LEFT.search(m.string, max(0, m.start() - 60), m.start()).group()
    return f"{left}-{_WORD.match(m.string, m.end()).group()}".lower()


def vocabulary(examples: DataFrame, quotes: str = "text_quotes") -> DataFrame:
    """(`token`, `n`): every run without white space in all quotes, and how often it occurs; MARK stands for a hyphen at a line break.

    White space beyond ASCII may stand inside a token; whoever takes words from one must split it.
    """
    texts = examples.where(F.col(quotes).isNotNull()).select(F.explode(F.col(f"{quotes}.text")).alias("t")).where("t is not null")
    marked = F.when(F.col("t").rlike(r"[\n\r\x0B\f\x85\u2028\u2029]"), F.regexp_replace("t", _BROKEN_JVM, MARK)).otherwise(F.col("t"))
    tokens = texts.select(F.explode(F.split(marked, r"\s+")).alias("token"))
    return cut(tokens.where("token <> ''").groupBy("token").agg(F.count("*").alias("n")))


def compounds(tokens: DataFrame) -> DataFrame:
    """(`word`): the words that stand on one line more often with a hyphen than joined, from the `vocabulary`."""

    low = tokens.select(F.lower("token").alias("t"), "n")
    parts = lambda group: F.regexp_extract_all("t", F.lit(_HYPHENED_JVM), F.lit(group))
    pairs = low.where(F.col("t").rlike("[-‐‑]")).select("n", F.explode(F.arrays_zip(parts(1).alias("l"), parts(2).alias("r"))).alias("x"))
    with_hyphen = pairs.groupBy(F.concat("x.l", "x.r").alias("joined"), F.concat("x.l", F.lit("-"), "x.r").alias("word")).agg(F.sum("n").alias("h"))
    words = low.select("n", F.explode(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("joined"))
    both = with_hyphen.join(words.groupBy("joined").agg(F.sum("n").alias("j")), "joined", "left")
    return both.where("h > coalesce(j, 0)").select("word")


def repeated_lines(examples: DataFrame, quotes: str = "text_quotes", name: str = "doc_name", least: int = 3) -> DataFrame:
    """(`word`): the `header_key` of every line that stands at the edge of quotes of at least `least` pages of a document."""
    text = F.col("q.text")
    lines = F.when(text.rlike(r"[\r\x0B\f\x85\u2028\u2029]"), F.split(text, r"\r\n|[\n\r\x0B\f\x85\u2028\u2029]")).otherwise(F.split(text, "\n"))
    edges = F.array_distinct(F.concat(F.slice(lines, 1, 2), F.slice(F.reverse(lines), 1, 2)))
    edges = F.filter(edges, lambda x: F.length(x).between(6, 90) & x.rlike(r"^\s*[\p{Lu}\p{N}]") & x.rlike(r"[\p{L}\p{N}]\s*$"))
    some = examples.select(F.col(name).alias("d"), F.explode(quotes).alias("q")).where("d is not null").select("d", F.col("q.page_id").alias("p"), F.col("q.layout_id").alias("l"), edges.alias("x")).where("size(x) > 0")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, str | None] = {}
        for pdf in batches:
            if len(memo) > 100_000:
                memo.clear()
            rows = []
            for d, p, at, own in zip(pdf["d"], pdf["p"], pdf["l"], pdf["x"]):
                page = page_of(*(None if x is None or x != x else x for x in (p, at)))
                if d not in memo:
                    memo[d] = document_key(d)
                rows += [(k, page) for x in own if page is not None and (k := header_key(split_number(x, page)[0], memo[d]))]
            yield pd.DataFrame(rows, columns=["word", "page"]).astype({"page": "Int64"})

    found = some.mapInPandas(keys, "word string, page long").distinct()
    return found.groupBy("word").agg(F.count("*").alias("pages")).where(F.col("pages") >= least).select("word")


def _table(own: Iterable[str] | None) -> dict[str, str]:
    return dict(x.split(" ") for x in own) if own is not None else {}


def _given(examples: DataFrame, words: DataFrame, spell: Callable[[list[dict], str | None, dict], Iterable[str]], column: str, quotes: str, name: str, most: int, known: dict[str, Broadcast]) -> tuple[DataFrame, Broadcast]:
    """The examples with a `column`, and a broadcast dict of `words` (`word`, `target`), if they are at most `most`.

    Beyond that the broadcast holds None, and the column "word target" for those words that `spell` finds in the example,
    given the tables `known` so far.
    """
    words = cut(words)
    few = words.limit(most + 1).toLocalIterator() if most >= 0 else None
    table = {r["word"]: r["target"] for r in few} if few is not None else None
    spark = examples.sparkSession
    if table is not None and len(table) <= most:
        return examples.withColumn(column, F.lit(None).cast("array<string>")), spark.sparkContext.broadcast(table)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, (e, d, qs) in enumerate(zip(pdf["e"], pdf["d"], pdf["q"])):
                tables = {c: _table(pdf[c].iloc[i]) if b.value is None else b.value for c, b in known.items()}
                rows += [(e, w) for w in set(spell([dict(q) for q in qs if q is not None], d, tables))]
            yield pd.DataFrame(rows, columns=["e", "word"])

    source = examples.where(F.col(quotes).isNotNull()).select(F.col("example_no").alias("e"), F.col(name).alias("d"), F.col(quotes).alias("q"), *known)
    own = source.mapInPandas(pairs, "e long, word string").join(words, "word")
    own = own.groupBy(F.col("e").alias("example_no")).agg(F.collect_set(F.concat_ws(" ", "word", "target")).alias(column))
    return examples.join(own, "example_no", "left"), spark.sparkContext.broadcast(None)


def _evidence(examples: DataFrame, quotes: str, name: str, most: int) -> tuple[DataFrame, DataFrame, dict[str, Broadcast]]:
    """The examples with `_head`, `_keep` and `_fix` (see `_given`), the corrections, and the three broadcasts: repeated lines, compounds, corrections."""
    known: dict[str, Broadcast] = {}

    def heads(own: list[dict], doc: str | None, _: dict) -> Iterator[str]:
        key = document_key(doc)
        for q in own:
            page = page_of(q["page_id"], q["layout_id"])
            yield from filter(None, (header_key(split_number(x, page)[0], key) for x in _LINES.split(q["text"] or "") if len(x) <= 90 and x.strip()))

    def breaks(own: list[dict], doc: str | None, tables: dict) -> Iterator[str]:
        read = read_quotes(own, doc, tables["_head"])
        for text in [q["text"] or "" for q in own] + [r["clean"] for r in read]:
            yield from map(_around, _BROKEN.finditer(text))
        for a, b in zip(in_order(read), in_order(read)[1:]):
            if w := across(a["clean"], b["clean"]):
                yield w

    def spelled(own: list[dict], doc: str | None, tables: dict) -> Iterator[str]:
        for text in [q["text"] or "" for q in own] + [r["clean"] for r in read_quotes(own, doc, tables["_head"])]:
            yield from (w for t in mended(text, tables["_keep"]).split() for w in words_in(t))

    examples = examples.where(F.col("example_no").isNotNull()).select("example_no", name, quotes)  # others of its columns might be named as ours
    tokens = vocabulary(examples, quotes)
    compound = cut(compounds(tokens))
    examples, known["_head"] = _given(examples, repeated_lines(examples, quotes, name).withColumn("target", F.lit("h")), heads, "_head", quotes, name, most, dict(known))
    examples, known["_keep"] = _given(examples, compound.withColumn("target", F.col("word")), breaks, "_keep", quotes, name, most, dict(known))
    fixes = cut(corrections(word_counts(tokens, compound)))
    examples, known["_fix"] = _given(examples, fixes, spelled, "_fix", quotes, name, most, dict(known))
    return examples, fixes, known


def word_counts(tokens: DataFrame, compound: DataFrame) -> DataFrame:
    """(`word`, `n`) from the `vocabulary`, broken words put together, with their hyphen where they are among the compounds."""
    broken = tokens.where(F.contains("token", F.lit(MARK)))
    around = rf"([\p{{L}}\p{{N}}_]+){MARK}(?=([\p{{L}}\p{{N}}_]+))"
    pairs = F.transform(F.regexp_extract_all("token", F.lit(around), F.lit(1)), lambda left, i: F.struct(i.alias("i"), F.lower(F.concat(left, F.lit("-"), F.get(F.regexp_extract_all("token", F.lit(around), F.lit(2)), i))).alias("word")))
    kept = broken.select("token", "n", F.explode(pairs).alias("x")).select("token", "n", "x.i", "x.word").join(compound.withColumn("yes", F.lit(True)), "word", "left")
    kept = kept.groupBy("token", "n").agg(F.array_sort(F.collect_list(F.when(F.col("yes"), F.col("i")))).alias("keep"))  # of one token

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for token, n, keep in zip(pdf["token"], pdf["n"], pdf["keep"]):
                if keep is not None:
                    first, *rest = token.split(MARK)
                    token = first + "".join(("-" if i in keep else "") + part for i, part in enumerate(rest))
                rows += [(w, n) for t in token.split() for w in words_in(t)]
            yield pd.DataFrame(rows, columns=["word", "n"])

    whole = tokens.where(~F.contains("token", F.lit(MARK))).withColumn("keep", F.lit(None).cast("array<int>"))
    return cut(whole.unionByName(kept).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def _deltas(word: str, most: int = 2) -> list[tuple[int, str]]:
    """(hash of the word with some confusions undone, those confusions); how often each may occur is bounded by the word itself."""
    here = [(anagram_hash(right) - anagram_hash(wrong), f"{wrong}>{right}") for wrong, right in CONFUSIONS if wrong in word for _ in range(min(word.count(wrong), most))]
    base = anagram_hash(word)
    return sorted({(base + sum(d for d, _ in some), " ".join(sorted(n for _, n in some))) for k in range(1, most + 1) for some in combinations(here, k)})


def undone(word: str, target: str, confusions: str) -> bool:
    """Whether undoing the confusions somewhere in the word gives the target."""
    if not confusions:
        return word == target
    first, _, rest = confusions.partition(" ")
    wrong, _, right = first.partition(">")
    return any(undone(word[:i] + right + word[i + len(wrong) :], target, rest) for i in range(len(word)) if word.startswith(wrong, i))


@F.pandas_udf(T.BooleanType())
def _undone(word: pd.Series, target: pd.Series, confusions: pd.Series) -> pd.Series:
    return pd.Series([undone(*x) for x in zip(word, target, confusions)], dtype=bool)


def corrections(counts: DataFrame, ratio: float = 8.0, long: int = 7, long_ratio: float = 4.0) -> DataFrame:
    """(`word`, `target`): every rare word that is a frequent one misread, with the best ranked target.

    A target has at least `ratio` times the occurrences of the rare word; from `long` letters on, where chance hardly
    makes two words alike, `long_ratio` times. Up to two confusions are found by their anagram hash differences. Words
    with figures or signs among the letters that differ by more are joined on their folded forms. Fewest confusions
    first, then the most frequent target, then the smaller.
    """
    longest = counts.where((F.col("n") >= long_ratio) & F.col("word").rlike(r"^\p{L}{2,}$")).agg(F.max(F.length("word"))).first()[0] or 0

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                yield pd.DataFrame([(w, n, h, c) for w, n in zip(part["word"], part["n"]) for h, c in _deltas(w)], columns=["word", "n", "hash", "confusions"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"hash": pdf["word"].map(anagram_hash), "fold": pdf["word"].map(fold), "target": pdf["word"], "m": pdf["n"]})

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["word"].map(mixed).astype(bool)]
            yield pd.DataFrame({"word": pdf["word"], "n": pdf["n"], "fold": pdf["word"].map(fold)})

    whole = cut(counts.where((F.col("n") >= long_ratio) & F.col("word").rlike(r"^\p{L}{2,}$")).mapInPandas(hashed, "hash long, fold string, target string, m long"))
    # no confusion adds more than a letter where it is undone, and two at most are: what is longer has no target
    near = counts.where(F.col("word").rlike(r"[\p{L}]") & (F.length("word") <= longest + 2))
    outnumbered = F.col("m") >= F.when(F.length("word") >= long, long_ratio).otherwise(ratio) * F.col("n")
    rare = near.mapInPandas(spread, "word string, n long, hash long, confusions string")
    both = rare.join(whole.drop("fold"), "hash").where(outnumbered & (F.col("word") != F.col("target"))).where(_undone("word", "target", "confusions"))
    some = both.select("word", "target", "m", F.size(F.split("confusions", " ")).alias("k"))
    more = counts.where(F.col("word").rlike(r"[0-9@]")).mapInPandas(folded, "word string, n long, fold string").join(whole.drop("hash"), "fold").where(outnumbered).select("word", "target", "m", F.lit(9).alias("k"))
    rank = F.min(F.struct("k", (-F.col("m")).alias("m"), "target"))
    return some.unionByName(more).groupBy("word").agg(rank.alias("best")).select("word", F.col("best.target").alias("target"))


_MIXED = re.compile(r"^(?=.*[^\W\d_].*[^\W\d_])[^\W\d_]*[015689@][^\W_]*@?[^\W_]*$")


def mixed(word: str) -> bool:
    """A word of letters with figures or signs among them that stand for letters; codes, ordinals and units are none."""
    return bool(_MIXED.match(word)) and len(word) >= 4 and sum(c.isalpha() for c in word) >= 3 and not re.match(r"^(?:[^\W\d_]{1,3}\d+|\d+[^\W\d_]{1,3}|\d{2,}.*)$", word)


#: The letter a figure or sign mostly stands for.
_LETTERS = str.maketrans("015689@", "olsbbga")


def unmixed(word: str) -> str:
    """A mixed word with letters for its figures, where the corpus has no word to compare it with."""
    return re.sub(r"(?<=[^aeiouyáéíóúäöüàèê\W\d_])1(?=[^aeiouyáéíóúäöüàèê\W\d_])", "i", word).translate(_LETTERS)


def in_order(read: list[dict]) -> list[dict]:
    """The quotes by page and layout; those without a number last."""
    return sorted(read, key=lambda r: (r["page"] is None, r["page"] or 0, r["layout"] is None, r["layout"] or 0))


def across(text: str, after: str) -> str | None:
    """The word that is broken between two texts, with a plain hyphen at the break; None if none is."""
    left, right = re.search(rf"(\w+)[{HYPHENS}]\s*$", text), re.match(r"\s*(\w+)", after)
    return f"{left.group(1)}-{right.group(1)}".lower() if left and right else None


def find_noise(examples: DataFrame, quotes: str = "text_quotes", name: str = "doc_name", most: int = 2_000_000) -> DataFrame:
    """(`example_no`, `quote_id`, `noise`), one row per quote and kind of noise.

    Null quotes and texts have none, nor have rows without an `example_no`. Repeated lines, compounds and corrections go to the workers as tables if each has
    at most `most` entries; beyond that each example is given those of its own words by a join.
    """
    examples, _, known = _evidence(examples, quotes, name, most)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = {c: b.value for c, b in known.items()}
        memo: dict[str, bool] = {}
        for pdf in batches:
            rows = []
            for number, doc, quotes_, *own_tables in zip(pdf["e"], pdf["d"], pdf["q"], *[pdf[c] for c in known]):
                head, compound, bad = (_table(x) if shared[c] is None else shared[c] for c, x in zip(known, own_tables))
                if shared["_fix"] is None or len(memo) > 500_000:
                    memo.clear()
                own = [{"quote_id": q["quote_id"], "text": q["text"], "page_id": q["page_id"], "layout_id": q["layout_id"]} for q in quotes_ if q is not None]
                for q, r in zip(own, read_quotes(own, doc, head)):
                    for token in mended(q["text"] or "", compound).split():
                        if token not in memo:
                            memo[token] = any(w in bad or mixed(w) for w in words_in(token))
                        if memo[token]:
                            r["found"].add("misread")
                            break
                    rows += [(number, q["quote_id"], k) for k in r["found"]]
            yield pd.DataFrame(rows, columns=["example_no", "quote_id", "noise"])

    source = examples.where(F.col(quotes).isNotNull()).select(F.col("example_no").alias("e"), F.col(name).alias("d"), F.col(quotes).alias("q"), *known)
    return source.mapInPandas(read, "example_no long, quote_id string, noise string").distinct()


def _fixed(token: str, table: dict[str, str]) -> str:
    """A token with its misread words corrected, in the case they are in."""
    if is_code(token):
        return token
    out = []
    for part in _INNER.split(token):
        m = _CORE.match(part)
        core = m.group(2)
        low = core.lower()
        right = table.get(low) if len(low) >= 2 else None
        if right is None and mixed(low):
            right = unmixed(low)
        if right is not None:
            letters = [c for c in core if c.isalpha()]
            right = right.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else right.capitalize() if core[0].isupper() or core[0].isdigit() and core[1:2].isupper() else right
            part = m.group(1) + right + m.group(3)
        out.append(part)
    return "".join(out)


def repair(examples: DataFrame, quotes: str = "text_quotes", name: str = "doc_name", most: int = 2_000_000) -> DataFrame:
    """(`example_no`, `text`): the quotes of each example in the order of page and layout as continuous paragraphs, headers and page numbers out, broken words and sentences joined, also from quote to quote, every word `find_noise` takes for misread corrected."""
    examples, _, known = _evidence(examples, quotes, name, most)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = {c: b.value for c, b in known.items()}
        memo: dict[str, str] = {}
        for pdf in batches:
            rows = []
            for number, doc, quotes_, *own_tables in zip(pdf["e"], pdf["d"], pdf["q"], *[pdf[c] for c in known]):
                head, compound, table = (_table(x) if shared[c] is None else shared[c] for c, x in zip(known, own_tables))
                if shared["_fix"] is None or len(memo) > 500_000:
                    memo.clear()
                text = ""
                read = in_order(read_quotes([dict(q) for q in quotes_ if q is not None], doc, head))
                for r, after in zip(read, [*read[1:], None]):
                    clean = r["clean"]
                    if broken := after and "continues" in r["found"] and across(clean, after["clean"]):
                        clean = re.sub(rf"[{HYPHENS}]\s*$", MARK + ("-" if broken in compound else ""), clean)
                    text += "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", mended(clean, compound)) if p.strip())
                    text += "" if text.endswith((MARK, MARK + "-")) else " " if "continues" in r["found"] else "\n\n"
                out = []
                for token in re.split(r"(\s+)", text.replace(MARK, "").strip()):
                    if token not in memo:
                        memo[token] = _fixed(token, table)
                    out.append(memo[token])
                rows.append((number, "".join(out)))
            yield pd.DataFrame(rows, columns=["example_no", "text"])

    source = examples.where(F.col(quotes).isNotNull()).select(F.col("example_no").alias("e"), F.col(name).alias("d"), F.col(quotes).alias("q"), *known)
    return source.mapInPandas(join, "example_no long, text string")
