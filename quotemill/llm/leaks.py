"""Held-out evaluation texts inside a corpus: greedy string tiling over Karp-Rabin seeds.

Documents and items become sequences of word numbers. Runs of `SEED` words are hashed with a rolling polynomial; a
sorted array of the items' hashes, sent to the workers in blocks of bounded size, finds the shared seeds of every
document. For each (document, item) with enough seeds the seeds are grown to maximal matches and the longest are
marked first, never overlapping (the tiles). A tile of `RUN` words is a leak; else, from every `SEED`th place of every
match, the least numbers of changed, added or dropped words are counted for all stretches backward and forward, and
the best of both are put together: a leak if a stretch of `STRETCH` words has at most one edit in `EDIT`.

Why that is exact: of a stretch of 2 * `STRETCH` words or more one half qualifies by itself, so only shorter ones are
looked for. These have at most `WIDE` edits, which bounds the shift between item and document; and some run of `SEED`
words is intact in them, which holds one of the places counted from.

Why seeds of 5 words lose nothing: n >= 40 words with e <= n/6 edits leave n - e words in at most e + 1 runs, so some run
has more than 4 words; and all runs together have at least n - e - 4 * (e + 1) seeds, which is least at n = 42, e = 7: 3.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, RUN, STRETCH, EDIT, LEAST_SEEDS = 5, 20, 40, 6, 3
#: The longest stretch that has to be looked for, and its edits.
LONGEST = 2 * STRETCH - 1
WIDE = LONGEST // EDIT
#: The items go to the workers in blocks of so many words.
BLOCK_WORDS = 2_000_000
#: Pairs of equal seeds of a batch of texts and the items that are listed at once; a batch with more is halved, a single text with more searched item by item.
SHARED = 4_000_000

_BROKEN = re.compile(r"[-‐‑¬\xad]+[ \t]*(?:\r\n|[\n\r\v\f\x85\u2028\u2029])[>\s]*(?=\w)")
_JOINED = re.compile(r"[^\w–—/|…]+|_+")
_WORDS = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def whole(text: str) -> str:
    """The text with words that were broken over two lines put together."""
    return _BROKEN.sub("", text) if "\n" in text or "\r" in text else text


def words_of_token(token: str) -> list[str]:
    """The words in a run of characters without white space: mostly one, several around dashes and slashes, none in mere punctuation."""
    token = unicodedata.normalize("NFKC", token)
    token = "".join(c for c in token if unicodedata.category(c) != "Cf").casefold()
    return _WORDS.findall(_JOINED.sub("", unicodedata.normalize("NFC", token)))


def words_of(text: str) -> list[str]:
    """The words of a text as they count for a comparison: without case, punctuation, hyphenation, quotation marks and invisible characters."""
    return [w for t in whole(text).split() for w in words_of_token(t)]


def rolling_hashes(ids: np.ndarray, k: int = SEED) -> np.ndarray:
    """Karp-Rabin values of all runs of k numbers (polynomial modulo 2^64)."""
    if len(ids) < k:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    for j in range(k):
        out = out * _BASE + ids[j : len(ids) - k + 1 + j]
    return out


class Items:
    """The seed index of a block of items."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[int] = []
        self.tokens: list[np.ndarray] = []
        hashes, owner, place = [], [], []
        for item_id, text in rows:
            t = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text or "")], dtype=np.uint64)
            h = rolling_hashes(t)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids), dtype=np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
            self.ids.append(item_id)
            self.tokens.append(t)
        all_hashes = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = np.argsort(all_hashes, kind="stable")
        self.hash = all_hashes[order]
        self.owner = np.concatenate(owner)[order] if hashes else np.empty(0, dtype=np.int32)
        self.place = np.concatenate(place)[order] if hashes else np.empty(0, dtype=np.int32)

        self.start = np.cumsum([0] + [len(t) for t in self.tokens])
        self.words = np.concatenate([*self.tokens, np.zeros(1, dtype=np.uint64)])
        self.memo: dict[str, int] = {}
        self.several: list[list[int]] = []

    def _resolve(self, token: str) -> int:
        """The number of a token's word, 0 for an unknown one; below 0 the place of a list, for tokens of no or several words."""
        ids = [self.number.get(w, 0) for w in words_of_token(token)]
        if len(ids) == 1:
            code = ids[0]
        else:
            self.several.append(ids)
            code = -len(self.several)
        self.memo[token] = code
        return code

    def numbers(self, text: str) -> list[int]:
        """The word numbers of a text."""
        if len(self.memo) > 1_000_000:
            self.memo.clear()
            self.several.clear()
        get, resolve = self.memo.get, self._resolve
        codes = [resolve(t) if (c := get(t)) is None else c for t in whole(text).split()]
        if codes and min(codes) < 0:
            return [x for c in codes for x in (self.several[-c - 1] if c < 0 else (c,))]
        return codes

    def search(self, texts: list[str]) -> list[tuple[int, int]]:
        """(place of the text, item id) of all leaks into some texts."""
        return self._search([self.numbers(t) for t in texts])

    def _search(self, parts: list[list[int]]) -> list[tuple[int, int]]:
        if not len(self.hash) or not parts:
            return []
        begin = np.cumsum([0] + [len(p) + SEED for p in parts])
        doc = np.zeros(begin[-1], dtype=np.uint64)  # texts stand apart by unknown words
        for b, p in zip(begin, parts):
            doc[b : b + len(p)] = p
        h = rolling_hashes(doc)
        at = np.searchsorted(self.hash, h)
        np.minimum(at, len(self.hash) - 1, out=at)
        hit = np.flatnonzero(self.hash[at] == h)
        if not len(hit):
            return []
        first = at[hit]
        n = np.searchsorted(self.hash, h[hit], side="right") - first
        if n.sum() > SHARED:
            if len(parts) > 1:
                half = len(parts) // 2
                return self._search(parts[:half]) + [(half + d, i) for d, i in self._search(parts[half:])]
            return [(0, self.ids[k]) for k in self._repetitive(doc[: len(parts[0])])]
        where = np.repeat(hit, n)
        entry = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        owner, place = self.owner[entry].astype(np.int64), self.place[entry]
        pair = (np.searchsorted(begin, where, side="right") - 1) * len(self.ids) + owner
        order = np.argsort(pair, kind="stable")
        pair, place, where = pair[order], place[order], where[order]
        edge = np.flatnonzero(np.r_[True, np.diff(pair) != 0, True])
        found, begun = [], []
        for a, b in zip(edge[:-1], edge[1:]):
            if b - a < LEAST_SEEDS:
                continue
            d, k = divmod(int(pair[a]), len(self.ids))
            item = self.tokens[k]
            if len(item) >= RUN and len(np.unique(place[a:b])) >= LEAST_SEEDS:
                at_doc = where[a:b] - begin[d]
                if b - a > RUN - SEED and any(n >= RUN for _, _, n in tiles(item, doc[begin[d] : begin[d + 1]], place[a:b], at_doc)):
                    found.append((d, self.ids[k]))
                elif len(item) >= STRETCH:
                    i, j = anchors(place[a:b], at_doc)
                    begun.append((np.full(len(i), d), np.full(len(i), k), i, j))
        if begun:
            d, k, i, j = map(np.concatenate, zip(*begun))
            hits = np.zeros(len(d), bool)
            for a in range(0, len(d), 5000):
                s = slice(a, a + 5000)
                item, text = (self.start[k[s]], self.start[k[s] + 1]), (begin[d[s]], begin[d[s] + 1] - SEED)
                hits[s] = stretches(self.words, doc, item, text, self.start[k[s]] + i[s], begin[d[s]] + j[s])
            found += [(int(x), self.ids[y]) for x, y in sorted(set(zip(d[hits], k[hits])))]
        return found

    def _repetitive(self, doc: np.ndarray) -> list[int]:
        """The places of the items that leaked into one text that shares so many seeds with them, for its repetitions, that they can't be listed at once."""
        h = rolling_hashes(doc)
        some = np.unique(h)
        a, b = np.searchsorted(self.hash, some, "left"), np.searchsorted(self.hash, some, "right")
        found = []
        for k in np.unique(np.concatenate([self.owner[x:y] for x, y in zip(a, b) if x < y])):
            item = self.tokens[k]
            if len(item) >= RUN and (longest_run(item, doc) >= RUN or len(item) >= STRETCH and self._stretched(item, doc, h)):
                found.append(int(k))
        return found

    def _stretched(self, item: np.ndarray, doc: np.ndarray, h: np.ndarray) -> bool:
        own = rolling_hashes(item)
        order = np.argsort(own, kind="stable")
        first, last = np.searchsorted(own[order], h, "left"), np.searchsorted(own[order], h, "right")
        hit = np.flatnonzero(last > first)
        step = max(1, SHARED // max(1, len(own)))  # so that a slice has at most SHARED pairs of seeds
        for s in range(0, len(hit), step):
            where = hit[s : s + step]
            n = last[where] - first[where]
            entry = np.repeat(first[where], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            i, j = anchors(order[entry], np.repeat(where, n))
            for x in range(0, len(i), 5000):
                c = slice(x, x + 5000)
                whole = lambda size, c=c: (np.zeros(len(i[c]), np.int64), np.full(len(i[c]), size))
                if stretches(item, doc, whole(len(item)), whole(len(doc)), i[c], j[c]).any():
                    return True
        return False

    def leaks(self, text: str) -> list[int]:
        """The ids of the items that leaked into a text."""
        return [i for _, i in self.search([text])]


def longest_run(item: np.ndarray, doc: np.ndarray) -> int:
    """Words of the longest stretch of the item that the text holds as it is; in time item x text, in memory of the text."""
    run = np.zeros(len(doc), dtype=np.int32)
    best = 0
    for w in item:
        run[1:] = run[:-1] + 1
        run[0] = 1
        run[doc != w] = 0
        best = max(best, int(run.max()))
    return best


def tiles(item: np.ndarray, doc: np.ndarray, place: np.ndarray, where: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length) of maximal matches, longest first, none overlapping one before in the item or in the document."""
    matches = []
    order = np.lexsort((place, where - place))
    place, where = place[order], where[order]
    diagonal = where - place
    fresh = np.flatnonzero(np.r_[True, (np.diff(diagonal) != 0) | (np.diff(place) != 1)])
    ends = np.r_[fresh[1:], len(place)] - 1
    for a, b in zip(fresh, ends):
        i, j, n = int(place[a]), int(where[a]), int(place[b] - place[a]) + SEED
        if (item[i : i + n] == doc[j : j + n]).all():  # the hash's word for it, checked
            matches.append((n, i, j))
    queue = [(-n, i, j) for n, i, j in matches]
    heapify(queue)
    used_item, used_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while queue:
        n, i, j = heappop(queue)
        n = -n
        free = ~(used_item[i : i + n] | used_doc[j : j + n])
        if free.all():
            used_item[i : i + n] = used_doc[j : j + n] = True
            out.append((i, j, n))
            continue
        edge = np.flatnonzero(np.diff(np.r_[0, free.astype(np.int8), 0]))  # what is left of it goes back into the queue
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= SEED:
                heappush(queue, (-int(e - s), i + int(s), j + int(s)))
    return out


def anchors(place: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every SEED-th place of every match, in the item and in the document."""
    order = np.lexsort((place, where - place))
    place, where = place[order], where[order]
    fresh = np.r_[True, (np.diff(where - place) != 0) | (np.diff(place) != 1)]
    first = place[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    keep = (place - first) % SEED == 0
    return place[keep], where[keep]


def stretches(words: np.ndarray, doc: np.ndarray, item: tuple[np.ndarray, np.ndarray], text: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a stretch of the item of at least STRETCH words that passes the place (i, j) has at most one edit in EDIT; for all places at once, each within its item and text (begin, end)."""
    left = _gains(words, doc, i - 1, j - 1, i - item[0], j - text[0], -1)
    right = _gains(words, doc, i, j, item[1] - i, text[1] - j, 1)
    beyond = np.maximum.accumulate(right[:, ::-1], axis=1)[:, ::-1]  # the best of at least so many words
    return (left + beyond[:, np.maximum(STRETCH - np.arange(LONGEST + 1), 0)] >= 0).any(axis=1)


def _gains(words: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray, item_left: np.ndarray, doc_left: np.ndarray, step: int) -> np.ndarray:
    """n - EDIT * (least edits of the n words of the item from i on, against words of the document from j on), for n up to LONGEST; in a band of WIDE words to both sides."""
    shift = np.arange(-WIDE, WIDE + 1)
    never = 10_000
    out = np.full((len(i), LONGEST + 1), -never * EDIT, dtype=np.int64)
    out[:, 0] = 0
    row = np.repeat(np.where(shift >= 0, shift, never)[None, :], len(i), axis=0)
    live = np.arange(len(i))
    for n in range(1, LONGEST + 1):
        go = (item_left >= n) & (row.min(axis=1) <= WIDE)
        if not go.all():
            i, j, item_left, doc_left, row, live = i[go], j[go], item_left[go], doc_left[go], row[go], live[go]
        if not len(live):
            break
        m = n + shift
        at = np.clip(j[:, None] + step * (m - 1), 0, len(doc) - 1)
        same = (doc[at] == words[i + step * (n - 1)][:, None]) & (m >= 1) & (m <= doc_left[:, None])
        new = row + ~same
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - shift, axis=1) + shift
        out[live, n] = n - EDIT * row.min(axis=1)
    return out


def _blocks(items: DataFrame, id_col: str, text: str) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.select(id_col, text).where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).toLocalIterator():
        n = len(r[1]) // 4 + 1
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(`doc_id`, `item_id`): every item that leaked into every document.

    The items are the stated query set: they run against all documents in blocks of `BLOCK_WORDS` words, each sent to
    the workers once. Null and empty texts and null ids on either side give no rows; repeated documents count each; repeated pairs
    come out once.
    """
    spark = documents.sparkSession
    out = None
    for block in _blocks(items, item_id, item_text):
        index = spark.sparkContext.broadcast(Items(block))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            own = index.value
            for pdf in batches:
                ids = pdf["doc_id"].tolist()
                rows = [(ids[d], i) for d, i in own.search(pdf["text"].tolist())]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        some = documents.where(F.col(doc_text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
        part = some.mapInPandas(search, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct() if out is not None else spark.createDataFrame([], "doc_id long, item_id long")


def leak_report(leaks: DataFrame) -> DataFrame:
    """(`item_id`, `documents`): in how many documents each item leaked."""
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))
