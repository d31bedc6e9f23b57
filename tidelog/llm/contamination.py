"""Held-out test passages inside a corpus, by pigeonhole pieces and bit-parallel edit distance.

Each item is split into pieces of five words, as many as fit.  With an error budget
of one less than its pieces, a copy of the whole item keeps at least one piece
whole; so does every passage of ten of its words in a row, which spans a whole
piece.  Exact piece hits are therefore all the candidates there are.  Each is
verified by Myers' bit-parallel word distance (on integers of any length): of the
longest passage around the hits, which must be found in the text without an error,
and of the whole item against the text around the hits.

The items are the stated query set: they go to the executors as one index of
sorted arrays, broadcast, in blocks only beyond ``BLOCK_CHARS`` characters of items
(an index has about as many bytes); the corpus is read once a block and never
shuffled.

Defined cases: null and empty texts hold nothing; items without words are never
found, items of fewer words than a piece are one piece; copies of items and
documents are reported each; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import spread

PIECE = 5
#: Most characters of items in one index.
BLOCK_CHARS = 64_000_000
#: Characters handled together.
PORTION = 200_000

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_BREAK = re.compile(r"-(?<=[^\W_]-)[ \t]*(?:\r\n?|\n)[ \t]*(?=[^\W_])")
_SOFT = re.compile("\xad[ \\t]*(?:\\r\\n?|\\n)[ \\t]*")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"(?<=\w)[*`~]+(?=\w)")
#: Letters that no normal form takes apart. Fixed values.
_LETTERS = {"æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "ŧ": "t", "\u2010": "-", "\u2011": "-"}
#: An odd number of 64 bits. Fixed value.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str | None) -> str:
    """Text of which the comparable words are the runs of letters and digits."""
    if not text:
        return ""
    if not text.isascii():
        if "\xad" in text:  # a soft hyphen at a line end
            text = _SOFT.sub("", text)
        text = unicodedata.normalize("NFKD", text).casefold()
        if not text.isascii():
            for c in set(text):
                if c > "\x7f":
                    if c in _LETTERS:
                        text = text.replace(c, _LETTERS[c])
                    elif unicodedata.category(c) in ("Cf", "Mn", "Me", "Cc") and c != "\x85":
                        text = text.replace(c, "")
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _LINK.sub("", text)
    if "-" in text:
        text = _BREAK.sub("", text)
    if "*" in text or "`" in text or "~" in text:
        text = _MARKS.sub("", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    """Comparable words: no case, accents, widths, ligatures, tags, invisible characters or line-end hyphens."""
    return _WORD.findall(fold(text))


_IN_WORD: list[np.ndarray] = []


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of folded texts together: 64-bit hashes, and the number of the text each is in.

    Characters are handled as arrays: a word's hash is the sum of its characters
    times powers of a fixed odd number.
    """
    if not _IN_WORD:
        _IN_WORD.append(np.array([chr(c).isalnum() for c in range(0x110000)]))
    joined = "\x00".join(texts)
    codes = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _IN_WORD[0][codes]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, length = edge[::2], np.diff(edge)[::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
    powers = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
    value = (codes[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return np.add.reduceat(value, first), np.searchsorted(bounds, start, side="right")


def myers_distance(pattern: list[int], text: list[int]) -> int:
    """Least edit distance of ``pattern`` to any stretch of ``text``.

    The columns of the distance matrix are two bit vectors of rises and falls.
    """
    m = len(pattern)
    if not m:
        return 0
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for w in text:
        eq = where.get(w, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        rise = down | ~(across | up) & full
        fall = up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = rise << 1 & full  # a match may begin anywhere: the top row is free
        fall = fall << 1 & full
        up = fall | ~(vertical | rise) & full
        down = rise & vertical
        best = min(best, score)
    return best


class PieceIndex:
    """Pieces of items by hash, with what verification needs, as arrays.  Words are numbers; 0 is a word no item has."""

    def __init__(self, items: list[tuple[int, str]]):
        hashed, number = hashed_words([t for _, t in items])
        self.vocabulary = np.unique(hashed)
        self.words = self.numbers(hashed)
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.bounds = np.searchsorted(number, np.arange(len(items) + 1))
        self.powers = np.random.default_rng(20_240_601).integers(1, 2**63, PIECE, dtype=np.uint64) | np.uint64(1)
        sizes = np.diff(self.bounds)
        #: By width of a piece: sorted hashes, and the item and offset of each.
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in range(1, PIECE + 1):
            hashes = self.hashes(self.words, width)
            which = np.flatnonzero(sizes == width if width < PIECE else sizes >= PIECE)
            if not len(which):
                continue
            many = sizes[which] // width
            n = np.repeat(which, many)
            offset = (np.arange(len(n)) - np.repeat(np.cumsum(many) - many, many)) * width
            keys = hashes[self.bounds[n] + offset]
            order = np.argsort(keys, kind="stable")
            self.pieces[width] = keys[order], n[order], offset[order]

    def item(self, n: int) -> np.ndarray:
        return self.words[self.bounds[n] : self.bounds[n + 1]]

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashed, at + 1, 0)

    def hashes(self, ids: np.ndarray, width: int) -> np.ndarray:
        n = max(0, len(ids) - width + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            out += ids[j : j + n].astype(np.uint64) * self.powers[j]
        return out

    def hits(self, ids: np.ndarray, number: np.ndarray):
        """(position, item number, offset) of every whole piece within one text."""
        for width, (keys, items, offsets) in sorted(self.pieces.items()):
            hashed = self.hashes(ids, width)
            if not len(hashed):
                continue
            at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            found = np.flatnonzero((keys[at] == hashed) & (number[: len(hashed)] == number[width - 1 :]))
            ends = np.searchsorted(keys, hashed[found], side="right")
            for p, first, end in zip(found.tolist(), at[found].tolist(), ends.tolist()):
                for i in range(first, end):
                    begin = self.bounds[items[i]] + offsets[i]
                    if np.array_equal(ids[p : p + width], self.words[begin : begin + width]):
                        yield p, int(items[i]), int(offsets[i])


def longest_run(item: np.ndarray, text: np.ndarray, diagonal: int) -> tuple[int, int]:
    """Length and start in ``item`` of the longest run of equal words where ``text[diagonal + i]`` stands against ``item[i]``."""
    lo, hi = max(0, -diagonal), min(len(item), len(text) - diagonal)
    if hi <= lo:
        return 0, 0
    best, start, last = 0, lo, 0
    for at in [*np.flatnonzero(item[lo:hi] != text[diagonal + lo : diagonal + hi]).tolist(), hi - lo]:
        if at - last > best:
            best, start = at - last, lo + last
        last = at + 1
    return best, start


def _portions(ids: list[int], texts):
    """Folded texts in portions that fit a processor's cache, plain ones (one byte a character) apart from others."""
    held: dict[bool, tuple[list[int], list[str]]] = {True: ([], []), False: ([], [])}
    size = {True: 0, False: 0}
    for doc_id, text in zip(ids, texts):
        text = fold(text)
        plain = text.isascii()
        held[plain][0].append(doc_id)
        held[plain][1].append(text)
        size[plain] += len(text)
        if size[plain] > PORTION:
            yield held[plain]
            held[plain], size[plain] = ([], []), 0
    for part in held.values():
        if part[0]:
            yield part


def _search(shared, least_run: int):
    def run(batches):
        index = shared.value
        seen = np.zeros(len(index.vocabulary) + 1, dtype=bool)
        for pdf in batches:
            for ids, texts in _portions(pdf["doc_id"].tolist(), pdf["text"]):
                out = search(index, seen, ids, texts)
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "pieces", "longest_run", "passage", "passage_errors", "distance", "item_words", "whole"])

    def absent(seen, item, stretch):
        seen[stretch] = True
        n = len(item) - int(np.count_nonzero(seen[item]))
        seen[stretch] = False
        return n

    def search(index, seen, ids, texts):
        out = []
        hashed, number = hashed_words(texts)
        flat = index.numbers(hashed)
        bounds = np.searchsorted(number, np.arange(len(ids) + 1))
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for p, n, offset in index.hits(flat, number):
            by.setdefault((int(number[p]), n), []).append((p, offset))
        for (d, n), places in by.items():
            begin, end = int(bounds[d]), int(bounds[d + 1])
            text, item = flat[begin:end], index.item(n)
            m = len(item)
            budget = max(1, m // PIECE) - 1
            diagonals = sorted({p - begin - offset for p, offset in places})
            run_, start, at = max((*longest_run(item, text, g), -g) for g in diagonals)
            stretches: list[list[int]] = []
            for g in diagonals:  # texts around the hits; what overlaps is one stretch
                lo, hi = max(0, g - budget), min(len(text), g + m + budget)
                if stretches and lo <= stretches[-1][1]:
                    stretches[-1][1] = max(hi, stretches[-1][1])
                else:
                    stretches.append([lo, hi])
            # the passage: the longest run, made up to the least length where it is shorter
            length = min(m, max(run_, least_run))
            first = max(0, min(start, m - length))
            passage = item[first : first + length]
            # an item word that is nowhere in the stretch costs an edit: most chance hits end here
            short = run_ < least_run or length < least_run
            if short and all(absent(seen, item, text[lo:hi]) > budget for lo, hi in stretches):
                continue
            around = text[max(0, first - at - length) : first - at + 2 * length]
            errors = myers_distance(passage.tolist(), around.tolist())
            pattern, distance = item.tolist(), m
            for lo, hi in stretches:
                distance = min(distance, myers_distance(pattern, text[lo:hi].tolist()))
            if (length >= least_run and errors == 0) or distance <= budget:
                out.append((ids[d], int(index.ids[n]), len(places), run_, length, errors, distance, m, distance <= budget))
        return out

    return run


def _blocks(items: DataFrame):
    """The items in blocks of bounded size."""
    block, chars = [], 0
    for row in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        block.append((row[0], fold(row[1])))
        chars += len(row[1])
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, least_run: int = 10) -> DataFrame:
    """``doc_id``, ``item_id`` and evidence of every document holding an item in whole or in part.

    ``pieces``: exact piece hits; ``longest_run``: most words in a row both share at
    the hits; ``passage``: words of the passage verified (that run, made up to
    ``least_run`` where the item has so many), and ``passage_errors``, its word edits
    from the text; ``distance``: least word edits from the whole item to a stretch
    of the text; ``whole``: these are within the item's error budget.  A pair is
    reported if a passage of ``least_run`` words has no error, or the item is whole.
    """
    schema = "doc_id bigint, item_id bigint, pieces int, longest_run int, passage int, passage_errors int, distance int, item_words int, whole boolean"
    corpus = spread(documents.where("text is not null").select("doc_id", "text"))
    result = None
    for block in _blocks(items):
        shared = documents.sparkSession.sparkContext.broadcast(PieceIndex(block))  # at most about BLOCK_CHARS bytes
        part = corpus.mapInPandas(_search(shared, least_run), schema)
        result = part if result is None else result.unionByName(part)
    return result if result is not None else documents.sparkSession.createDataFrame([], schema)


def contaminated(documents: DataFrame, items: DataFrame, least_run: int = 10) -> DataFrame:
    """``doc_id``, ``item_id`` of the pairs of which a passage of at least ``least_run`` words was verified without an error."""
    return leaked_items(documents, items, least_run).where((F.col("passage") >= least_run) & (F.col("passage_errors") == 0)).select("doc_id", "item_id")
