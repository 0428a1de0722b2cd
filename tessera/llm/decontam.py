"""Operator 1: benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised (small letters; every run of other
characters than letters, digits and marks is one blank).  An item of length m
may differ by k = max(least, rate * m) edits.  It is split into k + 1 pieces:
k edits leave at least one piece intact, so every match within the budget has
an exact piece hit.  All pieces of a block of items stand in one
multi-pattern automaton that runs over each whole text once.  A hit is
verified on both sides with Myers' bit-parallel algorithm, anchored at the
piece: right and left distances that add up to at most k are a match, and the
smallest sum over the hits is the edit distance of the best occurrence.

The items are a given query set.  They are taken to the executors in blocks of
at most ``block_chars`` characters, one pass over the documents for each
block, so what is sent at once does not grow.  Documents are not shuffled.

Items whose normalised text is shorter than ``least_chars`` have a budget of 0:
only their exact occurrences between word boundaries count, as a short text
with edits, or inside of other words, says nothing.

Defined results: null and empty texts match nothing; items without a letter,
digit or mark are empty and match nothing; null ids stay null; repeated documents or items are reported once each; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import bound_batches

MATCHES = "doc_id long, item_id long, distance int, budget int, start long, end long"
_GAP = re.compile(r"[\W_]+")
#: Letters of scripts that are written without blanks between words.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]")


def normalise(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def budget(length: int, rate: float, least: int) -> int:
    return min(max(least, int(rate * length)), max(length - 1, 0))


def bounded(text: str, start: int, end: int) -> bool:
    """Whether a span of a normalised text begins and ends between words."""

    def between(at: int) -> bool:
        if not 0 < at < len(text):
            return True
        around = text[at - 1 : at + 1]
        return " " in around or bool(_UNSPACED.search(around))

    return between(start) and between(end)


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` disjoint pieces of almost equal length, with their places."""
    cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


def anchored(pattern: str, text: Iterable[str], most: int) -> tuple[int, int]:
    """Least edit distance between ``pattern`` and a prefix of ``text``, and that prefix's length.

    Myers' bit vectors hold a column's differences.  Gives (most + 1, 0) when
    the distance exceeds ``most``.
    """
    m = len(pattern)
    if m == 0:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = (m, 0) if m <= most else (most + 1, 0)
    look = 4 * most // 2 + 16
    for j, c in enumerate(text, 1):
        if j > m + most:
            break
        eq = masks.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        h_plus = minus | ~(x | plus)
        h_minus = plus & x
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1 | 1) & full  # the first row grows by one with each character
        h_minus = h_minus << 1 & full
        x |= eq
        y = eq | minus
        plus = (h_minus | ~(y | h_plus)) & full
        minus = h_plus & y
        if score < best:
            best, at = score, j
        if j == look:  # nothing within the budget in this column: nothing later either
            look *= 2
            value = least = j
            p, q = plus, minus
            while p or q:
                value += (p & 1) - (q & 1)
                if value < least:
                    least = value
                p >>= 1
                q >>= 1
            if least > most:
                break
    return best, at


class Matcher:
    """Pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int, least_chars: int) -> None:
        import ahocorasick

        self.items = []
        self.short: set[int] = set()  # numbers of the items that count only between word boundaries
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for item, raw in items:
            text = normalise(raw)
            if not text:
                continue
            short = len(text) < least_chars
            k = 0 if short else budget(len(text), rate, least)
            if short:
                self.short.add(len(self.items))
            for at, piece in pieces(text, k):
                found.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item, text, k))
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """Best match of each item: (number of the item, distance, start, end) in the normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            begin, end = last + 1 - size, last + 1
            for number, at in where:
                _, item, k = self.items[number]
                most = min(k, best[number][0] - 1) if number in best else k
                if most < 0 or (number in self.short and not bounded(text, begin, end)):
                    continue
                right, used = anchored(item[at + size :], text[end : end + len(item) - at - size + most], most)
                if right > most:
                    continue
                left, back = anchored(item[:at][::-1], text[max(0, begin - at - most) : begin][::-1], most - right)
                if left + right > most:
                    continue
                best[number] = (left + right, begin - back, end + used)
        return [(n, *b) for n, b in sorted(best.items())]


#: The matcher of the block that this worker had last, so that its later tasks do not build it again.
_LAST: dict[str, Matcher] = {}


def worker_matcher(name: str, items: list[tuple[int, str]], rate: float, least: int, least_chars: int) -> Matcher:
    """The matcher of a block of items; ``name`` stands for the block and its parameters."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Matcher(items, rate, least, least_chars)
    return _LAST[name]


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Where a span of the normalised text stands in the text itself."""
    places = []
    gap = True
    for i, c in enumerate(text):
        for x in c.lower():
            if x.isalnum() or not (x == "_" or _GAP.fullmatch(x)):
                places.append(i)
                gap = False
            elif not gap:
                places.append(i)
                gap = True
    return (places[start], places[end - 1] + 1) if 0 <= start < end <= len(places) else (0, len(text))


def blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, one block in the driver's memory at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        if block and size + len(row["text"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.08, least: int = 2, least_chars: int = 40, block_chars: int = 4_000_000) -> DataFrame:
    """Documents that hold a test item within its edit budget: doc_id, item_id, distance, budget, start, end.

    ``start`` and ``end`` are code points of the document's text.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession

    def one(block: list[tuple[int, str]]) -> DataFrame:
        shipped, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = worker_matcher(name, shipped.value, rate, least, least_chars)
            for batch in batches:
                rows = []
                if matcher.items:
                    for doc, text in zip(batch.column(0), batch.column(1)):
                        raw = text.as_py()
                        if not raw:
                            continue
                        for number, distance, start, end in matcher.matches(normalise(raw)):
                            item, _, k = matcher.items[number]
                            rows.append((doc.as_py(), item, distance, k, *original_span(raw, start, end)))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "item_id", "distance", "budget", "start", "end"])

        return source.mapInArrow(run, MATCHES)

    found = [one(b) for b in blocks(items, block_chars)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], MATCHES)


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.08, least: int = 2, least_chars: int = 40, block_chars: int = 4_000_000) -> DataFrame:
    """The documents that hold no test item, with all their columns; nothing is shuffled."""
    spark, names = docs.sparkSession, docs.columns
    bound_batches(spark)
    at = names.index("text")

    def one(rest: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shipped, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = worker_matcher(name, shipped.value, rate, least, least_chars)
            for batch in batches:
                clean = []
                for lo in range(0, batch.num_rows, 256):  # few texts are unpacked at a time
                    part = batch.column(at).slice(lo, 256).to_pylist()
                    clean += [not (matcher.items and raw and matcher.matches(normalise(raw))) for raw in part]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rest.mapInArrow(run, rest.schema)

    return reduce(one, blocks(items, block_chars), docs)
