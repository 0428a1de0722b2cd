"""Operator 6: toxicity with noisy-channel deobfuscation.

Parts of a text that look disguised (digits or signs beside letters, letters
three times in a row or doubled where words seldom double them, single letters and
signs with blanks or other signs between them) are
taken as the output of a noisy channel.  A lattice holds the letters that each
sign may stand for, dropped separators and shortened repetitions; Viterbi
search under a character trigram model finds the likeliest word.  The restored
words join the plain words of the text, and a logistic regression (FTRL) over
hashed words and beginnings of words scores the whole; beginnings carry what is
learnt to other endings of a stem.

The character model counts all letters of all documents; the counts are
summed per trigram by Spark, so what comes to the driver is one bounded table.
Labels are learnt from at most ``most_labelled`` rows of the given fold.

Defined results: null and empty texts have no words and get the score of the
bias; documents without an id are scored and are never held out; repeated
rows are scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import ftrl
from tessera.llm.runtime import bound_batches
from tessera.llm.textkit import WordHasher, chunks, mix, string_buffers

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SUBSTITUTED, DROPPED_LEET, DROPPED_MARK, DROPPED_GAP, SHORTENED = 1.0, 9.0, 2.0, 0.2, 1.0
BEGINNINGS = (4, 6)  # bytes of a longer word that count as a feature of their own
ROW_GAP = 4  # bytes between rows that are looked at together
SYMBOLS = 28  # a-z, another letter, and the edge of a word
OTHER, EDGE = 26, 27

SIGNS = re.escape("".join(LEET))
SELDOM_DOUBLED = "ahijkquvwxy"

DISGUISED = re.compile(
    rf"""(?<!\S)\S*(?:[0-9@$!|+][a-z]|[a-z][0-9@$!|+]|([a-z])\1\1|([{SELDOM_DOUBLED}])\2|([a-z])\3([a-z])\4)\S*"""
    rf"""|(?<![^\W_])[a-z{SIGNS}](?:[ ._*\-]{{1,2}}[a-z{SIGNS}]){{2,}}(?![^\W_])""",
)
_DOUBLE_SIGN = re.compile(rf"(?!!!\Z)([{SIGNS}])\1(?!\1)")
_LITERAL = str.maketrans({c: x[0] for c, x in LEET.items()} | dict.fromkeys(" ._*-"))


def _symbol_table() -> np.ndarray:
    table = np.full(256, EDGE, dtype=np.int64)
    table[128:] = OTHER
    table[65:91] = table[97:123] = np.arange(26)
    return table


def char_counts(docs: DataFrame) -> DataFrame:
    """Counts of letter trigrams over all texts, each on its own: k (their number in base 28), n."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _symbol_table(), np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            data, offsets = string_buffers(batch.column(0))
            for lo, hi in chunks(offsets):
                own = table[data[offsets[lo] : offsets[hi]]]
                # two edges before each text and behind the last, so that no trigram reaches from text to text
                s = np.append(np.insert(own, np.repeat(offsets[lo:hi] - offsets[lo], 2), EDGE), [EDGE, EDGE])
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    bound_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """Costs (negative logarithms) of a symbol after two others, smoothed by shorter contexts."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
    p2 = (c2 + weight * p1) / (c2.sum(1, keepdims=True) + weight)
    p3 = (c3 + weight * p2[None]) / (c3.sum(2, keepdims=True) + weight)
    return -np.log(p3)


class Restorer:
    """Viterbi decoding of disguised words; results are kept for a while."""

    def __init__(self, cost: np.ndarray) -> None:
        self.cost = cost.tolist()
        self.known: dict[str, str] = {}

    @staticmethod
    def lattice(part: str) -> list[list[tuple[str, float]]]:
        """For each run of a character, what it may stand for and the channel's cost."""
        out = []
        for run in re.finditer(r"(.)\1*", part, re.DOTALL):
            c, n = run[1], len(run[0])
            if c.isalpha():
                out.append([(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, SHORTENED)] if n == 2 else [(c, SHORTENED), (c + c, SHORTENED)])
            elif c in LEET:
                options = [(x * k, SUBSTITUTED * k) for x in LEET[c] for k in range(1, min(n, 2) + 1)]
                dropped = DROPPED_GAP if n >= 3 else DROPPED_MARK if c in "!|+" and run.end() == len(part) else DROPPED_LEET
                out.append([*options, ("", dropped)])  # at a word's end such a sign may also be what it is
            else:
                out.append([("", DROPPED_GAP if c in " ._*-" else DROPPED_MARK)])
        return out

    def restore(self, part: str) -> str:
        """The likeliest word behind a disguised part."""
        if (got := self.known.get(part)) is not None:
            return got
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        for options in self.lattice(part):
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, path) in states.items():
                for letters, channel in options:
                    x, y, cost, way = a, b, so_far + channel, path
                    for c in letters:
                        s = ord(c) - 97 if "a" <= c <= "z" else OTHER
                        cost += self.cost[x][y][s]
                        x, y, way = y, s, (way, c)
                    if (x, y) not in following or cost < following[x, y][0]:
                        following[x, y] = (cost, way)
            states = following
        path = min((cost + self.cost[a][b][EDGE], i, way) for i, ((a, b), (cost, way)) in enumerate(states.items()))[2]
        letters = []
        while path:
            path, c = path
            letters.append(c)
        word = "".join(reversed(letters))
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[part] = word
        return word

    def words(self, text: str) -> list[str]:
        """Restored words of the disguised parts of a text in small letters.

        Spaced parts and doubled signs are also read sign by sign, since a shorter word may be likelier.
        """
        found = []
        for m in DISGUISED.finditer(text):
            part = m[0].strip(".,;:?\"'()[]")
            if not any("a" <= c <= "z" for c in part):
                continue
            literal = _DOUBLE_SIGN.search(part) or part[1:2] in tuple(" ._*-")
            words = [self.restore(part), part.translate(_LITERAL) if literal else ""]
            found += [w for w in dict.fromkeys(words) if w]
        return found


def doubtful_rows(data: np.ndarray, offsets: np.ndarray, letter: np.ndarray, leet: np.ndarray) -> np.ndarray:
    """The rows in which a disguise may stand; each row is looked at on its own."""
    rows = np.arange(len(offsets) - 1)
    apart = np.insert(data, np.repeat(offsets[:-1], ROW_GAP), ord("\n"))  # nothing reaches over this gap
    found = np.concatenate([[0], np.cumsum(_doubtful(apart, letter, leet))])
    begin, end = offsets[:-1] + ROW_GAP * (rows + 1), offsets[1:] + ROW_GAP * (rows + 1)
    return np.flatnonzero(found[end] > found[begin])


def _doubtful(data: np.ndarray, letter: np.ndarray, leet: np.ndarray) -> np.ndarray:
    """Marks bytes near which a disguise may begin; a cheap superset of DISGUISED."""
    mark = np.zeros(len(data), dtype=bool)
    if len(data) > 4:
        is_letter, is_leet = letter[data], leet[data]
        is_digit = (data >= 48) & (data <= 57)
        mark[:-1] |= is_leet[:-1] & is_letter[1:]
        mark[:-1] |= is_letter[:-1] & (is_leet[1:] | is_digit[1:])
        double = is_letter[:-1] & (data[:-1] == data[1:])
        mark[:-1] |= double & np.isin(data[:-1], np.frombuffer(SELDOM_DOUBLED.encode(), dtype=np.uint8))
        mark[:-2] |= double[:-1] & double[1:]
        mark[:-3] |= double[:-2] & double[2:]
        lone = is_letter | is_leet
        solid = is_letter | is_digit
        lone[1:] &= ~solid[:-1]
        lone[:-1] &= ~solid[1:]
        near = lone.copy()
        near[:-2] &= lone[2:]
        near[:-3] |= lone[:-3] & lone[3:]
        mark |= near
        mark[-1] |= is_leet[-1]
    elif len(data):
        mark[:] = True
    return mark


def _word_features(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the beginnings of longer words, with their rows."""
    words, starts, ends, first = hasher.words(data, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found, own = [words], [rows]
    for size in BEGINNINGS:
        longer = ends - starts > size
        found.append(mix(hasher.spans(starts[longer], starts[longer] + size) ^ np.uint64(size)))
        own.append(rows[longer])
    return np.concatenate(found), np.concatenate(own)


def make_featurise(cost: np.ndarray):
    """A featuriser of text columns: plain and restored words and their beginnings, each once."""

    def featurise(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hasher, restorer = WordHasher(), Restorer(cost)
        plain = np.arange(256, dtype=np.uint8)
        plain[65:91] += 32
        small = plain.copy()
        plain[[b for b in range(128) if not 97 <= b <= 122 and not 65 <= b <= 90]] = 32
        letter = np.zeros(256, dtype=bool)
        letter[97:123] = True
        leet = np.zeros(256, dtype=bool)
        leet[[ord(c) for c in LEET]] = True
        data, offsets = string_buffers(column)
        for lo, hi in chunks(offsets):
            part, off = small[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
            n_rows = hi - lo
            rows_at = doubtful_rows(part, off, letter, leet)
            extra = [" ".join(restorer.words(part[off[r] : off[r + 1]].tobytes().decode())) for r in rows_at]
            words, rows = _word_features(hasher, plain[part], off)
            if any(extra):
                more, at = string_buffers(pa.array(extra, pa.large_string()))
                words2, rows2 = _word_features(hasher, more, at)
                words = np.concatenate([words, words2])
                rows = np.concatenate([rows, rows_at[rows2]])
            yield ftrl.distinct(ftrl.to_features(words), rows, n_rows)

    return featurise


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", most_labelled: int = 12000):
    """The model and its featuriser; ``usable`` says which label rows may be learnt from."""
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for row in char_counts(docs).collect():  # at most 28**3 rows
        counts[row["k"]] = row["n"]
    featurise = make_featurise(language_model(counts))
    sample = ftrl.labelled_sample(labels, label, usable, most_labelled)
    return ftrl.fit(docs, sample, featurise, epochs=5, alpha=0.5, beta=1.0, l1=4.0, l2=0.0, least_docs=4), featurise


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, **params) -> DataFrame:
    """doc_id and score of every document."""
    return ftrl.score(docs, *train_toxicity(docs, labels, usable, **params))


def drop_toxic(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = 0.3, **params) -> DataFrame:
    """The documents whose score is below ``threshold``, with all their columns."""
    scored = ftrl.with_score(docs, *train_toxicity(docs, labels, usable, **params), "_toxicity")
    return scored.filter(F.col("_toxicity") < threshold).drop("_toxicity")
