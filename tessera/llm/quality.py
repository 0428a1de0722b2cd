"""Operator 5: quality classifier on hashed word n-grams.

Features of a whole text, each at most once: words, pairs of words, word
shapes (capitals, digits, signs, last sign, length), pairs of shapes, and
whether a word repeats the one before it.  The model is a logistic regression
trained with FTRL; a score is one sparse dot product.  Training takes at most
``most_labelled`` labelled rows of the given fold; scoring covers every row.

Defined results: null and empty texts have no features and get the score of
the bias; documents without an id are scored and are never held out; repeated
rows are scored each; without usable labels all scores are 0.5; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import ftrl
from tessera.llm.textkit import WordHasher, chunks, mix, string_buffers


def _classes() -> np.ndarray:
    """0 small letter or other character, 1 capital, 2 digit, 3 sign."""
    out = np.full(256, 0, dtype=np.int64)
    out[33:127] = 3
    out[48:58] = 2
    out[65:91] = 1
    out[97:123] = 0
    return out


def featurise(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of consecutive row ranges of a text column."""
    hasher, classes = WordHasher(), _classes()
    data, offsets = string_buffers(column)
    for lo, hi in chunks(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        words, starts, ends, first = hasher.words(part, off)
        n_rows = hi - lo
        if not len(words):
            yield np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64)
            continue
        rows = np.repeat(np.arange(n_rows), np.diff(first))
        kind = classes[part]
        sums = [np.concatenate([[0], np.cumsum(kind == k)]) for k in (1, 2, 3)]
        upper, digit, sign = (np.minimum(s[ends] - s[starts], 3) for s in sums)
        last = np.where(kind[ends - 1] == 3, part[ends - 1].astype(np.int64), 0)
        shape = ((((upper * 4 + digit) * 4 + sign) * 128 + last) * 8 + np.minimum((ends - starts) // 4, 7)).astype(np.uint64)
        same_row = rows[1:] == rows[:-1]
        pair_rows = rows[:-1][same_row]
        pairs = mix(words[:-1] * np.uint64(3) + words[1:])[same_row]
        shape_pairs = mix(shape[:-1] * np.uint64(1 << 32) + shape[1:] + np.uint64(11))[same_row]
        repeats = pair_rows[(words[:-1] == words[1:])[same_row]]
        hashes = np.concatenate([words, mix(shape + np.uint64(5)), pairs, shape_pairs, np.full(len(repeats), mix(np.array([13], np.uint64))[0])])
        yield ftrl.distinct(ftrl.to_features(hashes), np.concatenate([rows, rows, pair_rows, pair_rows, repeats]), n_rows)


def score_quality(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", most_labelled: int = 6000) -> DataFrame:
    """doc_id and score of every document; ``usable`` says which label rows may be learnt from."""
    model = ftrl.fit(docs, ftrl.labelled_sample(labels, label, usable, most_labelled), featurise, epochs=3, alpha=0.5, beta=1.0, l1=4.0, l2=0.0, least_docs=4)
    return ftrl.score(docs, model, featurise)


def fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def decided(scores: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    return scores.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
