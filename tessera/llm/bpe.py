"""Byte-level BPE over many words at once, in arrays.

Texts become one buffer of bytes.  Words are cut by the class of their bytes,
told apart by Arrow's dictionary, and only the distinct ones are merged: in
each step every word makes the merge of least rank, the leftmost first, as a
single word would be merged.  The ids are then copied to where the words stood.

This is for tokenizers built as the public one (``shape_of``): words of ASCII
and of the letters U+00C0 to U+00FF without apostrophes.  Blank-separated parts
with anything else, and words over ``LONGEST`` bytes, go to ``rest``, which
gives the ids of one part.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

LONGEST = 32  # bytes of a word merged in arrays; positions take five bits of a code
NONE = 0xFFFF  # no merge
SLICE = 2 << 20  # bytes taken at once
BLANK, LETTER, DIGIT, SIGN, OTHER, PART = range(6)

SHAPE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

_LOWER = bytes(range(256)).lower().replace(b"\n", b" ")
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[33:127] = SIGN
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[32] = BLANK
_CLASS[39] = OTHER  # an apostrophe may begin 's, 're and so on


def shape_of(tokenizer) -> dict | None:
    """The tokenizer's file as read, if words can be merged in arrays."""
    found = json.loads(tokenizer.to_str())
    model = found["model"]
    fits = all(found.get(k) == v for k, v in SHAPE.items()) and all(model.get(k) == v for k, v in MODEL.items())
    plain = all(t["content"].startswith("<|") for t in found["added_tokens"])
    return found if fits and plain and len(model["merges"]) < NONE and max(model["vocab"].values()) < NONE else None


class BatchBpe:
    """Ids of many texts; ``rest`` encodes a part that is not merged here."""

    def __init__(self, shape: dict, shown_as: dict[int, str], rest: Callable[[bytes], bytes]) -> None:
        vocab, suffix, self.rest = shape["model"]["vocab"], shape["model"]["end_of_word_suffix"] or "", rest
        # bytes that no text of UTF-8 holds may be absent
        self.inner = np.array([vocab.get(shown_as[b], 0) for b in range(256)], dtype=np.uint32)
        self.last = np.array([vocab.get(shown_as[b] + suffix, 0) for b in range(256)], dtype=np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in shape["model"]["merges"]]
        # one more than there are merges: the place of NONE
        self.keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs] + [0xFFFFFFFF], dtype=np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.uint32)
        # of two merges of one pair the later counts, as in the tokenizer's own map
        last = {k: i for i, k in enumerate(self.keys[:-1].tolist())}
        ranks = np.array(list(last.values()), dtype=np.int64)
        self.first, self.second = np.full(1 << 20, len(pairs), np.uint16), np.full(1 << 20, len(pairs), np.uint16)
        self.first[self._slot(self.keys[ranks], 0x9E3779B1)] = ranks
        left = ranks[self.first[self._slot(self.keys[ranks], 0x9E3779B1)] != ranks]
        for self.factor in range(0x85EBCA6B, 1 << 32, 0x10000):
            slots = self._slot(self.keys[left], self.factor)
            if len(np.unique(slots)) == len(left):
                break
        else:
            raise ValueError("no hash without collisions")
        self.second[slots] = left

    @staticmethod
    def _slot(keys: np.ndarray, factor: int) -> np.ndarray:
        return (keys * np.uint32(factor)) >> np.uint32(12)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; NONE if there is none."""
        key = a << np.uint32(16) | b
        rank = self.first[self._slot(key, 0x9E3779B1)]
        missed = np.flatnonzero(self.keys[rank] != key)
        if len(missed):
            key = key.ravel()[missed]
            again = self.second[self._slot(key, self.factor)]
            rank.ravel()[missed] = np.where(self.keys[again] == key, again, NONE)
        return rank

    def _codes(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._ranks(a, b).astype(np.uint32) << np.uint32(5) | at

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words (their numbers) with equally many ids and these ids, a column for each word."""
        done = []
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(LONGEST + 2))
        words, ids, codes = np.empty(0, np.int64), np.empty((LONGEST + 1, 0), np.uint32), np.empty((LONGEST, 0), np.uint32)
        for size in range(LONGEST, 0, -1):
            rows = np.arange(size, dtype=np.uint32)[:, None]
            more = order[bounds[size] : bounds[size + 1]]
            if len(more):
                taken = data[starts[more] + rows]
                fresh = self.inner[taken]
                fresh[-1] = self.last[taken[-1]]
                words, ids = np.concatenate([words, more]), np.concatenate([ids[:size], fresh], axis=1)
                if size > 1:
                    codes = np.concatenate([codes[: size - 1], self._codes(fresh[:-1], fresh[1:], rows[:-1])], axis=1)
            if size == 1 or not len(words):
                if len(words):
                    done.append((words, ids))
                    words = words[:0]
                ids, codes = np.empty((size, 0), np.uint32), np.empty((size - 1, 0), np.uint32)
                continue
            best = codes.min(axis=0)
            goes = best < NONE << 5
            ends = np.flatnonzero(~goes)
            if len(ends):
                done.append((words[ends], ids[:, ends]))
            go = np.flatnonzero(goes)
            best, words = best[go], words[go]
            at = best & np.uint32(31)
            # what stands behind the merged pair moves up by one
            behind = rows[:-1] > at
            ids = ids.ravel()[(rows[:-1] + behind) * np.int64(len(goes)) + go]
            columns = np.arange(len(go))
            new = self.made[best >> np.uint32(5)]
            ids[at, columns] = new
            if size == 2:
                codes = np.empty((0, len(go)), np.uint32)
                continue
            behind = rows[:-2] >= at
            codes = codes.ravel()[(rows[:-2] + behind) * np.int64(len(goes)) + go] - behind
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < size - 2)
            codes[at[left] - 1, left] = self._codes(ids[at[left] - 1, left], new[left], at[left] - 1)
            codes[at[right], right] = self._codes(new[right], ids[at[right] + 1, right], at[right])
        return done

    def _distinct(self, data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each distinct word, and all their ids; parts: words for ``rest``."""
        lengths = np.diff(offsets)
        apart = np.flatnonzero(parts | (lengths > LONGEST))
        given = [np.frombuffer(self.rest(data[offsets[w] : offsets[w + 1]].tobytes()), "<u4") for w in apart]
        short = lengths.copy()
        short[apart] = 0
        done = self.merge(data, offsets[:-1], short)
        counts = np.zeros(len(lengths), np.int64)
        counts[apart] = [len(x) for x in given]
        for words, ids in done:
            counts[words] = len(ids)
        to = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.uint32)
        for w, ids in zip(apart, given, strict=True):
            flat[to[w] : to[w] + len(ids)] = ids
        for words, ids in done:
            for k, row in enumerate(ids):
                flat[to[words] + k] = row
        return counts, flat

    def _slice(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of texts that are taken at once."""
        data = np.frombuffer(bytearray(b" ".join(texts) + b" ").translate(_LOWER), np.uint8)
        kind = _CLASS[data]
        leads = np.flatnonzero(data == 0xC3)
        if len(leads):
            trail = data[leads + 1]
            fine = leads[(trail != 0x97) & (trail != 0xB7)]
            kind[fine] = kind[fine + 1] = LETTER
            data[leads[(trail < 0x9F) & (trail != 0x97)] + 1] += 32
        odd = np.flatnonzero(kind == OTHER)
        if len(odd):
            blanks = np.flatnonzero(kind == BLANK)
            k = np.unique(np.searchsorted(blanks, odd))
            mark = np.zeros(len(data), np.int8)
            mark[np.where(k > 0, blanks[k - 1] + 1, 0)] = 1
            mark[blanks[k]] -= 1
            kind[np.cumsum(mark, dtype=np.int8) > 0] = PART
        begins = kind != BLANK
        filled = np.flatnonzero(begins)
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        starts = np.flatnonzero(begins)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.searchsorted(starts, np.cumsum(sizes))
        if not len(starts):
            return [b""] * len(texts)
        data = data[filled]
        offsets = np.append(np.flatnonzero(begins[filled]), len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        at = words.indices.to_numpy()
        distinct = words.dictionary
        parts = np.zeros(len(distinct), bool)
        parts[at[kind[starts] == PART]] = True
        _, offsets, data = distinct.buffers()
        counts, flat = self._distinct(np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int32)[: len(distinct) + 1], parts)
        long = counts[at]
        upto = np.concatenate([[0], np.cumsum(long)])
        # an id of a word stands as far from the word's first one as in the list of distinct words
        found = flat[np.repeat((np.cumsum(counts) - counts)[at] - upto[:-1], long) + np.arange(upto[-1])].astype("<u4", copy=False)
        cuts = upto[ends].tolist()
        return [found[lo:hi].tobytes() for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True)]

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; long texts are cut at blanks."""
        found: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if waiting:
                for (k, _), ids in zip(waiting, self._slice([t for _, t in waiting]), strict=True):
                    found[k].append(ids)
            waiting.clear()
            held = 0

        for k, text in enumerate(texts):
            lo = 0
            while lo < len(text):
                hi = len(text)
                if hi - lo > SLICE:
                    hi = max(text.rfind(b" ", lo, lo + SLICE), text.rfind(b"\n", lo, lo + SLICE)) + 1
                    if not hi:  # a part longer than a slice stays whole
                        hi = min([x + 1 for x in (text.find(b" ", lo + SLICE), text.find(b"\n", lo + SLICE)) if x >= 0], default=len(text))
                waiting.append((k, text[lo:hi]))
                held += hi - lo
                lo = hi
                if held >= SLICE:
                    flush()
        flush()
        return [b"".join(x) for x in found]
