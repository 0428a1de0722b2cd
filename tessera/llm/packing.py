"""Operator 9: sum-of-squares online packing of token sequences.

Every document becomes its token ids followed by one end id.  Documents are
placed online, one by one, into windows of ``seq_len`` ids.  Full windows are
cut off first; the rest goes to the fill level that makes the sum of squared
counts of partially filled windows smallest.  The counts live in one array by
level.

There are two passes.  In the first, each Spark partition packs on its own and
nothing is shuffled.  What lies in windows that are still open at its end goes
to the second pass: the documents (or rests of them) of the open windows of as
many partitions as hold some ``second_ids`` ids meet in one task and are placed
by the same rule, the largest first.  Only what is still open then is strung
together and cut anew (``strung``): full windows, and at last sequences whose
lengths are powers of two, so nothing at all is padded.  A task leaves at most
some windows a level open, so the share that is strung falls as partitions
grow.  Open windows are bounded: when there are more than ``most_open``, the
first pass hands them on and the second strings them.

The first pass is written as a table in the shared folder.  A sequence id holds
the number of its task, and the second pass reads its rows in a fixed order, so
a task that runs again gives the same rows.

Defined results: a null or empty text is the end id alone.  A null document id
stays null.  Repeated rows are packed once each.  An empty table gives no rows.
Extra columns are ignored.  Special tokens of the tokenizer found in a text
are encoded as the tokenizer does.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import BatchBpe, shape_of
from tessera.llm.runtime import bound_batches, materialise

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, strung boolean"
SECOND = 1 << 62  # added to the sequence ids of the second pass
ROWS = 4096  # encoded at once
LONGEST = 64  # bytes of a part that the word cache keeps


class WordCache(dict):
    """Encodes texts with a tokenizer whose pre-tokens never span blanks.

    The ids of a blank-separated part do not depend on its neighbours, so each
    distinct part (UTF-8, A-Z as a-z, which this vocabulary does not tell
    apart) is encoded once and kept as little-endian 32-bit ids.  A comma or
    full stop after a letter is a pre-token of its own, so such a part is the
    ids without it and those of the sign.  Texts that might hold special tokens
    go to the tokenizer whole.  ``encode_all`` merges most words of many texts
    in arrays (``BatchBpe``), and only the other parts come here.  Plain words go to its merge model directly if
    that gives the same ids on some probe words.  Parts
    of at most ``LONGEST`` bytes are kept for two generations of ``most`` each:
    those not met for a whole generation go.
    """

    #: Words that normalising only puts into small letters: a-z and the letters U+00C0 to U+00FF.
    PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
    PROBES = ("the", "thingouion", "été", "Übergröße", "éeaux", "Ñandú", "ÿþð", "a", "é")

    def __init__(self, tokenizer, most: int = 400_000) -> None:
        super().__init__({b"": b""})
        self.tokenizer, self.most = tokenizer, most
        self.older: dict[bytes, bytes] = {}
        # byte-level models see a printable byte as itself and the others from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.shown_as = {b: chr(256 + i) for i, b in enumerate(hidden)} | {b: chr(b) for b in shown}
        self.model = tokenizer.model
        self.direct = all(self._word_ids(w.encode().lower()) == self._ids(w) for w in self.PROBES)
        shape = shape_of(tokenizer)
        self.arrays = None if shape is None else BatchBpe(shape, self.shown_as, self.__getitem__)

    def _word_ids(self, word: bytes) -> bytes:
        """Ids of a plain word straight from the merge model."""
        shown = word.decode() if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(self.shown_as)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, part: bytes) -> bytes:
        if (ids := self.older.get(part)) is not None:
            pass
        elif part[-1:] in (b",", b".") and part[-2:-1].isalpha():
            ids = self[part[:-1]] + self[part[-1:]]
        elif self.direct and self.PLAIN.fullmatch(part):
            ids = self._word_ids(part)
        else:
            ids = self._ids(part.decode())
        if len(part) <= LONGEST:
            self[part] = ids
        return ids

    def _make_room(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
            self[b""] = b""

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, distinct words merged in arrays where the tokenizer allows it."""
        if self.arrays is None:
            return list(map(self.encode, texts))
        self._make_room()
        found = self.arrays.encode([b"" if b"<|" in t else t for t in texts])
        return [self._ids(t.decode()) if b"<|" in t else ids for t, ids in zip(texts, found, strict=True)]

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:
            return self._ids(text.decode())
        self._make_room()
        return b"".join(map(self.__getitem__, text.lower().replace(b"\n", b" ").split(b" ")))


EMPTY = -(1 << 40)  # a level without windows, which no cost can choose
Piece = tuple[int | None, int, int, bytes]  # document, start, ids of the document, ids


class SumOfSquares:
    """Online packing; a window is a list of pieces."""

    def __init__(self, seq_len: int) -> None:
        self.seq_len = seq_len
        self.counts = np.zeros(seq_len + 1, dtype=np.int64)
        self.held = np.full(seq_len + 1, EMPTY)  # the counts, where there is a window
        self.windows: list[list[list[Piece]]] = [[] for _ in range(seq_len)]
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level whose window takes ``size`` ids; 0 opens a window."""
        counts, most = self.counts, self.seq_len - size  # the most a window may hold already
        # a level h up to here costs 2 * counts[h + size] + 1 - 2 * counts[h] + 1, always even; the others are odd
        best, cost = 0, 2 * int(counts[size]) + 1
        if most > 1:
            change = counts[self.seq_len - 1 : size : -1] - self.held[most - 1 : 0 : -1]
            fullest = int(change.argmin())  # a tie goes to the fuller window
            if 2 * int(change[fullest]) + 2 < cost:
                best, cost = most - 1 - fullest, 2 * int(change[fullest]) + 2
        # a window that gets full leaves the array
        return most if counts[most] and 1 - 2 * int(counts[most]) <= cost else best

    def _count(self, level: int, by: int) -> None:
        self.counts[level] += by
        self.held[level] = self.counts[level] or EMPTY

    def place(self, pieces: list[Piece], size: int) -> Iterator[list[Piece]]:
        """Place what belongs together; gives the window if it is full now."""
        level = self.level_for(size)
        if level:
            window = self.windows[level].pop()
            self._count(level, -1)
            self.open -= 1
            window += pieces
        else:
            window = pieces
        if level + size == self.seq_len:
            yield window
            return
        self.windows[level + size].append(window)
        self._count(level + size, 1)
        self.open += 1

    def add(self, doc: int | None, ids: bytes) -> Iterator[list[Piece]]:
        """Cut the full windows off a document and place the rest."""
        n, top = len(ids) // 4, self.seq_len
        start = 0
        while n - start >= top:
            yield [(doc, start, n, ids[4 * start : 4 * (start + top)])]
            start += top
        if n > start:
            yield from self.place([(doc, start, n, ids[4 * start :])], n - start)

    def take_open(self) -> list[list[Piece]]:
        """All open windows, the fullest first; none is left."""
        found = [w for level in reversed(self.windows) for w in level]
        self.counts[:], self.held[:] = 0, EMPTY
        self.windows = [[] for _ in range(self.seq_len)]
        self.open = 0
        return found


def string_out(windows: list[list[Piece]], seq_len: int) -> Iterator[list[Piece]]:
    """The windows' pieces one behind the other, cut into full windows and then into powers of two."""
    pieces = [p for w in windows for p in w]
    left = sum(len(p[3]) // 4 for p in pieces)
    window, room = [], 0
    for doc, start, total, ids in pieces:
        at, n = 0, len(ids) // 4
        while at < n:
            if not room:
                room = seq_len if left >= seq_len else 1 << (left.bit_length() - 1)
            take = min(room, n - at)
            window.append((doc, start + at, total, ids[4 * at : 4 * (at + take)]))
            at, room, left = at + take, room - take, left - take
            if not room:
                yield window
                window = []


def _worker_tokenizer(path: str | None) -> WordCache:
    """One cache for each Python worker and file, kept from task to task."""
    import tokenizers

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _CACHES:
        _CACHES[path] = WordCache(tokenizers.Tokenizer.from_file(path))
    return _CACHES[path]


#: Word caches of this Python worker, by tokenizer file.
_CACHES: dict[str, WordCache] = {}


class _Rows:
    """Windows as rows of pieces, with sequence ids counted from ``base``."""

    def __init__(self, base: int) -> None:
        self.base, self.count, self.rows = base, 0, []

    def add(self, window: list[Piece], strung: bool = False, still_open: bool = False) -> None:
        offset = 0
        for doc, start, total, ids in window:
            self.rows.append((doc, start, len(ids) // 4, total, self.base + self.count, offset, ids, strung, still_open))
            offset += len(ids) // 4
        self.count += 1

    def take(self) -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 6, pa.binary(), pa.bool_(), pa.bool_())
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "strung", "open"]
        got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in self.rows], t) for k, t in enumerate(kinds)], names)
        self.rows = []
        return got


def _first_pass(batches: Iterable[pa.RecordBatch], seq_len: int, end_id: int, path: str | None, most_open: int) -> Iterator[pa.RecordBatch]:
    cache, packer, out = _worker_tokenizer(path), SumOfSquares(seq_len), _Rows(TaskContext.get().partitionId() << 32)
    end = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        ids_of, texts = batch.column(0), batch.column(1)
        for lo in range(0, batch.num_rows, ROWS):
            part = texts.slice(lo, ROWS).fill_null("").cast(pa.large_binary()).to_pylist()
            for doc, found in zip(ids_of.slice(lo, ROWS).to_pylist(), cache.encode_all(part), strict=True):
                for window in packer.add(doc, found + end):
                    out.add(window)
                if packer.open > most_open:
                    for window in packer.take_open():
                        out.add(window, still_open=True)
            if len(out.rows) >= 1000:
                yield out.take()
    for window in packer.take_open():
        out.add(window, still_open=True)
        if len(out.rows) >= 1000:
            yield out.take()
    if out.rows:
        yield out.take()
    cache.older = {}  # an idle worker keeps one generation at most


def _second_pass(batches: Iterable[pa.RecordBatch], seq_len: int, most_open: int) -> Iterator[pa.RecordBatch]:
    """Pieces that the first pass left in open windows, placed one by one."""
    packer, out = SumOfSquares(seq_len), _Rows(SECOND + (TaskContext.get().partitionId() << 32))
    for batch in batches:
        for doc, start, size, total, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 6)), strict=True):
            for window in packer.place([(doc, start, total, ids)], size):
                out.add(window)
            if packer.open > most_open:
                for window in string_out(packer.take_open(), seq_len):
                    out.add(window, strung=True)
        if len(out.rows) >= 1000:
            yield out.take()
    for window in string_out(packer.take_open(), seq_len):
        out.add(window, strung=True)
        if len(out.rows) >= 1000:
            yield out.take()
    if out.rows:
        yield out.take()


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048, end_id: int = 1, tokenizer_path: str | None = None, most_open: int = 4096, second_ids: int = 16 << 20
) -> DataFrame:
    """Pack documents; one row for each piece, with its ids as little-endian 32-bit numbers.

    ``seq_len`` is a power of two.  ``tokenizer_path`` names a tokenizer file
    that every machine has; None takes the public 49k word BPE.  Its
    pre-tokenizer must drop blanks, as this one does.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = source.mapInArrow(lambda batches: _first_pass(batches, seq_len, end_id, tokenizer_path, most_open), PIECES + ", open boolean")
    done, _ = materialise(packed, "packed")
    task = F.shiftright("sequence_id", 32)
    last, ids = done.filter("open").agg(F.max(task), F.sum("length")).first()
    whole = done.filter("not open").drop("open")
    if last is None:
        return whole
    together = max(1, second_ids * (last + 1) // ids)
    left = done.filter("open").repartitionById(last // together + 1, F.floor(task / together).cast("int")).sortWithinPartitions(F.desc("length"), "sequence_id", "offset")
    again = left.mapInArrow(lambda batches: _second_pass(batches, seq_len, most_open), PIECES + ", open boolean")
    return whole.unionAll(again.drop("open"))


def strung_share(pieces: DataFrame) -> DataFrame:
    """One row: the share of ids that were strung together and cut, not placed."""
    return pieces.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("strung"), F.col("length"))), F.sum("length")), F.lit(0.0)).alias("share"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC-32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
