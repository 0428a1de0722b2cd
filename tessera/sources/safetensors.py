"""Tensor files: an eight-byte header length, a JSON header, a payload (inventory A1-A8, B1-B20).

``register`` adds two formats to a session: ``safetensors`` reads headers
(one row a tensor) and writes files; ``safetensors_values`` reads elements.
A read plans one task a file (elements: one a tensor's chunk) and touches only
the bytes it needs.  Paths are local or mounted; other stores go through
``headers_from_binary``, which runs on Spark's own ``binaryFile`` reader.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import re
import shutil
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.functions.dtypes import ALIASES, DTYPES

# Fixed values of the format.
MOST_HEADER = 8 << 20
SCHEMA = "path string, file_size long, header_size long, name string, dtype string, shape array<long>, begin long, end long"


class FormatError(ValueError):
    pass


def parse_header(raw: bytes, strict: bool) -> list[tuple[str, str, list[int], int, int]]:
    """Entries (name, dtype, shape, begin, end) in order of name.

    Entries that make no sense are skipped, or raise if ``strict``.
    """
    try:
        header = json.loads(raw.decode("utf-8"))
    except (UnicodeDecodeError, ValueError) as e:
        raise FormatError(f"the header is not JSON: {e}") from e
    if not isinstance(header, dict):
        raise FormatError("the header is not an object")
    out = []
    for name, entry in sorted(header.items()):
        if name == "__metadata__":
            continue
        try:
            dtype = entry["dtype"].upper()
            dtype = ALIASES.get(dtype, dtype)
            shape = [int(x) for x in entry["shape"]]
            begin, end = (int(x) for x in entry["data_offsets"])
            if dtype not in DTYPES or min([0, begin, end, *shape]) < 0:
                raise FormatError("bad value")
            if strict and (0 in shape or begin >= end):
                raise FormatError("empty tensor")
        except (KeyError, TypeError, ValueError, AttributeError) as e:
            if strict:
                raise FormatError(f"bad entry {name}: {e}") from e
            continue
        out.append((name, dtype, shape, begin, end))
    return out


def read_header(path: str, strict: bool = False) -> tuple[int, int, list[tuple[str, str, list[int], int, int]]]:
    """File size, header size with its length field, and entries; reads the header only."""
    size = os.path.getsize(path)
    if size < 8:
        raise FormatError("shorter than 8 bytes")
    with open(path, "rb") as f:
        (length,) = struct.unpack("<Q", f.read(8))
        if not 0 < length <= MOST_HEADER:
            raise FormatError(f"header of {length} bytes")
        raw = f.read(length)
    if len(raw) < length:
        raise FormatError("the header is cut off")
    return size, 8 + length, parse_header(raw, strict)


def offset_errors(entry: tuple[str, str, list[int], int, int], payload: int) -> list[str]:
    _, dtype, shape, begin, end = entry
    size, found = DTYPES[dtype][0], []
    if begin > end:
        found.append("begin after end")
    if end > payload:
        found.append("end after payload")
    if size and end - begin != math.prod(shape) * size:
        found.append("size does not fit shape and type")
    return found


def list_files(path: str) -> list[str]:
    """The tensor files of a folder (not below it), or the file itself."""
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".safetensors") and os.path.isfile(os.path.join(path, n)))
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]


@dataclass
class FilePart(InputPartition):
    path: str


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.strict = options["path"], options.get("mode", "permissive") == "strict"
        self.corrupt = options.get("corrupt", "fail")

    def partitions(self):
        return [FilePart(p) for p in list_files(self.path)]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        try:
            size, header, entries = read_header(partition.path, self.strict)
            for e in entries:
                if self.strict and (bad := offset_errors(e, size - header)):
                    raise FormatError(f"{e[0]}: {', '.join(bad)}")
        except FormatError as e:
            if self.corrupt == "skip":
                return
            raise FormatError(f"{partition.path}: {e}") from e
        for name, dtype, shape, begin, end in entries:
            yield partition.path, size, header, name, dtype, shape, begin, end


#: Bytes of a file that one task reads, about.
SLICE = 256 << 20


@dataclass
class SlicePart(InputPartition):
    path: str
    part: int
    parts: int


class ValueReader(DataSourceReader):
    """path, name, idx, val; a tensor is read in chunks of ``chunk`` elements.

    The driver only asks for file sizes: a file is dealt to tasks by its size,
    and each task reads the header itself and takes its share of the chunks.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.chunk, self.only = options["path"], int(options.get("chunk", 1 << 20)), options.get("name")
        self.slice = int(options.get("slice", SLICE))

    def partitions(self):
        sized = [(path, max(1, -(-os.path.getsize(path) // self.slice))) for path in list_files(self.path)]
        return [SlicePart(path, k, n) for path, n in sized for k in range(n)]

    def read(self, partition: SlicePart):
        import numpy as np
        import pyarrow as pa

        from tessera.operators.numeric import decode

        _, header, entries = read_header(partition.path)
        number = 0
        with open(partition.path, "rb") as f:
            for name, dtype, shape, begin, _ in entries:
                size, total = DTYPES[dtype][0], math.prod(shape)
                if (self.only is not None and name != self.only) or not (size or dtype == "F8_E8M0"):
                    continue
                for first in range(0, total, self.chunk):
                    number += 1
                    if number % partition.parts != partition.part:
                        continue
                    f.seek(header + begin + first * (size or 1))
                    values = decode(f.read(min(self.chunk, total - first) * (size or 1)), dtype)
                    for lo in range(0, len(values), 1 << 16):
                        v = values[lo : lo + (1 << 16)]
                        n = len(v)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([partition.path] * n), pa.array([name] * n), pa.array(first + lo + np.arange(n)), pa.array(v, pa.float64())], ["path", "name", "idx", "val"]
                        )


def header_bytes(tensors: list[tuple[str, str, list[int], int]]) -> bytes:
    """Length field and header of (name, dtype, shape, payload bytes) in order of place, padded with blanks to eight bytes."""
    header, at = {}, 0
    for name, dtype, shape, size in tensors:
        if name in header:
            raise FormatError(f"repeated name {name}")
        each = DTYPES[dtype][0]
        if each and size != math.prod(shape) * each:
            raise FormatError(f"{name}: {size} bytes do not fit its shape")
        header[name] = {"dtype": dtype, "shape": list(shape), "data_offsets": [at, at + size]}
        at += size
    text = json.dumps(dict(sorted(header.items())), separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    if len(text) > MOST_HEADER:
        raise FormatError(f"header of {len(text)} bytes")
    return struct.pack("<Q", len(text)) + text


def entry_bytes(name: Column, dtype: Column, shape: Column, most_offset: Column) -> Column:
    """How many bytes a tensor takes of a header at most, with offsets up to ``most_offset``; a header has up to eight more."""
    plain = F.length(F.regexp_replace(name, r"[^ !#-\[\]-~]", ""))  # others are escaped, each half of UTF-16 with six characters at most
    lists = F.octet_length(F.array_join(shape.cast("array<string>"), ",")) + 2 * F.length(most_offset.cast("string"))
    return F.octet_length(F.encode(name, "UTF-16BE")) * 3 - plain * 5 + F.octet_length(dtype) + lists + len('"":{"dtype":"","shape":[],"data_offsets":[,]},')


def file_bytes(tensors: list[tuple[str, str, list[int], bytes]]) -> bytes:
    """A whole tensor file; the header comes first."""
    return header_bytes([(n, t, s, len(raw)) for n, t, s, raw in tensors]) + b"".join(raw for *_, raw in tensors)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    tensors: int
    size: int


def _names(path: str) -> Iterator[str]:
    """Lines of a file of names, a block at a time; the file is open only meanwhile."""
    at = 0
    while True:
        with open(path, "rb") as f:
            f.seek(at)
            block = f.readlines(1 << 16)
        if not block:
            return
        at += sum(map(len, block))
        yield from map(json.loads, block)


class FileWriter(DataSourceWriter):
    """Rows (name, dtype, shape, payload): each task writes one shard, and the commit names and indexes them.

    A tensor may come in several rows one after the other; no more than a row
    is held in memory.  Names reach the commit in sorted files beside the
    shards, and it holds no more than a block of each.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        temporary = os.path.join(self.path, f".part-{context.partitionId()}-{context.taskAttemptId()}")
        tensors: list[list] = []
        with open(temporary + ".body", "wb") as body:
            for r in iterator:
                raw = bytes(r["payload"])
                if tensors and tensors[-1][0] == r["name"]:
                    tensors[-1][3] += len(raw)
                else:
                    tensors.append([r["name"], r["dtype"], list(r["shape"]), len(raw)])
                body.write(raw)
        if tensors:
            with open(temporary, "wb") as f, open(temporary + ".body", "rb") as body:
                f.write(header_bytes([tuple(t) for t in tensors]))
                shutil.copyfileobj(body, f, 1 << 20)
            with open(temporary + ".names", "w") as f:
                f.writelines(json.dumps(t[0]) + "\n" for t in sorted(tensors))
        os.remove(temporary + ".body")
        return Written(temporary, len(tensors), sum(t[3] for t in tensors))

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None and m.tensors]
        shards = [f"model-{i:05d}-of-{len(done):05d}.safetensors" for i in range(1, len(done) + 1)]
        aside = os.path.join(self.path, ".index")
        try:
            self._write_index(aside, done, shards)
        except FormatError:
            os.remove(aside)
            raise
        if self.overwrite:
            for old in list_files(self.path):
                os.remove(old)
        for m, shard in zip(done, shards):
            os.replace(m.temporary, os.path.join(self.path, shard))
            os.remove(m.temporary + ".names")
        os.replace(aside, os.path.join(self.path, "model.safetensors.index.json"))

    def _write_index(self, path: str, done: list[Written], shards: list[str]) -> None:
        """Total size and the shard of each name, in order of name."""
        placed = heapq.merge(*[zip(_names(m.temporary + ".names"), repeat(shard)) for m, shard in zip(done, shards)])
        last = None
        with open(path, "w") as f:
            f.write('{\n  "metadata": {\n    "total_size": %d\n  },\n  "weight_map": {' % sum(m.size for m in done))
            for name, shard in placed:
                if name == last:
                    raise FormatError("a name is in two shards")
                f.write(f"{',' if last is not None else ''}\n    {json.dumps(name)}: {json.dumps(shard)}")
                last = name
            f.write("\n  }\n}" if last is not None else "}\n}")

    def abort(self, messages) -> None:
        for path in [m.temporary + end for m in messages if m is not None for end in ("", ".names")]:
            if os.path.exists(path):
                os.remove(path)


class Safetensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


class SafetensorsValues(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors_values"

    def schema(self) -> str:
        return "path string, name string, idx long, val double"

    def reader(self, schema) -> ValueReader:
        return ValueReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Safetensors)
    spark.dataSource.register(SafetensorsValues)


def headers_from_binary(spark: SparkSession, path: str) -> DataFrame:
    """Headers of files in any store that Spark reads, by SQL functions alone; columns as for the format.

    Spark reads these files whole, so this suits shards of moderate size.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").load(path)
    turned = F.concat(*[F.hex(F.substring("content", i, 1)) for i in range(8, 0, -1)])
    length = F.conv(turned, 16, 10).cast("bigint")
    sized = raw.select("path", F.col("length").alias("file_size"), length.alias("n"), "content").filter((F.col("n") > 0) & (F.col("n") <= MOST_HEADER))
    text = F.decode(F.col("content").substr(F.lit(9), F.col("n").cast("int")), "UTF-8")
    entry = "map<string,struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>>"
    parsed = sized.select("path", "file_size", (F.col("n") + 8).alias("header_size"), F.explode(F.from_json(text, entry)).alias("name", "e"))
    good = parsed.filter((F.col("name") != "__metadata__") & F.col("e.dtype").isNotNull() & (F.size("e.data_offsets") == 2))
    return good.select("path", "file_size", "header_size", "name", F.col("e.dtype").alias("dtype"), F.col("e.shape").alias("shape"), F.col("e.data_offsets")[0].alias("begin"), F.col("e.data_offsets")[1].alias("end"))


def natural_key(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]
