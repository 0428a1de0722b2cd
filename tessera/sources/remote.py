"""Headers of tensor files over HTTP range requests, with a file cache (inventory A17-A24)."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.safetensors import MOST_HEADER, SCHEMA, FormatError, parse_header


class RangeUnsupported(OSError):
    pass


def fetch(url: str, first: int, last: int, retries: int = 3, timeout: float = 30.0) -> tuple[bytes, int]:
    """Bytes ``first`` to ``last`` and the file's size; a server that sends the whole file is refused."""
    request = urllib.request.Request(url, headers={"Range": f"bytes={first}-{last}"})
    for attempt in range(retries):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                if answer.status != 206:
                    raise RangeUnsupported(f"{url}: status {answer.status}")
                total = answer.headers.get("Content-Range", "*/0").rpartition("/")[2]
                return answer.read(), int(total) if total.isdigit() else 0
        except RangeUnsupported:
            raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == retries - 1:
                raise
    raise OSError(url)


def supports_ranges(url: str) -> bool:
    try:
        fetch(url, 0, 0, retries=1)
    except OSError:
        return False
    return True


class Cache:
    """One JSON file for each address, named by its digest; replaced in one step."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _path(self, url: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(url.encode()).hexdigest() + ".json")

    def get(self, url: str) -> dict | None:
        try:
            with open(self._path(url)) as f:
                found = json.load(f)
        except (FileNotFoundError, ValueError):
            return None
        return found if found.get("url") == url else None

    def put(self, url: str, value: dict) -> None:
        os.makedirs(self.folder, exist_ok=True)
        aside = f"{self._path(url)}.{os.getpid()}"
        with open(aside, "w") as f:
            json.dump(value | {"url": url}, f)
        os.replace(aside, self._path(url))

    def drop(self, url: str) -> bool:
        try:
            os.remove(self._path(url))
        except FileNotFoundError:
            return False
        return True


def remote_header(url: str, cache: Cache | None = None, retries: int = 3) -> dict:
    """File size, header size and raw header of a remote file; two small requests."""
    if cache and (found := cache.get(url)):
        return found
    raw, size = fetch(url, 0, 7, retries)
    (length,) = struct.unpack("<Q", raw)
    if not 0 < length <= MOST_HEADER:
        raise FormatError(f"header of {length} bytes")
    text, _ = fetch(url, 8, 7 + length, retries)
    value = {"url": url, "file_size": size, "header_size": 8 + length, "header": text.decode("utf-8")}
    if cache:
        cache.put(url, value)
    return value


class UrlPart(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options["path"].split(",") if u]
        self.strict = options.get("mode") == "strict"
        self.cache = Cache(options["cache"]) if options.get("cache") else None
        self.retries = int(options.get("retries", 3))

    def partitions(self):
        return [UrlPart(u) for u in self.urls]

    def read(self, partition: UrlPart) -> Iterator[tuple]:
        h = remote_header(partition.url, self.cache, self.retries)
        for name, dtype, shape, begin, end in parse_header(h["header"].encode(), self.strict):
            yield partition.url, h["file_size"], h["header_size"], name, dtype, shape, begin, end


class RemoteSafetensors(DataSource):
    """``spark.read.format("safetensors_http").load("http://a,http://b")``; options cache, retries, mode."""

    @classmethod
    def name(cls) -> str:
        return "safetensors_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RemoteReader:
        return RemoteReader(self.options)
