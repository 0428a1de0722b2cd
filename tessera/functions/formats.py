"""Sizes, numbers, durations, hashes, seeds and guards (inventory C24-C230, B9-B13, B33-B37)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.dtypes import lookup

UNSIGNED = "18446744073709551616"


def _units(n: Column, steps: list[tuple[int, str]], small: str) -> Column:
    x = n.cast("double")
    out = None
    for size, unit in steps:
        text = F.format_string(f"%.2f {unit}", x / size)
        out = F.when(n >= size, text) if out is None else out.when(n >= size, text)
    return out.otherwise(F.concat(n.cast("string"), F.lit(small)))


def format_size(n: Column) -> Column:
    """Decimal units with two digits."""
    return _units(n, [(10**12, "TB"), (10**9, "GB"), (10**6, "MB"), (10**3, "KB")], " B")


def format_bytes(n: Column) -> Column:
    """Binary units with two digits."""
    return _units(n, [(1 << 40, "TiB"), (1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")], " o")


def format_number(n: Column) -> Column:
    return F.regexp_replace(F.format_number(n, 0), ",", "_")


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    hours, minutes, rest = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string")
    return (
        F.when(s < 60, F.concat(rest, F.lit("s")))
        .when(s < 3600, F.concat(minutes, F.lit("m "), rest, F.lit("s")))
        .otherwise(F.concat(hours, F.lit("h "), minutes, F.lit("m "), rest, F.lit("s")))
    )


def parse_size(text: Column) -> Column:
    """Bytes of a number with a decimal suffix; null if malformed or zero.  The first of t, g, m, k that occurs anywhere counts."""
    s = F.lower(F.trim(text))
    value = F.lit(None).cast("double")
    scale = F.lit(1.0)
    chain = None
    for mark, factor in (("t", 1e12), ("g", 1e9), ("m", 1e6), ("k", 1e3)):
        number = F.substring_index(s, mark, 1).try_cast("double") * factor
        chain = F.when(s.contains(mark), number) if chain is None else chain.when(s.contains(mark), number)
    value = chain.otherwise(s.try_cast("double") * scale)
    whole = F.floor(value)
    return F.when(whole > 0, whole.cast("bigint"))


def parse_mode(text: Column) -> Column:
    return lookup({m.lower(): m for m in ("Safe", "Realistic", "Compression", "Stress")}, F.lower(text))


def parse_codec(text: Column) -> Column:
    names = {"none": "none", "no": "none", "off": "none", "lz4": "lz4", "zstd": "zstd", "zstandard": "zstd", "gzip": "gzip", "gz": "gzip"}
    return lookup(names, F.lower(text))


def compression_ratio(original: Column, compressed: Column) -> Column:
    return F.coalesce(F.try_divide(compressed.cast("double"), original.cast("double")), F.lit(0.0))


def reduction_percent(original: Column, compressed: Column) -> Column:
    return (1 - compression_ratio(original, compressed)) * 100


def throughput_mib(size: Column, seconds: Column) -> Column:
    return F.coalesce(F.try_divide(size / F.lit(1048576.0), seconds), F.lit(0.0))


def shard_name(index: Column, total: Column) -> Column:
    return F.format_string("model-%05d-of-%05d.safetensors", index, total)


def padded_header_size(length: Column) -> Column:
    return F.floor((length + 7) / 8).cast("bigint") * 8


def pad_header(json: Column) -> Column:
    n = F.octet_length(json)
    return F.concat(json, F.repeat(F.lit(" "), (padded_header_size(n) - n).cast("int")))


def header_reserve(names: Column) -> Column:
    """Aggregate: room to keep for a header of these names."""
    return F.sum(F.octet_length(names) + 128) + 65536


def hash_short(digest: Column, algorithm: str = "sha256") -> Column:
    return F.concat(F.lit(algorithm + ":"), F.substring(digest, 1, 8))


def is_hash(text: Column) -> Column:
    return text.rlike("^sha256:[0-9a-fA-F]{64}$")


def is_timestamp(text: Column) -> Column:
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{3})?Z$")


def little_endian(n: Column, size: int) -> Column:
    """An unsigned number as ``size`` bytes, lowest first."""
    wide = F.lpad(F.hex(n.cast("bigint")), 2 * size, "0")
    last = F.substring(wide, -2 * size, 2 * size) if size < 8 else wide
    return F.unhex(F.concat(*[F.substring(last, 2 * i + 1, 2) for i in reversed(range(size))]))


def _framed(text: Column) -> Column:
    """A string's bytes after their number as eight bytes."""
    raw = text.cast("binary")
    return F.concat(little_endian(F.octet_length(raw), 8), raw)


def derive_seed(seed: Column, model: Column, tensor: Column, layer: Column, version: Column) -> Column:
    """Hex digest that names a tensor's random stream; a null layer counts as 0xFFFFFFFF."""
    number = F.coalesce(layer.cast("bigint"), F.lit(0xFFFFFFFF).cast("bigint"))
    return F.sha2(F.concat(little_endian(seed, 8), _framed(model), _framed(tensor), little_endian(number, 4), _framed(version)), 256)


def derive_secondary_seed(seed_hex: Column, domain: Column, index: Column) -> Column:
    return F.sha2(F.concat(F.unhex(seed_hex), _framed(domain), little_endian(index, 4)), 256)


def seed_number(seed_hex: Column) -> Column:
    """First eight bytes, lowest first, as an unsigned number."""
    turned = F.concat(*[F.substring(seed_hex, 2 * i + 1, 2) for i in reversed(range(8))])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def traceability_hash(generation: Column, seed: Column, mode: Column, timestamp: Column, *hashes: Column) -> Column:
    """Digest of a run's identity; null input hashes are left out."""
    more = [F.coalesce(h.cast("binary"), F.lit(b"")) for h in hashes]
    parts = [generation.cast("binary"), little_endian(seed, 8), mode.cast("binary"), timestamp.cast("binary"), *more]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*parts), 256))


def strictly_positive(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x > 0) & (x < float("inf")), F.lit(False))


def divided(size: Column, parts: Column) -> Column:
    """Exact quotient, null where ``parts`` does not divide ``size``."""
    return F.when((parts > 0) & (F.try_mod(size, parts) == 0), F.floor(F.try_divide(size, parts)).cast("bigint"))


def offsets_fit(begin: Column, end: Column, expected: Column, allow_empty: bool = False) -> Column:
    ordered = begin <= end if allow_empty else begin < end
    return ordered & (end - begin == expected)


def relative_error(observed: Column, target: Column) -> Column:
    return F.abs(observed - target) / F.greatest(F.abs(target), F.lit(1e-10))


def outlier_magnitude(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std < 1e-10, 0.0).otherwise(F.try_divide(F.abs(x - mean), std))


def normalized_depth(layer: Column, layers: Column) -> Column:
    return F.when(layers == 1, 0.5).otherwise(F.try_divide(layer.cast("double"), layers - 1))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


# The least and the largest tensor of the middle class, and the chunk of larger ones, in bytes.
LEAST_CHUNK, MIDDLE_TENSOR, LARGE_CHUNK = 1 << 20, 32 << 20, 8 << 20


def adaptive_chunk(size: Column) -> Column:
    """Bytes that a tensor of this size is written in at a time."""
    return F.when(size < LEAST_CHUNK, size).when(size <= MIDDLE_TENSOR, LEAST_CHUNK).otherwise(LARGE_CHUNK)


# What the exit codes 0 to 6 mean.
EXIT_CODES = ["Succès", "Erreur générale", "Argument invalide", "Modèle invalide", "Erreur d'entrée/sortie", "Validation échouée", "Comparaison incompatible"]


def exit_description(code: Column) -> Column:
    """Short description of an exit code."""
    known = F.get(F.array(*map(F.lit, EXIT_CODES)), code.cast("int"))
    return F.coalesce(known, F.lit("Code inconnu"))
