"""Element types of tensors: names, sizes and kinds as column expressions (inventory C11-C19, A8, A13)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical name, bytes (None below one byte or without a storage form), bits, kind.
DTYPES: dict[str, tuple[int | None, int, str]] = {
    "F64": (8, 64, "float"),
    "F32": (4, 32, "float"),
    "F16": (2, 16, "float"),
    "BF16": (2, 16, "float"),
    "F8_E4M3": (1, 8, "float"),
    "F8_E5M2": (1, 8, "float"),
    "F8_E8M0": (None, 8, "float"),
    "F6_E2M3": (None, 6, "float"),
    "F6_E3M2": (None, 6, "float"),
    "F4": (None, 4, "float"),
    "I64": (8, 64, "signed"),
    "I32": (4, 32, "signed"),
    "I16": (2, 16, "signed"),
    "I8": (1, 8, "signed"),
    "U64": (8, 64, "unsigned"),
    "U32": (4, 32, "unsigned"),
    "U16": (2, 16, "unsigned"),
    "U8": (1, 8, "unsigned"),
    "BOOL": (1, 8, "bool"),
}
# Other spellings.
ALIASES = {
    "F8_E4M3FN": "F8_E4M3",
    "F8_E8M0FNU": "F8_E8M0",
    "F6E2M3": "F6_E2M3",
    "F6E3M2": "F6_E3M2",
    "FLOAT64": "F64",
    "FLOAT32": "F32",
    "FLOAT16": "F16",
    "BFLOAT16": "BF16",
    "INT64": "I64",
    "INT32": "I32",
    "INT16": "I16",
    "INT8": "I8",
    "UINT8": "U8",
}


def lookup(table: dict, key: Column) -> Column:
    """A literal map's value for ``key``, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def parse_dtype(name: Column) -> Column:
    """Canonical type name in any case and spelling (a leading ``torch.`` is dropped); null if unknown."""
    upper = F.upper(F.regexp_replace(name, "^torch\\.", ""))
    return lookup({k: k for k in DTYPES} | ALIASES, upper)


def size_bytes(dtype: Column) -> Column:
    return lookup({k: v[0] for k, v in DTYPES.items() if v[0]}, dtype)


def bits_per_element(dtype: Column) -> Column:
    return lookup({k: v[1] for k, v in DTYPES.items()}, dtype)


def kind(dtype: Column) -> Column:
    return lookup({k: v[2] for k, v in DTYPES.items()}, dtype)


def is_float(dtype: Column) -> Column:
    return kind(dtype) == "float"


def is_signed_int(dtype: Column) -> Column:
    return kind(dtype) == "signed"


def is_unsigned_int(dtype: Column) -> Column:
    return kind(dtype) == "unsigned"


def is_integer(dtype: Column) -> Column:
    return kind(dtype).isin("signed", "unsigned")


def is_supported_for_write(dtype: Column) -> Column:
    return size_bytes(dtype).isNotNull()


def safetensors_name(dtype: Column) -> Column:
    """The name in tensor files; null for types below one byte."""
    return F.when(bits_per_element(dtype) >= 8, dtype)


def num_elements(shape: Column) -> Column:
    """Product of the dimensions (1 for a scalar) as decimal, which no tensor overflows."""
    return F.aggregate(shape, F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x.cast("decimal(20,0)")).cast("decimal(38,0)"))


def byte_size(shape: Column, dtype: Column) -> Column:
    """Elements times bytes; null below one byte."""
    return (num_elements(shape) * size_bytes(dtype)).cast("decimal(38,0)")


def rank(shape: Column) -> Column:
    return F.size(shape)


def is_scalar(shape: Column) -> Column:
    return F.size(shape) == 0


def has_zero_dim(shape: Column) -> Column:
    return F.exists(shape, lambda x: x == 0)
