"""Row-wise numeric shapes of model code (inventory R1-R6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from tessera.operators.generate import counter_uniform


def gate(scores: DataFrame, k: int, scale: float = 1.0, item: str = "id", expert: str = "expert", score: str = "score") -> DataFrame:
    """The ``k`` best experts of each item (ties by number) with weights that add up to ``scale``."""
    rank = F.row_number().over(W.partitionBy(item).orderBy(F.desc(score), expert))
    best = scores.withColumn("rank", rank).filter(F.col("rank") <= k)
    total = F.sum(score).over(W.partitionBy(item))
    return best.select(item, expert, "rank", (scale * F.try_divide(F.col(score), total)).alias("weight"))


def sample(logits: DataFrame, seed: int, temperature: float = 1.0, item: str = "id", token: str = "token", logit: str = "logit") -> DataFrame:
    """One token for each item, by the largest logit plus Gumbel noise."""
    noise = -F.log(-F.log(counter_uniform(seed, item, token)))
    return logits.groupBy(item).agg(F.max_by(token, F.struct(F.col(logit) / max(temperature, 1e-5) + noise, F.col(token))).alias(token))


def block_quantise(df: DataFrame, value: str, index: str, block: int, most: float, *by: str, power_of_two: bool = False) -> DataFrame:
    """Scale of each block of consecutive indices (largest magnitude / ``most``) and the scaled, clipped value."""
    keyed = df.withColumn("block", F.floor(F.col(index) / block))
    top = F.greatest(F.max(F.abs(F.col(value))).over(W.partitionBy(*by, "block")), F.lit(1e-4))
    scale = top / most
    if power_of_two:
        scale = F.pow(F.lit(2.0), F.ceil(F.log2(scale)))
    scaled = keyed.withColumn("scale", scale)
    return scaled.withColumn("scaled", F.greatest(F.lit(-most), F.least(F.lit(most), F.col(value) / F.col("scale"))))


def nibble_values(code: Column) -> Column:
    """Value of a four-bit float (one sign, two exponent, one mantissa bit)."""
    magnitude, sign = code.bitwiseAND(F.lit(7)), F.when(code >= 8, -1.0).otherwise(1.0)
    exponent, mantissa = F.shiftright(magnitude, 1), magnitude.bitwiseAND(F.lit(1))
    return sign * F.when(exponent == 0, mantissa * 0.5).otherwise((1 + mantissa * 0.5) * F.pow(F.lit(2.0), exponent - 1))


def unpack_nibbles(byte: Column) -> Column:
    """The low and high half of a byte as values."""
    return F.array(nibble_values(byte.bitwiseAND(F.lit(15))), nibble_values(F.shiftright(byte, 4)))


def sinkhorn(matrix: DataFrame, rounds: int, *by: str) -> DataFrame:
    """Rows and columns of positive matrices (row, col, val) are scaled in turn to add up to one.

    Only a factor for each row and each column is carried from step to step;
    sums are aggregated before they meet the cells, so no row or column is
    gathered in one task.
    """

    def scaled(factors: DataFrame | None, side: str, df: DataFrame) -> DataFrame:
        if factors is None:
            return df
        keys = [*by, side]
        named = factors.select(*[F.col(c).alias(f"_{c}") for c in keys], "_factor")
        joined = df.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
        return joined.withColumn("val", F.col("val") * F.col("_factor")).select(*df.columns)

    row = col = None
    for _ in range(rounds):
        row = scaled(col, "col", matrix).groupBy(*by, "row").agg(F.try_divide(F.lit(1.0), F.sum("val")).alias("_factor"))
        col = scaled(row, "row", matrix).groupBy(*by, "col").agg(F.try_divide(F.lit(1.0), F.sum("val")).alias("_factor"))
    return scaled(col, "col", scaled(row, "row", matrix))


def _encode(x: np.ndarray, dtype: str) -> bytes:
    if dtype == "BF16":
        return (x.astype("<f4").view("<u4") >> 16).astype("<u2").tobytes()  # the low half is cut off
    kinds = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1"}
    kind = np.dtype(kinds[dtype])
    if kind.kind in "iu":
        limit = np.iinfo(kind)
        whole = np.trunc(np.nan_to_num(x))
        out = np.clip(whole, float(limit.min), float(limit.max))
        return np.where(whole >= float(limit.max), limit.max, out.astype(kind)).astype(kind).tobytes()
    return x.astype(kind).tobytes()


def _small_float(bits: np.ndarray, exponent: int, mantissa: int, bias: int, has_inf: bool) -> np.ndarray:
    """Values of small floats from their fields."""
    e, m = bits >> mantissa & ((1 << exponent) - 1), bits & ((1 << mantissa) - 1)
    sign = np.where(bits >> (exponent + mantissa) & 1, -1.0, 1.0)
    value = np.where(e == 0, m * 2.0 ** (1 - bias - mantissa), (1 + m / 2.0**mantissa) * 2.0 ** (e.astype(float) - bias))
    top = (1 << exponent) - 1
    if has_inf:
        value = np.where(e == top, np.where(m == 0, np.inf, np.nan), value)
    else:
        value = np.where((e == top) & (m == (1 << mantissa) - 1), np.nan, value)
    return sign * value


def decode(raw: bytes, dtype: str) -> np.ndarray:
    """Element values of a payload as doubles."""
    kinds = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "u1", "BOOL": "u1"}
    if dtype in kinds:
        return np.frombuffer(raw, kinds[dtype]).astype(float)
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4").astype(float)
    bits = np.frombuffer(raw, np.uint8).astype(int)
    if dtype == "F8_E4M3":
        return _small_float(bits, 4, 3, 7, False)
    if dtype == "F8_E5M2":
        return _small_float(bits, 5, 2, 15, True)
    if dtype == "F8_E8M0":
        return np.where(bits == 255, np.nan, 2.0 ** (bits - 127.0))
    raise ValueError(f"no codec for {dtype}")


@pandas_udf(BinaryType())
def encode_values(values: pd.Series, dtype: pd.Series) -> pd.Series:
    """Arrays of doubles as little-endian bytes of a type; whole numbers are cut and saturate."""
    return pd.Series([None if v is None else _encode(np.asarray(v, float), d) for v, d in zip(values, dtype)])
