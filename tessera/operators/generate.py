"""Seeded synthetic tensors (inventory K1-K27, L1-L20, N1-N12).

Two families.  *Stream* generators follow a sequential 128-bit shift-register
generator, seeded for each chunk from the tensor's seed, so chunks run in
parallel and a chunk that runs again gives the same values.  *Counter*
generators hash (seed, index) in column expressions: they run inside
generated code and any row can be made on its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.functions.distributions import Distribution, Normal

TOGETHER = 1 << 21  # values of the streams that advance together


class ShiftRegister:
    """Many independent streams at once, one for each seed of 32 bytes."""

    def __init__(self, seeds: list[bytes]) -> None:
        state = np.array([[int.from_bytes(s[:8], "little"), int.from_bytes(s[8:16], "little")] for s in seeds], dtype=np.uint64).reshape(-1, 2)
        state[(state == 0).all(axis=1)] = (1, 2)
        self.a, self.b = state[:, 0].copy(), state[:, 1].copy()

    def next_u64(self) -> np.ndarray:
        a, b = self.a, self.b
        out = a + b
        mixed = a ^ b ^ (b << np.uint64(16)) ^ (a >> np.uint64(24))
        self.a = (b << np.uint64(24)) | (b >> np.uint64(40))
        self.b = (mixed << np.uint64(37)) | (mixed >> np.uint64(27))
        return out

    def next_f64(self) -> np.ndarray:
        """Uniform numbers in [0, 1) with 53 bits."""
        return (self.next_u64() >> np.uint64(11)).astype(np.float64) / float(1 << 53)

    def uniforms(self, n: int) -> np.ndarray:
        """``n`` numbers of each stream, one row a stream."""
        drawn = np.empty((n, len(self.a)), dtype=np.uint64)
        for i in range(n):
            drawn[i] = self.next_u64()
        return (drawn >> np.uint64(11)).T.astype(np.float64) / float(1 << 53)

    def normals(self, n: int) -> np.ndarray:
        """Box-Muller, one number from two uniforms."""
        u = np.maximum(self.uniforms(2 * n), 2.0**-53)
        return np.sqrt(-2 * np.log(u[:, 0::2])) * np.cos(2 * np.pi * u[:, 1::2])


def chunk_table(tensors: DataFrame, chunk: int, model: str, version: str, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """name, layer, chunk_id, start, n, seed (hex) and the columns ``keep`` for each chunk of tensors (name, layer, elements); without elements one empty chunk."""
    number = F.greatest(F.ceil(F.col("elements") / chunk), F.lit(1)).cast("bigint")
    tensor_seed = formats.derive_seed(F.lit(seed), F.lit(model), F.col("name"), F.col("layer"), F.lit(version))
    split = tensors.withColumn("_seed", tensor_seed).withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("bigint"), number - 1)))
    start = F.col("chunk_id") * chunk
    return split.select(
        "name", "layer", "chunk_id", start.alias("start"), F.least(F.lit(chunk), F.col("elements") - start).cast("bigint").alias("n"),
        formats.derive_secondary_seed(F.col("_seed"), F.lit("chunk"), F.col("chunk_id")).alias("seed"), *keep,
    )


def _side_by_side(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of streams that advance together: of near lengths, and at most ``TOGETHER`` values unless 16 have more."""
    order = np.argsort(-lengths, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + max(16, TOGETHER // max(int(lengths[order[lo]]), 1))
        yield order[lo:hi]
        lo = hi


def stream_arrays(chunks: DataFrame, kind: str = "normal", p1: float = 0.0, p2: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """name, chunk_id, start, vals (one array a chunk) and the columns ``keep``; ``kind`` is normal (mean, std) or uniform (low, high).

    A step of the generator is a handful of array operations over all streams
    that advance together, so its cost is shared by thousands of short chunks.
    """

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            for rows in _side_by_side(lengths):
                own, n = batch.take(pa.array(rows)), lengths[rows]
                most = int(n.max(initial=0))
                streams = ShiftRegister([bytes.fromhex(s) for s in own.column(4).to_pylist()])
                x = p1 + p2 * streams.normals(most) if kind == "normal" else p1 + (p2 - p1) * streams.uniforms(most)
                flat = x[np.arange(most)[None] < n[:, None]]
                vals = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*own.columns[:3], vals, *own.columns[5:]], ["name", "chunk_id", "start", "vals", *keep])

    kept = "".join(f", `{k}` {chunks.schema[k].dataType.simpleString()}" for k in keep)
    return chunks.select("name", "chunk_id", "start", "n", "seed", *keep).mapInArrow(make, f"name string, chunk_id long, start long, vals array<double>{kept}")


def stream_values(chunks: DataFrame, kind: str = "normal", p1: float = 0.0, p2: float = 1.0, tasks: int | None = None) -> DataFrame:
    """name, chunk_id, idx, val of each chunk's elements.

    Chunks are descriptions of a few bytes that grow into values, so they are
    dealt to ``tasks`` tasks (by default the session's shuffle partitions)
    before the values are made, however few files they came from.
    """
    tasks = tasks or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrays = stream_arrays(chunks.repartition(tasks, "name", "chunk_id"), kind, p1, p2)
    rows = arrays.select("name", "chunk_id", "start", F.posexplode("vals").alias("i", "val"))
    return rows.select("name", "chunk_id", (F.col("start") + F.col("i")).alias("idx"), "val")


def xorshift_normals(seeds: DataFrame, count: int) -> DataFrame:
    """key, idx, val: ``count`` normals for each row (key, seed) by a 64-bit xorshift register and Box-Muller.

    All rows of a batch advance together.
    """

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, max(1, TOGETHER // max(count, 1))):
                part = batch.slice(lo, max(1, TOGETHER // max(count, 1)))
                state = part.column(1).to_numpy().view(np.uint64).copy()
                out = np.empty((part.num_rows, count))
                for i in range(count):
                    state ^= state << np.uint64(13)
                    state ^= state >> np.uint64(7)
                    state ^= state << np.uint64(17)
                    second = state + np.uint64(i * 6364136223846793005 % (1 << 64))
                    u, v = ((x & np.uint64(0xFFFFFFFF)).astype(np.float64) / 0xFFFFFFFF for x in (state, second))
                    out[:, i] = np.sqrt(-2 * np.log(np.maximum(u, 1e-10))) * np.cos(2 * np.pi * v)
                at = pa.array(np.arange(part.num_rows + 1) * count, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(out.reshape(-1)))], ["key", "vals"])

    source = seeds.select(F.col("key").cast("long"), F.col("seed").cast("long"))
    return source.mapInArrow(make, "key long, vals array<double>").select("key", F.posexplode("vals").alias("idx", "val"))


def counter_uniform(seed: int, *key: Column | str) -> Column:
    """A uniform number in (0, 1) that depends on the seed and key alone."""
    h = F.xxhash64(F.lit(seed), *key)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def counter_values(df: DataFrame, distribution: Distribution, seed: int, *key: str, column: str = "val") -> DataFrame:
    """Rows with one sample each, by inverting the distribution function."""
    return df.withColumn(column, distribution.quantile(counter_uniform(seed, *key)))


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """row, col, idx of a matrix in row-major order."""
    i = F.col("id")
    return spark.range(rows * cols).select(F.floor(i / cols).alias("row"), (i % cols).alias("col"), i.alias("idx"))


def low_rank(spark: SparkSession, rows: int, cols: int, rank: int, seed: int, alpha: float = 1.0) -> DataFrame:
    """alpha * U V' with independent normal factors."""
    from tessera.operators.linalg import product

    u = counter_values(grid(spark, rows, rank), Normal(), seed, "idx").select("row", "col", "val")
    v = counter_values(grid(spark, cols, rank), Normal(), seed + 1, "idx").select("row", "col", "val")
    return product(u, v, alpha)


def correlated_columns(spark: SparkSession, rows: int, cols: int, rho: float, std: float, seed: int) -> DataFrame:
    """Columns that share a factor: their correlation is rho squared."""
    z = Normal().quantile(counter_uniform(seed, "row"))
    noise = Normal().quantile(counter_uniform(seed + 1, "row", "col"))
    return grid(spark, rows, cols).withColumn("val", std * (rho * z + (1 - rho * rho) ** 0.5 * noise))


def correlated_draws(spark: SparkSession, factor: DataFrame, n: int, dimension: int, seed: int) -> DataFrame:
    """row, col, val: ``n`` draws of a normal vector, mixed by a lower factor (row, col, val) of its covariance."""
    from tessera.operators.linalg import product

    return product(counter_values(grid(spark, n, dimension), Normal(), seed, "idx").select("row", "col", "val"), factor)


def local_draws(spark: SparkSession, sizes: list[int], rhos: list[float], n: int, seed: int) -> DataFrame:
    """row, col, val: ``n`` draws whose columns are equicorrelated within blocks and independent across them."""
    from tessera.operators.linalg import cholesky, equicorrelation

    return correlated_draws(spark, cholesky(equicorrelation(spark, sizes, rhos)), n, sum(sizes), seed)


def block_values(spark: SparkSession, blocks: list[tuple[int, Distribution, list[float] | None]], seed: int) -> DataFrame:
    """idx, val: consecutive blocks of (size, distribution, correlations within it or None).

    Correlations are the upper triangle of the block's matrix, row by row.
    """
    from tessera.operators.linalg import cholesky, pairwise

    start, parts = 0, []
    for size, distribution, rhos in blocks:
        if size <= 0:
            raise ValueError("a block has at least one element")
        own = counter_values(spark.range(size).select((F.col("id") + start).alias("idx")), distribution, seed, "idx")
        if rhos:
            drawn = own.select(F.lit(0).cast("long").alias("row"), (F.col("idx") - start).alias("col"), "val")
            factor = cholesky(pairwise(spark, size, rhos)).select(F.col("row").alias("_r"), "col", F.col("val").alias("_w"))
            own = drawn.join(factor, "col").groupBy((F.col("_r") + start).alias("idx")).agg(F.sum(F.col("val") * F.col("_w")).alias("val"))
        parts.append(own.select("idx", "val"))
        start += size
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "idx long, val double")


# ---- transforms of (row, col, idx, val) or (idx, val) tables


def sparse_mask(kind: str, rows: int, cols: int, size: int = 0) -> Column:
    """Where a sparse structure has values."""
    r, c = F.col("row"), F.col("col")
    if kind == "rows":
        return r % 2 == 0
    if kind == "columns":
        return c % 2 == 0
    if kind == "diagonal_band":
        return F.abs(r - c) <= size
    if kind == "single_block":
        top, left = (rows - size) // 2, (cols - size) // 2
        return r.between(top, top + size - 1) & c.between(left, left + size - 1)
    if kind == "grid":
        return (F.floor(r / size) + F.floor(c / size)) % 2 == 0
    raise ValueError(f"unknown structure {kind}")


def apply_mask(df: DataFrame, mask: Column, column: str = "val") -> DataFrame:
    return df.withColumn(column, F.when(mask, F.col(column)).otherwise(0.0))


def bernoulli(seed: int, probability: float, *key: str) -> Column:
    """A mark on each row with this probability."""
    return counter_uniform(seed, *key) < probability


def super_weights(df: DataFrame, hit: Column, scale: float, column: str = "val") -> DataFrame:
    return df.withColumn(column, F.when(hit, F.col(column) * scale).otherwise(F.col(column)))


def clip_outliers(df: DataFrame, column: str, k: float, *by: str, how: str = "clip", compat: bool = False) -> DataFrame:
    """Treat values beyond ``k`` deviations: clip to the limit, replace by the mean, or set to zero."""
    x = F.col(column).cast("double")
    moments = df.groupBy(*by).agg(F.avg(x).alias("_mu"), F.stddev_pop(x).alias("_sd"))
    joined = df.join(moments, list(by)) if by else df.crossJoin(F.broadcast(moments))
    far = F.abs(x if compat else x - F.col("_mu")) > k * F.col("_sd")
    limits = F.greatest(F.least(x, F.col("_mu") + k * F.col("_sd")), F.col("_mu") - k * F.col("_sd"))
    new = {"clip": limits, "mean": F.col("_mu"), "zero": F.lit(0.0)}[how]
    return joined.withColumn(column, F.when(far, new).otherwise(x)).drop("_mu", "_sd")


def damp_rows(df: DataFrame, rank: int, factor: float = 0.1, column: str = "val") -> DataFrame:
    """Rows from ``rank`` on are scaled down."""
    return df.withColumn(column, F.when(F.col("row") >= rank, F.col(column) * factor).otherwise(F.col(column)))


def depth_factor(kind: str, intensity: float, depth: Column) -> Column:
    """Factor of a layer at a relative depth."""
    return {"uniform": F.lit(1.0) + 0 * depth, "increasing": 1 + intensity * depth, "decreasing": 1 + intensity * (1 - depth)}[kind]


def layer_policies(spark: SparkSession, layers: int, probability: float, scale: float, kind: str, intensity: float) -> DataFrame:
    """layer, depth, probability (at most 1) and scale of every layer."""
    depth = formats.normalized_depth(F.col("layer"), F.lit(layers))
    factor = depth_factor(kind, intensity, depth)
    return spark.range(layers).select(F.col("id").alias("layer")).select(
        "layer", depth.alias("depth"), F.least(F.lit(1.0), probability * factor).alias("probability"), (scale * factor).alias("scale")
    )


def budget(total: int, header: int, metadata: int, margin_percent: float) -> int:
    """Bytes left for values."""
    return max(0, total - header - metadata - int(total * margin_percent / 100))


# Bytes of a file's head and of one tensor's entry, and what metadata files take.
HEAD_BYTES, ENTRY_BYTES, METADATA_BYTES = 16, 88, 24 * 1024


def header_estimate(tensors: Column) -> Column:
    """Bytes that the headers of so many tensors are expected to take."""
    return HEAD_BYTES + ENTRY_BYTES * tensors


def budget_left(total: Column, header: Column, metadata: Column, margin: float = 0.02) -> Column:
    """Bytes left for values, 0 at least."""
    return F.greatest(F.lit(0).cast("bigint"), total - header - metadata - F.floor(total * F.lit(margin)))


def budget_kept(actual: Column, target: Column, tolerance: float) -> Column:
    """Whether a size is within a relative tolerance of its target; a target of 0 asks for nothing."""
    return F.when(target == 0, True).otherwise(F.abs(actual - target) / target <= tolerance)


def budget_suffices(mode: Column, actual: Column, required: Column) -> Column:
    """Only the full structure must fit; the constrained modes take what there is."""
    return (mode != "full_structural") | (actual >= required)


# ---- numeric forms of values


def round_robin_amplitudes(df: DataFrame, mask: Column, specs: DataFrame, index: str = "idx", column: str = "val", block: int = 1 << 16) -> DataFrame:
    """The k-th row that the mask marks, in order of a whole-numbered index, gets the amplitude ``ord`` = k: add or multiply.

    Marks are counted by blocks of the index, so a task orders one block only.
    """
    from pyspark.sql import Window as W

    from tessera.operators.ordered import with_offsets

    marked = df.withColumn("_hit", F.coalesce(mask, F.lit(False)).cast("int")).withColumn("_bucket", F.floor(F.col(index) / block))
    placed = with_offsets(marked, F.col("_hit"))
    number = F.sum("_hit").over(W.partitionBy("_bucket").orderBy(index).rowsBetween(W.unboundedPreceding, 0)) + F.col("_offset")
    numbered = placed.withColumn("_k", F.when(F.col("_hit") == 1, number - 1)).drop("_hit", "_bucket", "_offset", "n")
    joined = numbered.join(specs.select(F.col("ord").alias("_k"), "kind", "amount"), "_k", "left")
    new = F.when(F.col("kind") == "add", F.col(column) + F.col("amount")).when(F.col("kind") == "multiply", F.col(column) * (1 + F.col("amount"))).otherwise(F.col(column))
    return joined.withColumn(column, new).drop("_k", "kind", "amount")
