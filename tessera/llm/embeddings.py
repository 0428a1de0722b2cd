"""Operator 2: embedding near-dedup by spherical k-means cells and blocked cosine products.

Unit vectors of one label (and one length) are assigned to the cell of the
nearest of the label's k centroids and compared within cells.  A label of at
most ``cell_rows`` vectors is one cell.  A pair may lie in two cells; so that none is lost, a vector also visits each lower cell c' in which
a partner could lie.  With D = c' - c for its own centroid c and t the least
cosine, a partner y at cosine s >= t has y.D <= s x.D + sqrt(1 - s^2) |D'|,
D' being D without its part along x, and y lies in c' only if y.D >= 0; so c'
is visited if -x.D <= sqrt(1 - t^2) / t * |D'|.  This is exact whatever the
centroids are; they only decide how much is compared.  On clustered vectors few
cells are visited, on vectors without structure most are.

Equal vectors are one class from the start.  A cell's vectors are dealt to
blocks of bounded size and blocks are compared pair by pair with one matrix
product each, so a large cell is many tasks.  A task gives, for each class,
the number of its links, and a spanning forest of the links: no pairs.

Centroids are fitted on at most ``fit_floats`` / length vectors, chosen by
hash; there are at most ``most_cells`` of them for the ``most_labels`` largest
labels together, so what is sent is bounded.  Other labels are one cell each,
cut into blocks like any.

Defined results: vectors that are null, empty, zero or hold null or non-finite
numbers, and vectors without a label, are linked with nothing and are kept;
rows that repeat are vectors of their own, also where their ids repeat: each
has its own links, and ids that repeat across components do not join them; a
null id gets no component and is kept, and links with nothing; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components, forest
from tessera.llm.runtime import bound_batches, delete, materialise


@dataclass(frozen=True)
class Params:
    cosine: float = 0.93
    cell_rows: int = 8192
    block_rows: int = 4096
    most_cells: int = 4096
    most_labels: int = 256
    fit_floats: int = 1_280_000
    rounds: int = 8


def unit(column: pa.Array, size: int) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 5) -> np.ndarray:
    """``k`` unit centroids at most; empty cells are dropped."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[lo : lo + 4096] @ c.T, axis=1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        length = np.sqrt((total * total).sum(axis=1))
        c = total[length > 1e-12] / length[length > 1e-12, None]
    return c


def visits(x: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each vector; and (row, cell) of all visits to lower cells."""
    s = x @ c.T
    home = np.argmax(s, axis=1)
    gram = c @ c.T
    drop = s[np.arange(len(x)), home][:, None] - s  # -x.D
    length = np.maximum(gram[home, home][:, None] + np.diag(gram)[None] - 2 * gram[home], 0)
    across = np.sqrt(np.maximum(length - drop * drop, 0))
    go = drop <= math.sqrt(1 - cosine * cosine) / cosine * across + 1e-9
    go &= np.arange(len(c))[None] < home[:, None]
    row, cell = np.nonzero(go)
    return home, row, cell


def _classes(vectors: DataFrame) -> DataFrame:
    """Classes of equal usable vectors: cid, label, size, h1, h2, least (id), copies, embedding.

    The number of a class lasts from when the table is written.
    """
    value = F.col("embedding")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    usable = vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return (
        usable.groupBy("label", F.size(value).alias("size"), F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2"))
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first(value).alias("embedding"))
        .withColumn("cid", F.monotonically_increasing_id())
    )


def fit_cells(classes: DataFrame, p: Params) -> dict[tuple[int, int], np.ndarray]:
    """Centroids for the largest labels that have more vectors than a cell; by label and vector length."""
    counted = classes.groupBy("label", "size").agg(F.count("*").alias("n")).filter(F.col("n") > p.cell_rows)
    wanted = {(r["label"], r["size"]): r["n"] for r in counted.orderBy(F.desc("n"), "label", "size").limit(p.most_labels).collect()}
    if not wanted:
        return {}
    groups = counted.select("label", "size").orderBy(F.desc("n"), "label", "size").limit(p.most_labels)
    most = max(p.fit_floats // max(size for _, size in wanted), 2)
    some = classes.join(F.broadcast(groups), ["label", "size"]).orderBy(F.xxhash64("cid"), "cid").limit(most).select("label", "size", "embedding").toArrow()
    labels, sizes = some.column("label").to_numpy(), some.column("size").to_numpy()
    share = min(1.0, p.most_cells / sum(math.ceil(n / p.cell_rows) for n in wanted.values()))
    cells = {}
    for (label, size), n in wanted.items():
        own = np.flatnonzero((labels == label) & (sizes == size))
        k = min(int(math.ceil(n / p.cell_rows) * share), len(own) // 2)
        if k > 1:
            cells[label, size] = spherical_kmeans(unit(some.column("embedding").take(pa.array(own)), size), k, p.rounds)
    return cells


def place(classes: DataFrame, cells: dict[tuple[int, int], np.ndarray], p: Params) -> DataFrame:
    """Each class in its cell, and in the cells it visits."""
    shipped = classes.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for label, size in sorted(set(zip(labels.tolist(), sizes.tolist()))):
                own = batch.take(pa.array(np.flatnonzero((labels == label) & (sizes == size))))
                c = shipped.value.get((label, size))
                n = own.num_rows
                home, row, cell = visits(unit(own.column(4), size), c, p.cosine) if c is not None else (np.zeros(n, int), np.zeros(0, int), np.zeros(0, int))
                at = np.concatenate([np.arange(n), row])
                got = own.take(pa.array(at))
                more = [pa.array(np.concatenate([home, cell]), pa.int32()), pa.array(np.arange(len(at)) >= n)]
                yield pa.RecordBatch.from_arrays([*got.columns, *more], ["label", "size", "cid", "copies", "embedding", "cell", "visitor"])

    source = classes.select(F.col("label").cast("long"), F.col("size").cast("long"), "cid", "copies", F.col("embedding").cast("array<double>"))
    return source.mapInArrow(run, "label long, size long, cid long, copies long, embedding array<double>, cell int, visitor boolean")


def compare(placed: DataFrame, p: Params) -> DataFrame:
    """a, b, w: links of the forest (b given), and numbers of linked vectors (b null)."""
    cell = ["label", "size", "cell"]
    sizes = placed.groupBy(*cell).agg(F.count(F.when(~F.col("visitor"), 1)).alias("home"), F.count(F.when(F.col("visitor"), 1)).alias("guests"))
    blocks = placed.join(sizes, cell).withColumn("nh", F.ceil(F.col("home") / p.block_rows).cast("int")).withColumn("nv", F.ceil(F.col("guests") / p.block_rows).cast("int"))
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("visitor"), F.col("nv")).otherwise(F.col("nh"))).cast("int")
    blocks = blocks.filter("nh > 0").withColumn("block", own)

    def pairs(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array())

    def task(guest, i, j, left):
        return F.struct(F.lit(guest).alias("guest"), i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("left"))

    b = F.col("block")
    at_home = F.concat(
        pairs(F.col("nh"), lambda j: task(False, F.least(b, j), F.greatest(b, j), b <= j)),
        pairs(F.col("nv"), lambda i: task(True, i, b, F.lit(False))),
    )
    tasks = F.when(F.col("visitor"), pairs(F.col("nh"), lambda j: task(True, b, j, F.lit(True)))).otherwise(at_home)
    dealt = blocks.select(*cell, "cid", "copies", "embedding", F.explode(tasks).alias("t")).select(*cell, "cid", "copies", "embedding", "t.guest", "t.i", "t.j", "t.left")

    def run(key, table):
        guest, i, j = (k.as_py() for k in key[3:6])
        left = table.column("left").to_numpy(zero_copy_only=False)
        x = unit(table.column("embedding"), key[1].as_py())
        ids, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        same = not guest and i == j
        a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        linked = x[a] @ x[b].T >= p.cosine
        if same:
            np.fill_diagonal(linked, False)
        number = np.zeros(len(ids), dtype=np.int64)
        number[a] += linked @ copies[b]
        if not same:
            number[b] += linked.T @ copies[a]
        some = np.flatnonzero(number)
        tree = np.array(forest(linked), dtype=np.int64).reshape(-1, 2)
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[some], ids[a][tree[:, 0]]]), pa.int64()),
                "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[b][tree[:, 1]], pa.int64())]),
                "w": pa.array(np.concatenate([number[some], np.zeros(len(tree), np.int64)]), pa.int64()),
            }
        )

    return dealt.groupBy(*cell, "guest", "i", "j").applyInArrow(run, "a long, b long, w long")


def link_vectors(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    bound_batches(spark)
    classes, _ = materialise(_classes(vectors), "classes")
    placed, placed_path = materialise(place(classes.select("label", "size", "cid", "copies", "embedding"), fit_cells(classes, p), p), "placed")
    links, links_path = materialise(compare(placed, p), "links")
    delete(spark, placed_path)
    found, found_path = components(links.filter("b is not null").select("a", "b"))
    number = links.groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("w"))
    own = classes.drop("embedding").join(number, "cid", "left").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    links_of = (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("links")
    named, _ = materialise(own.join(least, "component").select("label", "size", "h1", "h2", "component_id", links_of), "named")
    delete(spark, links_path, found_path)
    value = F.col("embedding")
    keyed = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"), F.size(value).alias("size"), F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2"))
    joined = keyed.join(named, ["label", "size", "h1", "h2"], "left")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
