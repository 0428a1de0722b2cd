"""Operator 7: near-duplicate documents by MinHash with tensored banding, verified on full sets.

A document's set is its distinct shingles of ``words`` words.  Two collections
of ``m`` half-bands (``half`` minhashes each) are computed; table (i, j) has as
its key the i-th half-band of the first collection with the j-th of the second.
So m * m tables of 2 * half rows cost 2 * m * half minhashes.  Half-bands that
no other document shares are dropped before keys are formed.

Documents with equal sets are one class from the start; a class has a number
of its own, so ids may repeat.  Each bucket compares its members with its least
member (a star) on the full sets.  Buckets that
still hold more than one component go on: Jaccard distance is a metric, so two
members can be linked only if their distances to the centre differ by at most
1 - threshold; buckets are split into such rings, and what spans one component
is done.  Where the pairs across components are few for the bucket's size they
are all compared.  The members of the other buckets are compared block by
block, within connected clumps of them, by matrix products; as the sizes of
linked sets differ by a bounded ratio, a clump is cut into rings of near sizes
and only blocks of the same ring or of neighbouring ones meet.  No pair of a
bucket that could join two components is left out, and no bucket is capped.

Keys that many rows share (buckets, half-bands, centres) are dealt to many
tasks wherever rows are joined by them.

Defined results: null and empty texts and texts without words have an empty
set, are linked with nothing and are kept; fewer words than a shingle has make
one shingle of all; a null id gets no component and is kept; rows that repeat
an id with the same set get the same component, with another set that of the
set; an empty table gives no rows; extra columns are ignored.  ``one_of_each``
keeps one row of each group also where ids or whole rows repeat or are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.components import components, forest
from tessera.llm.runtime import bound_batches, delete, join_dealt, materialise
from tessera.llm.textkit import WordHasher, chunks, distinct_sets, mix, seeds, shingles, string_buffers

BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # documents of a block, and shingles in them
COLUMNS = 4096  # shingles of one matrix product
PARTNERS = 2  # a bucket is compared directly if its members have at most so many partners each, on average


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80  # least similarity
    half: int = 3
    m: int = 10


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of consecutive row ranges, with offsets."""
    hasher = WordHasher()
    data, offsets = string_buffers(column)
    for lo, hi in chunks(offsets):
        w, _, _, first = hasher.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield distinct_sets(*shingles(w, first, words))


def half_bands(sets: np.ndarray, at: np.ndarray, p: Params) -> np.ndarray:
    """Half-band hashes, one row a non-empty set, 2 * m columns."""
    full = at[:-1][at[1:] > at[:-1]]
    a, b = seeds(2 * p.m * p.half, 1), seeds(2 * p.m * p.half, 2) | np.uint64(1)
    out = np.zeros((len(full), 2 * p.m), dtype=np.uint64)
    if len(full):
        for k in range(2 * p.m * p.half):
            x = (sets ^ a[k]) * b[k]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, k // p.half] = mix(out[:, k // p.half] * np.uint64(31) + np.minimum.reduceat(x, full))
    return out


def row_key() -> Column:
    """With the id it stands for a row's id and text."""
    return F.xxhash64("doc_id", "text")


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, key, n (set size), s1, s2 (hash of the whole set), h (half-bands; null for an empty set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for sets, at in shingle_sets(batch.column(2), p.words):
                n = np.diff(at)
                bands = half_bands(sets, at, p)
                sums = []
                for salt in (101, 202):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(salt)), dtype=np.uint64)])
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * p.m, 0))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
                own = batch.slice(done, len(n))
                done += len(n)
                yield pa.RecordBatch.from_arrays([*own.columns[:2], pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "key", "n", "s1", "s2", "h"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", row_key().alias("key"), "text")
    return source.mapInArrow(run, "doc_id long, key long, n long, s1 long, s2 long, h array<long>")


def full_sets(chosen: DataFrame, p: Params) -> DataFrame:
    """cid, n, s: the sets of some texts (cid, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for sets, at in shingle_sets(batch.column(1), p.words):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sets.view(np.int64)))
                ids = batch.column(0).slice(done, len(at) - 1)
                done += len(at) - 1
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at), pa.int64()), lists], ["cid", "n", "s"])

    return chosen.select("cid", "text").mapInArrow(run, "cid long, n long, s array<long>")


def bucket_members(classes: DataFrame, p: Params) -> DataFrame:
    """key, cid of all buckets with more than one member."""
    half = classes.select("cid", F.posexplode("h").alias("i", "x")).select("cid", "i", F.xxhash64("i", "x").alias("x"))
    busy = half.groupBy("x").agg(F.count("*").alias("c")).filter("c > 1").select("x")
    own = half.join(busy, "x", "left_semi").groupBy("cid").agg(F.collect_set(F.struct("i", "x")).alias("h"))
    first, second = (F.filter("h", lambda y: (y["i"] < p.m) if side == 0 else (y["i"] >= p.m)) for side in (0, 1))
    keys = own.withColumn("first", first).withColumn("second", second).select(
        "cid", F.explode(F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a["x"], b["x"]))))).alias("key")
    )
    many = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    return keys.join(many, "key", "left_semi")


def verify(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """a, b, dist (Jaccard distance), link, from the full sets; ``a`` may stand in many pairs."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n_rows"))
    one = join_dealt(pairs, sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), ["a"], counts, pairs.count())
    two = one.join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    counted = two.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u"))
    return counted.select("a", "b", (1 - F.col("i") / F.col("u")).alias("dist"), (F.col("i") * 100 >= F.col("u") * p.percent).alias("link"))


def _with_component(members: DataFrame, found: DataFrame) -> DataFrame:
    joined = members.join(found.withColumnRenamed("node", "cid"), "cid", "left")
    return joined.withColumn("component", F.coalesce("component", "cid"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that span more than one component, with the bucket's least member (``centre``).

    ``direct``: the pairs across components are few for the bucket's size, so
    that comparing them all is in proportion to the members.  Then all members
    but those of the largest component (``main``) are a handful.
    """
    by_component = members.groupBy("key", "component").agg(F.count("*").alias("c"), F.min("cid").alias("least"))
    stats = by_component.groupBy("key").agg(
        F.min("least").alias("centre"), F.sum("c").alias("n_rows"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count("*").alias("parts"),
        F.max(F.struct("c", "component"))["component"].alias("main"),
    )
    direct = (F.col("n_rows") * F.col("n_rows") - F.col("same")) / 2 <= PARTNERS * F.col("n_rows")
    several = stats.filter("parts > 1").select("key", "centre", direct.alias("direct"), "main", "n_rows")
    return join_dealt(members, several.drop("n_rows"), ["key"], several, members.count())


def direct_pairs(opened: DataFrame) -> DataFrame:
    """a, b: the pairs across components of the buckets that are compared directly."""
    few = opened.filter("direct")
    minor = few.filter("component <> main").groupBy("key").agg(F.collect_list(F.struct("cid", "component")).alias("minor"))  # a handful a key
    counts = few.groupBy("key").agg(F.count("*").alias("n_rows"))
    met = join_dealt(few.select("key", "cid", "component"), minor, ["key"], counts, few.count()).select("cid", "component", F.explode("minor").alias("y"))
    across = met.filter(F.col("component") != F.col("y.component"))
    return across.select(F.least("cid", "y.cid").alias("a"), F.greatest("cid", "y.cid").alias("b")).distinct()


def compare_blocks(members: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """a, b: a spanning forest of all links within the clumps of (cid, clump).

    A clump is cut into rings by the logarithm of the set size, so that linked
    sets stand in the same ring or in neighbouring ones.  A ring's members are
    dealt to blocks of a bounded number of sets and of shingles; each pair of
    blocks that may have links is one task that counts common shingles by
    matrix products over a bounded number of shingles at a time.
    """
    width = math.log(100 / p.percent) * (1 + 1e-9) if p.percent < 100 else 1.0
    ringed = members.join(sets.select("cid", "n"), "cid").withColumn("r", F.floor(F.log("n") / width).cast("int"))
    need = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = ringed.groupBy("clump", "r").agg(need.alias("nb"), F.count("*").alias("n_rows"))
    by_ring = W.partitionBy("clump").orderBy("r")  # a clump has few rings

    def beside(step: int) -> Column:
        return F.when(F.lag("r", step).over(by_ring) == F.col("r") - step, F.lag("nb", step).over(by_ring)).otherwise(0)

    blocks = blocks.select("clump", "r", "nb", "n_rows", beside(1).alias("below"), beside(-1).alias("above"))
    own = join_dealt(ringed.drop("n"), blocks.drop("n_rows"), ["clump", "r"], blocks, members.count())
    own = own.withColumn("k", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    r, k = F.col("r"), F.col("k")

    def tasks(n: Column, make) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array())

    def pair(ra: Column, i: Column, rb: Column, j: Column) -> Column:
        return F.struct(ra.cast("int").alias("ra"), i.cast("int").alias("i"), rb.cast("int").alias("rb"), j.cast("int").alias("j"))

    every = F.concat(
        tasks(F.col("nb"), lambda j: pair(r, F.least(k, j), r, F.greatest(k, j))),
        tasks(F.col("above"), lambda j: pair(r, k, r + 1, j)),
        tasks(F.col("below"), lambda j: pair(r - 1, j, r, k)),
    )
    dealt = own.withColumn("t", F.explode(every)).select("cid", "clump", "r", "k", "t.ra", "t.i", "t.rb", "t.j").join(sets.select("cid", "s"), "cid")

    def run(key, table):
        table = table.combine_chunks()
        column = table.column("s").combine_chunks()
        ids = table.column("cid").to_numpy()
        side = (table.column("r").to_numpy() != key[1].as_py()) | (table.column("k").to_numpy() != key[2].as_py())
        n = np.diff(np.asarray(column.offsets))
        rows = np.repeat(np.arange(len(ids)), n)
        shared, at, count = np.unique(np.asarray(column.flatten()), return_inverse=True, return_counts=True)
        keep = count[at] > 1  # a shingle of one document alone is common to none
        rows, at = rows[keep], at[keep]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        first = np.cumsum(np.concatenate([[0], at[1:] != at[:-1]])) if len(at) else at
        a, b = (np.flatnonzero(~side), np.flatnonzero(side)) if side.any() else (np.arange(len(ids)),) * 2
        common = np.zeros((len(a), len(b)), dtype=np.float32)
        for lo in range(0, int(first[-1]) + 1 if len(first) else 0, COLUMNS):
            part = slice(np.searchsorted(first, lo), np.searchsorted(first, lo + COLUMNS))
            dense = np.zeros((len(ids), COLUMNS), dtype=np.float32)
            dense[rows[part], first[part] - lo] = 1
            common += dense[a] @ dense[b].T
        linked = 100 * common.astype(np.int64) >= p.percent * (n[a][:, None] + n[b][None] - common.astype(np.int64))
        linked &= ids[a][:, None] != ids[b][None]
        tree = np.array(forest(linked), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[a][tree[:, 0]], pa.int64()), "b": pa.array(ids[b][tree[:, 1]], pa.int64())})

    return dealt.groupBy("clump", "ra", "i", "rb", "j").applyInArrow(run, "a long, b long")


def link_classes(members: DataFrame, sets: DataFrame, p: Params) -> tuple[DataFrame, str]:
    """(node, component) of the classes that have links."""
    spark = members.sparkSession
    width = 1 - p.percent / 100
    centres = members.groupBy("key").agg(F.min("cid").alias("centre"), F.count("*").alias("n_rows"))
    starred = join_dealt(members, centres.drop("n_rows"), ["key"], centres, members.count())
    star, star_path = materialise(starred.filter(F.col("cid") != F.col("centre")), "stars")
    pairs, pairs_path = materialise(star.select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    checked, checked_path = materialise(verify(pairs, sets, p), "verified")
    found, found_path = components(checked.filter("link").select("a", "b"))
    # all pairs with a centre are settled; the others of a bucket can link only within a ring of distances or to the next
    to_centre = checked.select(F.col("a").alias("centre"), F.col("b").alias("cid"), F.floor(F.col("dist") / width).cast("int").alias("ring"))
    ringed = star.join(to_centre, ["centre", "cid"])
    parted = ringed.select("cid", "key", F.explode(F.array(F.col("ring") - 1, F.col("ring"))).alias("r")).select("cid", F.xxhash64("key", "r").alias("key"))
    parted, parted_path = materialise(_with_component(parted, found), "rings")
    opened, opened_path = materialise(_open(parted), "open")
    direct, direct_path = materialise(direct_pairs(opened).join(checked, ["a", "b"], "left_anti"), "direct")
    many = opened.filter("not direct and cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
    clumps, clumps_path = components(many)
    blocks = compare_blocks(clumps.select(F.col("node").alias("cid"), F.col("component").alias("clump")).unionAll(clumps.select("component", "component").distinct()), sets, p)
    links = checked.filter("link").select("a", "b").unionAll(verify(direct, sets, p).filter("link").select("a", "b")).unionAll(blocks)
    links, links_path = materialise(links, "links")
    delete(spark, found_path)
    found, found_path = components(links)
    delete(spark, star_path, pairs_path, checked_path, parted_path, opened_path, direct_path, clumps_path, links_path)
    return found, found_path


def resolve(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, key, n of every row, with component_id (least id) and the component's first row (first_id, first_key)."""
    spark = docs.sparkSession
    bound_batches(spark)
    signed, signed_path = materialise(signatures(docs, p), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    grouped = signed.filter("n > 0").groupBy("n", "s1", "s2").agg(first.alias("first"), F.first("h").alias("h"))
    classes, classes_path = materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members, members_path = materialise(bucket_members(classes, p), "buckets")
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("first.doc_id").alias("w_id"), F.col("first.key").alias("w_key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", row_key())
    chosen = texts.join(wanted, (F.col("key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    sets, sets_path = materialise(full_sets(chosen.select("cid", "text").dropDuplicates(["cid"]), p), "sets")
    found, found_path = link_classes(members, sets, p)
    delete(spark, members_path, sets_path)
    own = _with_component(classes.select("cid", "n", "s1", "s2", "first"), found)
    least = own.groupBy("component").agg(F.min("first").alias("lead"))
    named = own.join(least, "component").select("n", "s1", "s2", "lead")
    joined = signed.drop("h").join(named, ["n", "s1", "s2"], "left")
    done, _ = materialise(joined.select("doc_id", "key", "n", F.col("lead.doc_id").alias("component_id"), F.col("lead.doc_id").alias("first_id"), F.col("lead.key").alias("first_key")), "resolved")
    delete(spark, signed_path, classes_path, found_path)
    return done


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    done = resolve(docs, p)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def one_of_each(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row of each group of near copies, and every row without words, with all columns.

    The row that stays is that of the least id (null ids come last, repeated
    ids go by a hash); of rows that repeat it one stays.
    """
    names = docs.columns
    done = resolve(docs, p).filter("n > 0")
    first = (F.col("key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    verdicts = done.groupBy("doc_id", "key").agg(F.count("*").alias("copies"), F.bool_or(first).alias("stays"))
    verdicts = verdicts.filter("not stays or copies > 1").select(F.col("doc_id").alias("_v_id"), F.col("key").alias("_v_key"), F.col("stays").alias("_v_stays"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("_key"))
    same = (F.col("_key") == F.col("_v_key")) & F.col("_id").eqNullSafe(F.col("_v_id"))
    single = rows.join(verdicts, same, "left_anti")
    repeated = rows.join(verdicts.filter("_v_stays"), same, "left_semi").groupBy("_id", "_key").agg(F.first("_doc").alias("_doc"))
    return single.select("_doc").unionAll(repeated.select("_doc")).select(*[F.col("_doc").getField(c).alias(c) for c in names])
