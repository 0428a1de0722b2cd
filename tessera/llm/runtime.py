"""Shared scratch tables and small helpers of the llm operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (single-machine tests) a folder of this
    machine is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tessera-shared-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        root = _OWN[0]
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lets Spark hand Python at most ``most`` bytes at a time (it may be set lower already).

    Whole texts are long, and each task holds a batch on both sides of the
    pipe, in and out.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "67108864b").rstrip("b")) > most:
        spark.conf.set(key, str(most))


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete shared folders through Hadoop's file system API."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage; a lost executor only costs its running tasks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key with more than one in ``SALTS`` of all rows, and more than ``LEAST_HOT``, is dealt to several tasks.
SALTS, LEAST_HOT = 512, 100


def join_dealt(many: DataFrame, one: DataFrame, on: list[str], counts: DataFrame, total: int, size: str = "n_rows") -> DataFrame:
    """Inner join of ``many`` rows with a table that has one row a key, however hot a key is.

    ``counts`` gives the number (``size``) of the rows of each key, ``total``
    that of all rows.  The rows of a hot key are cut into parts by a hash, and
    its row of ``one`` goes to each part.  There are fewer than ``SALTS`` hot
    keys, so that their hashes can stand in the plan.
    """
    key, most = F.xxhash64(*on), max(total // SALTS, LEAST_HOT)
    tiers: dict[int, list[int]] = {}
    for r in counts.filter(F.col(size) > most).select(key.alias("k"), F.col(size).alias("n")).collect():
        tiers.setdefault(1 << (-(-r["n"] // most) - 1).bit_length(), []).append(r["k"])
    if not tiers:
        return many.join(one, on)
    parts = F.lit(1)
    for number, keys in sorted(tiers.items()):
        parts = F.when(key.isin(keys), number).otherwise(parts)
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*many.columns), parts).cast("int"))
    copied = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    # merged, as broadcasting the many rows would leave a hot key's joined rows in the task of its one row
    return dealt.hint("merge").join(copied, [*on, "_salt"]).drop("_salt")
