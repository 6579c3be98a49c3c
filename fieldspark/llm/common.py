"""What several operators share: the cluster's shared folder, null-safe keys, gapless ranks, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the word contracts define it.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path below the folder that all executors share.

    ``spark.checkpoint.dir`` is read from the session. Only where neither it nor a checkpoint folder is set and all of
    Spark runs in this process, as in tests, a temporary folder of this machine is taken, and set as the checkpoint
    folder. Elsewhere a missing setting is an error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def put(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, and its path."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives a lost executor."""
    return put(df, label)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of ``put`` that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offsets(counts: DataFrame, group: list[str], bucket: str, value: str, name: str, wide: int = 1024) -> DataFrame:
    """``group``, ``bucket`` and ``name``: the sum of ``value`` over the group's buckets before, 0 for the first.

    ``counts`` has one row for each bucket. Sums run within runs of ``wide`` buckets, and over these runs' totals, so
    that a task gets a ``wide``-th of a group's buckets.
    """
    def before(by: list[str], order: str, v: str):
        return F.coalesce(F.sum(v).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    rows = counts.select(*group, bucket, value).withColumn("_run", F.floor(F.col(bucket) / wide))
    runs = rows.groupBy(*group, "_run").agg(F.sum(value).alias("_sum")).withColumn("_base", before(group, "_run", "_sum")).drop("_sum")
    inner = rows.withColumn("_inner", before([*group, "_run"], bucket, value))
    return inner.join(runs, [*group, "_run"]).select(*group, bucket, (F.col("_base") + F.col("_inner")).alias(name))


def numbered(df: DataFrame, lo: Column, hi: Column, name: str, wide: int = 4096) -> DataFrame:
    """``df`` once for each whole number from ``lo`` to ``hi``, named ``name``; none where ``hi`` is less. Numbers come in
    runs of ``wide``, so that no row ever holds more of them, however many there are."""
    runs = df.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long")).where("_hi >= _lo")
    runs = runs.withColumn("_r", F.explode(F.sequence(F.floor(F.col("_lo") / wide), F.floor(F.col("_hi") / wide))))
    each = F.sequence(F.greatest("_lo", F.col("_r") * wide), F.least("_hi", F.col("_r") * wide + wide - 1))
    return runs.withColumn(name, F.explode(each)).drop("_lo", "_hi", "_r")


def gapless_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 0-based gapless rank within ``group``, buckets in order of ``bucket``, rows in ``order``.

    A group may hold any share of the rows: rows are ranked within (group, bucket) and shifted by the counts of the
    buckets before it, so that no task ever holds a whole group.
    """
    keys = [*group, bucket]
    before = offsets(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), group, bucket, "_n", "_before")
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn("_rn", inner).join(before, keys)
        .withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("long")).drop("_before", "_rn")
    )


def _stars(edges: DataFrame) -> bool:
    """Whether (a, b), with a > b, are stars: each a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    seen = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return not seen.where("low > 1 or (low > 0 and top > 0)").limit(1).count()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a, b): columns node, component.

    Alternating large-star and small-star rounds until all is stars, which edges may be from the start; only (node,
    neighbour) rows move and minima are combined before the shuffle. Minima are written before they are joined, so that
    a join has its own shuffle and Spark can split a node with very many neighbours. Tables of rounds before are
    deleted. Nulls and loops are ignored; an empty input has no rows.
    """
    spark = edges.sparkSession
    now, path = put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    for _ in range(rounds):
        if _stars(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, p = put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large, q = put(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct(), "large")
        # small star: to the smallest neighbour among the smaller ones, and to the node itself
        low, r = put(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before = path
        now, path = put(small.where("a > b").distinct(), "links")
        discard(spark, before, p, q, r)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine that has its package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def lean_worker() -> None:
    """Gives back what a reused Python worker still holds from tasks of other kinds: encoders' memories and free pages.

    Called between blocks by operators that hold large arrays themselves.
    """
    import ctypes
    import gc

    import pyarrow as pa

    from fieldspark.llm import tokens

    tokens.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
