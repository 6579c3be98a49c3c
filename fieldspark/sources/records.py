"""Records of one large file that many tasks read, although only quotes and braces tell where records begin.

Spark cuts files into blocks at line ends (or at another separator). Whether a piece begins inside quotes, and how deep in
braces, follows from counts of the pieces before it: first by block, a row for each, then within blocks. Pieces that are
records by themselves go on as they are; only those of longer records are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.sources.scratch import landed

BLOCK = ["file", "block"]


def _pieces(spark: SparkSession, path: str, separator: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return reader.text(path).select(*meta, F.monotonically_increasing_id().alias("at"), F.col("value"))


def with_before(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all pieces of the file before this one."""
    def before(by: list[str], order: str, v: str) -> Column:
        return F.coalesce(F.sum(v).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = pieces.groupBy(*BLOCK).agg(F.sum(value).alias("_s")).withColumn("_base", before(["file"], "block", "_s")).drop("_s")
    return pieces.join(blocks, BLOCK).withColumn(name, F.col("_base") + before(BLOCK, "at", value)).drop("_base")


def _joined(parts: DataFrame, number: str, separator: str) -> DataFrame:
    """file and record: the values of equal ``number`` in order, put together."""
    rows = parts.groupBy("file", number).agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    return rows.select("file", F.array_join(F.transform("p", lambda p: p["value"]), separator).alias("record"))


def quoted_lines(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """file, record of delimited text in which line ends within quotes are part of a value; a quote is doubled to stand for
    itself. Line ends within values become ``\\n``."""
    lines = _pieces(spark, path, None).withColumn("q", F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit(""))))
    lines = with_before(lines, "q", "_q").withColumn("inside", F.col("_q") % 2 == 1)
    whole = ~F.col("inside") & (F.col("q") % 2 == 0)
    rest = landed(lines.where(~whole).select(*BLOCK, "at", "value", (~F.col("inside")).cast("int").alias("first")), "parts")
    rest = with_before(rest, "first", "_n").withColumn("_n", F.col("_n") + F.col("first"))
    return lines.where(whole).select("file", F.col("value").alias("record")).unionByName(_joined(rest, "_n", "\n"))


def json_members(spark: SparkSession, path: str) -> DataFrame:
    """file, record: the text of every object two levels deep in a JSON document: the root's members and the elements of its
    arrays. The document may stand on one line or on many."""
    pieces = _pieces(spark, path, "}").withColumn("bare", F.regexp_replace("value", r"\\.", ""))
    pieces = landed(pieces.withColumn("q", F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit("")))), "pieces")
    pieces = with_before(pieces, "q", "_q").withColumn("inside", F.col("_q") % 2 == 1)
    # Without what is quoted: from a piece that begins within quotes all up to the first quote goes as well.
    open_ = F.when(F.col("inside"), F.regexp_replace("bare", r'^[^"]*("|$)', "")).otherwise(F.col("bare"))
    bare = F.regexp_replace(open_, r'"[^"]*("|$)', "")
    ends = ((F.col("_q") + F.col("q")) % 2 == 0).cast("int")
    pieces = landed(pieces.select(*BLOCK, "at", "value", "inside", (F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))).alias("opens"), ends.alias("ends")), "levels")
    deep = with_before(pieces.withColumn("d", F.col("opens") - F.col("ends")), "d", "_d")
    deep = landed(deep.withColumn("done", ((F.col("ends") == 1) & (F.col("_d") + F.col("d") == 1)).cast("int")), "deep")
    parts = with_before(deep, "done", "_n").where("_d + opens > 1 or _d > 1")
    outside = r'^(?:[^"{]|"(?:[^"\\]|\\.)*")*+'
    # The root's brace, and the end of a quoted text of the root's own, belong to no member.
    rootless = F.when(F.col("_d") == 0, F.regexp_replace("value", outside + r"\{", "")).when((F.col("_d") == 1) & F.col("inside"), F.regexp_replace("value", r'^(?:[^"\\]|\\.)*+"', ""))
    rootless = rootless.otherwise(F.col("value"))
    return _joined(parts.withColumn("value", rootless), "_n", "}").select("file", F.regexp_replace(F.concat(F.col("record"), F.lit("}")), outside, "").alias("record"))
