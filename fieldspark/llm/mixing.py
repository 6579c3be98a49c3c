"""Low-discrepancy source schedule, with DataFrame functions only.

Points of the golden-ratio sequence are mapped through the cumulative target weights of the sources; each slot gets
the rank of its source, and slot ``r`` of a source takes words ``[r * block, (r + 1) * block)`` of that source's
documents in a shuffled order, read again from the start when it is exhausted. A slot of a source that already has
its target is passed over; what the sequence leaves short (a few slots a source) follows at the end. The slots are the
order of the mix: every prefix of them holds each source's share but for a few blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import WORD, numbered, offsets, put, word_count, written

#: Words in a block: what one slot of the schedule takes.
BLOCK = 256
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix against those of all documents, and the most that a source may be repeated.
SHARE, REPEATS = 1.5, 2
#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Cells of the unit interval by which points meet their source, and slots in a chunk that is ranked by itself.
CELLS, CHUNK = 1024, 1024
#: Documents in one bucket of a source's shuffled order, on average.
BUCKET_ROWS = 200
#: Slots whose documents are written together, in order.
RUN_SLOTS = 16_384


def source_targets(sizes: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Targets from (source, source_size): source, source_size, src (its number in code point order, null last), target.

    Sources share ``share`` times all words by weight; none gets more than ``repeats`` times its size, and the excess
    goes to the others by weight until none is above. That fixed point is ``min(cap, level * weight)``: with sources
    in order of cap / weight, the level is the first one that the next source's ratio is not below. One row a source.
    """
    every = Window.partitionBy(F.lit(0))
    up = every.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod("src", F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = (
        sizes.withColumn("src", F.row_number().over(every.orderBy(F.asc_nulls_last("source"))) - 1)
        .withColumn("w", weight).withColumn("cap", repeats * F.col("source_size").cast("double"))
        .withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0))))
        .withColumn("fits", F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "src", "level")))
        .withColumn("level", F.min("fits").over(every)["level"])
    )
    return t.select("source", "source_size", "src", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _same_source(a: DataFrame, b: DataFrame):
    return a["source"].eqNullSafe(b["source"])


def schedule(targets: DataFrame, total: float, block: int = BLOCK) -> DataFrame:
    """Slots (src, rank, slot) that fill the targets with blocks; ``total``: the sum of the targets."""
    spark = targets.sparkSession
    points = max(1, int(total / block) + 1)
    up = Window.partitionBy(F.lit(0)).orderBy("src")
    shares = targets.where("target >= 1").select("src", F.floor("target").alias("goal"), (F.col("target") / F.lit(total)).alias("p"))
    shares = shares.withColumn("to", F.sum("p").over(up)).withColumn("from", F.col("to") - F.col("p")).withColumn("need", F.ceil(F.col("goal") / block))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * CELLS), F.floor(F.col("to") * CELLS))))
    drawn = (
        spark.range(points).withColumn("x", F.pmod((F.col("id") + 1).cast("double") * GOLDEN, F.lit(1.0)))
        .withColumn("cell", F.floor(F.col("x") * CELLS)).join(cells, "cell").where("x >= `from` and x < `to`")
        .select("src", "need", F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    )
    counts = drawn.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = offsets(counts, ["src"], "chunk", "n", "before")
    ranked = (
        drawn.withColumn("rn", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1)
        .join(before, ["src", "chunk"]).withColumn("rank", F.col("before") + F.col("rn")).where("rank < need").select("src", "rank", "slot")
    )
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    tail = (
        shares.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
        .withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("need") - 1)))
        .select("src", "rank", (F.lit(points) + F.col("rank")).alias("slot"))
    )
    return ranked.unionByName(tail)


def mix_pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """From (doc_id, source, digest, size): what the mix takes, a row for each slot that a unit is read in.

    A unit is one distinct row of these, with ``copies``, the number of rows that are equal in all four columns; they
    are laid out together. Returns doc_id, source, digest, size, copies, source_size, target, unit and bucket (its
    name), read (0, or 1 for the second reading), slot, part (words of the unit in that slot, of all copies). A unit
    that the mix doesn't take, as it has no words or comes after the target, has one row with a null slot and part 0.
    Null ids and sources are values like others; an empty input has no rows.
    """
    units = rows.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    facts = targets.agg(F.sum("target").alias("total")).first()
    total = float(facts["total"] or 0.0)
    buckets = max(1, rows.count() // BUCKET_ROWS)
    laid = (
        units.join(targets, units["source"].eqNullSafe(targets["source"]), "left").drop(targets["source"])
        .withColumn("h", F.xxhash64(F.lit("order"), "doc_id", "digest", "size"))
        .withColumn("bucket", F.pmod("h", F.lit(buckets)))
    )
    sums = laid.groupBy("src", "bucket").agg(F.sum("words").alias("n"))
    before = offsets(sums, ["src"], "bucket", "n", "before")
    inside = Window.partitionBy("src", "bucket").orderBy("h", F.asc_nulls_first("doc_id"), "digest", "size")
    laid = (
        laid.withColumn("inner", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("unit", F.row_number().over(inside)).join(before, ["src", "bucket"])
        .withColumn("start", F.col("before") + F.col("inner"))
    )
    # Reading k of a unit covers words [start + k * source_size, ...) of the source's stream, cut at the source's goal.
    goal = F.floor("target")
    reads = (
        laid.withColumn("read", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
        .withColumn("lo", F.col("start") + F.col("read") * F.col("source_size"))
        .withColumn("hi", F.least(F.col("lo") + F.col("words"), goal))
        .withColumn("hi", F.greatest("hi", "lo"))
        .where("hi > lo or read = 0")
    )
    some = F.col("hi") > F.col("lo")
    pieces = (
        numbered(reads, F.when(some, F.floor(F.col("lo") / block)).otherwise(-1), F.when(some, F.floor((F.col("hi") - 1) / block)).otherwise(-1), "rank")
        .withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block)))
    )
    slots = schedule(targets, total, block)
    joined = pieces.join(slots, ["src", "rank"], "left").withColumn("part", F.when(F.col("slot").isNotNull(), F.col("part")).otherwise(F.lit(0)))
    return joined.select("doc_id", "source", "digest", "size", "copies", "source_size", "target", "src", "bucket", "unit", "read", "slot", "part")


_UNIT = ("src", "bucket", "unit", "doc_id", "source", "digest", "size", "copies", "source_size", "target")


def mix_units(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``mix_pieces`` by unit: its columns, taken (words that each copy gives), first_slot (null where it gives none) and
    slots (the first slot of each of its readings, in order)."""
    reads = mix_pieces(rows, block).groupBy(*_UNIT, "read").agg(F.sum("part").alias("words"), F.min("slot").alias("slot"))
    units = reads.groupBy(*_UNIT).agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"), F.sort_array(F.collect_list(F.when(F.col("words") > 0, F.struct("read", "slot"))))["slot"].alias("slots"))
    return units.select(*_UNIT[3:], F.floor(F.col("words") / F.col("copies")).cast("long").alias("taken"), "first_slot", "slots")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), word_count(F.col("text")).alias("size"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Digest of ``documents``: doc_id, size, source_size, target, taken, first_slot (where the mix first takes words of
    it, null if nowhere), one row for each row of the table."""
    out = mix_units(written(_sized(docs), "sized"))
    return numbered(out, F.lit(1), F.col("copies"), "_copy").select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixed_corpus(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``, in the order of the schedule: each document stands where the slot
    of its first word does, once for every full reading, and once more cut to its first ``taken mod size`` words (single
    spaces between) where the target cuts it. Documents that the mix doesn't take go; n_chars follows the text. Partitions
    are runs of slots in order, and so are the files that they are written to. An empty table has no rows."""
    units = mix_units(written(_sized(docs), "sized")).where("taken > 0")
    units, _ = put(units.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "digest", "size", "taken", "slots")]), "units")
    last = units.agg(F.max(F.array_max("_slots"))).first()[0] or 0
    keyed = docs.withColumn("_d", F.xxhash64("text"))
    on = keyed["doc_id"].eqNullSafe(units["_doc_id"]) & keyed["source"].eqNullSafe(units["_source"]) & (keyed["_d"] == units["_digest"])
    each = keyed.join(units, on).withColumn("_read", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("_size")))))
    words = F.least(F.col("_size"), F.col("_taken") - F.col("_read") * F.col("_size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    out = each.withColumn("_slot", F.element_at("_slots", F.least(F.col("_read") + 1, F.size("_slots")).cast("int")))
    out = out.withColumn("text", F.when(words < F.col("_size"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return in_slot_order(out, last).select(*docs.columns)


def in_slot_order(df: DataFrame, last: int) -> DataFrame:
    """Rows sorted by ``_slot``, 0 to ``last``: partition k holds the k-th run of slots."""
    runs = max(1, min(last + 1, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-last // RUN_SLOTS))))
    return df.repartitionById(runs, F.floor(F.col("_slot") * F.lit(runs) / F.lit(last + 1)).cast("int")).sortWithinPartitions("_slot", F.asc_nulls_first("doc_id"), "_read")
