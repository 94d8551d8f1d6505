"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, WORD_PATTERN, kept, partitions, row_key, text_of

#: Bits of the hash that make a uniform number.
UNIT_BITS = 52


def quality_weight(score: Column) -> Column:
    """Weight of a document in its source by its quality score, 0 to 1: from 0.1, so that none is without a chance, to 1.1."""
    return F.lit(0.1) + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.5))))


def source_targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """Target words of each source. sizes: (source, source_size). Returns these with target.

    Sources by code point, null last, weigh 1, 2, ..., cycle, repeating. All words are shared by weight; a source takes
    cap times its own words at most, and what it can't take is shared among the others by weight. With the sources
    sorted by room (cap * size) per weight, the level (words a unit of weight gets) if all before are full rises while
    sources are full and falls after the first that isn't, so the greatest is the final one. One task sorts the sources:
    a row each.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double"))
    by_room = Window.orderBy((F.col("source_size") * cap / F.col("weight")), F.col("source").asc_nulls_last())
    before, everything = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = (
        weighed.withColumn("room", F.col("source_size") * cap)
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
    )
    level = F.max("level").over(everything)
    return filled.select("source", "source_size", F.least(F.col("room"), level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weight: Column | None = None, cap: float = 3.0, cycle: int = 3, seed: int = 17) -> DataFrame:
    """How many words of each document the mix takes.

    weight: of a document in its source, over 0, as a column of docs (quality_weight of a score); none: all weigh the same.
    Returns (doc_id, rid, size, source, source_size, target, taken, key): size is the number of runs of characters that
    aren't white space, taken counts repeats. Complete epochs of a source precede the last, fractional one; in that,
    documents are taken by ascending exponential keys -ln(u) / weight until the rest of the budget is spent, and
    of the document that crosses it only the first words are taken, so that a source meets its rounded target exactly.
    u comes from a hash of doc_id, text and seed, so reruns agree.

    Null text: size 0, nothing taken. Null source: a source of its own, last. Rows that repeat: each counts. Empty
    table: no rows. rid is a hash of the text; (doc_id, rid) names a row up to equal rows.

    A source's keys are cut into buckets, finer on more partitions, whose sums give the budget before each bucket; only rows of one bucket are
    sorted together, so a source with a third of all rows is spread over all tasks.
    """
    spark = docs.sparkSession
    counted = docs.select("doc_id", "source", text_of().alias("text"), (F.lit(1.0) if weight is None else weight).alias("weight")).withColumn("size", F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long"))
    unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(2**UNIT_BITS)) + 0.5) / float(2**UNIT_BITS)
    n = partitions(spark)  # buckets of an octave of keys: whatever the weights, a source's keys spread over two or three octaves at least
    slim = kept(
        counted.select(
            "doc_id", "source", "size", F.xxhash64("text").alias("rid"),
            (-F.log(unit) / F.col("weight")).alias("key"),
        ).withColumn("bucket", F.floor(F.log2("key") * n))
    )
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, cap, cycle)
    budgets = (
        sums.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("before_bucket", F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("epochs", F.floor(F.round("target") / F.greatest("source_size", F.lit(1))))
        .withColumn("budget", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
        .select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "source_size", "target", "before_bucket", "epochs", "budget")
    )
    rows = slim.join(budgets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "rid", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("before_bucket") + F.sum("size").over(inside) - F.col("size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("budget") - before))
    return rows.select(
        "doc_id", "rid", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "key"
    )


def mixed_documents(docs: DataFrame, weight: Column | None = None, cap: float = 3.0, cycle: int = 3, seed: int = 17) -> DataFrame:
    """docs as mixed: a row for each whole copy taken, and one with the first words of a document that is taken in part.

    Columns as docs has them; documents of which nothing is taken go. A part is the text up to the end of
    its last word taken, with its white space; it has the whole document's doc_id. Null and empty texts have no words and go. Rows
    that repeat are taken each by itself. An empty table gives no rows.
    """
    columns, taken = docs.columns, F.col("__mix_taken")
    # equal rows can be taken to different extents, three at most: each extent with the number of rows up to it
    plan = mix_sources(docs, weight, cap, cycle, seed).withColumns(row_key(F.col("doc_id"), F.col("rid"), F.col("source")))
    plan = plan.groupBy(*ROW_KEY, F.col("size").alias("__mix_size"), "taken").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*ROW_KEY).orderBy("taken").rowsBetween(Window.unboundedPreceding, 0)
    plan = plan.withColumn("upto", F.sum("n").over(upto)).groupBy(*ROW_KEY).agg(
        F.first("__mix_size").alias("__mix_size"), F.sort_array(F.collect_list(F.struct("upto", "taken"))).alias("__mix_extents")
    )
    rows = docs.withColumns(row_key(F.col("doc_id"), F.xxhash64(text_of()), F.col("source"))).join(plan, ROW_KEY)
    rows = rows.withColumn("__mix_no", F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy(F.lit(0))))
    joined = rows.withColumn("__mix_taken", F.get(F.filter("__mix_extents", lambda e: e["upto"] >= F.col("__mix_no")), F.lit(0))["taken"])
    size, words = F.col("__mix_size"), F.regexp_extract_all(text_of(), F.lit(WORD_PATTERN), F.lit(0))
    gaps = F.split(text_of(), WORD_PATTERN, -1)
    whole, part = F.floor(taken / F.greatest(size, F.lit(1))), taken % F.greatest(size, F.lit(1))
    copies = F.concat(
        F.array_repeat(F.col("text"), whole.cast("int")),
        F.when(part > 0, F.array(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), part.cast("int")), F.slice(words, F.lit(1), part.cast("int")), lambda g, w: F.concat(g, w)), ""))).otherwise(F.array().cast("array<string>")),
    )
    out = joined.withColumn("__mix_text", F.explode(copies))
    return out.select(*[F.col("__mix_text").alias(c) if c == "text" else F.char_length("__mix_text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])
