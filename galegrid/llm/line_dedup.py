"""Line deduplication: explode normalised lines, hash, count distinct documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, kept, text_of


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Lines whose key (ends stripped, A-Z lower-cased) has min_chars code points or more and stands in min_docs
    documents or more go from all documents but the one with the largest doc_id.

    Returns (doc_id, text, n_lines, n_dropped): the text that stays, and the number of lines before and dropped. One
    row for each row of docs, extra columns are left out. Null text: one empty line. Rows that repeat a doc_id count
    as one document; a null doc_id is one document and the smallest. Long texts are split whole, in time proportional to their
    lines. Empty table: no rows.

    Only hashes, ids and positions of long lines are shuffled by line; texts are shuffled once, by document, to meet
    the positions that go. Lines that stand in many documents are counted by partial sums and joined by a join whose
    large partitions are split, so that a line in a third of the documents does not gather in one task.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("rid", F.xxhash64("text"))
    spread = (
        rows.select("doc_id", "rid", F.split(ascii_lower(F.col("text")), "\n", -1).alias("lines"))
        .select("doc_id", "rid", F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "rid", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "rid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7919), "key").alias("h2"))
    )
    lines = kept(spread)
    common = kept(
        lines.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    gone = (
        lines.join(common, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("gone"))
        .withColumnsRenamed({"doc_id": "g_doc", "rid": "g_rid"})
    )
    joined = rows.join(gone, rows.doc_id.eqNullSafe(F.col("g_doc")) & (rows.rid == F.col("g_rid")), "left")
    # the explode of one struct binds the lines: named in a lambda, the split would be done again for each line
    split = joined.select("doc_id", "text", "gone", F.explode(F.array(F.struct(F.split("text", "\n", -1).alias("lines")))).alias("x"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("x.lines") - 1), F.col("gone"))
    return split.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(stay, lambda i: F.get("x.lines", i)), "\n")).alias("text"),
        F.size("x.lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
