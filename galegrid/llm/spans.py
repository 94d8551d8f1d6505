"""Positions of pattern matches in texts, and document frequencies of terms, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Terms of which the list may be broadcast.
BROADCAST_ROWS = 200_000


def match_spans(docs: DataFrame, patterns: dict[str, str], window: int = 0) -> DataFrame:
    """Leftmost non-overlapping matches: (doc_id, rid, kind, start, end, found, before, after); start and end count code
    points, end is exclusive; rid is a hash of the text, (doc_id, rid) names a row up to equal rows, which are given once.

    Splitting at a pattern gives the stretches between its matches, so a match starts after the lengths of all stretches and
    matches before it: a running sum over one document's matches. Only matches are shuffled, once, and window code points of
    text on both sides of each. Patterns should not back up over long runs: possessive repeats, and no start inside a run.
    """
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("rid"), text_of().alias("text"))
    each = F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("found"),
            F.when(F.col("text").rlike(p), F.split("text", p, -1)).alias("between"),
        ) for kind, p in patterns.items()
    ])
    hits = rows.select("doc_id", "rid", F.explode(F.filter(each, lambda x: F.size(x["found"]) > 0)).alias("x"))
    one = hits.select("doc_id", "rid", F.col("x.kind").alias("kind"), F.col("x.between").alias("between"), F.posexplode("x.found").alias("no", "found")).select(
        "doc_id", "rid", "kind", "no", "found", F.char_length("found").alias("size"), F.char_length(F.get("between", F.col("no"))).alias("gap"),
        F.right(F.get("between", F.col("no")), F.lit(window)).alias("before"), F.left(F.get("between", F.col("no") + 1), F.lit(window)).alias("after"),
    )
    # one shuffle serves both: equal rows meet where a document's matches do
    one = one.repartition("doc_id", "rid", "kind").dropDuplicates(["doc_id", "rid", "kind", "no"])
    sums = Window.partitionBy("doc_id", "rid", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(sums).cast("long")
    return one.withColumn("end", end).select("doc_id", "rid", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "found", "before", "after")


def holders(docs: DataFrame, terms: DataFrame, pattern: str) -> DataFrame:
    """terms: one column, term. Returns (doc_id, rid, term) of the rows of docs in which a match of pattern, lower-cased, is a term.

    All words of all texts are looked up in one pass; where the terms are few they are broadcast, else the distinct words of each
    text are shuffled to meet them.
    """
    words = docs.select("doc_id", F.xxhash64(text_of()).alias("rid"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_of()), F.lit(pattern), F.lit(0)))).alias("term"))
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return words.join(F.broadcast(terms) if few else terms, "term", "left_semi")


def document_frequency(docs: DataFrame, terms: DataFrame, pattern: str) -> DataFrame:
    """terms: one column, term. Returns (term, df): in how many rows of docs a match of pattern, lower-cased, is the term.

    Terms that no row has are left out. All words of all texts are looked up; where the terms are few they are broadcast, else
    words are counted by partial sums before they meet them.
    """
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_of()), F.lit(pattern), F.lit(0)))).alias("term"))
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(terms, "term", "left_semi")
