"""Exact deduplication as a stream over disk-backed keyed state, with a check of full bytes on hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CLASS, WRITTEN, folder, kept, one_of_equal, own_folder, row_key, text_of

#: The state store on local disk, with its memory bounded on each executor.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # else each of many small stores reserves megabytes on disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Arrivals; call is the folder that a call writes, slice that of one of its tasks (call and task in one
#: name, by which Spark prunes folders), so that a text is found by reading one file.
LOG = "digest binary, doc_id long, n_chars long, rid long, row long, sha binary, norm string, call int, slice string"
#: Each task writes one slice: with room for a writer Spark needn't sort its rows by it first.
WRITE_CONF = {"spark.sql.maxConcurrentOutputFileWriters": "2"}
#: Groups of copies of which the digests may be broadcast: 32 bytes each.
BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANK_CLASS + "+", "")


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def best_row() -> Column:
    """Sorts first the row that stays of a group: most code points, then the smallest doc_id (null last), then the first to
    arrive. call and row name a row for good, and with the text's hash they locate its content in the log."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "call", "row")


def calls(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the calls that have written to a table of a state folder."""
    files, where = folder(spark, path)
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("call="))


def arrival_log(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{home}/log")


def run_stream(spark: SparkSession, home: str, call: int) -> None:
    """Streams what is new in the log through the keyed state, and writes what the state then holds of each digest it touched
    to the call's updates: (digest, n, keep, anchor).

    keep is the row that stays, anchor the first to arrive under the digest, which never changes. The state is kept without expiry in
    home/state: a later run goes on with it. An update is written for each batch, and written again if the batch is repeated
    after a failure.
    """
    arrivals = spark.readStream.schema(LOG).parquet(f"{home}/log").select("digest", "doc_id", "n_chars", "rid", "call", "row", "slice")
    state = arrivals.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(best_row()).alias("keep"), F.min(F.struct("call", "row", "slice")).alias("anchor"))
    with settings(spark, STATE_CONF):
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{home}/updates/call={call}/batch={number}"))
            .option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()


def state_of(spark: SparkSession, home: str, call: int | None = None) -> DataFrame:
    """What the state holds of each digest that a call touched (all digests, without one): (digest, n, keep, anchor)."""
    row = "struct<less:long,no_id:boolean,doc_id:long,rid:long,call:int,row:long>"
    schema = f"digest binary, n long, keep {row}, anchor struct<call:int,row:long,slice:string>"
    done = calls(spark, f"{home}/updates")
    if not done or call is not None and call not in done:
        return spark.createDataFrame([], schema)  # calls of empty tables touch nothing
    updates = spark.read.schema(schema).parquet(f"{home}/updates/call={'*' if call is None else call}/batch=*")
    # counts only grow and the row that stays only improves, so the latest update of a digest has the greatest n
    return updates.groupBy("digest").agg(F.max("n").alias("n"), F.min("keep").alias("keep"), F.min("anchor").alias("anchor"))


def exact_dedup(docs: DataFrame, state_path: str | None = None, digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """Finds texts that are equal without white space; of each group the row with the most code points, then the smallest
    doc_id, stays.

    Returns (doc_id, rid, call, row, keep_id, group_size, kept, text_sha256), a row for each row of docs. Null text counts as
    empty; null doc_id sorts last; of equal rows one stays. Long texts count whole. Empty table: no rows. Extra columns are left
    out.

    state_path: a folder in which the state lives on. A later call with the same folder deduplicates its rows against those of
    all calls before; verdicts then gives all rows as they stand. One call at a time. Without it: a state of this call's own.

    Digest, id, locator (call and row) and normalised text of each row are written to an arrival log, and the log is streamed through
    the keyed state (run_stream): a group's state is one row, and partial sums keep a group with a third of the rows from
    gathering in one task. Then each new row that hit a digest is compared, all bytes, with the text that the digest's anchor
    locates; where they differ (the digest collided) rows are grouped by their whole text. digest: for tests of that. Of the calls
    before, only the files are read that hold such a text, however long the history is.
    """
    spark = docs.sparkSession
    home = state_path or own_folder(spark, "dedup")
    call = max(calls(spark, f"{home}/log"), default=-1) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("norm", normalised(F.col("text")))
    arrivals = rows.select(
        digest(F.col("norm")).alias("digest"), "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("rid"),
        F.monotonically_increasing_id().alias("row"), sha256_bytes(F.col("norm")).alias("sha"), "norm", F.concat_ws("-", F.lit(call), F.spark_partition_id()).alias("slice"),
    )
    with settings(spark, WRITE_CONF):
        arrivals.write.options(**WRITTEN).partitionBy("slice").parquet(f"{home}/log/call={call}")
    run_stream(spark, home, call)
    touched = kept(state_of(spark, home, call))
    wrong = _wrong_hits(spark, home, call, touched)
    if wrong is not None:
        wrong.write.parquet(f"{home}/wrong/call={call}")
    return _verdicts(spark, home, arrival_log(spark, home).where(F.col("call") == call), touched)


def verdicts(spark: SparkSession, state_path: str) -> DataFrame:
    """exact_dedup's rows for all rows of all calls with this state folder, as they stand now."""
    return _verdicts(spark, state_path, arrival_log(spark, state_path), state_of(spark, state_path))


def _verdicts(spark: SparkSession, home: str, log: DataFrame, state: DataFrame) -> DataFrame:
    placed = log.drop("norm").join(state.drop("anchor"), "digest")
    if calls(spark, f"{home}/wrong"):
        wrong = spark.read.schema("digest binary").parquet(f"{home}/wrong/call=*").distinct()
        everything = arrival_log(spark, home).join(wrong, "digest")
        groups = everything.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min(best_row()).alias("keep"))
        again = log.join(wrong, "digest").join(groups, "norm")
        placed = placed.join(wrong, "digest", "left_anti").unionByName(again.drop("norm"))
    return placed.select(
        "doc_id", "rid", "call", "row", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("call") == F.col("keep.call")) & (F.col("row") == F.col("keep.row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _wrong_hits(spark: SparkSession, home: str, call: int, touched: DataFrame) -> DataFrame | None:
    """Digests under which a row of this call has another text than their anchor; None if there are none, as is all but certain.
    The digests of groups are broadcast if they are few, else joined by a shuffle."""
    log = arrival_log(spark, home).select("digest", "norm", "call", "row", "slice")
    groups = touched.where("n > 1").select("digest", F.col("anchor.call").alias("a_call"), F.col("anchor.row").alias("a_row"))
    small = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = F.broadcast(groups) if small else groups
    at_anchor = (F.col("call") == F.col("a_call")) & (F.col("row") == F.col("a_row"))
    # written first, so that the join reads both sides from plain exchanges and can split a large group
    hits = kept(log.where(F.col("call") == call).join(named, "digest").select("digest", "norm", at_anchor.alias("is_anchor")))
    anchors = hits.where("is_anchor").select("digest", F.col("norm").alias("first_norm"))
    if call:
        anchors = anchors.unionByName(earlier_anchors(spark, home, call, touched))
    anchors = kept(anchors)
    # distinct comes later: in the same stage it would hold the join's large groups together
    differ = kept(hits.where(~F.col("is_anchor")).join(anchors, "digest").where(F.col("norm") != F.col("first_norm")).select("digest"))
    return None if differ.isEmpty() else differ.distinct()


def earlier_anchors(spark: SparkSession, home: str, call: int, touched: DataFrame) -> DataFrame:
    """(digest, first_norm) of the digests touched whose anchor came in a call before. Only slices with such an anchor are read: their
    names, at most one for each anchor and each file, are broadcast if they are few, and prune the log's folders."""
    anchors = kept(touched.select("digest", "anchor.*").where(F.col("call") < call))
    slices = kept(anchors.select("call", "slice").distinct()).where(F.col("call") < call).select("slice")
    small = slices.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    log = arrival_log(spark, home).where(F.col("call") < call).select("norm", "row", "slice")
    read = log.join(F.broadcast(slices) if small else slices, "slice", "left_semi")
    few = anchors.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return read.join(F.broadcast(anchors) if few else anchors, ["slice", "row"]).select("digest", F.col("norm").alias("first_norm"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of equal texts, with the columns of docs. Nulls, ties and repeated rows as in exact_dedup; an
    empty table gives no rows."""
    verdict = exact_dedup(docs).where("kept").withColumns(row_key(F.col("doc_id"), F.col("rid")))
    return one_of_equal(docs.withColumns(row_key(F.col("doc_id").cast("long"), F.xxhash64(text_of()))), verdict)
