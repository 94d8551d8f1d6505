"""Packing documents into sequences: cutting stock by column generation over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, partitions, text_batches, text_of
from .token_counts import PIECES, byte_symbols, merge_ranks

#: Ends each document.
END_ID = 0
#: Column generation stops once the linear program is within this share of its lower bound.
GAP = 0.0005
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"

#: Runs of white space of this length are cut before the encoder sees them: its matcher backs up over each sign of a run, and gives up
#: at a million.
LONG_RUN = 100_000
_WHITE = regex.compile(r"\s+")

_encoders: dict[str, tiktoken.Encoding] = {}


def encoder_for(path: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level BPE .json file whose ids follow its merges, as tiktoken merges it (the same ids as
    the tokenizers library gives, three times as fast). One for each Python worker."""
    if path not in _encoders:
        import json

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks, special = merge_ranks(path)
        ids = [vocabulary[a + b] for a, b in ranks]
        if ids != sorted(ids):
            raise ValueError("the ids of this vocabulary don't follow its merges")
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        table = {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        named = {s: vocabulary.get(s, len(table) + n) for n, s in enumerate(special)}
        _encoders[path] = tiktoken.Encoding("of_file", pat_str=PIECES, mergeable_ranks=table, special_tokens=named)
    return _encoders[path]


def encode(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """ids of a text; special strings in it are one id each.

    A long run of white space is one piece of the pattern but for its last sign, which goes to what follows (all of it at the end of a
    text and before a special string), so it is merged as that piece, and the stretches around it go the usual way.
    """
    if len(text) < LONG_RUN:
        return encoder.encode(text, allowed_special="all")
    special = sorted(encoder.special_tokens_set, key=len, reverse=True)
    ids: list[int] = []
    for part in regex.split("(" + "|".join(map(regex.escape, special)) + ")", text) if special else [text]:
        if part in encoder.special_tokens_set:
            ids.append(encoder.encode_single_token(part))
            continue
        done = 0
        for run in _WHITE.finditer(part):
            if run.end() - run.start() >= LONG_RUN:
                end = run.end() - (run.end() < len(part))
                ids += encoder.encode_ordinary(part[done : run.start()])
                ids += encoder._encode_single_piece(part[run.start() : end])
                done = end
        ids += encoder.encode_ordinary(part[done:])
    return ids


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """A row for each piece: the document's ids and END_ID, cut at multiples of capacity."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(vocabulary)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                rows = []
                for doc_id, text in zip(batch["doc_id"].iloc[lo : lo + 256], batch["text"].iloc[lo : lo + 256], strict=True):
                    ids = np.array([*encode(encoder, text), END_ID], dtype="<u4")
                    doc_id = None if pd.isna(doc_id) else int(doc_id)
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.astype("int32") if with_ids else None))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(cut, PIECE_SCHEMA)


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The pattern of greatest value: unbounded knapsack by dynamic programming. values[w]: of a piece of length w."""
    best, chosen = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        sums = best[c - 1 :: -1] + values[1 : c + 1] if c > 1 else best[:1] + values[1:2]
        w = int(sums.argmax())
        best[c], chosen[c] = (sums[w], w + 1) if sums[w] > best[c - 1] else (best[c - 1], 0)
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if w := int(chosen[c]):
            pattern[w] = pattern.get(w, 0) + 1
            c -= w
        else:
            c -= 1
    return float(best[capacity]), pattern


def generate_columns(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], float]]:
    """The linear program's patterns and how often each is used, fractional.

    Revised simplex, with the inverse of the basis updated at each pivot. It starts from the patterns of one length
    each; a knapsack priced with the duals gives the column to enter. best > 1 bounds the optimum from below by
    objective / best, so the search stops within GAP of it. At most capacity - 1 lengths, whatever the data's size.
    """
    n, at = len(lengths), {w: i for i, w in enumerate(lengths)}
    basis = [{w: capacity // w} for w in lengths]
    inverse = np.diag([w_n and 1.0 / w_n for w_n in (capacity // w for w in lengths)])
    used = inverse @ np.array(counts, dtype=float)
    duals = inverse.sum(axis=0)
    for _ in range(40 * n + 100):
        values = np.full(capacity + 1, -1.0)
        values[lengths] = np.where(duals > 1e-12, duals, -1.0)
        best, pattern = knapsack(values, capacity)
        if best <= 1 + 1e-9 or used.sum() * (1 - 1 / best) <= GAP * used.sum() + 0.25:
            break
        column = np.zeros(n)
        for w, k in pattern.items():
            column[at[w]] = k
        step = inverse @ column
        ratios = np.full(n, np.inf)
        np.divide(used, step, out=ratios, where=step > 1e-9)
        leaves = int(ratios.argmin())
        theta = max(0.0, ratios[leaves])
        used -= theta * step
        used[leaves] = theta
        row = inverse[leaves] / step[leaves]
        inverse -= np.outer(step, row)
        inverse[leaves] = row
        duals += (1 - best) * row
        basis[leaves] = pattern
    return [(p, max(0.0, x)) for p, x in zip(basis, used, strict=True)]


def best_fit(pieces: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Patterns for the few pieces that rounding leaves: longest first, each into the fullest open pattern that has room."""
    rooms: list[tuple[int, int]] = []
    patterns: list[dict[int, int]] = []
    for w in sorted(pieces, reverse=True):
        for _ in range(pieces[w]):
            k = bisect_left(rooms, (w, -1))
            room, p = rooms.pop(k) if k < len(rooms) else (capacity, len(patterns))
            if p == len(patterns):
                patterns.append({})
            patterns[p][w] = patterns[p].get(w, 0) + 1
            insort(rooms, (room - w, p))
    return patterns


def cutting_plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns with their numbers of sequences; they hold exactly the pieces of the histogram."""
    left = {w: n for w, n in histogram.items() if n > 0}
    plan = [({capacity: 1}, left.pop(capacity))] if capacity in left else []
    if left:
        lengths = sorted(left)
        for pattern, x in generate_columns(lengths, [left[w] for w in lengths], capacity):
            times = min([int(x + 1e-6), *(left[w] // k for w, k in pattern.items())])
            if times:
                plan.append((pattern, times))
                for w, k in pattern.items():
                    left[w] -= k * times
    merged: dict[tuple, int] = {}
    for pattern in best_fit(left, capacity):
        merged[key] = merged.get(key := tuple(sorted(pattern.items())), 0) + 1
    return plan + [(dict(key), n) for key, n in merged.items()]


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length, ranges of ranks: (length, first rank, end, first sequence, copies in a sequence, first offset)."""
    rows, ranks, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for w in sorted(pattern, reverse=True):
            k, first = pattern[w], ranks.get(w, 0)
            rows.append((w, first, first + k * times, sequence, k, offset))
            ranks[w] = first + k * times
            offset += k * w
        sequence += times
    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, grid: int = 8, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of capacity ids at most.

    Returns a row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ids if
    with_ids. A document is its ids and END_ID; it is cut into pieces of capacity ids and one rest. Null text: the
    one id END_ID. Null doc_id: kept null. Rows that repeat: each is packed. Texts of any length are encoded whole.
    Empty table: no rows. Extra columns are left out.

    The program sees lengths in units of grid ids, rounded up, which bounds it by capacity / grid lengths and costs
    (grid - 1) / 2 ids of padding a rest on average. Only the histogram of units goes to the driver, which solves the
    cutting-stock program; its patterns (some hundred rows, bounded likewise) are broadcast. Documents are ranked
    within a unit length by buckets of a hash, whose counts give each bucket's first rank, so that a length that a third
    of the pieces have is ranked by all tasks. Rank and pattern give sequence and slot by arithmetic; a window over
    the few pieces of a sequence closes the gaps between them.
    """
    spark = docs.sparkSession
    text_batches(spark)
    stored = kept(cut_documents(docs, vocabulary, capacity, with_ids).withColumn("piece", F.monotonically_increasing_id()))
    pieces = stored.drop("ids").withColumns({
        "units": F.ceil(F.col("length") / grid),
        "bucket": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(2 * partitions(spark))).cast("int"),
    })
    counts = pieces.groupBy("units", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["units"]: r["n"] for r in counts.groupBy("units").agg(F.sum("n").alias("n")).collect()}
    fit = spark.createDataFrame(
        slots(cutting_plan(histogram, capacity // grid)), "s_units long, first long, end long, s_sequence long, copies long, s_offset long"
    )
    firsts = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ).select(F.col("units").alias("f_units"), F.col("bucket").alias("f_bucket"), "before")
    order = Window.partitionBy("units", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "start", "ids_crc32")
    ranked = pieces.withColumn("no", F.row_number().over(order)).join(
        firsts, (F.col("units") == F.col("f_units")) & (F.col("bucket") == F.col("f_bucket"))
    ).withColumn("rank", F.col("before") + F.col("no") - 1)
    placed = (
        ranked.join(F.broadcast(fit), (F.col("units") == F.col("s_units")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
        .withColumn("nth", F.col("rank") - F.col("first"))
        .withColumn("sequence_id", F.col("s_sequence") + F.floor(F.col("nth") / F.col("copies")))
        .withColumn("slot", F.col("s_offset") + F.col("nth") % F.col("copies") * F.col("units"))
    )
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    found = placed.withColumn("offset", F.sum("length").over(ahead) - F.col("length"))
    # ids are shuffled once, when the places are known
    return found.join(stored.select("piece", "ids"), "piece").select(*columns, "ids") if with_ids else found.select(*columns)
