"""Conversation prefix trie: conversations that begin alike share nodes; each node is owned by the smallest conversation through it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, wide_hash

#: Turns of a conversation that one window goes over, and ids in one chunk of a node's list.
BLOCK = 1024
CHUNK = 256


def running(rows: DataFrame, key: str, block: Column, order: list[Column], added: list[str], xored: list[str] = []) -> DataFrame:
    """rows with the columns added (and xored) as totals up to the row, within key, by block and then by order; all are longs.

    A key's rows are dealt by their blocks, and only a row for each block meets the others of its key, so a key with very many rows is
    no one task's work. block must follow order.
    """
    rows = rows.withColumn("__block", block)
    here = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "__block").agg(*[F.sum(c).alias(f"__{c}") for c in added], *[F.bit_xor(c).alias(f"__{c}") for c in xored])
    earlier = totals.select(
        key, "__block", *[F.coalesce(f(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for f, names in ((F.sum, added), (F.bit_xor, xored)) for c in names]
    )
    plain = [c for c in rows.columns if c not in added and c not in xored]
    within = rows.select(*plain, *[F.sum(c).over(here).alias(c) for c in added], *[F.bit_xor(c).over(here).alias(c) for c in xored])
    joined = within.join(earlier, [key, "__block"])
    return joined.select(
        *[c for c in plain if c != "__block"], *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in added], *[F.col(c).bitwiseXOR(F.col(f"__{c}")).alias(c) for c in xored]
    )


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank from 1, mark_a, mark_b, chars): each turn's place by turn (null first; then role, text), 128 bits of its role and
    text, and its code points. Written once; texts are shuffled once and go no further."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("rank"),
    )
    block = F.coalesce(F.shiftright("turn", 10), F.lit(-(1 << 62)))
    placed = running(turns, "conv_id", block, [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], ["rank"])
    mark = wide_hash(F.col("role"), F.col("text"))
    return kept(placed.select("conv_id", "rank", mark["a"].alias("mark_a"), mark["b"].alias("mark_b"), F.char_length("text").cast("long").alias("chars")))


def rebuild(turns: DataFrame, span: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their span does: the first h turns of conversation c - c % span, then c's own after its
    first h, where h is crc32 of c in decimal by heads. turns: as ranked_turns gives them. Returns (conv_id, n), n the number of turns, 0 too,
    and (conv_id, depth, mark_a, mark_b, chars)."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(span))
    asked = sizes.select("conv_id", "own", first.alias("first"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    firsts = sizes.where(F.pmod("conv_id", F.lit(span)) == 0).select(F.col("conv_id").alias("first"), F.col("own").alias("there"))
    plan = kept(
        asked.join(firsts, "first", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
        .select("conv_id", "first", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    )
    begin = turns.where((F.pmod("conv_id", F.lit(span)) == 0) & (F.col("rank") < heads)).withColumnRenamed("conv_id", "first")
    marks = ["mark_a", "mark_b", "chars"]
    borrowed = plan.where("taken > 0").join(begin, "first").where("rank <= taken").select("conv_id", F.col("rank").alias("depth"), *marks)
    own = turns.join(plan, "conv_id").where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("taken")).alias("depth"), *marks)
    return plan.select("conv_id", "n"), borrowed.unionByName(own)


def prefix_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, upto, a, b): for each depth the code points up to it, and 128 bits of the turns up to it, which is the xor of
    the turns' marks, each hashed with its depth. Written once."""
    bound = wide_hash(F.col("depth"), F.col("mark_a"), F.col("mark_b"))
    rows = turns.select("conv_id", "depth", "chars", F.col("chars").alias("upto"), bound["a"].alias("a"), bound["b"].alias("b"))
    return kept(running(rows, "conv_id", F.shiftright("depth", 10), [F.asc("depth")], ["upto"], ["a", "b"]))


def first_owned(lengths: DataFrame, digests: DataFrame, owners: DataFrame) -> DataFrame:
    """(conv_id, n, f): the first depth whose prefix no smaller conversation has, n + 1 if there is none.

    A conversation that owns a depth owns all below it, so the depth is found by halving: in each round all open conversations ask at once
    for the owner of their middle prefix. Rounds are the logarithm of the longest conversation.
    """
    now = lengths.select("conv_id", "n", F.lit(1).cast("long").alias("low"), (F.col("n") + 1).alias("high"))
    longest, done = lengths.agg(F.max("n")).first()[0] or 0, []
    for _ in range(int(longest).bit_length()):
        done.append(now.where("low >= high"))
        asked = now.where("low < high").withColumn("depth", F.shiftright(F.col("low") + F.col("high"), 1))
        answers = asked.join(digests.select("conv_id", "depth", "a", "b"), ["conv_id", "depth"]).join(owners, ["depth", "a", "b"])
        owns = F.col("owner") == F.col("conv_id")
        now = kept(answers.select(
            "conv_id", "n", F.when(owns, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owns, F.col("depth")).otherwise(F.col("high")).alias("high")
        ))
    for part in done:
        now = now.unionByName(part)
    return now.select("conv_id", "n", F.col("low").alias("f"))


def subtree_totals(chains: DataFrame, columns: list[str]) -> DataFrame:
    """chains (conv_id, up, columns) with the columns summed over the chain and all chains below it.

    Bottom-up by doubling: in a round each chain hands what it has gathered to its ancestor 1, 2, 4, ... chains up, so rounds are the
    logarithm of the longest way to the root. Sums are made before they are shuffled.
    """
    now = kept(chains)
    while now.where("up is not null").limit(1).count():
        handed = now.where("up is not null").groupBy("up").agg(*[F.sum(c).alias(f"__{c}") for c in columns]).withColumnRenamed("up", "conv_id")
        gathered = now.join(handed, "conv_id", "left").select("conv_id", *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in columns])
        above = now.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("__above"))
        higher = now.where("up is not null").select("conv_id", "up").join(above, "up").select("conv_id", F.col("__above").alias("up"))
        now = kept(gathered.join(higher, "conv_id", "left").select("conv_id", "up", *columns))
    return now.select("conv_id", *columns)


def listed_sha256(ends: DataFrame) -> DataFrame:
    """ends: (conv_id, depth, member). Returns (conv_id, depth, ends_sha256) of each node's members in decimal, ascending, comma-joined.

    Members meet in chunks of CHUNK neighbouring ids; a node's chunks go by in order and are never held together.
    """
    grouped = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("member")).alias("ids"))
    chunks = grouped.select("conv_id", "depth", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            found = []
            for conv_id, depth, ids in zip(batch["conv_id"], batch["depth"], batch["ids"], strict=True):
                if (conv_id, depth) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    found.append((*node, state.hexdigest()))
                node, state = (conv_id, depth), hashlib.sha256(ids.encode())
            yield pd.DataFrame(found, columns=["conv_id", "depth", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])

    dealt = chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk")
    return dealt.drop("chunk").mapInPandas(fold, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of conversations: lengths (conv_id, n), n turns, maybe 0, and turns (conv_id, depth from 1 to n, mark_a, mark_b, chars).

    Returns for each distinct prefix, the empty one (root, depth 0) too: conv_id, the smallest conversation with it; depth; parent_conv_id,
    the same of its parent (root: null); n_convs, conversations with it; n_children; n_leaves, childless nodes under it, itself too;
    saved_tokens, summed over the nodes under it, itself too, (n_convs - 1) times the code points of the node's last turn; ends_sha256 of
    the conversations that end there.

    A conversation owns the nodes from its first owned depth to its end, its chain, or none if another has all its turns. A chain hangs from
    a node of its parent's chain; chains hand their sums upwards, then each chain is summed from its end. Of a node's members all but the
    owner leave the depths before their first owned one to others, which is what is saved. No conversations: no rows.
    """
    digests = prefix_digests(turns)
    owners = kept(digests.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner")))
    found = kept(first_owned(lengths, digests, owners))
    least = found.agg(F.min("conv_id")).first()[0]
    if least is None:
        least = 0
    # where each conversation's own part begins: the chain above, and the code points that it leaves to others
    above = (
        found.where("f > 1").withColumn("depth", F.col("f") - 1).join(digests.select("conv_id", "depth", "a", "b", "upto"), ["conv_id", "depth"])
        .join(owners, ["depth", "a", "b"]).select("conv_id", "n", "f", F.col("owner").alias("up"), F.col("upto").alias("left"))
    )
    at_root = found.where(F.col("f") == 1).select(
        "conv_id", "n", F.when(F.col("conv_id") == least, F.lit(0)).otherwise(F.col("f")).cast("long").alias("f"),
        F.when(F.col("conv_id") != least, F.lit(least)).cast("long").alias("up"), F.lit(0).cast("long").alias("left"),
    )
    placed = kept(above.unionByName(at_root))
    chains, copies = placed.where("f <= n"), placed.where("f > n")
    branches = chains.where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("f") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("branches"))
    leaf = chains.join(branches.withColumnRenamed("depth", "n"), ["conv_id", "n"], "left").select(
        "conv_id", "up", "f", "n", "left", F.col("branches").isNull().cast("long").alias("leaf")
    )
    ended = copies.groupBy(F.col("up").alias("conv_id")).agg(F.count(F.lit(1)).alias("__convs"), F.sum("left").alias("__left"))
    own = leaf.join(ended, "conv_id", "left").select(
        "conv_id", "up", (F.coalesce("__convs", F.lit(0)) + 1).alias("convs"), F.col("leaf").alias("leaves"), (F.coalesce("__left", F.lit(0)) + F.col("left")).alias("left_to")
    )
    sums = ["convs", "leaves", "left_to"]
    whole = subtree_totals(own, sums)
    hanging = chains.where("up is not null").join(whole, "conv_id").select("up", "f", *sums, F.lit(1).cast("long").alias("branches")).unionByName(
        copies.select("up", "f", F.lit(1).cast("long").alias("convs"), F.lit(0).cast("long").alias("leaves"), F.col("left").alias("left_to"), F.lit(0).cast("long").alias("branches"))
    )
    hung = hanging.groupBy(F.col("up").alias("conv_id"), (F.col("f") - 1).alias("depth")).agg(*[F.sum(c).alias(c) for c in [*sums, "branches"]])
    root = leaf.where(F.col("conv_id") == least).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("upto"))
    nodes = digests.select("conv_id", "depth", "chars", "upto").unionByName(root).join(leaf, "conv_id").where("depth >= f").join(hung, ["conv_id", "depth"], "left")
    last = F.col("depth") == F.col("n")
    ready = nodes.select(
        "conv_id", "depth", "f", "n", "up", "left", (F.col("upto") - F.col("chars")).alias("before"), F.coalesce("branches", F.lit(0)).alias("branches"),
        *[(F.coalesce(c, F.lit(0)) + F.when(last, end).otherwise(0)).cast("long").alias(c) for c, end in (("convs", F.lit(1)), ("leaves", F.col("leaf")), ("left_to", F.col("left")))],
    )
    summed = running(ready, "conv_id", F.shiftright(F.col("n") - F.col("depth"), 10), [F.desc("depth")], sums)
    ends = listed_sha256(
        chains.select("conv_id", F.col("n").alias("depth"), F.col("conv_id").alias("member"))
        .unionByName(copies.select(F.col("up").alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member")))
    )
    return summed.join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("f"), F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id"), F.col("convs").alias("n_convs"),
        (F.col("branches") + (F.col("depth") < F.col("n")).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("left_to") - F.col("left") - (F.col("convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, span: int = 100, heads: int = 6) -> DataFrame:
    """prefix_trie of the rebuilt conversations (rebuild) of a table with conv_id, turn, role and text.

    Null role or text: empty. Null turn: first. Equal turns: by role, then text; rows that repeat are turns each. A row without conv_id is of
    no conversation and left out. A conversation that is rebuilt to no turns is a member of the root and ends there. Long texts are hashed
    whole. Empty table: no rows, as no conversation names the root. Extra columns are left out.
    """
    return prefix_trie(*rebuild(ranked_turns(conversations), span, heads))
