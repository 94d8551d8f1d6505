"""The conversation trie against a trie built whole in plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from galegrid.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner string, up int, n int, a string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: tuple(own.get(c - c % 100, [])[: heads[c]] + v[heads[c] :]) for c, v in own.items()}


def brute(turns):
    members = defaultdict(list)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids, leaves, saved, found = Counter(v[:-1] for v in members if v), Counter(), Counter(), set()
    for v, m in members.items():
        for d in range(len(v) + 1):
            leaves[v[:d]] += not kids[v]
            saved[v[:d]] += (len(m) - 1) * (len(v[-1][1]) if v else 0)
    for v, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(turns[c]) == len(v))
        parent = min(members[v[:-1]]) if v else None
        found.add((min(m), len(v), parent, len(m), kids[v], leaves[v], saved[v], hashlib.sha256(ends.encode()).hexdigest()))
    return found


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 7, 7, "x") for r in rows], SCHEMA)


def check(df):
    got = [tuple(r) for r in ct.conversation_trie(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rebuilt([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))
    return got


@pytest.mark.parametrize("block", [1024, 2])
def test_equals_brute_force(spark, small_dir, monkeypatch, block):
    monkeypatch.setattr(ct, "CHUNK", block)
    check(spark.read.parquet(f"{small_dir}/conversations.parquet"))


def test_odd_rows(spark):
    rows = [(0, i, "user", f"turn {i}") for i in range(4)] + [(100, 0, "user", "turn 0"), (100, 1, "user", "turn 1")]
    rows += [(c, t, r, x) for c in range(1, 40) for t, r, x in ((0, "user", "turn 0"), (1, None, None), (2, "user", "x" * (c % 3)))]  # copies
    rows += [(c, 0, "user", "alone") for c in range(201, 330)]  # no first of the span: some are left without turns, and end at the root
    rows += [(50, None, "user", "null first"), (50, None, "a", "null first"), (50, 0, None, "b"), (50, 0, None, "b"), (50, -3, "", None)]
    rows += [(60, 5, "user", "y" * 300_000), (None, 0, "user", "of no conversation"), (None, None, None, None), (-7, 0, "user", "below zero")]
    rows += [(400, i, "user", str(i % 5)) for i in range(1100)] + [(400 + c, i, "user", str(i % 5)) for c in (1, 2) for i in range(1050 + c)]  # longer than a block
    got = check(table(spark, rows))
    assert max(r[1] for r in got) > ct.BLOCK


def test_chains_of_chains(spark):
    """Each conversation leaves the one before it a turn later: as many chains above each other as turns."""
    long = [("user", str(i)) for i in range(40)]
    turns = {c: tuple(long[:c] + [("user", f"own {c}")] + [("user", "end")] * (c % 4)) for c in range(40)}
    rows = [(c, d + 1, r, x) for c, v in turns.items() for d, (r, x) in enumerate(v)]
    marks = spark.createDataFrame(rows, "conv_id long, depth long, role string, text string").select(
        "conv_id", "depth", F.xxhash64("role", "text").alias("mark_a"), F.xxhash64("text").alias("mark_b"), F.char_length("text").cast("long").alias("chars")
    )
    lengths = spark.createDataFrame([(c, len(v)) for c, v in turns.items()], "conv_id long, n long")
    assert {tuple(r) for r in ct.prefix_trie(lengths, marks).collect()} == brute(turns)


def test_empty_table(spark):
    assert ct.conversation_trie(table(spark, [])).collect() == []
    assert ct.conversation_trie(table(spark, [(None, 1, "user", "x")])).collect() == []
