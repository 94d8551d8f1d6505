"""Byte tries, and the audit against exact arithmetic in plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galegrid.llm import divergence as dv
from galegrid.llm.common import read_documents

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10):
    docs, counts, found = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {lang for lang, _ in counts}:
        terms = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        group = {s: c for (x, s), c in counts.items() if x == lang}

        def portions(c, terms=terms):
            n = sum(c[t] for t in terms) + 2 * len(terms)
            return [1 + 10**9 * (c[t] + 2) // n for t in terms]

        p, q = {s: portions(c) for s, c in group.items()}, portions(sum(group.values(), Counter()))
        for s in group:
            pairs = sorted((-sum(map(f, p[s], p[o])), o.encode()) for o in group if o != s)
            more = sorted((-f(x, y), t.encode()) for t, x, y in zip(terms, p[s], q, strict=True) if group[s][t] and x > y)[:10]
            found |= {(lang, s, part, item.decode(), -v, i + 1) for part, some in (("pair", pairs), ("term", more)) for i, (v, item) in enumerate(some)}
    return found


def check(docs, **kwargs):
    got = [tuple(r) for r in dv.divergence(docs, **kwargs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([tuple(r) for r in docs.select("text", "lang", "source").collect()], *(s.min_docs for s in kwargs.values()))
    return got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6)))
def test_trie_walks_in_order_of_bytes(terms):
    trie = dv.ByteTrie()
    leaves = {t: trie.leaf(t) for t in terms}
    assert list(trie.walk()) == sorted(leaves.items()) and sorted(leaves.values()) == list(range(trie.size))


def test_merged_tries_equal_one(monkeypatch):
    """Parts of a text's words in tries of few leaves, sorted as Spark does and merged a few rows at a time."""
    texts = [f"a ab abc {'é' * (i % 4)} b{'x' * (i % 7)} Zz z" for i in range(200)]
    gids = np.arange(200) % 3
    whole = dv.Counts(3)
    whole.add(texts, gids)
    parts = []
    for i in range(0, 200, 20):
        part = dv.Counts(3)
        part.add(texts[i : i + 20], gids[i : i + 20])
        parts += [r for b in part.rows() for r in b.to_pylist()]
    parts.sort(key=lambda r: r["term"])
    batches = [dv.pa.RecordBatch.from_pylist(parts[i : i + 3], dv.pa.schema([("term", dv.pa.binary()), *((c, dv.pa.list_(k)) for c, k in (("gids", dv.pa.int32()), ("counts", dv.pa.int64()), ("docs", dv.pa.int64())))])) for i in range(0, len(parts), 3)]
    got = [(terms[int(a)].as_py(), int(g), int(n), int(d)) for terms, at, *rest in dv.merged(iter(batches), 3) for a, g, n, d in zip(at, *rest, strict=True)]
    assert got == [(r["term"], g, n, d) for b in whole.rows() for r in b.to_pylist() for g, n, d in zip(r["gids"], r["counts"], r["docs"], strict=True)]


def test_large_numbers():
    counts, total = np.array([0, 5, 10**14, 8 * 10**15 - 7]), 8 * 10**15
    assert dv.scaled(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]


@pytest.mark.parametrize("leaves", [200_000, 50])
def test_equals_brute_force(spark, small_dir, leaves, monkeypatch):
    monkeypatch.setattr(dv, "TRIE_LEAVES", leaves)
    check(read_documents(spark, small_dir))


def test_odd_rows(spark, odd, none):
    few = dv.Settings(min_docs=2)
    got = check(odd, s=few)
    assert {r[2] for r in got} == {"pair", "term"}
    assert dv.divergence(none).collect() == []
    with pytest.raises(ValueError, match="sources"):
        dv.divergence(odd, dv.Settings(max_groups=2))
    wordless = spark.createDataFrame([("1 2", "en", "a"), (None, "en", "b"), ("", None, None)], "text string, lang string, source string")
    assert sorted(check(wordless)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
