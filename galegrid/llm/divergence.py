"""Source divergence audit: how far a language's sources are from each other in the words they use, from mergeable byte tries."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, text_batches, text_of

#: Bytes of a term: ASCII letters (texts are lower-cased before) and every byte of a character beyond ASCII.
LETTERS = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
#: Bytes of text whose terms are counted before they go into the trie, and leaves and counters of a trie before it is handed on.
CHUNK_BYTES, TRIE_LEAVES, TRIE_COUNTERS = 8_000_000, 200_000, 3_000_000
LEAF_SCHEMA = "term binary, gids array<int>, counts array<long>, docs array<long>"


@dataclass(frozen=True)
class Settings:
    """min_docs: documents of a language that a term it keeps is in. top: terms reported for a source. max_groups: pairs of language and source
    at most; more are an error, since each source is reported against each of its language."""

    min_docs: int = 10
    top: int = 10
    max_groups: int = 2000


class ByteTrie:
    """A radix trie of byte strings. Edges are keyed by their first byte: [label, edges below, leaf or -1]; leaves are numbered as they come."""

    def __init__(self) -> None:
        self.root: dict[int, list] = {}
        self.size = 0

    def leaf(self, term: bytes) -> int:
        """The number of the term's leaf, made if it is new. term has a byte at least."""
        edges, at, end = self.root, 0, len(term)
        while True:
            edge = edges.get(term[at])
            if edge is None:
                edge = edges[term[at]] = [term[at:], None, -1]
                at = end
            elif term.startswith(edge[0], at):
                at += len(edge[0])
            else:
                label, n = edge[0], 1
                while n < len(label) and at + n < end and label[n] == term[at + n]:
                    n += 1
                edges[term[at]] = edge = [label[:n], {label[n]: [label[n:], edge[1], edge[2]]}, -1]
                at += n
            if at == end:
                if edge[2] < 0:
                    edge[2], self.size = self.size, self.size + 1
                return edge[2]
            if edge[1] is None:
                edge[1] = {}
            edges = edge[1]

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Terms and leaves in the order of bytes."""
        open_edges = [(b"", self.root[b]) for b in sorted(self.root, reverse=True)]
        while open_edges:
            before, (label, below, leaf) = open_edges.pop()
            term = before + label
            if leaf >= 0:
                yield term, leaf
            if below:
                open_edges += [(term, below[b]) for b in sorted(below, reverse=True)]


def terms_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, as binary, and the place of each one's text."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw).lower(), dtype=np.uint8)  # of bytes, lower() knows A-Z alone
    letter = LETTERS[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])])
    return terms, np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sums of the values of each."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return sorted_keys[first], *[np.add.reduceat(v[order], first) for v in values]


class Counts:
    """A partition's trie, and for each leaf and group the occurrences of its term and the documents with it."""

    def __init__(self, groups: int) -> None:
        self.groups, self.trie = groups, ByteTrie()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, texts: list[str], gids: np.ndarray) -> None:
        terms, doc = terms_of(texts)
        if not len(terms):
            return
        coded = terms.dictionary_encode()
        code, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        leaf = np.fromiter(map(self.trie.leaf, coded.dictionary.to_pylist()), dtype=np.int64, count=distinct)
        in_docs, times = np.unique(doc * distinct + code, return_counts=True)
        keys = leaf[in_docs % distinct] * self.groups + gids[in_docs // distinct]
        self.parts.append(summed(keys, times.astype(np.int64), np.ones(len(keys), dtype=np.int64)))
        self.held += len(self.parts[-1][0])
        if self.held > TRIE_COUNTERS:
            self.parts = [summed(*map(np.concatenate, zip(*self.parts, strict=True)))]
            self.held = len(self.parts[0][0])

    def full(self) -> bool:
        return self.trie.size >= TRIE_LEAVES or self.held > TRIE_COUNTERS // 2

    def rows(self) -> Iterator[pa.RecordBatch]:
        """LEAF_SCHEMA in the order of bytes."""
        if not self.parts:
            return
        key, counts, docs = summed(*map(np.concatenate, zip(*self.parts, strict=True)))
        terms, leaves = zip(*self.trie.walk(), strict=True)
        place = np.empty(len(leaves), dtype=np.int64)
        place[np.array(leaves)] = np.arange(len(leaves))
        order = np.argsort(place[key // self.groups], kind="stable")
        at = place[key // self.groups][order]
        yield from leaf_batches(pa.array(terms, pa.binary()), at, (key % self.groups)[order], counts[order], docs[order])


def leaf_batches(terms: pa.Array, at: np.ndarray, gids: np.ndarray, counts: np.ndarray, docs: np.ndarray, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """LEAF_SCHEMA; at: the place in terms of each counter, ascending."""
    for first in range(0, len(terms), rows):
        some = terms.slice(first, rows)
        bounds = np.searchsorted(at, np.arange(first, first + len(some) + 1))
        lists = [pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(v[bounds[0] : bounds[-1]].astype(kind))) for v, kind in ((gids, np.int32), (counts, np.int64), (docs, np.int64))]
        yield pa.RecordBatch.from_arrays([some, *lists], names=["term", "gids", "counts", "docs"])


def counted(rows: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Tries of the rows' (text, gid) as LEAF_SCHEMA, each in the order of bytes."""
    counts, texts, gids, size = Counts(groups), [], [], 0
    for batch in rows:
        texts += batch.column("text").to_pylist()
        gids += batch.column("gid").to_pylist()
        size += batch.column("text").nbytes
        if size > CHUNK_BYTES:
            counts.add(texts, np.array(gids))
            texts, gids, size = [], [], 0
            if counts.full():
                yield from counts.rows()
                counts = Counts(groups)
    counts.add(texts, np.array(gids, dtype=np.int64))
    yield from counts.rows()


def merged(rows: Iterator[pa.RecordBatch], groups: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The tries' leaves, sorted by term, with those of one term made one: (terms, place of each counter, gids, counts, docs). Only the last
    term waits for the next batch, as one leaf."""
    last = None
    for batch in rows:
        term, lists = batch.column("term").cast(pa.large_binary()), batch.select(["gids", "counts", "docs"])
        gids, counts, docs = (c.flatten().to_numpy(zero_copy_only=False) for c in lists.columns)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("gids")).to_numpy(zero_copy_only=False))
        if last is not None:
            term = pa.concat_arrays([last[0], term])
            row = np.concatenate((np.zeros(len(last[1]), dtype=np.int64), row + 1))
            gids, counts, docs = (np.concatenate(x) for x in zip(last[1:], (gids, counts, docs), strict=True))
        coded = term.dictionary_encode()  # sorted, so codes ascend
        key, counts, docs = summed(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * groups + gids, counts, docs)
        at, gids, end = key // groups, key % groups, len(coded.dictionary) - 1
        whole = at < end
        yield coded.dictionary.slice(0, end), at[whole], gids[whole], counts[whole], docs[whole]
        last = coded.dictionary.slice(end), gids[~whole], counts[~whole], docs[~whole]
    if last is not None:
        yield last[0], np.zeros(len(last[1]), dtype=np.int64), *last[1:]


def scaled(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (counts + 2) / total), exactly: three digits at a time, so nothing outgrows 64 bits while total is under 9e15."""
    whole, rest = np.divmod(counts + 2, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def divergence(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Sources of a language compared by the terms that it keeps. Returns (lang, source, part, item, value, rank).

    A term is a run of ASCII letters (A-Z lower-cased) and characters beyond ASCII; a language keeps those in min_docs of its documents. Each
    source and the language as a whole have, for each kept term, a smoothed share in billionths, and f of two shares is their squared difference by
    their sum, rounded down. part pair: item is another source of the language, value the sum of f over the kept terms. part term: item is a kept term that
    the source has more of than the language, value f; the first `top`. rank: from 1, by value descending, then item by its UTF-8 bytes.

    Each partition counts into a byte trie with counters by source at its leaves. Leaves are written once, meet by ranges of prefixes, and are merged in the
    order of bytes; the kept ones, written too, go by again when totals are known. Sums of pairs and the first terms of each partition are small.

    Null text, lang, source: ''. Empty and wordless texts have no terms; a source without terms is compared all the same. Equal rows are documents
    each. Long texts are read whole; a term may be as long as a text. Ties go by the item. Empty table: no rows. Extra columns are left out.
    More than max_groups sources: ValueError.
    """
    spark = docs.sparkSession
    text_batches(spark)
    named = docs.select(text_of().alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    found = sorted(map(tuple, named.select("lang", "source").distinct().limit(s.max_groups + 1).collect()), key=lambda g: (g[0].encode(), g[1].encode()))
    if len(found) > s.max_groups:
        raise ValueError(f"more than {s.max_groups} sources")
    n_groups = max(1, len(found))
    groups = spark.createDataFrame([(i, *g) for i, g in enumerate(found)], "gid int, lang string, source string")
    langs = sorted({lang for lang, _ in found}, key=str.encode)
    lang_of = np.array([langs.index(lang) for lang, _ in found], dtype=np.int64)

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for terms, at, gids, counts, in_docs in merged(rows, n_groups):
            pair = at * len(langs) + lang_of[gids]
            pairs, spread = summed(pair, in_docs)
            there = np.isin(pair, pairs[spread >= s.min_docs])
            order = np.argsort(pair[there], kind="stable")
            place = np.unique(pair[there][order], return_inverse=True)
            yield from kept_batches(terms.take(pa.array(place[0] // len(langs))), place[0] % len(langs), place[1], gids[there][order], counts[there][order])

    tries = kept(named.join(F.broadcast(groups), ["lang", "source"]).select("text", "gid").mapInArrow(lambda rows: counted(rows, n_groups), LEAF_SCHEMA))
    by_range = tries.repartitionByRange("term").sortWithinPartitions("term")
    leaves = kept(by_range.mapInArrow(keep, "lang int, term binary, gids array<int>, counts array<long>"))

    held = leaves.select(F.explode(F.arrays_zip("gids", "counts")).alias("x")).groupBy("x.gids").agg(F.sum("x.counts").alias("n")).collect()
    vocabulary = {r["lang"]: r["n"] for r in leaves.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = np.zeros(n_groups, dtype=np.int64)
    for r in held:
        total[r["gids"]] = r["n"]
    smooth = np.array([total[lang_of == k].sum() + 2 * vocabulary.get(k, 0) for k in range(len(langs))], dtype=np.int64)
    total[: len(found)] += 2 * np.array([vocabulary.get(k, 0) for k in lang_of], dtype=np.int64)

    def audit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((np.sum(lang_of == k),) * 2, dtype=np.int64) for k in range(len(langs))}
        first: dict[int, list[tuple[int, bytes]]] = {}
        for batch in rows:
            lang = batch.column("lang").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("gids")).to_numpy(zero_copy_only=False))
            gids, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("gids", "counts"))
            for k in np.unique(lang):
                sources, here = np.flatnonzero(lang_of == k), np.flatnonzero(lang == k)
                for some in np.array_split(here, max(1, len(here) * len(sources) // 1_000_000)):
                    inside = np.isin(row, some)
                    dense = np.zeros((len(some), len(sources)), dtype=np.int64)
                    dense[np.searchsorted(some, row[inside]), np.searchsorted(sources, gids[inside])] = counts[inside]
                    p, q = scaled(dense, total[sources]), scaled(dense.sum(axis=1), smooth[k])
                    terms = batch.column("term").take(pa.array(some))
                    rank = np.empty(len(some), dtype=np.int64)
                    rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(some))
                    for i, gid in enumerate(sources):
                        sums[k][i, i + 1 :] += apart(p[:, i : i + 1], p[:, i + 1 :]).sum(axis=0)
                        more = np.flatnonzero((dense[:, i] > 0) & (p[:, i] > q))
                        value = apart(p[more, i], q[more])
                        best = np.lexsort((rank[more], -value))[: s.top]
                        both = first.get(gid, []) + [(-int(value[b]), terms[int(more[b])].as_py()) for b in best]
                        first[gid] = heapq.nsmallest(s.top, both)
        found_rows = [(int(g), None, t, -v) for g, some in first.items() for v, t in some]
        for k, square in sums.items():
            sources = np.flatnonzero(lang_of == k)
            if square.any():
                found_rows += [(int(sources[i]), int(sources[j]), None, int(square[min(i, j), max(i, j)])) for i in range(len(sources)) for j in range(len(sources)) if i != j]
        columns = list(zip(*found_rows, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["gid", "other", "term", "value"])

    parts = kept(leaves.mapInArrow(audit, "gid int, other int, term binary, value long"))
    other = groups.select(F.col("gid").alias("other"), "lang", F.col("source").alias("item"))
    sums = parts.where("other is not null").groupBy("gid", "other").agg(F.sum("value").alias("value"))
    pairs = groups.join(F.broadcast(other), "lang").where("gid <> other").join(F.broadcast(sums), ["gid", "other"], "left")
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    term = parts.where("term is not null").join(F.broadcast(groups), "gid").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(ordered))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= s.top))


def kept_batches(terms: pa.Array, lang: np.ndarray, at: np.ndarray, gids: np.ndarray, counts: np.ndarray, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """(lang, term, gids, counts) in parts; at: the place in terms of each counter, ascending."""
    for batch, first in zip(leaf_batches(terms.cast(pa.binary()), at, gids, counts, counts, rows), range(0, len(terms), rows), strict=True):
        yield pa.RecordBatch.from_arrays([pa.array(lang[first : first + rows].astype(np.int32)), *(batch.column(c) for c in ("term", "gids", "counts"))], names=["lang", "term", "gids", "counts"])
