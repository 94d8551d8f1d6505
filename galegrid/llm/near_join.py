"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact similarity of the shingle sets decides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, one_of_equal, row_key, text_batches, text_of
from .components import components

#: Words kept hashed by a task; the store is emptied when it is full.
STORE_ROWS = 100_000
#: Rows of shingle sets that may be named in a broadcast: 24 bytes each.
BROADCAST_ROWS = 500_000
#: Products of hash functions and shingles made at once: 256 KB, so that they stay in a core's own cache.
PRODUCTS = 32_768


@dataclass(frozen=True)
class Forest:
    """trees and leaf_depth of the forest; recall is the least chance with which a pair of the threshold's similarity must
    meet in a node; cell, cell_shingles: shingle sets, and shingles in all, of one side of a block of comparisons (about)."""

    words: int = 5
    threshold: float = 0.8
    trees: int = 24
    leaf_depth: int = 8
    recall: float = 0.999
    cell: int = 256
    cell_shingles: int = 500_000
    seed: int = 11

    def chance(self, depth: int, similarity: float | None = None) -> float:
        """With which a pair of a similarity (the threshold's, without one) shares a prefix of depth in some tree."""
        return 1 - (1 - (similarity or self.threshold) ** depth) ** self.trees

    def depth(self) -> int:
        """The longest prefix, from the leaves up, at which even pairs of the threshold's similarity meet with recall: no table
        needs shorter ones."""
        for depth in range(self.leaf_depth, 0, -1):
            if self.chance(depth) >= self.recall:
                return depth
        raise ValueError("the forest has too few trees for this recall")

    def bits(self) -> list[int]:
        """Bits of each minimum in a path of 64: 4, and those up to depth() share what is left, so that the shortest prefixes tell
        most apart."""
        if 4 * self.leaf_depth > 64:
            raise ValueError("a path has room for 16 minima")
        depth = self.depth()
        return [4 + (64 - 4 * self.leaf_depth) // depth * (i < depth) for i in range(self.leaf_depth)]

    def shift(self, level: int) -> int:
        """Bits by which a path is shifted right to leave its prefix of level."""
        return 64 - sum(self.bits()[:level])

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.trees * self.leaf_depth
        return rng.integers(0, 2**63, n, dtype=np.uint64) * 2 + 1, rng.integers(0, 2**63, n, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= STORE_ROWS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: each bit of the input moves all bits above."""
    x = (x ^ (x >> _MIX[2])) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of words; a shorter text is one run; no words: none."""
    split = text.split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, split), dtype=np.uint64, count=len(split))
    k = min(words, len(h))
    run = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        run = _mixed(run * _MIX[0] + h[i : len(h) - k + 1 + i])
    run.sort()
    return run[np.concatenate(([True], run[1:] != run[:-1]))]


def tree_paths(sets: np.ndarray, forest: Forest, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The path of a shingle set in each tree: some bits of each of that tree's minima, the first of them highest. So paths sort as
    tries do, and a shorter prefix is the path shifted right. (Bits that are equal by chance only make a node larger.)"""
    least = np.empty(len(a), dtype=np.uint64)
    step = min(len(a), max(1, PRODUCTS // len(sets)))
    room = np.empty((step, len(sets)), dtype=np.uint64)
    for lo in range(0, len(a), step):
        products = room[: len(a) - lo]
        np.bitwise_xor(sets, b[lo : lo + step, None], out=products)
        np.multiply(products, a[lo : lo + step, None], out=products)
        least[lo : lo + step] = products.min(axis=1)
    bits = np.array(forest.bits(), dtype=np.uint64)
    left = np.uint64(64) - np.cumsum(bits, dtype=np.uint64)
    minima = (least >> np.uint64(8)).reshape(forest.trees, -1)
    path = np.bitwise_or.reduce((_mixed(minima * _MIX[0]) >> (np.uint64(64) - bits)) << left, axis=1)
    return path.view(np.int64)


def signatures(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, rid, set_id, n, paths) for each row: set_id names the shingle set, n is its size."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = forest.hashes()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(text, forest.words)
                rows.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), tree_paths(s, forest, a, b) if len(s) else None))
            yield pd.concat([batch[["doc_id", "rid"]].reset_index(drop=True), pd.DataFrame(rows, columns=["set_id", "n", "paths"])], axis=1)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("rid"), text_of().alias("text"))
    # doc_id travels as text: a null among longs would make them floats
    return (
        rows.withColumn("doc_id", F.col("doc_id").cast("string"))
        .mapInPandas(sign, "doc_id string, rid long, set_id binary, n long, paths array<long>")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of wanted (rep, w_doc, w_rid), read again from the texts; shingles: 8 bytes each."""
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("rid"), text_of().alias("text"))
    match = rows.doc_id.eqNullSafe(F.col("w_doc")) & (rows.rid == F.col("w_rid"))
    texts = rows.join(F.broadcast(wanted) if small else wanted, match).select("rep", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rep": batch["rep"], "shingles": [shingles(t, words).tobytes() for t in batch["text"]]})

    return texts.mapInPandas(sets, "rep long, shingles binary").dropDuplicates(["rep"])


def shared_prefix(paths: np.ndarray, i: np.ndarray, j: np.ndarray, shift: int) -> np.ndarray:
    """Whether the pairs i, j share the prefix that shift leaves, in each of the trees given."""
    return (paths[i] ^ paths[j]) >> np.uint64(shift) == 0


def compare_cell(cell: pd.DataFrame, forest: Forest, level: int) -> pd.DataFrame:
    """Links among the shingle sets of one cell: for each its links' weight, the smallest linked set it connects to, and the least
    similarity of these links (null: none).

    A cell is a node's sets of two blocks (or one block with itself); pairs that share a longer prefix in any tree, or one of this
    length in an earlier tree, are counted there. Shared shingles are counted by products of 0/1 matrices, a few thousand shingles
    at a time; shingles that one set alone has can't be shared and are left out.
    """
    cell = cell.sort_values("rep", ignore_index=True)
    tree, lo, hi = int(cell["tree"].iloc[0]), int(cell["lo"].iloc[0]), int(cell["hi"].iloc[0])
    rep, weight, m = cell["rep"].to_numpy(), cell["size"].to_numpy(), len(cell)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in cell["shingles"]]
    sizes = np.array([len(s) for s in sets])
    ids, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, often = np.repeat(np.arange(m), sizes), times >= 2
    number = np.cumsum(often) - 1
    use = often[inverse]
    owner, inverse = owner[use], number[inverse[use]]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    shared, step = np.zeros((m, m), dtype=np.float32), 4096
    for first in range(0, int(often.sum()), step):
        a, b = np.searchsorted(inverse, (first, first + step))
        part = np.zeros((m, step), dtype=np.float32)
        part[owner[a:b], inverse[a:b] - first] = 1
        shared += part @ part.T
    union = sizes[:, None] + sizes[None, :] - shared
    linked = np.triu(shared >= forest.threshold * union - 1e-6, 1)
    if lo != hi:
        block = cell["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    i, j = np.nonzero(linked)
    root = np.arange(m)
    for x, y in zip(i, j, strict=True):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        root[max(x, y)] = min(x, y)
    for x in range(m):
        root[x] = root[root[x]]
    if len(i):
        paths = np.stack(cell["paths"].to_numpy()).view(np.uint64)
        met = shared_prefix(paths[:, :tree], i, j, forest.shift(level)).any(axis=1)
        if level < forest.leaf_depth:
            met |= shared_prefix(paths, i, j, forest.shift(level + 1)).any(axis=1)
        i, j = i[~met], j[~met]
    links = np.bincount(i, weights=weight[j], minlength=m) + np.bincount(j, weights=weight[i], minlength=m)
    weakest = np.full(m, np.inf)
    for ends in (i, j):
        np.minimum.at(weakest, ends, shared[i, j] / union[i, j])
    return pd.DataFrame({"rep": rep, "links": links.astype(np.int64), "root": rep[root], "weakest": np.where(weakest < np.inf, weakest, None)})


def open_nodes(members: DataFrame, forest: Forest, level: int) -> DataFrame:
    """(tree, prefix, m, total) of the nodes at level with two members or more that haven't all met: each member is held
    against one of the node's, and a bit for each tree says whether they share this level's prefix, or the next longer one."""
    key = ["tree", "prefix"]
    powers = F.array(*[F.lit(1 << t).cast("long") for t in range(forest.trees)])

    def trees_shared(at: int):
        same = F.zip_with("paths", "first_paths", lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), forest.shift(at)) == 0)
        bits = F.zip_with(same, powers, lambda s, p: F.when(s, p).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)

    firsts = members.groupBy(*key).agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.first("paths").alias("first_paths")
    ).where("m > 1")
    longer = trees_shared(level + 1) if level < forest.leaf_depth else F.lit(0).cast("long")
    held = members.join(firsts, key).select(*key, "m", "total", trees_shared(level).alias("here"), longer.alias("longer"))
    earlier = F.expr("cast(shiftleft(1L, tree) - 1 as long)")
    return (
        held.groupBy(*key).agg(F.first("m").alias("m"), F.first("total").alias("total"), F.bit_and("here").alias("here"), F.bit_and("longer").alias("longer"))
        .where((F.col("longer") == 0) & (F.col("here").bitwiseAND(earlier) == 0)).select(*key, "m", "total")
    )


def compare_level(members: DataFrame, texts: DataFrame, forest: Forest, level: int) -> DataFrame:
    """(rep, links, root, weakest, level) of the members of open nodes at level, compared."""
    here = members.withColumn("prefix", F.shiftrightunsigned("path", forest.shift(level)))
    fresh = kept(open_nodes(here, forest, level))
    blocks = F.ceil(F.greatest(F.col("m") / forest.cell, F.col("total") / forest.cell_shingles)).cast("int")
    key = ["tree", "prefix", "lo", "hi"]
    cells = (
        here.join(fresh, ["tree", "prefix"])
        .withColumn("blocks", F.least(blocks, F.col("m"))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .select(*key, "block", "rep", "size", "paths")
        .join(texts, "rep")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells stand one after the other; the last of a batch may go on in the next."""
        waiting = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(batch)]
            if waiting and (waiting[0][key].iloc[0].to_numpy() != keys[0]).any():
                yield compare_cell(pd.concat(waiting), forest, level)
                waiting = []
            done = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.iloc[a:b]
                if b == len(batch):
                    waiting.append(part)
                elif waiting:
                    done.append(compare_cell(pd.concat([*waiting, part]), forest, level))
                    waiting = []
                else:
                    done.append(compare_cell(part, forest, level))
            if done:
                yield pd.concat(done)
        if waiting:
            yield compare_cell(pd.concat(waiting), forest, level)

    found = cells.repartition(*key).sortWithinPartitions(*key).mapInPandas(compare, "rep long, links long, root long, weakest double")
    return kept(found.groupBy("rep", "root").agg(F.sum("links").alias("links"), F.min("weakest").alias("weakest")).withColumn("level", F.lit(level)))


def reached(found: DataFrame, forest: Forest, level: int) -> float:
    """The recall that the links found so far show, down to level: the chance with which pairs like the weakest of them meet by a prefix
    of level. Without a link nothing is known, and it is that of the threshold."""
    weakest = found.agg(F.min("weakest")).first()[0]
    return forest.chance(level, None if weakest is None else max(weakest, forest.threshold))


def jaccard_join(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """Joins documents whose sets of five-word runs have a Jaccard similarity of threshold or more.

    Returns (doc_id, rid, class_id, n_links, level), a row for each row of docs: class_id is the smallest doc_id of those that
    links connect, n_links the number of other rows that the row is linked to, level the shortest prefix at which the row was
    compared (null: never). Words are what white space separates; a text of fewer words is one run. A text without words (null,
    empty) has no links and is its own class, as is a row without links. Rows with the same set are linked; repeated rows too. Null
    doc_id: after all others. Long texts count whole. Empty table: no rows. Extra columns are left out.

    Rows with one shingle set are one class member (rep) from the start, so copies cost one row. Each rep has a path of minima in each
    tree; paths, sorted, are the tree's trie. Prefixes are matched at the leaves first, and what shares one is compared. Then they are
    shortened, a level in each round, for those reps alone that a shorter one brings together with a rep they haven't met. After
    each round the verified links say what recall is reached: rounds end when pairs as weak as the weakest link met so far meet with
    a chance of recall, so a table of closer copies ends at longer prefixes; depth() is where any table ends. A node's reps are dealt in
    blocks of bounded number and size, and a cell compares two blocks, so a node of any size is many bounded tasks and no pair is
    written: a cell returns sums of links and a spanning forest. Similarity is exact; a pair no weaker than the weakest link
    found is missed with a chance of 1 - recall at most, and one of the threshold's similarity, where the rounds end at level, with
    1 - chance(level): a link so weak that is met anywhere sends the rounds on.
    """
    text_batches(docs.sparkSession)
    rows = kept(signatures(docs, forest))
    sets = kept(
        rows.groupBy("set_id").agg(
            F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("paths").alias("paths"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")).alias("who"),
        ).withColumn("rep", F.monotonically_increasing_id())
    )
    # what meets nothing by the shortest prefix that any table needs meets nothing by longer ones
    node = F.shiftrightunsigned("path", forest.shift(forest.depth()))
    spread = sets.where("n > 0").select("rep", F.posexplode("paths").alias("tree", "path")).withColumn("node", node)
    crowded = kept(spread.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    tries = spread.join(crowded, ["tree", "node"]).drop("node").join(sets.select("rep", "size", "n", "paths"), "rep")
    members = kept(tries.sortWithinPartitions("tree", "path"))
    wanted = kept(members.select("rep").distinct().join(sets.select("rep", F.col("who.doc_id").alias("w_doc"), F.col("who.rid").alias("w_rid")), "rep"))
    texts = kept(shingle_sets(docs, wanted, forest.words))
    level = forest.leaf_depth
    found = compare_level(members, texts, forest, level)
    while level > forest.depth() and reached(found, forest, level) < forest.recall:
        level -= 1
        found = found.unionByName(compare_level(members, texts, forest, level))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"), F.min("level").alias("level"))
    joined = (
        sets.select("set_id", "rep", "size", "n", "who")
        .join(links, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("root", F.coalesce("root", "rep"))
    )
    heads = joined.groupBy("root").agg(F.min(F.struct(F.col("who.no").alias("no"), F.col("who.doc_id").alias("doc_id"))).alias("head"))
    classes = kept(joined.join(heads, "root").select("set_id", "size", "links", "level", F.col("head.doc_id").alias("class_id")))
    empty = F.col("n") == 0
    return rows.select("doc_id", "rid", "set_id", "n").join(classes, "set_id").select(
        "doc_id", "rid",
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), "level",
    )


def one_of_each(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row of docs for each class, that of the smallest doc_id, with the columns of docs. Of texts without words, and
    of rows with a null doc_id that head their class, all stay but equal rows. An empty table gives no rows."""
    verdict = jaccard_join(docs, forest).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).withColumns(row_key(F.col("doc_id"), F.col("rid")))
    return one_of_equal(docs.withColumns(row_key(F.col("doc_id").cast("long"), F.xxhash64(text_of()))), verdict)
