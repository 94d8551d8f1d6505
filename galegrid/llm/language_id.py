"""Language identification as a mixture: each document's shares of languages by expectation-maximisation over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .quality import held_out

UNKNOWN = "und"
#: Characters of texts that are worked on at once; longer texts are cut for counting, and their counts added up.
BLOCK_CHARS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """bits: of the hashed space of letters with their two neighbours. smooth: added to each count. rounds: of expectation-maximisation. penalty: times half
    the logarithm of the number of letters is what a further language must gain. max_langs: learned languages at most (more: an error), as the table of
    2**bits numbers for each is sent to all tasks."""

    bits: int = 16
    smooth: float = 0.2
    rounds: int = 15
    penalty: float = 3.0
    max_langs: int = 256


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter, for each; made once in a process."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count), ascending: each letter, in lower case, with the sign before and after it, hashed; all signs but letters are alike."""
    places, cuts = [], []
    for i, text in enumerate(texts):
        low = text.lower()
        for first in range(0, len(low), BLOCK_CHARS):
            places.append(i)
            cuts.append(f"{low[first - 1] if first else ' '}{low[first : first + BLOCK_CHARS + 1]}{' ' if first + BLOCK_CHARS >= len(low) else ''}")
    keys, counts, block, owners, size = [], [], [], [], 0
    for n, (i, cut) in enumerate(zip(places, cuts, strict=True)):
        block.append(cut)
        owners.append(i)
        size += len(cut)
        if size >= BLOCK_CHARS or n == len(cuts) - 1:
            codes = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), dtype="<u4")
            is_letter = letters()[codes]
            signs = np.where(is_letter, codes, 32).astype(np.uint64)
            ends = np.cumsum([len(c) for c in block])
            inner = is_letter.copy()
            inner[ends - 1] = False  # the first and last sign of a cut are neighbours only
            inner[np.concatenate(([0], ends[:-1]))] = False
            at = np.flatnonzero(inner)
            odd = np.uint64(0x9E3779B97F4A7C15)
            mixed = ((signs[at - 1] * odd + signs[at]) * odd + signs[at + 1]) * odd
            bucket = (mixed >> np.uint64(64 - bits)).astype(np.int64)
            key, count = np.unique(np.array(owners)[np.searchsorted(ends, at, side="right")] << bits | bucket, return_counts=True)
            keys.append(key)
            counts.append(count)
            block, owners, size = [], [], 0
    if not keys:
        return (np.zeros(0, dtype=np.int64),) * 3
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(place, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
    return key >> bits, key & ((1 << bits) - 1), count


def fit_languages(docs: DataFrame, s: Settings = Settings()) -> tuple[list[str], np.ndarray | None]:
    """Languages in the order of code points, and for each gram its probability in each: (2**bits, languages). From all texts with a language that aren't
    held out; ([], None) without one. Partitions add up counts, which meet by language and gram."""
    text_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def told() -> pd.DataFrame:
            names, sizes = list(sums), [np.count_nonzero(n) for n in sums.values()]
            found = {"gram": [np.flatnonzero(n) for n in sums.values()], "n": [n[n > 0] for n in sums.values()]}
            columns = {c: np.concatenate([np.zeros(0, dtype=np.int64), *parts]) for c, parts in found.items()}
            return pd.DataFrame({"lang": np.repeat(np.array(names, dtype=object), sizes)} | columns)

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                _, gram, n = grams(list(texts), s.bits)
                np.add.at(sums.setdefault(lang, np.zeros(1 << s.bits, dtype=np.int64)), gram, n)
            if len(sums) > s.max_langs:
                yield told()
                sums.clear()
        yield told()

    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(s.max_langs + 1).collect())
    if len(langs) > s.max_langs:
        raise ValueError(f"more than {s.max_langs} languages")
    if not langs:
        return [], None
    counts = rows.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((1 << s.bits, len(langs)), s.smooth)
    place = {lang: i for i, lang in enumerate(langs)}
    columns = np.array([place[x] for x in counts["lang"].to_pylist()], dtype=np.int64)
    table[counts["gram"].to_numpy(), columns] += counts["n"].to_numpy()
    return langs, (table / table.sum(axis=0)).astype(np.float32)


def shares(chance: np.ndarray, count: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shares of its languages, and the logarithm of their likelihood. chance: (grams, languages) of all texts after one another, each from
    first on; count: of each gram."""
    sizes = np.add.reduceat(count, first)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(count))))
    share = np.full((len(first), chance.shape[1]), 1 / chance.shape[1])
    for _ in range(rounds):
        both = chance * share[owner]
        both *= (count / both.sum(axis=1))[:, None]
        share = np.add.reduceat(both, first) / sizes[:, None]
    return share, np.add.reduceat(count * np.log((chance * share[owner]).sum(axis=1)), first)


def mixtures(texts: list[str], table: np.ndarray, s: Settings) -> Iterator[tuple[int, list[tuple[int, float]], float]]:
    """(text, its languages with their shares, largest first, share of the first among all languages) of each text with a letter."""
    text, gram, count = grams(texts, s.bits)
    if not len(text):
        return
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    chance = table[gram].astype(np.float64)
    all_shares, _ = shares(chance, count, first, s.rounds)
    single = np.add.reduceat(count[:, None] * np.log(chance), first)
    best = single.argmax(axis=1)
    rows = np.arange(len(first))
    # the best single language first, then the others by their share: sets are the beginnings of this order
    rank = all_shares.copy()
    rank[rows, best] = 2.0
    order = np.argsort(-rank, axis=1, kind="stable")
    needed = s.penalty * np.log(np.maximum(2, np.add.reduceat(count, first))) / 2
    chosen = [[(int(b), 1.0)] for b in best]
    reached, open_rows = single[rows, best], rows
    owner = np.repeat(rows, np.diff(np.append(first, len(count))))
    for size in range(2, table.shape[1] + 1):
        here = np.isin(owner, open_rows)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(owner[here]) != 0)))
        sets = order[:, :size]
        share, likely = shares(np.take_along_axis(chance[here], sets[owner[here]], axis=1), count[here], starts, s.rounds)
        better = likely - reached[open_rows] > needed[open_rows]
        for i, row in enumerate(open_rows):
            if better[i]:
                chosen[row] = sorted(zip(map(int, sets[row]), share[i].tolist(), strict=True), key=lambda x: (-x[1], x[0]))
                reached[row] = likely[i]
        open_rows = open_rows[better]
        if not len(open_rows):
            break
    for row in rows:
        yield int(text[first[row]]), chosen[row], float(min(1.0, all_shares[row, chosen[row][0][0]]))


def identify_languages(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Returns (doc_id, held_out, lang_pred, score, langs, shares), a row for each row of docs.

    A document is a mixture of languages, each a distribution of letters with their neighbours that is learned from text and lang of documents that
    aren't held out; shares are estimated by expectation-maximisation. langs is the set of languages whose likelihood, less a penalty for each
    language, is highest of the sets that add languages by share; shares are theirs, and lang_pred has the largest. score is lang_pred's share in the mixture of all
    languages. lang, source and doc_id are no inputs.

    Null text, text without a letter, or no language learned: lang_pred und, score 0, no langs. Null doc_id: not held out. Null lang: not learned from.
    Equal texts have equal results; equal shares go to the lower code point. Long texts: all letters count. Empty table: no rows. Extra columns are
    left out. More than max_langs languages: ValueError.
    """
    spark = docs.sparkSession
    langs, table = fit_languages(docs, s)
    shared = spark.sparkContext.broadcast(table)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["text"].str.len().fillna(0).to_numpy()
            for _, some in batch.groupby(np.cumsum(lengths) // BLOCK_CHARS):
                found: list[tuple] = [(UNKNOWN, 0.0, [], [])] * len(some)
                if shared.value is not None:
                    for i, held, score in mixtures([t or "" for t in some["text"]], shared.value, s):
                        found[i] = (langs[held[0][0]], score, [langs[k] for k, _ in held], [v for _, v in held])
                told = pd.DataFrame(found, columns=["lang_pred", "score", "langs", "shares"], index=some.index)
                yield pd.concat([some[["doc_id", "held_out"]], told], axis=1)

    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInPandas(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>")
