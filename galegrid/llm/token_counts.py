"""Token counts by heap-and-linked-list byte-pair merging; no token identifiers are made."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers.pre_tokenizers import ByteLevel

from .common import text_batches, text_of

#: Fixed value: the pieces that a byte-level vocabulary merges within. White space is Unicode's.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of pieces kept by a task (41 MB if they have ten ASCII letters), so that its memory is bounded. When half of them are new, the older half goes.
STORE_ROWS = 500_000
#: Longer pieces are counted anew each time.
STORE_BYTES = 64
#: Pieces of longer texts are taken one by one, not listed, so that a text's memory is bounded.
LISTED_SIGNS = 1_000_000
#: Code points below the first number alone, and below the second: Unicode has no letters, numbers or white space above.
BASIC, ALL = 0x10000, 0x40000
_BEYOND_BASIC = re.compile("[\U00010000-\U0010ffff]+")


def merge_ranks(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Rank of each pair of symbols, and the special strings, which are one token each."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    merges = vocabulary["model"]["merges"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
    return {pair: rank for rank, pair in enumerate(pairs)}, [t["content"] for t in vocabulary["added_tokens"]]


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next free code point from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging: initial symbols minus merges.

    The symbols form a doubly linked list. The heap holds (rank, position) of adjacent pairs; a popped pair counts only
    if its two symbols still stand there and have that rank. O(n log n) for a piece of n bytes.
    """
    n = len(symbols)
    if n < 2:
        return n
    symbols, ahead, behind = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        left = symbols[i]
        if left is None or (j := ahead[i]) == n or ranks.get((left, symbols[j])) != rank:
            continue
        symbols[i], symbols[j] = left + symbols[j], None
        merges += 1
        ahead[i] = k = ahead[j]
        if k < n:
            behind[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i))
        if (h := behind[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h))
    return n - merges


@cache
def sign_classes(below: int) -> tuple[str, str, str]:
    """Letters, numbers and white space below a code point, as ranges of a character class.

    They are what the tokenizers library takes for them, whose version of Unicode may be another than Python's: a run of signs of one
    kind stays with an "a", a "1" or an exclamation mark before it. Runs that don't are halved, down to single signs of white space.
    """
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    kinds: dict[str, list[str]] = {"a": [], "1": [], "!": [], " ": []}
    runs = regex.findall(r"\p{L}+|\p{N}+|\s+|[^\s\p{L}\p{N}]+", "".join(chr(c) for c in range(below) if not 0xD800 <= c < 0xE000))
    while runs:
        run = runs.pop()
        kind = next((sign for sign in "a1!" if len(split(sign + run)) == 1), " ")
        if kind == " " and len(run) > 1:
            runs += [run[: len(run) // 2], run[len(run) // 2 :]]
        else:
            kinds[kind].append(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}")
    return "".join(kinds["a"]), "".join(kinds["1"]), "".join(kinds[" "])


@cache
def pieces_below(point: int) -> re.Pattern[str]:
    """PIECES for texts of code points below point, with its classes written out: the standard library's matcher, which looks up a class of
    BASIC points in a table, takes about half the time of one that knows the names. One for each Python worker."""
    letters, numbers, white = sign_classes(point)
    pattern = PIECES
    for name, ranges in (
        (r"[^\s\p{L}\p{N}]", f"[^{white}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"),
        (r"\S", f"[^{white}]"), (r"\s", f"[{white}]"),
    ):
        pattern = pattern.replace(name, ranges)
    return re.compile(pattern)


@cache
def in_a_class() -> re.Pattern[str]:
    return re.compile(f"[{''.join(sign_classes(ALL))}]")


def cut(text: str) -> Iterable[str]:
    """The pieces of a text without special strings. Signs beyond BASIC that are in no class (such as emoji) need no wider one."""
    beyond = [] if text.isascii() else _BEYOND_BASIC.findall(text)
    pieces = pieces_below(ALL if beyond and in_a_class().search("".join(beyond)) else BASIC)
    return pieces.findall(text) if len(text) <= LISTED_SIGNS else (found[0] for found in pieces.finditer(text))


class Store(dict[str, int]):
    """Counts of pieces. One that isn't there is counted, and stays if it is short.

    The store itself holds the pieces met since it was last full, old those met between the last two times: a piece that comes often is
    always in one of them.
    """

    def __init__(self, of_bytes: Callable[[bytes], int]) -> None:
        super().__init__()
        self.of_bytes = of_bytes
        self.old: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            raw = piece.encode("utf-8")
            n = self.of_bytes(raw)
            if len(raw) > STORE_BYTES:
                return n
        if len(self) >= STORE_ROWS // 2:
            self.old = dict(self)
            self.clear()
        self[piece] = n
        return n


class Counter:
    """Counts tokens of texts with one vocabulary."""

    def __init__(self, path: str) -> None:
        self.ranks, special = merge_ranks(path)
        self.symbols = byte_symbols()
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known = Store(self.of_bytes)

    def of_bytes(self, raw: bytes) -> int:
        return count_merged([self.symbols[b] for b in raw], self.ranks)

    def of_text(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.known.__getitem__, cut(part))) for part in parts)


_counters: dict[str, Counter] = {}


def counter_for(path: str) -> Counter:
    """One counter for each Python worker and vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Returns (doc_id, n_bytes, n_tokens, over_limit) for each row of docs; no row is shuffled.

    vocabulary: path of a byte-level BPE .json file, the same on all executors. Special strings in a text are one token
    each. Null or empty text: 0 bytes and tokens. Long texts count whole. Null doc_id stays null; each repeated row is counted;
    an empty table gives no rows; extra columns are left out.
    """

    @F.pandas_udf(T.LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        of = counter_for(vocabulary).of_text
        return pd.Series([of(t) for t in texts], dtype="int64")

    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
