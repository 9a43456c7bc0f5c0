"""Edit distance of texts of any length, bit-parallel, in Arrow batches.

A column of the distance table is two big integers: where it rises and where it falls
by one from row to row (Myers 1999, in Hyyrö's form of 2003). A column holds only the band
of rows that a cheapest path can cross (Ukkonen 1985): a first, narrow band gives the cost of some
path, and a path of no more cost leaves no band of that width, so a result within it is exact, and
else the band is widened until it is. A step takes a dozen and a half operations on integers of as many bits as
the band has rows, so a pair costs the shorter length times the distance over the machine's word at
most about twice, and memory in proportion to its lengths. Nothing is cut or estimated.

Spark's own ``levenshtein`` takes pairs whose lengths have a small product: below
SMALL it is faster and stays in the JVM. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import text

#: Products of lengths up to this are left to the JVM: about a millisecond either way.
SMALL = 1 << 18


def numbers(left: Sequence[Hashable], right: Sequence[Hashable]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of both sides as numbers from 0."""
    known = dict(zip(dict.fromkeys([*left, *right]), count()))
    return tuple(np.fromiter((known[s] for s in side), np.int64, len(side)) for side in (left, right))


def code_points(value: str) -> np.ndarray:
    return np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def edit_distance(left: np.ndarray, right: np.ndarray) -> int:
    """Insertions, deletions and replacements that turn one array of symbols into the other."""
    n = min(len(left), len(right))
    differ = np.flatnonzero(left[:n] != right[:n])
    start = int(differ[0]) if len(differ) else n
    left, right, n = left[start:], right[start:], n - start
    differ = np.flatnonzero(left[len(left) - n :][::-1] != right[len(right) - n :][::-1])
    end = int(differ[0]) if len(differ) else n
    left, right = left[: len(left) - end], right[: len(right) - end]
    if len(left) < len(right):
        left, right = right, left
    if not len(right):
        return len(left)
    spare = max(LEAST_SPARE, len(left) >> 5)
    while True:
        found = banded(left, right, spare)
        # a path that leaves the band costs at least two more than twice the spare rows and the difference in length
        needed = (found - len(left) + len(right)) // 2
        if needed <= spare or spare >= len(right):
            return found
        spare = min(needed, 4 * spare + 1)


#: Rows that a first band has on each side beyond the difference in length, at least.
LEAST_SPARE = 32
#: Rows whose symbols are turned into bits at once, at least.
BLOCK = 1 << 11


def places(symbols: np.ndarray) -> dict[int, int]:
    """The bits of each symbol's places."""
    order = np.argsort(symbols, kind="stable")
    known, first, counts = np.unique(symbols[order], return_index=True, return_counts=True)
    found = {}
    for symbol, at, n in zip(known.tolist(), first.tolist(), counts.tolist(), strict=True):
        own = order[at : at + n]
        if n < 8:
            bits = 0
            for i in own.tolist():
                bits |= 1 << i
        else:
            mark = np.zeros(len(symbols), bool)
            mark[own] = True
            bits = int.from_bytes(np.packbits(mark, bitorder="little").tobytes(), "little")
        found[symbol] = bits
    return found


def banded(left: np.ndarray, right: np.ndarray, spare: int) -> int:
    """The least cost of the paths within ``spare`` rows of the two corners' diagonals; ``left`` is not the shorter side."""
    m, n = len(left), len(right)
    # column j holds the rows from j - spare on; those before the first row are as if the table went on there
    width = m - n + 2 * spare + 1
    whole = (1 << width) - 1
    rises, falls = whole >> spare << spare, 0
    block = max(BLOCK, width)
    level = 0
    for start in range(0, n, block):
        # rows start - spare + 1 to start - spare + block + width, as bits from 0
        low = start - spare
        own = places(left[max(low, 0) : max(low + block + width, 0)])
        ahead = max(-low, 0)
        own = {s: bits << ahead for s, bits in own.items()} if ahead else own
        for j, symbol in enumerate(right[start : start + block].tolist()):
            match = own.get(symbol, 0) >> j
            diagonal = ((((match & rises) + rises) ^ rises) | match | falls) & whole
            level += diagonal & 1
            up, down, diagonal_next = falls | (whole ^ (diagonal | rises)), diagonal & rises, diagonal >> 1
            rises = down | (whole ^ (diagonal_next | up))
            falls = diagonal_next & up
    # along the first diagonal of the band, then from there up to the last row
    rest = (1 << m - n + spare) - 1
    return n - level + (rises & rest).bit_count() - (falls & rest).bit_count()


@F.pandas_udf(LongType())
def _character_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edit_distance(code_points(a), code_points(b)) for a, b in zip(left, right, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def _word_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(*numbers(a.split(" ") if a else [], b.split(" ") if b else [])) for a, b in zip(left, right, strict=True)], dtype="Int64")


def characters(left: Column, right: Column) -> Column:
    """Edit distance of two texts of any length, in characters."""
    left, right = (F.coalesce(c, F.lit("")) for c in (left, right))
    # lengths of UTF-16 would do; bytes are never fewer than characters
    small = F.octet_length(left).cast("long") * F.octet_length(right) <= SMALL
    long_ones = [F.when(~small, c) for c in (left, right)]
    return F.coalesce(F.when(small, F.levenshtein(left, right)).cast("long"), _character_distance(*long_ones))


def words(left: Column, right: Column) -> Column:
    """Edit distance of two normalised texts of any length, in words between single spaces."""
    return _word_distance(left, right)


def with_rates(rows: DataFrame, reference: str, hypothesis: str, profile: str = "standard") -> DataFrame:
    """The rows with distance, cer, wer and accuracy of texts of any length.

    Texts are normalised once, in a projection of their own; ``distance`` counts characters.
    """
    names = rows.columns
    normal = rows.select("*", text.normalize(F.col(reference), profile).alias("r_"), text.normalize(F.col(hypothesis), profile).alias("h_"))
    found = normal.select(*names, characters(F.col("r_"), F.col("h_")).alias("distance"), words(F.col("r_"), F.col("h_")).alias("words_"), *[
        n.alias(a) for a, n in (("r_size_", F.length("r_")), ("h_size_", F.length("h_")), ("r_words_", F.size(text.tokens(F.col("r_")))))
    ])
    empty = F.col("h_size_") == 0
    cer = text.rate(F.col("distance").cast("double"), F.col("r_size_"), empty)
    wer = text.rate(F.col("words_").cast("double"), F.col("r_words_"), empty)
    return found.select(*names, "distance", cer.alias("cer"), wer.alias("wer"), text.accuracy(cer).alias("accuracy"))
