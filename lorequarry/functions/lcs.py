"""The longest common subsequence, bit-parallel.

One row of the table is a number whose bit ``j`` is unset where the row grows at
character ``j`` of the longer string; a character of the shorter one updates all
of it by one sum.  Python's whole numbers are words of any count, so strings of up
to a machine word take one step a character, and longer ones a step a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


@lru_cache(4096)
def _places(text: str) -> dict[str, int]:
    """For each character, a number with its places set."""
    found: dict[str, int] = {}
    for j, ch in enumerate(text):
        found[ch] = found.get(ch, 0) | 1 << j
    return found


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence of two strings."""
    if len(a) > len(b):
        a, b = b, a
    places, full = _places(b), (1 << len(b)) - 1
    row = full
    for ch in a:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.arrow_udf(IntegerType())
def _lcs_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        yield pa.array([None if a is None or b is None else lcs(a, b) for a, b in pairs], pa.int32())


def lcs_length(a: Column, b: Column) -> Column:
    """``lcs`` of each row; null, and free of cost, where either is null."""
    return _lcs_of(a, b)
