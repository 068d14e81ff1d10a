"""Portable seeded randomness: every draw is a function of an md5 key, never of row order.

The same text hashed by any engine gives the same draw, so simulated results can be
recomputed in plain SQL, on any partition count, and after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def key_text(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def rank_key(*parts: Column | str | int) -> Column:
    """Hash to order by when drawing without replacement."""
    return F.md5(key_text(*parts))


def draw_bits(*parts: Column | str | int) -> Column:
    """The first 60 bits of the md5 as a number."""
    return F.conv(F.substring(F.md5(key_text(*parts)), 1, 15), 16, 10).cast("bigint")


def index_of(bits: Column, size: Column) -> Column:
    """Uniform number in 1..size from such bits."""
    return F.try_mod(bits, size) + 1
