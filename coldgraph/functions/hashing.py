"""Integer hashes that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash rules.
SPLIT_PRIME = 7919
PAIR_PRIME = 104729
MIX_FACTOR = 2654435761
MIX_INPUT = 2147483648
MIX_OUTPUT = 4294967296


def is_integer(df, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")


def split_bucket(id_: Column) -> Column:
    """0..999; the hold-out sets ``bucket < 1000 * share`` are nested in the share.

    Ids are reduced before the multiplication, so that no id overflows.
    """
    return F.pmod(F.pmod(id_, F.lit(1000)) * F.lit(SPLIT_PRIME), F.lit(1000))


def pair_bucket(a: Column, b: Column) -> Column:
    left, right = F.pmod(a, F.lit(1000)), F.pmod(b, F.lit(1000))
    return F.pmod(left * F.lit(SPLIT_PRIME) + right * F.lit(PAIR_PRIME), F.lit(1000))


def mix(value: Column) -> Column:
    """Multiplicative hash to 32 bits."""
    low = F.pmod(value.cast("bigint"), F.lit(MIX_INPUT))
    return F.pmod(low * F.lit(MIX_FACTOR), F.lit(MIX_OUTPUT))


def mix_pair(a: Column, b: Column) -> Column:
    """Order-dependent hash of two integers, 16 good bits and more (upper half first).

    ``mix_pair(a, b)`` and ``mix_pair(b, a)`` serve as two independent hashes of one pair.
    """
    first = mix(a)
    return mix(F.shiftright(first, 3) + mix(b))
