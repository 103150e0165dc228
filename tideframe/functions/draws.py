"""Random draws by key: the same in every run, partitioning and SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by |: an order that looks random."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def draw_int(*parts: Column | str | int) -> Column:
    """0 to 2^32 - 1, from the first 8 hex digits of the key."""
    return F.conv(F.substring(draw_key(*parts), 1, 8), 16, 10).cast("bigint")


def draw_unit(*parts: Column | str | int) -> Column:
    """[0, 1)."""
    return draw_int(*parts) / F.lit(4294967296.0)
