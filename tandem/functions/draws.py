"""Seeded draws that Spark and other engines compute alike: the leading 60 bits of an MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chances are compared in steps of this fraction.
STEPS = 1 << 20


def draw(*values: str | Column, seed: int = 0) -> Column:
    """A number from 0 to 2**60 - 1 for each combination of the values."""
    text = F.concat_ws("|", *[(F.col(v) if isinstance(v, str) else v).cast("string") for v in values], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draw_sql(*values: str, seed: int = 0) -> str:
    text = " || '|' || ".join(f"CAST({v} AS VARCHAR)" for v in values)
    return f"CAST('0x' || substr(md5({text} || '|{seed}'), 1, 15) AS BIGINT)"
