"""Random draws that any engine repeats: uniforms from md5."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 48 bits of md5('seed:key')."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12), 16, 10).cast("double")
    return (bits + 1) / F.lit(float(2**48 + 1))


def graph_level(key: Column, m: int, seed: int = 42, cap: int = 30) -> Column:
    """The top layer of a graph node: geometric with ratio 1/m."""
    return F.least(F.floor(-F.log(uniform(key, seed)) / log(m)), F.lit(cap)).cast("int")
