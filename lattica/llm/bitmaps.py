"""Bit maps of hashed values, of a fixed size: they thin out rows in the scan, with no false negatives, and whatever they pass in excess is for an exact
step to settle. The more values, the more they pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** BITS bits, 8 MB.
BITS = 26


def marked(rows: DataFrame, hashed: Column) -> np.ndarray:
    """The map of 64-bit hashes (nulls are left out), by their leading bits. At most 2 ** (BITS - 6) rows reach the driver."""
    place = F.shiftrightunsigned(hashed, 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    cells = rows.filter(hashed.isNotNull()).groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) >> np.uint64(64 - BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
