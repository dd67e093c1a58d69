"""Exact quantiles of a whole column without bringing its values together."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that the driver gets at once, at most.
AT_ONCE = 1_000_000
_ACCURACY = 10_000


def order_statistics(values: DataFrame, column: str, ranks: Sequence[int], n: int) -> dict[int, float]:
    """rank (from 0, in ascending order) -> value, of a column of n numbers without nulls.

    Of more than AT_ONCE values, approximate quantiles bracket a rank, one pass counts what lies below, at and between the bracket's ends,
    and the search goes on between them: two passes for every factor of some thousands in n. Equal values end it at once.
    """
    ranks = sorted(set(ranks))
    if n <= AT_ONCE:
        got = np.sort(values.select(F.col(column).cast("double").alias("v")).toArrow().column("v").to_numpy())
        return {r: float(got[r]) for r in ranks}
    out = {}
    for r in ranks:
        marks = [max(0.0, min(1.0, r / n + s * 2 / _ACCURACY)) for s in (-1, 1)]
        row = values.agg(F.percentile_approx(column, marks, _ACCURACY).alias("p"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
        low, high = (row["lo"] if marks[0] == 0 else row["p"][0]), (row["hi"] if marks[1] == 1 else row["p"][1])
        v = F.col(column)
        below, at_low, between, at_high = values.agg(F.count_if(v < low), F.count_if(v == low), F.count_if((v > low) & (v < high)), F.count_if(v == high)).first()
        if below <= r < below + at_low:
            out[r] = float(low)
        elif r < below or r >= below + at_low + between + at_high:
            raise RuntimeError("approximate quantiles outside their promised error")
        elif r >= below + at_low + between:
            out[r] = float(high)
        else:
            rank = r - below - at_low
            out[r] = order_statistics(values.where((v > low) & (v < high)), column, [rank], between)[rank]
    return out


def quantiles(values: DataFrame, column: str, at: Sequence[float], n: int) -> list[float | None]:
    """The quantiles with linear interpolation of a column of n numbers without nulls; nulls of none."""
    if not n:
        return [None] * len(at)
    places = [p * (n - 1) for p in at]
    got = order_statistics(values, column, [f(x) for x in places for f in (math.floor, math.ceil)], n)
    return [got[math.floor(x)] + (got[math.ceil(x)] - got[math.floor(x)]) * (x - math.floor(x)) for x in places]
