"""Floor-rank percentiles and robust ranges.

The percentile p of n sorted values is the one at floor((n - 1) * p). It is neither the discrete
percentile (which rounds up) nor the interpolated one, so it is taken from the sorted values of a
group; groups are bounded by a video's samples or units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.functions.scalars import apply_range


def floor_rank(value: str | Column, p: float) -> Column:
    """Aggregate: the floor-rank percentile of the group's values."""
    values = F.sort_array(F.collect_list(value))
    return F.element_at(values, F.floor((F.size(values) - 1) * F.lit(p)).cast("int") + 1)


def ranges(rows: DataFrame, keys: list[str], names: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """keys, <name>_lo, <name>_hi for each name: one aggregation for all names, each sorted once."""
    return floor_ranks(rows, keys, {f"{n}_{s}": (n, p) for n in names for p, s in ((low, "lo"), (high, "hi"))})


def floor_ranks(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """keys and for each name wanted the percentile of a column; a column's values are sorted once for all its percentiles."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    held = rows.groupBy(*keys).agg(*[F.sort_array(F.collect_list(c)).alias(f"_sorted_{c}") for c in columns])
    place = lambda values, p: F.element_at(values, F.floor((F.size(values) - 1) * F.lit(p)).cast("int") + 1)
    return held.select(*keys, *[place(F.col(f"_sorted_{c}"), p).alias(name) for name, (c, p) in wanted.items()])


def normalize(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``names`` brought to 0..1 by the 5th and 95th percentile of their group."""
    fitted = rows.join(ranges(rows, keys, names).hint("merge"), keys)
    others = [c for c in rows.columns if c not in names]
    return fitted.select(*others, *[apply_range(F.col(n), F.col(f"{n}_lo"), F.col(f"{n}_hi")).alias(n) for n in names])
