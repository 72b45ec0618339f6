"""Arrays and lists: padded prompts, sources that stand in for each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tokens that begin and end a prompt, and how many tokens a prompt has.
BEGIN, END, PROMPT_TOKENS = 49406, 49407, 77


def padded_prompt(ids: Column, size: int = PROMPT_TOKENS, begin: int = BEGIN, end: int = END) -> Column:
    """The ids between a begin and an end, which are added where they lack, cut or filled with 0 to ``size``."""
    opened = F.when(F.get(ids, F.lit(0)).eqNullSafe(F.lit(begin)), ids).otherwise(F.concat(F.array(F.lit(begin)), ids))
    closed = F.when(F.element_at(opened, -1) == end, opened).otherwise(F.concat(opened, F.array(F.lit(end))))
    return F.slice(F.concat(closed, F.array_repeat(F.lit(0), size)), 1, size)


def first_given(rows: DataFrame, others: DataFrame, key: str = "video_id") -> DataFrame:
    """``rows``, and ``others`` for the keys that have none."""
    return rows.unionByName(others.join(rows.select(key).distinct(), key, "left_anti"))


def merge_last_two(lists: Column, merged) -> Column:
    """An array whose last two elements are made one by ``merged``; shorter ones stay."""
    n = F.size(lists)
    return F.when(n >= 2, F.concat(F.slice(lists, 1, n - 2), F.array(merged(F.element_at(lists, -2), F.element_at(lists, -1))))).otherwise(lists)
