"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many rows: so there are fewer hot keys than this, whatever the data.
HOT_SHARE = 1000


def spread_join(rows: DataFrame, values: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row per key and in ``count`` the key's number of ``rows``.

    Hot keys, fewer than ``HOT_SHARE`` of them, are broadcast with their values; the rest, with at most a thousandth of
    the rows each, meet by an equi-join.  Rows without a value, or with a null key, are left out.  Both inputs should be stored.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > total
    often, seldom = values.where(hot).drop(count), values.where(~hot).drop(count)
    listed = F.broadcast(often.select(key))
    return rows.join(F.broadcast(often), key).unionByName(rows.join(listed, key, "left_anti").join(seldom, key))
