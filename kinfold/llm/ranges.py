"""Shards that are ranges of ids, the same for the same rows however these are dealt out: bounds come from a sample by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of a shard, unless that makes more shards than MAX_SHARDS; rows of the sample for each shard (16 bytes each on the driver).
SHARD_BYTES, MAX_SHARDS, SAMPLE = 8_000_000, 100_000, 20


def place(key: Column, content: Column) -> tuple[Column, Column]:
    """(id, tie), both never null, whose order is: null keys, then keys ascending, rows of one key by a hash of their content.

    So rows of a key that many have are dealt out too.
    """
    low = F.lit(-(1 << 63))
    h = F.xxhash64(content)
    tie = F.when(key.isNull(), h.bitwiseOR(low)).when(key == low, h.bitwiseAND(F.lit((1 << 63) - 1))).otherwise(h)
    return F.coalesce(key, low), tie


def by_range(rows: DataFrame, size: Column, extra: DataFrame | None = None, shard_bytes: int | None = None) -> DataFrame:
    """rows (with columns _id and _tie) and then `extra` (same columns, few bytes), a partition for each shard `_shard`, from 0.

    size: a row's bytes. How many shards there are and where they begin depends on the rows' ids, ties and sizes alone.
    """
    all_ = rows if extra is None else rows.unionByName(extra)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    shards = min(MAX_SHARDS, max(1, -(-total // (shard_bytes or SHARD_BYTES))))
    if shards == 1:
        return all_.withColumn("_shard", F.lit(0)).repartitionById(1, "_shard")
    every = max(1, n // (shards * SAMPLE))
    taken = rows.where(F.pmod(F.xxhash64(F.lit(29), "_id", "_tie"), F.lit(every)) == 0).select("_id", "_tie").toArrow()
    ids, ties = (taken.column(c).to_numpy() for c in ("_id", "_tie"))
    order = np.lexsort((ties, ids))
    at = order[(np.arange(1, shards) * len(order)) // shards] if len(order) else order
    low, tie = ids[at], ties[at]

    @F.pandas_udf("int")
    def shard(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for i, t in parts:
            i, t = i.to_numpy(), t.to_numpy()
            begin, end = np.searchsorted(low, i, "left"), np.searchsorted(low, i, "right")
            out = begin.copy()
            inside = np.flatnonzero(end > begin)  # an id that itself is a bound: its ties decide
            for a in np.unique(begin[inside]):
                own = inside[begin[inside] == a]
                out[own] = a + np.searchsorted(tie[a : end[own[0]]], t[own], "right")
            yield pd.Series(out.astype(np.int32))

    return all_.withColumn("_shard", shard("_id", "_tie")).repartitionById(int(shards), "_shard")
