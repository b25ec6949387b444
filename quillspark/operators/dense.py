"""Exact cosine search of a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quillspark.session import packed, saved_parts, settled

BLOCK = 4096  # queries that go to the tasks at once; more are taken in several passes
AT_ONCE = 1024  # of them, whose products with a batch of rows are in memory at once


def blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[list[Row]]:
    """The queries in lists of at most ``size``, one list on the driver at a time; at least one list."""
    rows = queries.toLocalIterator()
    block = list(islice(rows, size))
    yield block
    while block := list(islice(rows, size)):
        yield block


def top_dense(queries: DataFrame, rows: DataFrame, query: str, query_vector: str, key: str, vector: str, n: int, within: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """``query, key, cos, vec_rank``: the ``n`` rows of highest cosine (9 digits), ties by the smaller key.

    Vectors must be usable and of one length (see ``usable_vector``); one that is all zero has cosine 0 with any. Each
    task, of which there are no more than cores, keeps the ``n`` best of its own rows per query, so only these are stored and shuffled. Queries come in blocks of bounded
    size, each of which is searched and written before the next is fetched; rows are never collected. With ``within``
    (query, group) a query is compared with the rows of its groups only, ranks are those in each, and ``group`` is a
    column of the result. The result is stored.
    """
    scope = [query] + [group] * bool(group)
    kinds = dict(queries.dtypes) | dict(rows.dtypes)
    asked = queries.select(query, query_vector).where(F.col(query_vector).isNotNull())
    if group:
        asked = asked.join(within.groupBy(query).agg(F.collect_set(group).alias("_groups")), query)  # as many as a query's routes
    source = packed(rows.select(*[group] * bool(group), key, vector))

    def found(block: list[Row]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in block])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared.value
            if not own:
                return
            names = np.array([r[0] for r in own])
            q = np.array([r[1] for r in own], np.float64)
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            asks: dict = {}
            for i, r in enumerate(own):
                for g in r[2] if group else [None]:
                    asks.setdefault(g, []).append(i)
            pairs = sum(map(len, asks.values()))
            best: list[pd.DataFrame] = []
            held = 0
            for batch in batches:
                parts = batch.groupby(group, sort=False) if group else [(None, batch)]
                for g, part in parts:
                    every = np.array(asks.get(g, ()), np.int64)
                    if not len(every) or not len(part):
                        continue
                    x = np.stack(part[vector].to_list()).astype(np.float64)
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    keys = part[key].to_numpy()
                    order = np.argsort(keys, kind="stable")
                    for a in range(0, len(every), AT_ONCE):
                        who = every[a : a + AT_ONCE]
                        cos = np.round(q[who] @ x[order].T, 9)
                        if len(keys) > n:  # all rows at the n-th value stay, lest a tie is lost
                            least = np.partition(cos, len(keys) - n, axis=1)[:, [len(keys) - n]]
                            i, j = np.nonzero(cos >= least)
                        else:
                            i, j = (a.ravel() for a in np.indices(cos.shape))
                        best.append(pd.DataFrame({query: names[who[i]], **({group: g} if group else {}), key: keys[order][j], "cos": cos[i, j]}))
                        held += len(i)
                if held > 4 * n * pairs:
                    best = [_best(pd.concat(best), scope, key, n)]
                    held = len(best[0])
            if best:
                yield _best(pd.concat(best), scope, key, n)

        return source.mapInPandas(search, ", ".join(f"`{c}` {kinds[c]}" for c in [*scope, key]) + ", cos double")

    def ranked() -> DataFrame:
        every = saved_parts((found(block) for block in blocks(asked)), "dense-best")
        by = Window.partitionBy(*scope).orderBy(F.desc("cos"), F.asc(key))
        return every.withColumn("cos", F.col("cos") + 0.0).withColumn("vec_rank", F.row_number().over(by)).where(F.col("vec_rank") <= n)

    return settled(rows.sparkSession, ranked, "dense")


def _best(x: pd.DataFrame, scope: list[str], key: str, n: int) -> pd.DataFrame:
    x = x.sort_values([*scope, "cos", key], ascending=[True] * len(scope) + [False, True])
    return x[x.groupby(scope).cumcount() < n]
