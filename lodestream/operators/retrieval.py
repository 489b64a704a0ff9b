"""Exact nearest neighbours by inner product of unit vectors."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import materialize, spread

#: Most queries that are sent to every task at once; more are handled in blocks.
QUERY_BLOCK = 4096


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def top_k(items: DataFrame, queries: DataFrame, item_id: str, query_id: str, vector: str, k: int) -> DataFrame:
    """``query_id, item_id, score, rank``: the k items of largest cosine for each query, ties to the smaller item id.

    Queries are a stated set: blocks of QUERY_BLOCK of them reach the driver one after the other, are broadcast and multiplied with batches of all items, each task keeps
    its k best a query, and those are ranked. Null ids and vectors take no part; a query does not find itself if ids are equal.
    """
    kind = {c: d.schema[i].dataType.simpleString() for c, d, i in (("i", items, item_id), ("q", queries, query_id))}
    qs = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).where("q is not null and v is not null")
    src = spread(items.select(F.col(item_id).alias("i"), F.col(vector).alias("v")).where("i is not null and v is not null"))
    sc = items.sparkSession.sparkContext
    stream = ((r["q"], r["v"]) for r in qs.toLocalIterator())
    done: list[DataFrame] = []
    while (part := list(itertools.islice(stream, QUERY_BLOCK))) or not done:
        held = sc.broadcast(([q for q, _ in part], _unit(np.array([v for _, v in part], dtype=float)) if part else np.zeros((0, 1))))

        def run(batches: Iterator[pd.DataFrame], held: object = held) -> Iterator[pd.DataFrame]:
            ids, m = held.value
            best: list[list[tuple]] = [[] for _ in ids]
            for b in batches:
                if not len(b) or not ids:
                    continue
                s = m @ _unit(np.stack(b["v"].to_numpy()).astype(float)).T
                own = b["i"].to_numpy()
                for j in range(len(ids)):
                    near = np.argpartition(-s[j], min(k, len(own) - 1))[: k + 1]
                    edge = s[j][near].min()
                    near = np.flatnonzero(s[j] >= edge) if len(own) > k else np.arange(len(own))
                    best[j] = sorted([*best[j], *((-s[j, x], own[x]) for x in near if own[x] != ids[j])])[:k]
            yield pd.DataFrame([(ids[j], i, -s) for j in range(len(ids)) for s, i in best[j]], columns=["q", "i", "score"])

        done.append(src.mapInPandas(run, f"q {kind['q']}, i {kind['i']}, score double"))
        if len(part) == QUERY_BLOCK:  # more may follow; only one block of queries is held at a time
            done[-1] = materialize(done[-1], "nearest")
            held.unpersist()
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "i"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("i").alias(item_id), "score", "rank")
