"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, stored


@dataclass
class MultiIndex:
    """Centroids of both vector halves and the number of indexed rows in each pair of centroids."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray
    rows: DataFrame


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None]


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _squares(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id long, v array<double>: rows with an id whose vector is not null, not zero, finite and of the usual length."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def build(df: DataFrame, id_col: str, vector_col: str, sample: int = 20_000, cell_rows: int = 12, fewest: int = 64, most: int = 256) -> MultiIndex | None:
    """Index every usable row; None if there is none.

    Each half of the vectors is quantised by k-means of its own, fitted on about `sample` rows chosen by a hash of the
    id. The number of centroids makes `cell_rows` rows a pair on average, between `fewest` and `most` centroids a half
    but no more than a quarter of the sample, so the sizes of all pairs (most ** 2 numbers) are what the driver keeps. Rows with a null id, and vectors that are null, zero, of
    another length than most or hold null or non-finite components are not indexed. Repeated rows are indexed each and
    found each; other columns are not read, whatever their names.
    """
    rows = usable(df, id_col, vector_col)
    n = rows.count()
    if not n:
        return None
    part = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))
    fit = np.array([r["v"] for r in part.select("v").collect()] or [rows.first()["v"]])
    half = fit.shape[1] // 2
    k = int(min(np.clip(round((n / cell_rows) ** 0.5), fewest, most), max(1, len(fit) // 4)))
    first, second = k_means(fit[:, :half], k), k_means(fit[:, half:], k)

    def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
        cell = _squares(x[:, :half], first).argmin(1) * k + _squares(x[:, half:], second).argmin(1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32())], ["id", "v", "cell"])

    indexed = stored(map_batches(rows, cells, "id long, v array<double>, cell int"), "index")
    sizes = np.zeros(k * k, np.int64)
    for r in indexed.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    return MultiIndex(first, second, sizes, indexed)


def visit(q: np.ndarray, index: MultiIndex, enough: int) -> list[int]:
    """The non-empty pairs of centroids by ascending sum of squared distances, until they hold `enough` rows."""
    k, half = len(index.first), index.first.shape[1]
    d1, d2 = ((index.first - q[:half]) ** 2).sum(1), ((index.second - q[half:]) ** 2).sum(1)
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, found, out = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and found < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * k + int(o2[j])
        if index.sizes[cell]:
            out.append(cell)
            found += int(index.sizes[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < k and b < k and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


def _blocks(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell and its number of blocks: small cells share a block, large ones get several."""
    first, many, block, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, block_rows
    for cell, n in enumerate(sizes.tolist()):
        if n > block_rows:
            block += room < block_rows
            first[cell], many[cell] = block, -(-n // block_rows)
            block, room = block + int(many[cell]), block_rows
        else:
            if n > room:
                block, room = block + 1, block_rows
            first[cell], room = block, room - n
    return first, many


def search(index: MultiIndex, queries: DataFrame, k: int = 10, share: float = 0.5, block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """The k nearest rows found for each query (id long, v array<double>): query_id, rank, vec_id, score.

    Each query visits pairs of centroids until they hold more than `share` of the index, and reranks all rows of these
    by Euclidean distance in double precision; ties go to the smaller id, and a query's own id is left out.
    Cells are dealt to blocks of about `block_rows` rows, a cell with more rows to several, and the queries of a block
    are dealt to parts of about `query_rows`, so no cell, however many rows share it, becomes one task. Queries with the
    same id count as one, the one whose vector sorts first; repeated vectors under different ids are all candidates.
    """
    visiting = queries.groupBy("id").agg(F.min("v").alias("v"))
    spark = index.rows.sparkSession
    bare = MultiIndex(index.first, index.second, index.sizes, None)
    enough = int(share * index.sizes.sum()) + k + 1  # the query's own row and k others at least
    first, many = _blocks(index.sizes, block_rows)

    def plan(batch: pa.RecordBatch) -> pa.Table | None:
        x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
        rows, blocks, cells = [], [], []
        for row, q in enumerate(x):
            own = np.array(visit(q, bare, enough), np.int64)
            per_block: dict[int, list[int]] = {}
            for cell in own.tolist():
                for b in range(int(first[cell]), int(first[cell] + many[cell])):
                    per_block.setdefault(b, []).append(cell)
            for b, c in per_block.items():
                rows.append(row)
                blocks.append(b)
                cells.append(np.array(c, "<i4").tobytes())
        at = pa.array(rows, pa.int64())
        return pa.table({"block": pa.array(blocks, pa.int32()), "id": batch.column(0).take(at), "v": batch.column(1).take(at), "cells": pa.array(cells, pa.binary())})

    asked = stored(map_batches(visiting, plan, "block int, id long, v array<double>, cells binary"), "asked")
    # The driver gets a row for each block; there are about as many as sizes.sum() / block_rows, or cells if that is more.
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("nq"))
    cell_map = F.broadcast(spark.createDataFrame([(int(c), int(f), int(m)) for c, (f, m) in enumerate(zip(first, many)) if index.sizes[c]], "cell int, b int, m int"))  # most ** 2 rows at most
    left = asked.join(parts, "block").select("block", F.pmod(F.xxhash64("id"), F.col("nq")).cast("int").alias("part"), "id", "v", "cells")
    right = index.rows.join(cell_map, "cell").withColumn("block", (F.col("b") + F.pmod(F.xxhash64("id"), F.col("m"))).cast("int"))
    right = right.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("part"), "id", "v", "cell")

    def rerank(asks: pa.Table, rows: pa.Table) -> pa.Table:
        ids, got = rows["id"].to_numpy(), ([], [], [])
        if len(ids) and len(asks):
            v = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            q = asks["v"].combine_chunks().flatten().to_numpy().reshape(len(asks), -1)
            cell, about = rows["cell"].to_numpy(), _squares(q, v)
            for i, (own, cells) in enumerate(zip(asks["id"].to_pylist(), asks["cells"].to_pylist())):
                near = np.flatnonzero(np.isin(cell, np.frombuffer(cells, "<i4")) & (ids != own))
                if len(near) > k:
                    close = about[i, near]  # rounded otherwise than the score: those near the edge are kept and scored
                    edge = np.partition(close, k - 1)[k - 1]
                    near = near[close <= edge + 1e-9 * (1 + abs(edge) + (q[i] ** 2).sum())]
                d = np.sqrt(((v[near] - q[i]) ** 2).sum(1))
                best = np.lexsort((ids[near], d))[:k]
                for c, x in zip(got, (np.full(len(best), own), ids[near[best]], d[best])):
                    c.append(x)
        cat = [np.concatenate(c) if c else np.zeros(0) for c in got]
        return pa.table({"query_id": pa.array(cat[0].astype(np.int64)), "vec_id": pa.array(cat[1].astype(np.int64)), "score": pa.array(cat[2].astype(np.float64))})

    keys = ["block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
