"""Exact top-k inner products by a Voronoi join.

Vectors are dealt to the cells of a few pivots. Queries of a cell are handled as groups of bounded
size; a group is known by its centre u and radius r, so that for any of its queries q and any
vector x:  u.x - r|x| <= q.x <= u.x + r|x|. The summaries (per task, the best lower bounds for each
group) give every group a score that its k-th best surely reaches; a vector is sent to a group
only if its upper bound reaches that score. Groups with many candidates are cut into blocks, each
block answers its queries exactly, and the few answers per query and block are merged. Scores are
sums of integers, computed exactly.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .rows import keep, numbered, pick

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXACT = float(2**53)
SLICE = 256  # groups that the data meets at a time
FOUND = "query_row long, query_id long, vec_id long, score long"
SLACK = 1e-6  # of the bounds, against rounding


def encoded(x: np.ndarray) -> list[bytes]:
    """Integer rows as bytes, each component as narrow as its row allows; the length tells the width."""
    top = np.abs(x).max(axis=1, initial=0)
    out = []
    for row, m in zip(x, top.tolist()):
        out.append(row.astype("<i2" if m < 2**15 else "<i4" if m < 2**31 else "<f8").tobytes())
    return out


def decoded(column: list[bytes], dim: int) -> np.ndarray:
    """The rows of ``encoded`` as float64."""
    kinds = {2: "<i2", 4: "<i4", 8: "<f8"}
    widths = {len(v) // dim for v in column}
    if len(widths) == 1:
        return np.frombuffer(b"".join(column), kinds[widths.pop()]).reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(v, kinds[len(v) // dim]).astype(np.float64) for v in column]).reshape(-1, dim)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, vec_id, dim, v): components as floor(scale * x); vectors with a NULL or non-finite part left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, dims, vs = [], [], [], []
            for row, vec_id, x in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "x"))):
                with np.errstate(over="ignore"):
                    v = np.floor(np.array(x, np.float64) * scale)
                if np.isfinite(v).all():
                    rows.append(row), ids.append(vec_id), dims.append(len(x)), vs.append(encoded(v[None])[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vs, pa.binary())],
                names=["row", "vec_id", "dim", "v"],
            )

    x = F.col("x")
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(F.coalesce(x, F.array()), lambda e: e.isNotNull())
    return (
        numbered(pick(df, vec_id=id_col, x=vector_col))
        .select("row", F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<double>").alias("x"))
        .where(whole)
        .mapInArrow(run, "row long, vec_id long, dim int, v binary")
    )


def top_k(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, query_every: int = 50,
    scale: int = 256, n_pivots: int = 64, group_rows: int = 512, block_rows: int = 20_000,
) -> DataFrame:
    """The ``k`` best inner products of every query row among all other rows.

    Queries are the rows whose id is divisible by ``query_every``; ties go to the smaller id, then
    to NULL ids last. Rows are told apart by place, not by id, so repeated rows are candidates of
    each other. Vectors meet only vectors of their own length. Scores beyond 64 bits saturate. An
    empty table, or one with a single row, gives no rows; other columns are ignored.

    ``n_pivots`` (a bounded sample, all that is broadcast with the group centres: n_pivots times
    the number of groups of ``group_rows`` queries) and ``block_rows`` bound what a task holds.
    """
    data = keep(quantised(df, id_col, vector_col, scale))
    spark = df.sparkSession
    parts = [
        _one_dim(data.where(F.col("dim") == d), d, k, query_every, n_pivots, group_rows, block_rows)
        for d in sorted(r[0] for r in data.select("dim").distinct().collect())
    ]
    empty = spark.createDataFrame([], FOUND)
    found = empty
    for part in parts:
        found = found.unionByName(part)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _one_dim(data, dim, k, query_every, n_pivots, group_rows, block_rows) -> DataFrame:
    queries = data.where(F.col("vec_id") % query_every == 0).select("row", "vec_id", "v")
    # Pivots: a bounded sample, the same on every run; enough for cells of about half a group.
    wanted = max(1, min(n_pivots, -(-2 * queries.count() // group_rows)))
    sample = queries.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
    if not sample:
        return data.sparkSession.createDataFrame([], FOUND)
    pivots = decoded([bytes(r[0]) for r in sample], dim)

    def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(1) / 2
        for batch in batches:
            if batch.num_rows:
                cell = (decoded(batch.column("v").to_pylist(), dim) @ pivots.T - half).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    celled = keep(queries.mapInArrow(to_cell, "row long, vec_id long, v binary, cell int"))
    # Large cells are cut into groups of bounded size, by place.
    queries = celled.join(celled.groupBy("cell").agg(F.count("*").alias("n")), "cell").select(
        "row", "vec_id", "v",
        F.xxhash64("cell", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / group_rows))).alias("grp"),
    )

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        x = decoded(pdf["v"].tolist(), dim)
        u = x.mean(0)
        away = np.sqrt(((x - u) ** 2).sum(1)).max()
        return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "u": [u.tolist()], "radius": [away]})

    groups = keep(queries.groupBy("grp").applyInPandas(summary, "grp long, u array<double>, radius double"))
    # Groups grow with the queries, so the data meets them in slices of bounded width.
    n_slices = max(1, -(-groups.count() // SLICE))
    found = None
    for s in range(n_slices):
        part = groups.where(F.pmod(F.xxhash64("grp"), F.lit(n_slices)) == s).orderBy("grp").collect()
        if part:
            part = _one_slice(data, queries, part, dim, k, block_rows)
            found = part if found is None else found.union(part)
    return found


def _one_slice(data, queries, groups, dim, k, block_rows) -> DataFrame:
    """At most a few hundred groups (about the slice width) against all rows."""
    ids = np.array([g.grp for g in groups], dtype=np.int64)
    centre = np.array([g.u for g in groups]).reshape(-1, dim)
    radius = np.array([g.radius for g in groups])

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dot = x @ centre.T
        slack = np.sqrt((x**2).sum(1))[:, None] * (radius + SLACK * (1 + np.sqrt((centre**2).sum(1))))
        return dot, slack

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.empty((0, len(ids)))
        for batch in batches:
            if batch.num_rows:
                dot, slack = bounds(decoded(batch.column("v").to_pylist(), dim))
                best = np.sort(np.vstack([best, dot - slack]), axis=0)[-(k + 1) :]
        if len(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(ids, len(best))), pa.array(best.ravel())], names=["grp", "low"]
            )

    # k + 1, since a query's own row is no candidate of its own.
    lows = data.select("v").mapInArrow(lowest, "grp long, low double")
    rank = Window.partitionBy("grp").orderBy(F.desc("low"))
    sure = dict(
        lows.withColumn("i", F.row_number().over(rank)).where(F.col("i") == k + 1).select("grp", "low").collect()
    )
    floor = np.array([sure.get(int(g), -np.inf) for g in ids])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                dot, slack = bounds(decoded(some.column("v").to_pylist(), dim))
                i, j = np.nonzero(dot + slack >= floor)
                if len(i):
                    got = some.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[j]), got.column("row"), got.column("vec_id"), got.column("v")],
                        names=["grp", "row", "vec_id", "v"],
                    )

    # How many candidates each group has: groups with many are cut into blocks.
    sent = data.select("row", "vec_id", "v").mapInArrow(send, "grp long, row long, vec_id long, v binary")
    cut = sent.groupBy("grp").agg(F.ceil(F.count("*") / block_rows).alias("blocks")).collect()
    blocks = {int(r.grp): int(r.blocks) for r in cut}
    if not blocks:
        return data.sparkSession.createDataFrame([], FOUND)
    n_blocks = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])[F.col("grp")]
    right = sent.withColumn("block", F.pmod(F.xxhash64("row"), n_blocks))
    left = queries.where(F.col("grp").isin(list(blocks))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks.cast("long") - 1))
    )

    def solve(key, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ask) and len(have):
            have = have.sort_values("vec_id", kind="stable", na_position="last")
            q, x = (decoded(f["v"].tolist(), dim) for f in (ask, have))
            safe = np.abs(q).max() * np.abs(x).max() * dim < EXACT
            rows, vec = have["row"].to_numpy(), have["vec_id"].to_numpy()
            if not safe:
                whole = np.vectorize(int, otypes=[object])
                q, x = whole(q), whole(x)
            for a in range(0, len(ask), 256):
                scores = q[a : a + 256] @ x.T
                for s, (row, qid) in zip(scores, ask[["row", "vec_id"]].iloc[a : a + 256].itertuples(index=False)):
                    s = s if safe else np.array([max(-(2**63), min(2**63 - 1, e)) for e in s], dtype=object)
                    other = rows != row
                    s, v = s[other], vec[other]
                    if len(s) > 4 * k and safe:
                        near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    else:
                        near = np.arange(len(s))
                    top = near[np.argsort(-s[near], kind="stable")[:k]]
                    out += [(row, qid, None if pd.isna(v[t]) else int(v[t]), int(s[t])) for t in top]
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"]).astype(
            {"query_row": "int64", "query_id": "int64", "vec_id": "Int64", "score": "int64"}
        )

    return left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInPandas(
        solve, FOUND
    )
