"""Order-dependent dedup of sequences (a question's evidence, a chunk's frames).

By vectors: blocks of a group against what was kept, in one task a group, with a form that carries what was kept from round to round. By hashes: folds
over sorted arrays, which are as short as a chunk's frames.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.functions.vector import dot, hamming


def greedy(items: Column, kept: Column, same) -> Column:
    """Adds each item that same(kept item, item) holds for none of those kept so far."""
    return F.aggregate(items, kept, lambda acc, x: F.when(F.exists(acc, lambda k: same(k, x)), acc).otherwise(F.concat(acc, F.array(x))))


def first_of_kind(vectors: np.ndarray, threshold: float, block: int = 512, before: np.ndarray | None = None, joins: np.ndarray | None = None) -> np.ndarray:
    """Which rows are below the threshold to all kept before (and to those of `before`): a block at a time against the kept ones, then row by row within
    the block. Rows that don't join are judged, but nothing is held against them."""
    joins = np.ones(len(vectors), bool) if joins is None else joins
    n = 0 if before is None else len(before)
    kept, keep = np.empty((n + len(vectors), vectors.shape[1])), np.zeros(len(vectors), bool)
    if n:
        kept[:n] = before
    for i in range(0, len(vectors), block):
        part, own_joins = vectors[i : i + block], joins[i : i + block]
        free = np.ones(len(part), bool)
        for j in range(0, n, 4096):
            free &= ~(np.round(part @ kept[j : min(j + 4096, n)].T, 6) >= threshold).any(axis=1)
        own = np.round(part @ part.T, 6) >= threshold
        for k in np.flatnonzero(free):
            if free[k] and own_joins[k]:
                free[k + 1 :] &= ~own[k, k + 1 :]
        new = part[free & own_joins]
        kept[n : n + len(new)] = new
        n += len(new)
        keep[i : i + block] = free
    return keep


def stacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a vector, those vectors as a matrix). Vectors have one length."""
    column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    has = size > 0
    return has, flat.reshape(int(has.sum()), -1) if has.any() else np.zeros((0, 0))


def placed(rows: DataFrame, by: str, order: str, *columns: str) -> DataFrame:
    """The columns with _at, each row's place in its group."""
    return rows.select(by, order, *columns, F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("_at"))


def greedy_similarity(rows: DataFrame, by: str, order: str, vector: str, threshold: float) -> DataFrame:
    """Rows of each group, in order, that are below the threshold to all kept before. A row without a vector always stays.

    Matrix products of blocks: a group's ids and vectors are one task's, as the rule looks back on all that was kept. Vectors of a group have one length."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["_at"]))
        has, vectors = stacked(table[vector])
        keep = ~has
        if has.any():
            keep[has] = first_of_kind(vectors, threshold)
        return table.filter(pa.array(keep)).select([by, order])

    kept = placed(rows, by, order, vector)
    return kept.groupBy(by).applyInArrow(run, kept.select(by, order).schema)


dedup_large = greedy_similarity


def carried(rows: DataFrame, state: DataFrame | None, by: str, order: str, vector: str, threshold: float, joins: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Greedy dedup that goes on from round to round: (all rows' by, order, vector and _kept, whether they are below the threshold to the state and to
    all that joined before them in order; the new state).

    state: by, vector, what earlier rounds left. Only rows that are kept, have a vector and whose column joins is true enter it; others are judged
    against it, and a row without a vector is kept. A group's state is as long as what was kept for it."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    joined = F.coalesce(F.col(joins), F.lit(False)) if joins else F.lit(True)
    new = placed(rows.withColumn("_joins", joined), by, order, vector, "_joins")
    old = state.select(by, vector) if state is not None else rows.sparkSession.createDataFrame([], rows.select(by, vector).schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left["_at"]))
        has, vectors = stacked(left[vector])
        keep = ~has
        if has.any():
            _, before = stacked(right["_v"])
            keep[has] = first_of_kind(vectors, threshold, before=before if len(before) else None, joins=left["_joins"].to_numpy()[has])
        enters = keep & has & left["_joins"].to_numpy()
        return left.select([by, order, vector]).append_column("_kept", pa.array(keep)).append_column("_enters", pa.array(enters))

    schema = f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, `{vector}` {kinds[vector]}, _kept boolean, _enters boolean"
    known = old.select(F.col(by).alias("_k"), F.col(vector).alias("_v"))
    judged = new.groupBy(by).cogroup(known.groupBy("_k")).applyInArrow(run, schema).where(F.col(order).isNotNull())
    return judged, old.unionByName(judged.where("_enters").select(by, vector))


def recent_hashes(rows: DataFrame, by: str, order: str, hash_: str, most: int = 4, window: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose hash differs in more than most bits from each of the last kept, with the columns in carry. A row without a hash stays and isn't
    remembered. The fold carries the last hashes by themselves, so a step costs the window, not the sequence."""
    item = F.struct(F.col(order).alias("o"), F.col(hash_).alias("h"), *carry)
    kind = rows.select(F.array(hash_).alias("x")).schema["x"].dataType.simpleString()
    start = F.struct(F.expr(f"cast(array() as {kind})").alias("last"), F.expr("cast(array() as array<boolean>)").alias("keep"))

    def step(acc, x):
        near = x.h.isNotNull() & F.exists(acc.last, lambda h: hamming(h, x.h) <= most)
        last = F.concat(F.slice(acc.last, F.greatest(F.size(acc.last) - window + 2, F.lit(1)), window), F.array(x.h))
        return F.struct(F.when(near | x.h.isNull(), acc.last).otherwise(last).alias("last"), F.concat(acc.keep, F.array(~near)).alias("keep"))

    items = F.sort_array(F.collect_list(item))
    flagged = rows.groupBy(by).agg(items.alias("_i")).withColumn("_k", F.aggregate("_i", start, step, lambda acc: acc.keep))
    return flagged.select(by, F.explode(F.arrays_zip("_i", "_k")).alias("_z")).where("_z._k").select(by, F.col("_z._i.o").alias(order), *[F.col(f"_z._i.{c}").alias(c) for c in carry])


def two_gates(rows: DataFrame, by: str, order: str, hash_: str, vector: str, most: int, threshold: float) -> DataFrame:
    """Drops a row that is near to a kept one by hash or by vector; a row without a hash goes."""
    item = F.struct(F.col(order).alias("o"), F.col(hash_).alias("h"), F.col(vector).alias("v"))
    kind = rows.select(F.array(item).alias("x")).schema["x"].dataType.simpleString()
    near = lambda k, x: (hamming(k.h, x.h) <= most) | (F.round(dot(k.v, x.v), 6) >= threshold)
    kept = greedy(F.filter(F.sort_array(F.collect_list(item)), lambda x: x.h.isNotNull()), F.expr(f"cast(array() as {kind})"), near)
    return rows.groupBy(by).agg(kept.alias("_k")).select(by, F.explode("_k").alias("_k")).select(by, F.col("_k.o").alias(order))
