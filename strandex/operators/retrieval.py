"""Scoring and top-k: similarity within a video, fusion, reranking, merged pools.

`nearest` is the exact search: queries and chunks of a video meet as blocks, a matrix product each, and only the best of a block leave its task. A
video's chunks are dealt to as many blocks as they fill, so a long video is work for many tasks, and blocks of queries go to each of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandex.scratch import released, small_batches

DIGITS = 6
#: Rows of a block.
QUERIES, CHUNKS = 256, 1024


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half away from zero, by scaling."""
    return np.copysign(np.floor(np.abs(x) * 10**digits + 0.5) / 10**digits, x) + 0.0


def dealt(rows: DataFrame, by: str, item: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(rows with _block, a number below the blocks that their group fills; the groups with _blocks)."""
    blocks = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_blocks"))
    return rows.join(blocks, by).withColumn("_block", F.pmod(F.xxhash64(*item), F.col("_blocks")).cast("int")).drop("_blocks"), blocks


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a list column as rows of a matrix, short ones filled with zeros, and their lengths (0 for null)."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width), size
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out, size


def products(queries: pa.Array, chunks: pa.Array) -> np.ndarray:
    """The rounded product of each query with each chunk; NaN where either vector is missing or their lengths differ."""
    (q, nq), (c, nc) = matrix(queries), matrix(chunks)
    width = max(q.shape[1], c.shape[1])
    fill = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
    s = half_up(fill(q) @ fill(c).T, DIGITS)
    s[(nq[:, None] != nc) | (nc == 0)] = np.nan
    return s


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row, of equals those that come first; NaN is lowest."""
    low = np.where(np.isnan(scores), np.inf, -scores)
    if low.shape[1] > 4 * k:
        edge = np.partition(low, k - 1, axis=1)[:, k - 1 : k]
        rows, columns = np.nonzero(low <= edge)
    else:
        rows, columns = (x.ravel() for x in np.indices(low.shape))
    order = np.lexsort((columns, low[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(len(low)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], columns[keep]


def blended(texts: np.ndarray, speech: np.ndarray, images: np.ndarray, speech_share: float, text_share: float, digits: int = DIGITS) -> np.ndarray:
    """Text scores with a share of speech scores, and of that a share beside image scores; a score that isn't there leaves the others as they are."""
    both = np.where(np.isnan(speech), texts, (1 - speech_share) * texts + speech_share * speech)
    mixed = text_share * both + (1 - text_share) * np.where(np.isnan(images), both, images)
    return np.floor(mixed * 10**digits + 0.5) / 10**digits


def nearest(queries: DataFrame, chunks: DataFrame, by: str, query: list[str], k: int, channels: tuple[tuple[str, str], ...] = (("q_vec", "v_dynamic"),), combine: Callable[..., np.ndarray] | None = None, item: str = "chunk_id", score: str = "score", rank: str = "rank") -> DataFrame:
    """by, query, item, score and rank of the k best chunks of each query's video, exactly; of equal scores the smaller item.

    channels: pairs of a query's and a chunk's vector columns; combine makes one score of their rounded products, matrices of queries by chunks
    (the first alone without it). Chunks whose score isn't known come last, with a null score."""
    small_batches(queries.sparkSession)
    mine, theirs = [q for q, _ in dict.fromkeys(channels)], list(dict.fromkeys(c for _, c in channels))
    mine = list(dict.fromkeys(mine))
    q, _ = dealt(queries.select(by, *query, *mine), by, query, QUERIES)
    c, blocks = dealt(chunks.select(by, item, *theirs), by, [item], CHUNKS)
    packed = c.groupBy(by, "_block").agg(F.collect_list(F.struct(item, *theirs)).alias("_c"))
    asked = q.groupBy(by, "_block").agg(F.collect_list(F.struct(*query, *mine)).alias("_q")).drop("_block")
    asked = asked.join(blocks, by).select(by, "_q", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(batch.schema.get_field_index(n))[i].values for n in ("_q", "_c"))
                b = b.take(pc.sort_indices(b.field(item)))
                parts = [products(a.field(x), b.field(y)) for x, y in channels]
                s = combine(*parts) if combine else parts[0]
                rows, columns = best(s, k)
                found = s[rows, columns]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(by)).take(pa.array(np.full(len(rows), i))), *[a.field(n).take(at) for n in query], b.field(item).take(pa.array(columns)), pa.array(found, pa.float64(), mask=np.isnan(found))],
                    names=[by, *query, item, score],
                )

    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *chunks.schema]}
    out = asked.join(packed, [by, "_block"]).select(by, "_q", "_c").mapInArrow(released(run), ", ".join(f"`{n}` {kinds[n]}" for n in (by, *query, item)) + f", `{score}` double")
    return top_k(out, query, k, score, (item,), rank)


def top_k(rows: DataFrame, by: list[str], k: int, score: str = "score", ties: tuple[str, ...] = ("chunk_id",), rank: str = "rank") -> DataFrame:
    """The k best of each group, ranked from 1; Spark limits each partition before it shuffles."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def merged(pools: list[DataFrame], by: list[str], k: int) -> DataFrame:
    """Scored pools in order of layer, the best k of all; of equal scores the earlier pool's."""
    out = None
    for i, p in enumerate(pools):
        p = p.withColumn("pool", F.lit(i + 1))
        out = p if out is None else out.unionByName(p)
    return top_k(out, by, k, ties=("pool", "chunk_id"))


def in_best_windows(queries: DataFrame, windows: DataFrame, chunks: DataFrame, by: str, query: str, best: int) -> DataFrame:
    """Chunks that overlap one of the query's best windows (open ends)."""
    top = nearest(queries, windows, by, [query], best, (("q_vec", "w_vec"),), item="window_id").join(windows.select(by, "window_id", "w_start", "w_end"), [by, "window_id"]).select(query, by, "w_start", "w_end")
    hit = chunks.join(top, by).where((F.col("start_time") < F.col("w_end")) & (F.col("end_time") > F.col("w_start")))
    return hit.dropDuplicates([query, "chunk_id"]).drop("w_start", "w_end")


def unseen(rows: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(seen.select(*on).distinct(), on, "left_anti")


def first_seen(rows: DataFrame, by: list[str], q_pos: str = "q_pos") -> DataFrame:
    """Each chunk of a question only with the first query that found it; later queries get no replacement."""
    w = Window.partitionBy(*by, "chunk_id").orderBy(q_pos, "rank")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
