"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within them, one representative a group.

Vectors are compared only within their label. Equal directions are first folded into one row with a count, so thousands of copies cost one
vector. A bounded sample of each label's directions (SAMPLE rows in all) fits the centroids. Every vector belongs to its nearest cell, and
visits each further cell whose side of the bisecting plane it could have a partner on: with unit vectors, a partner within the angle acos(t)
lies beyond the plane between centroids c and d only if v.c - v.d <= sqrt(1 - t*t) * |c - d|. So no pair at or above t is missed,
whatever the centroids. Within a cell, owners are dealt into blocks of BLOCK rows, and tasks multiply a block of visitors or owners with a
block of owners in double precision: a large cell becomes many tasks, none of which holds more than two blocks.

Each product yields, per vector, the number of partners and one link to the smallest partner; pairs are never written out one by one, yet
links of a block are complete: the partners of a row within a block all hang on it through its group's smallest member.

Defined cases: vectors that are null, of no elements, zero, or with null or non-finite elements link with nothing, as do rows whose
label is null; only vectors of equal length are compared; repeated rows are copies and link with each other; a null id is ignored as a
partner and kept as a row of its own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import Scratch, components, roots, small_batches, table, tidy

SAMPLE, CELL, BLOCK, ROUNDS = 20_000, 512, 1024, 8
#: Vectors that a task holds against the centroids at once, and rows of visits, each with its vector, that it hands on at once.
HELD, HANDED = 512, 4096
#: Rows of a block that are held against the other block at once.
STRIP = 128
#: Cells whose sizes are broadcast at most; those of more are joined.
MOST_BLOCKS = 100_000


def usable(v):
    """Whether a vector has a direction: SQL functions, no Python."""
    d = v.cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(d) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(d, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def unit(m: np.ndarray) -> np.ndarray:
    scale = np.abs(m).max(axis=1, keepdims=True)  # first, so that tiny and huge vectors keep their direction
    m = m / np.where(scale > 0, scale, 1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def fit_cells(vectors: DataFrame, seed: int = 5) -> dict[tuple[int, int], np.ndarray]:
    """Centroids by label and length, from a bounded sample; a cell for every CELL directions of the label. What comes to the driver is the sample and
    a count for each label in it; labels outside it are one cell each."""
    spark, total = vectors.sparkSession, vectors.count()
    if not total:
        return {}
    share = min(1.0, 1.2 * SAMPLE / total)
    sample = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30))).select("label", "dim", "v").limit(2 * SAMPLE).toPandas()
    if not len(sample):
        return {}
    groups = dict(list(sample.groupby(["label", "dim"])))
    known = F.broadcast(spark.createDataFrame([(int(a), int(b)) for a, b in groups], "label bigint, dim int"))
    sizes = {(r.label, r.dim): r.n for r in vectors.join(known, ["label", "dim"], "left_semi").groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    for key, rows in groups.items():
        x = unit(np.stack([np.frombuffer(v, np.float64) for v in rows.v]))
        out[key] = spherical_kmeans(x, max(1, min(-(-sizes[key] // CELL), len(x) // 8, 1024)), seed=seed)
    return out


def visits(cells: dict, threshold: float):
    """Rows (place, cell, owner) of each vector: its own cell and those it could have a partner in."""
    reach = np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9

    def run(batches):
        for batch in (b.slice(i, HELD) for b in batches for i in range(0, b.num_rows, HELD)):
            rep, label, dim, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            raw = batch.column(3)
            rows, cell, owner = [], [], []
            for key in {*zip(label.tolist(), dim.tolist(), strict=True)}:
                at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                c = cells.get(key)
                if c is None or len(c) == 1:
                    rows.append(at), cell.append(np.zeros(len(at), np.int64)), owner.append(np.ones(len(at), bool))
                    continue
                x = unit(np.stack([np.frombuffer(raw[int(i)].as_buffer(), np.float64) for i in at]))
                dots = x @ c.T
                own = dots.argmax(axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                near = dots[np.arange(len(x)), own][:, None] - dots <= reach * apart[own]
                near[np.arange(len(x)), own] = True
                i, j = np.nonzero(near)
                rows.append(at[i]), cell.append(j), owner.append(j == own[i])
            if not rows:
                continue
            visitors, cell, owner = (np.concatenate(x) for x in (rows, cell, owner))
            for k in range(0, len(visitors), HANDED):
                s = slice(k, k + HANDED)
                at = visitors[s]
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(label[at]), pa.array(dim[at]), raw.take(pa.array(at)), pa.array(n[at]), pa.array(cell[s]), pa.array(owner[s])], names=["rep", "label", "dim", "v", "n", "cell", "owner"])

    return run


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links a-b as a star a group: (nodes in order, places of those that aren't their group's smallest, places of these)."""
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(len(nodes), ids[: len(a)], ids[len(a) :])
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes, leaf, root[leaf]


PARTNERS = "rep bigint, links bigint, other bigint"


def block_product(threshold: float):
    """A group holds one block of owners and one block that meets it: partner counts and links of the latter's rows with the former's."""

    def run(key, rows):
        side = rows.column("side").to_numpy(zero_copy_only=False)
        rep = rows.column("rep").to_numpy()
        n = rows.column("n").to_numpy()
        x = unit(np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float64).reshape(len(rep), -1))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, u, v = np.zeros(len(b), np.int64), [], []
        for k in range(0, len(b), STRIP):  # a strip's pairs go as soon as they are a star a group
            part = b[k : k + STRIP]
            hit = x[part] @ x[a].T >= threshold
            hit &= rep[part][:, None] != rep[a][None, :]
            links[k : k + STRIP] = hit.astype(np.int64) @ n[a]
            i, j = np.nonzero(hit)
            known, one, other = star(rep[part[i]], rep[a[j]])
            u.append(known[one]), v.append(known[other])
        some = np.flatnonzero(links)
        if not len(some):
            return pa.Table.from_pydict({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        nodes, leaf, root = star(np.concatenate(u), np.concatenate(v))
        return pa.Table.from_pydict({"rep": pa.array(np.concatenate([rep[b[some]], nodes[leaf]])), "links": pa.array(np.concatenate([links[some], np.zeros(len(leaf), np.int64)])), "other": pa.array(np.concatenate([rep[b[some]], nodes[root]]))})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("a"))
    good = rows.where(usable(F.col("a")) & F.col("label").isNotNull() & F.col("id").isNotNull())

    def packed(batches):  # doubles as bytes: equal vectors are equal keys, and NumPy reads them in place
        for batch in batches:
            lists = batch.column(2)
            dim = np.diff(lists.offsets.to_numpy())
            flat, off = lists.values.to_numpy(zero_copy_only=False) + 0.0, lists.offsets.to_numpy()  # + 0.0: no negative zero
            raw = [flat[off[i] : off[i + 1]].tobytes() for i in range(len(dim))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], names=["id", "label", "dim", "v"])

    flat = scratch.save(good.mapInArrow(tidy(packed), "id bigint, label bigint, dim int, v binary"), "flat")
    folded = scratch.save(flat.groupBy("label", "dim", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", "label", "dim", "v", "n"), "folded")
    cells = fit_cells(folded)
    placed = scratch.save(folded.mapInArrow(tidy(visits(cells, threshold)), "rep bigint, label bigint, dim int, v binary, n bigint, cell bigint, owner boolean"), "placed")
    # Blocks by a hash of the id: as many as the cell's owners and visitors need.
    place = ["label", "dim", "cell"]
    blocks = scratch.save(placed.groupBy(*place).agg((F.floor(F.count_if("owner") / BLOCK) + 1).alias("own_blocks"), (F.floor(F.count(F.lit(1)) / BLOCK) + 1).alias("all_blocks")), "blocks")
    dealt = placed.join(F.broadcast(blocks) if blocks.count() <= MOST_BLOCKS else blocks, place).withColumn("h", F.xxhash64("rep"))
    own = dealt.where("owner").select(*place, F.pmod("h", "own_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), F.lit(0).alias("side"), "rep", "v", "n")
    meet = dealt.select(*place, F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("i"), F.pmod("h", "all_blocks").alias("j"), F.lit(1).alias("side"), "rep", "v", "n")
    found = scratch.save(own.union(meet).groupBy(*place, "i", "j").applyInArrow(block_product(threshold), PARTNERS), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.where("rep <> other").select("rep", "other"), scratch)
    # A direction's row: own copies are partners of each other.
    known = folded.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("label", "dim", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    members = flat.join(known, ["label", "dim", "v"]).select("id", "n_links", "component_id")
    rest = rows.where(~(usable(F.col("a")) & F.col("label").isNotNull() & F.col("id").isNotNull())).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = members.unionByName(rest)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.vec_id = e.vec_id
"""
