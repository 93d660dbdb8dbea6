"""N-gram Jaccard join: a count-vector R-tree over sets of word shingles, exact at any size.

A document is the set of its distinct word shingles, as 64-bit hashes. Equal sets are folded into one.

Which sets can meet: two sets with Jaccard similarity t or more differ in at most r = n(1/t - 1) shingles, n being the smaller one's size.
Shingles are hashed into more than r groups, so a linked pair has equal content in one group at least: documents are dealt by (size
class, group, content) and no pair is compared outside such a bucket. Empty groups, which unrelated sets have in common, count only for
the few sets that fill no more than r groups.

Inside: the numbers of shingles by group (DIMS groups) are a point; sum over groups of min(a, b) bounds the overlap from above. First every
bucket's members are held against its smallest id: bounded, then verified on the sets. The buckets that still hold more than one component
are cut into blocks, and each block is an R-tree of count vectors, whose nodes keep the largest count of each group and the smallest size:
a probe descends only where the summed minima reach the overlap it needs. Pairs of different components that survive are verified too.
A signature also keeps the parity of BITS finer groups: where two parities differ the sets differ, which bounds the overlap once more.
So thousands of copies cost a star, not all their pairs, and documents that share much but not enough die by the bounds.

Defined cases: a null or empty text, or one without words, is an empty set, linked with nothing; a text with fewer words than a shingle
has its whole word sequence as the one shingle; repeated rows fold; a null id is never a component's name unless alone; further columns
are ignored by the join and carried by the stage; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import KeyFilter, Scratch, components, mix, slices, small_batches, table, tidy, word_hashes

DIMS, FANOUT, BLOCK, RATIO = 32, 16, 256, 1.5
#: Groups whose parity a signature keeps, and the largest count it holds: beyond, all counts are FULL and bound nothing.
BITS, FULL = 1024, 65535


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    w, off = word_hashes(column)
    out = []
    if len(w) >= words:
        h = mix(w[: len(w) - words + 1] + np.uint64(words))
        for k in range(1, words):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - words + 1 + k])
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(h[a : b - words + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for v in w[a:b]:
                x = mix(np.array([x]) * np.uint64(0x9E3779B97F4A7C15) + v)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Classes:
    """Size classes: class k holds sizes from start[k] on; a pair belongs to the class of its smaller set."""

    def __init__(self, percent: int):
        self.percent = percent
        self.start, s = [], -(-percent // (100 - percent)) if percent < 100 else 1 << 60  # smaller sets can only link when equal
        while s < 1 << 40:
            self.start.append(s)
            s = max(s + 1, int(s * RATIO))
        self.bounds = np.array(self.start)

    def differ(self, k: int) -> int:
        """The shingles in which a pair of class k can differ."""
        return (self.start[k + 1] - 1) * (100 - self.percent) // self.percent

    @cache  # noqa: B019
    def groups(self, k: int) -> int:
        """More than differ(k), and so many that nearly every set of the class fills more than differ(k) of them."""
        n, r = self.start[k], self.differ(k)
        g = r + 1
        while g < 2 * r + 1:
            empty = (1 - 1 / g) ** n
            if g * (1 - empty) - 3 * (g * empty * (1 - empty)) ** 0.5 > r:
                break
            g += max(1, g // 64)
        return g

    def of(self, n: int) -> list[int]:
        """The classes in which a set of size n is dealt: its own, and those of smaller sets that it may link with."""
        k = int(np.searchsorted(self.bounds, n, "right")) - 1
        out = []
        least = -(-n * self.percent // 100)
        while k >= 0 and (not out or self.start[k + 1] - 1 >= least):
            out.append(k)
            k -= 1
        return out


def bucket_keys(s: np.ndarray, classes: Classes) -> np.ndarray:
    """One key for each class and group with content: equal content, equal key.

    A set that fills more groups than a pair can differ in has one of these in common with any set that it links with. Only a set that
    fills fewer gets keys for its empty groups too: of a pair that links, both are such sets or one common group has content."""
    out = []
    for k in classes.of(len(s)):
        g = classes.groups(k)
        group = ((s >> np.uint64(20)) % np.uint64(g)).astype(np.int64)
        total = np.zeros(g, np.uint64)
        np.add.at(total, group, mix(s ^ np.uint64(0x5851F42D4C957F2D)))
        keys = mix(mix(total) + (np.arange(g, dtype=np.uint64) << np.uint64(8)) + np.uint64(k))
        filled = np.bincount(group, minlength=g) > 0
        out.append(keys[filled] if filled.sum() > classes.differ(k) else keys)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def points(sets: list[np.ndarray]) -> np.ndarray:
    """Count vectors: shingles by group."""
    out = np.zeros((len(sets), DIMS), np.int32)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=DIMS)
    return out


def packed(sets: list[np.ndarray]) -> pa.Array:
    """Count vectors as 16-bit numbers, then parities as bits."""
    p = points(sets)
    p[(p >= FULL).any(axis=1)] = FULL
    out = []
    for s, counts in zip(sets, p.astype("<u2"), strict=True):
        odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
        out.append(counts.tobytes() + np.packbits(odd.astype(np.uint8)).tobytes())
    return pa.array(out, pa.binary())


def unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """(count vectors, parities as 64-bit words)."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * DIMS + BITS // 8)
    return np.ascontiguousarray(raw[:, : 2 * DIMS]).view("<u2").astype(np.int32), np.ascontiguousarray(raw[:, 2 * DIMS :]).view(np.uint64)


def could_link(counts, odd, sizes, percent: int) -> np.ndarray:
    """For pairs given side by side: whether summed minima and differing parities leave the overlap they need."""
    bound = np.minimum(*counts).sum(axis=1, dtype=np.int64)
    bound[bound >= DIMS * FULL] = 1 << 60
    differ = np.bitwise_count(odd[0] ^ odd[1]).sum(axis=1, dtype=np.int64)
    return np.minimum(bound, (sizes[0] + sizes[1] - differ) // 2) >= needed(*sizes, percent)


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes a and b that link: 100 * overlap >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


class CountTree:
    """An R-tree over count vectors, packed by sort-tile-recursion on the widest groups."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        order = self._tile(vectors, np.arange(len(vectors)))
        self.order, self.vectors, self.sizes = order, vectors[order], sizes[order]
        self.levels = []  # from the leaves up: (largest counts, smallest size, largest size)
        top, low, high = self.vectors, self.sizes, self.sizes
        while len(top) > 1 or not self.levels:
            cut = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def _tile(self, v: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if len(rows) <= FANOUT:
            return rows
        spread = np.ptp(v[rows], axis=0)
        by = rows[np.argsort(v[rows, spread.argmax()], kind="stable")]
        leaves = -(-len(by) // FANOUT)
        half = leaves // 2 * FANOUT
        return np.concatenate([self._tile(v, by[:half]), self._tile(v, by[half:])])

    def search(self, vectors: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe, row) of all pairs whose summed minima reach the overlap they need, found from the root down, many probes at once."""
        top = self.levels[-1]
        probe, node = np.repeat(np.arange(len(vectors)), len(top[1])), np.tile(np.arange(len(top[1])), len(vectors))
        for level in range(len(self.levels) - 1, -2, -1):
            largest, low, high = self.levels[level] if level >= 0 else (self.vectors, self.sizes, self.sizes)
            n = sizes[probe]
            fits = (100 * np.minimum(n, high[node]) >= percent * np.maximum(n, low[node]))
            probe, node = probe[fits], node[fits]
            bound = np.minimum(vectors[probe], largest[node]).sum(axis=1, dtype=np.int64)
            bound[bound >= DIMS * FULL] = 1 << 60
            live = bound >= needed(sizes[probe], low[node], percent)
            probe, node = probe[live], node[live]
            if level < 0:
                return probe, self.order[node]
            width = len(self.levels[level - 1][1]) if level else len(self.sizes)
            probe = np.repeat(probe, FANOUT)
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            inside = node < width
            probe, node = probe[inside], node[inside]
        raise AssertionError


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, two fingerprint halves and the count vector of every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), *fingerprints(sets), packed(sets)], names=["doc_id", "n_shingles", "f1", "f2", "point"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, point binary")


def fingerprints(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit sums over each set: equal sets, and for all practical purposes only they, agree in both."""
    one = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    two = [int(mix(s * np.uint64(0xD1342543DE82EF95) + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    return [pa.array(one, pa.int64()), pa.array(two, pa.int64())]


def dealt_keys(docs: DataFrame, chosen: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, rep) of every bucket of the chosen documents (doc_id, g1, g2: their fingerprint), one of several equal rows."""
    classes = Classes(percent)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays([part.column(0), *fingerprints(sets), pa.array([bucket_keys(s, classes) for s in sets], pa.list_(pa.int64()))], names=["rep", "f1", "f2", "keys"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "rep bigint, f1 bigint, f2 bigint, keys array<bigint>")
    rows = rows.where(F.size("keys") > 0).join(chosen, F.col("rep") == F.col("doc_id")).where("f1 = g1 and f2 = g2").dropDuplicates(["rep", "f1", "f2"])
    return rows.select(F.explode("keys").alias("key"), "rep")


def shared_keys(rows: DataFrame) -> DataFrame:
    """key, rep, center (the key's smallest rep) of all rows whose key occurs twice or more.

    One shuffle: rows are dealt and sorted by key, outside memory if need be, and each task walks its sorted rows holding no more than a
    batch and the current key's first row, so a key with very many rows is streamed, not gathered."""

    def run(batches):
        last_key, first, shown = None, None, True
        for batch in batches:
            key, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            again = np.concatenate([[last_key is not None and key[0] == last_key], key[1:] == key[:-1]])
            start = np.flatnonzero(~again)
            of = np.searchsorted(start, np.arange(len(key)), "right") - 1  # -1: the run that came with the last batch
            center = np.where(of >= 0, rep[start[of]] if len(start) else 0, first if first is not None else 0)
            followed = np.concatenate([again[1:], [False]])
            out = np.flatnonzero(again | (~again & followed))
            k, r, c = key[out], rep[out], center[out]
            if again[0] and not shown:
                k, r, c = np.append(k, last_key), np.append(r, first), np.append(c, first)
            last_key, first, shown = key[-1], center[-1], bool(again[-1])
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(r), pa.array(c)], names=["key", "rep", "center"])

    return rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(tidy(run), "key bigint, rep bigint, center bigint")


def bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bounds leave."""

    def run(batches):
        for batch in batches:
            n = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4)]
            counts, odd = zip(*(unpacked(batch.column(i)) for i in (3, 5)), strict=True)
            live = could_link(counts, odd, n, percent)
            yield batch.select(["a", "b"]).filter(pa.array(live))

    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "pa", "nb", "pb")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return joined.where(fits).mapInArrow(tidy(run), "a bigint, b bigint")


def parity(s: np.ndarray) -> bytes:
    """The parity of about two groups a shingle, a power of two of them, as bits. A longer one folds to a shorter by exclusive or."""
    bits = max(64, 1 << (2 * max(1, len(s)) - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(30)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many groups two parities differ: at most as many as shingles in which the sets differ."""
    x, y = (np.frombuffer(v, np.uint64) for v in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def of_documents(ids: DataFrame, docs: DataFrame, words: int, schema: str, make) -> DataFrame:
    """id and what make gives for the sets of the documents in ids (and of a few others): one pass over the texts, which stay where they are,
    behind a filter of fixed size."""
    wanted = KeyFilter.of(ids)
    box = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        keep = box.value
        for batch in batches:
            batch = batch.filter(pa.array(keep.test(batch.column(2).to_numpy(zero_copy_only=False))))
            for part in slices(batch, "text"):
                yield make(part.column(0), shingle_sets(part.column(1), words))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.withColumn("h", KeyFilter.place("doc_id")).mapInArrow(tidy(run), schema)


def narrowed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that parities as long as the sets leave: a few bits a shingle spare most of the sets' way to each other."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def make(id_, sets):
        return pa.RecordBatch.from_arrays([id_, pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary())], names=["id", "n", "p"])

    def run(batches):
        for batch in batches:
            na, pa_, nb, pb = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            d = np.array([differing(x, y) for x, y in zip(pa_, pb, strict=True)], np.int64)
            na, nb = np.array(na, np.int64), np.array(nb, np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((na + nb - d) // 2 >= needed(na, nb, percent), pa.bool_()))

    found = of_documents(ids, docs, words, "id bigint, n bigint, p binary", make)
    side = lambda x: found.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "pa", "nb", "pb").mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link, by their sets, which are made anew for the documents in question only."""
    pairs = scratch.save(narrowed(pairs, docs, words, percent), "narrowed")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def make(id_, sets):
        return pa.RecordBatch.from_arrays([id_, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "set"])

    sets = of_documents(ids, docs, words, "id bigint, set array<bigint>", make)
    sets = scratch.save(sets, "sets")
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "sb"}), "b")
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")))
    out = scratch.save(both.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b").distinct(), "linked")
    scratch.drop(sets, pairs)
    return out


def tree_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """rows: key, i, j, side, rep, comp, n_shingles, point, dealt and sorted by (key, i, j). In each group side 0 is an R-tree, side 1
    probes it; pairs of one component are left out."""

    def groups(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            k = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            if not len(cut):
                held = t
                continue
            yield t.slice(0, cut[-1]), np.concatenate([[0], cut])
            held = t.slice(cut[-1])
        if held is not None and held.num_rows:
            yield held, np.array([0, held.num_rows])

    def run(batches):
        for t, cut in groups(batches):
            side, rep, comp, size = (t.column(c).to_numpy() for c in ("side", "rep", "comp", "n_shingles"))
            point, odd = unpacked(t.column("point"))
            a, b = [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                own, meet = (lo + np.flatnonzero(side[lo:hi] == s) for s in (0, 1))
                if not len(own) or not len(meet):
                    continue
                probe, row = CountTree(point[own], size[own]).search(point[meet], size[meet], percent)
                x, y = meet[probe], own[row]
                apart = comp[x] != comp[y]
                x, y = x[apart], y[apart]
                live = could_link((point[x], point[y]), (odd[x], odd[y]), (size[x], size[y]), percent)
                a.append(np.minimum(rep[x], rep[y])[live])
                b.append(np.maximum(rep[x], rep[y])[live])
            if a:
                pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of the links 100 * overlap >= percent * union."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    sig = scratch.save(signatures(docs, words), "signatures")
    classes = sig.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = scratch.save(classes, "classes")
    named = classes.where("rep is not null").select(F.col("rep").alias("doc_id"), F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    reps = sig.join(named, "doc_id").where("f1 = g1 and f2 = g2").select(F.col("doc_id").alias("rep"), "n_shingles", "point")
    shared = scratch.save(shared_keys(dealt_keys(docs, named, words, percent)), "shared")
    reps = scratch.save(reps.join(shared.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep", "n_shingles", "point"]), "reps")
    star = shared.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    star = scratch.save(bounded(star, reps, percent), "star")
    links = verified(star, docs, words, percent, scratch)
    comp = components(links, scratch)
    # Buckets that hold more than one component, cut into blocks.
    tagged = shared.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("key", "m")
    rows = tagged.join(mixed, "key").join(reps.select("rep", "n_shingles", "point"), "rep")
    rows = rows.withColumns({"nb": F.floor(F.col("m") / BLOCK) + 1}).withColumn("own", F.pmod(F.xxhash64("rep"), "nb"))
    cols = ["rep", "comp", "n_shingles", "point"]
    tree = rows.select("key", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("nb") - 1)).alias("j"), F.lit(0).alias("side"), *cols)
    probe = rows.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), "own")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), *cols)
    dealt = tree.union(probe).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = scratch.save(tree_pairs(dealt, percent).distinct(), "survivors")
    more = verified(more, docs, words, percent, scratch)
    comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch)
    known = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    scratch.drop(shared, reps, star)
    out = sig.select("doc_id", "n_shingles", "f1", "f2").join(known, ["f1", "f2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; documents without an id stay. Shingles of five words, similarity 0.8."""
    comp = jaccard_components(docs, 5, 80)
    gone = comp.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
