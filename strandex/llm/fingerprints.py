"""Document fingerprints that keep every shingle hash below a fixed share of the hash range.

A fingerprint holds the hashes below the threshold of a text's distinct word shingles, sorted, six bytes each. Its size follows the text, so a long text and a
short one are sampled alike: what share of the short one's hashes the long one has estimates how much of it the long one contains, however
unequal they are. The fingerprint of a union is the union of fingerprints, so those of parts, versions or sources merge. A text without any hash
below the threshold keeps its smallest one, so two of those compare as equal or not, and merging keeps that rule.

`numbered_next` deals documents out by ranges of their id and sees to it that each range ends with a copy of the next one's first document, so
every document meets its successor in one shuffle of the texts and without one task holding the order.

Defined cases: a null or empty text, or one without words, has the empty fingerprint, which is like another empty one (1) and unlike all others (0),
and is contained in any (1); a text with fewer words than a shingle has its whole word sequence as the one shingle; A-Z count as a-z; rows with one id
stand in the order of their texts' hashes and each counts as a document; null ids come first; a table of one row is its own next; columns other than
id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import mix, slices, small_batches, table, tidy, word_hashes

#: Words of a shingle; one hash in SCALE is kept; hashes have BITS bits.
WORDS, SCALE, BITS = 5, 8, 48


def sketches(column: pa.Array, words: int = WORDS, scale: int = SCALE) -> list[np.ndarray]:
    """The sorted kept hashes of every text of a column."""
    w, off = word_hashes(column)
    least = np.uint64((1 << BITS) // scale)
    n = np.diff(off)
    if len(w) >= words:
        h = mix(w[: len(w) - words + 1] + np.uint64(words))
        for k in range(1, words):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - words + 1 + k])
        h >>= np.uint64(64 - BITS)
        low = np.flatnonzero(h < least)
    else:
        h, low = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin, end = np.searchsorted(low, off[:-1]), np.searchsorted(low, np.maximum(off[:-1], off[1:] - words + 1))
    out = []
    for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        if b > a:
            out.append(np.unique(h[low[a:b]]))
        elif n[i] >= words:
            out.append(h[off[i] : off[i + 1] - words + 1].min(keepdims=True))
        elif n[i]:
            x = mix(np.array([n[i]], np.uint64))
            for v in w[off[i] : off[i + 1]]:
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + v)
            out.append(x >> np.uint64(64 - BITS))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def to_text(sketch: np.ndarray) -> str:
    """A sketch as base64 of its hashes in ascending order, each of six bytes, the highest first."""
    return base64.b64encode(np.ascontiguousarray(sketch, ">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6).astype(np.uint64)
    return raw @ (np.uint64(1) << np.arange(40, -1, -8, dtype=np.uint64))


def merge(parts: Iterable[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The sketch of all shingles of the parts together."""
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
    low = every[every < np.uint64((1 << BITS) // scale)]
    return low if len(low) else every[:1]


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """The estimated Jaccard similarity."""
    both = merge((a, b), scale)
    return np.isin(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).sum() / len(both) if len(both) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of a's shingles that b has too."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """key, n_hashes and fingerprint of every row, without a shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                got = sketches(part.column(1), words, scale)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in got], pa.int64()), pa.array(map(to_text, got), pa.string())], names=["key", "n_hashes", "fingerprint"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), f"key {kind}, n_hashes bigint, fingerprint string").withColumnRenamed("key", key)


def hashes(prints: DataFrame, *by: str) -> DataFrame:
    """The distinct hashes of rows of fingerprints by the given columns: the merged sketch of each group, as rows, so that a group of any size
    stays spread over tasks. What a text keeps only because it has nothing below the threshold counts as well."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                s = from_text(batch.column(batch.num_columns - 1)[row].as_py() or "").astype(np.int64)
                held = batch.slice(row, 1).select(list(range(batch.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*held.take(pa.array(np.zeros(len(s), np.int64))).columns, pa.array(s)], names=[*by, "hash"])

    kinds = ", ".join(f"`{c}` {prints.schema[c].dataType.simpleString()}" for c in by)
    return prints.select(*by, "fingerprint").mapInArrow(tidy(run), f"{kinds}, hash bigint").distinct()


def contained(small: DataFrame, small_key: str, large: DataFrame, large_key: str) -> DataFrame:
    """For each pair of keys of two tables of hashes() that share any: the estimated share of small's shingles that large has."""
    sizes = small.groupBy(small_key).agg(F.count(F.lit(1)).alias("n"))
    shared = small.join(large, "hash").groupBy(small_key, large_key).agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes, small_key).select(small_key, large_key, "shared", (F.col("shared") / F.col("n")).alias("containment"))


def numbered_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, copy: ranges of ascending key, a partition each, sorted; every partition ends with copies of the rows that have the next one's
    least key (the last with the first one's), so the next row after the last of its own is there.

    The bounds are quantiles of the keys, and each range's least key comes to the driver: a number a partition."""
    spark = docs.sparkSession
    parts = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col(f"`{key}`").cast("bigint").alias(key))
    cuts = np.array(sorted({int(q) for q in ids.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts)}), np.int64)
    none = np.iinfo(np.int64).min  # null keys come first

    def bucket(values: pa.Array) -> np.ndarray:
        return np.searchsorted(cuts, values.fill_null(none).to_numpy(zero_copy_only=False), "right").astype(np.int32)

    def least(batches):
        for batch in batches:
            at, values = bucket(batch.column(0)), batch.column(0).fill_null(none).to_numpy(zero_copy_only=False)
            low = np.full(len(cuts) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, at, values)
            seen = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(low[seen])], names=["bucket", "low"])

    heads = sorted((r.bucket, r.low) for r in ids.mapInArrow(least, "bucket int, low bigint").groupBy("bucket").agg(F.min("low").alias("low")).collect())
    low, before = np.full(len(cuts) + 1, np.iinfo(np.int64).max), np.zeros(len(cuts) + 1, np.int32)
    for (b, x), (a, _) in zip(heads, [heads[-1], *heads[:-1]] if heads else [], strict=True):
        low[b], before[b] = x, a

    def deal(batches):
        for batch in batches:
            at, values = bucket(batch.column(0)), batch.column(0).fill_null(none).to_numpy(zero_copy_only=False)
            own = pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), bool)), *batch.columns], names=["bucket", "copy", "key", "text"])
            yield own
            if len(first := np.flatnonzero(values == low[at])):
                again = own.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array(before[at[first]]), pa.array(np.ones(len(first), bool)), *again.columns[2:]], names=own.schema.names)

    small_batches(spark)
    kind = "bucket int, copy boolean, key bigint, text string"
    dealt = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(tidy(deal), kind)
    spread = dealt.repartitionById(len(cuts) + 1, F.col("bucket"))
    return spread.sortWithinPartitions("copy", F.col("key").asc_nulls_first(), F.xxhash64("text")).select(F.col("key").alias(key), "text", "copy")


COMPARED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def compared(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its edited text (its last quarter gives way to the beginning of the next document) and of the
    next document, with their likenesses and how much of the document they contain."""

    def results(ids, texts):
        """Rows for all but the last of these documents, each before its successor."""
        edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:], strict=False)]
        own, new = sketches(pa.array(texts, pa.string())), sketches(pa.array(edited, pa.string()))
        rows = [(ids[i], len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest(), to_text(own[i]), to_text(new[i]), likeness(own[i], new[i]), likeness(own[i], own[i + 1]), containment(own[i], new[i]), containment(own[i], own[i + 1])) for i in range(len(edited))]
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[(c, pa.float64()) for c in ("near_edited", "near_next", "contained_edited", "contained_next")]])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        ids, texts, ended = [], [], False
        for batch in batches:
            for part in slices(batch, "text"):
                copies = part.column(2).to_pylist()
                own = len(copies) - sum(copies)
                if not ended:
                    take = min(len(copies), own + 1)  # of the copies only the first is anybody's next
                    ids += part.column(0).slice(0, take).to_pylist()
                    texts += part.column(1).slice(0, take).to_pylist()
                    ended = take > own
                if len(texts) > 1:
                    yield results(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]

    return numbered_next(docs).mapInArrow(tidy(run), COMPARED)


def op12_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
