"""Phrase collocation mining by hashed bucket counts.

Three passes over the texts. Each counts exactly only what may still be frequent, and at the same time counts the next longer phrases by hash bucket:

1. words and pairs by bucket (words are the next length of the empty phrase), and each language's words in all;
2. words whose bucket is frequent, and pairs of such words (Apriori) whose own bucket is, exactly; triples of such pairs by bucket;
3. triples whose pairs and bucket are frequent, exactly.

A bucket that holds a frequent phrase is frequent itself, so nothing is lost; buckets that aren't spare their phrases from being counted, which is
nearly all of them, for most phrases are rare. Buckets are one byte each, up to the least frequency, in PIECES pieces that tasks send compressed
and that are added up piece by piece; only a bit a bucket is broadcast. They number 2**WORD_BITS and 2**PHRASE_BITS at any size: on a larger
corpus more buckets are frequent and more phrases are counted, to the same result.

Exact counts are of phrases as strings, combined within batches (under ids of words in the batch, not hashes) and within tasks before they are shuffled.

Defined cases: A-Z count as a-z; a null text has no words; a null language is `und`; equal texts and repeated rows count each; a language without words,
or without candidates, gives no rows; columns other than text and language are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandex.llm.common import Scratch, mix, prefix_hash, small_batches, substring_hash, table, texts_of, tidy

WORD_BITS, PHRASE_BITS, PIECES = 23, 25, 256
#: A phrase goes if a longer one has at least this share of its occurrences, in percent.
COVERED = 50
#: Parts of a language that are ranked by themselves before the whole.
DEALT = 64
#: Bytes of text that are worked on at once, and of which counts are combined before they leave a task.
AT_ONCE = 4 << 20

#: A word as a pattern: what stands between the spaces of a piece.
WORD = r"[^.,;:!?\x09-\x0D\x20]+"

# what bytes are: 0 in a word, 1 between words, 2 between pieces
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts in one language: their bytes, hashes, and whether the next word (the one after that) belongs to the same piece."""

    def __init__(self, column: pa.Array, lang: str):
        data, off = texts_of(column)
        n = len(off) - 1
        flat = np.full(len(data) + n + 1, 0x0A, np.uint8)  # a break after each text, and one before all
        flat[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(off)) + 1] = _LOWER[data]
        kind = _KIND[flat]
        inside = np.append(kind == 0, False)
        turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = turn[::2], turn[1::2]
        breaks = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        self.joined = breaks[1:] == breaks[:-1]
        h = substring_hash(prefix_hash(flat), self.start, self.end)
        self.hash = mix(h + mix(prefix_hash(np.frombuffer(lang.encode() + b"\xff", np.uint8))[-1:])[0])
        self.flat = flat

    def bytes_of(self) -> pa.Array:
        """The words as Arrow strings, without copying one by one."""
        size = self.end - self.start
        upto = np.concatenate([[0], np.cumsum(size)])
        held = self.flat[np.repeat(self.start - upto[:-1], size) + np.arange(upto[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(held)])

    def longer(self, k: int) -> np.ndarray:
        """Where k words stand in one piece."""
        at = np.arange(max(0, len(self.start) - k + 1))
        for i in range(k - 1):
            at = at[self.joined[at + i]]
        return at

    def buckets(self, at: np.ndarray, k: int) -> np.ndarray:
        h = self.hash[at]
        for i in range(1, k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self.hash[at + i])
        return (h >> np.uint64(64 - (WORD_BITS if k == 1 else PHRASE_BITS))).astype(np.int64)


class Bits:
    """A bit a bucket."""

    def __init__(self, bits: int):
        self.bytes = np.zeros((1 << bits) >> 3, np.uint8)

    def put(self, piece: int, packed: bytes) -> None:
        n = len(self.bytes) // PIECES
        self.bytes[piece * n : piece * n + n] = np.frombuffer(packed, np.uint8)

    def has(self, bucket: np.ndarray) -> np.ndarray:
        return (self.bytes[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


class Frequent:
    """What passes so far say: which buckets of words, pairs and triples may hold frequent phrases."""

    def __init__(self, **found: Bits):
        self.found = found

    def words(self, w: Words) -> np.ndarray:
        return self.found["1"].has(w.buckets(np.arange(len(w.hash)), 1))

    def pairs(self, w: Words) -> np.ndarray:
        ok, at = self.words(w), w.longer(2)
        at = at[ok[at] & ok[at + 1]]
        return at[self.found["2"].has(w.buckets(at, 2))]

    def triples(self, w: Words) -> np.ndarray:
        pair = np.zeros(len(w.hash) + 1, bool)
        pair[self.pairs(w)] = True
        at = np.flatnonzero(pair[:-1] & pair[1:])
        return at[self.found["3"].has(w.buckets(at, 3))] if "3" in self.found else at


def counted(w: Words, at: dict[int, np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Distinct phrases and their numbers, for places by length. Words get ids within the batch, phrases are pairs of ids."""
    coded = w.bytes_of().dictionary_encode()
    ids, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    out = []
    for k, places in at.items():
        key = ids[places]
        if k == 3:  # the first two as one id, so that three ids fit in 64 bits
            first, key = np.unique(key * len(names) + ids[places + 1], return_inverse=True)
        last = ids[places + k - 1]
        key = key if k == 1 else key * len(names) + last
        found, where, n = np.unique(key, return_index=True, return_counts=True)
        parts = [names.take(pa.array(ids[places[where] + i])) for i in range(k)]
        out.append((parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), n))
    return pa.concat_arrays([p for p, _ in out]), pa.array(np.concatenate([n for _, n in out]))


def by_language(batches):
    """The texts of one language each. Languages are held back together until they have 4 * AT_ONCE bytes."""
    held, size = {}, 0
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            held.setdefault(lang, []).append(batch.column(1).filter(pc.equal(langs.indices, i)))
        size += batch.nbytes
        if size >= 4 * AT_ONCE:
            for lang in list(held):
                yield lang, pa.chunked_array(held.pop(lang)).cast(pa.large_string())
            size = 0
    for lang, texts in held.items():
        yield lang, pa.chunked_array(texts).cast(pa.large_string())


def blocks(column: pa.ChunkedArray):
    """Runs of texts of AT_ONCE bytes, or single texts."""
    texts = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    _, off = texts_of(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(off, off[start] + AT_ONCE, "right")) - 1)
        yield texts.slice(start, end - start)
        start = end


def add(counts: np.ndarray, bucket: np.ndarray, most: int) -> None:
    """Counts buckets, none beyond most."""
    at, n = np.unique(bucket, return_counts=True)
    counts[at] = np.minimum(counts[at] + n, most)


def frequent_buckets(texts: DataFrame, least: int, before: Frequent | None, sizes: tuple[int, ...]) -> dict[str, Bits]:
    """Which buckets of phrases of the given lengths hold at least so many, counting only phrases that `before` leaves."""
    bits = {k: WORD_BITS if k == 1 else PHRASE_BITS for k in sizes}
    most = min(least, 127)
    seen = texts.sparkSession.sparkContext.broadcast(before)

    def count(batches):
        counts = {k: np.zeros(1 << b, np.uint8) for k, b in bits.items()}
        for lang, column in by_language(batches):
            for part in blocks(column):
                w = Words(part, lang)
                for k in sizes:
                    add(counts[k], w.buckets(seen.value.triples(w) if seen.value else w.longer(k), k), most)
        pack = zstandard.ZstdCompressor(level=1)
        for k in sizes:
            for piece, x in enumerate(counts[k].reshape(PIECES, -1)):
                if x.any():
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "piece": pa.array([piece], pa.int32()), "counts": pa.array([pack.compress(x.tobytes())], pa.binary())})

    def total(batches):
        sums, unpack = {}, zstandard.ZstdDecompressor()
        for batch in batches:
            for k, piece, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(unpack.decompress(packed), np.uint8)
                sums[k, piece] = np.minimum(sums[k, piece] + x, most) if (k, piece) in sums else x
        for (k, piece), x in sums.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "piece": pa.array([piece], pa.int32()), "bits": pa.array([np.packbits(x >= most, bitorder="little").tobytes()], pa.binary())})

    pieces = texts.mapInArrow(tidy(count), "k int, piece int, counts binary").repartition("k", "piece")
    out = {k: Bits(b) for k, b in bits.items()}
    for r in pieces.mapInArrow(tidy(total), "k int, piece int, bits binary").collect():  # a bit a bucket at most
        out[r.k].put(r.piece, r.bits)
    return {str(k): b for k, b in out.items()}


def exact(texts: DataFrame, least: int, frequent: Frequent, sizes: tuple[int, ...]) -> DataFrame:
    """lang, phrase, n of the phrases of the given lengths that occur at least so often."""
    seen = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for lang, column in by_language(batches):
            for part in blocks(column):
                w = Words(part, lang)
                places = {k: np.flatnonzero(seen.value.words(w)) if k == 1 else seen.value.pairs(w) if k == 2 else seen.value.triples(w) for k in sizes}
                phrases, n = counted(w, places)
                for i in range(0, len(n), 1 << 14):
                    p = phrases.slice(i, 1 << 14)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(p), pa.string()), p.cast(pa.string()), n.slice(i, 1 << 14)], names=["lang", "phrase", "n"])

    return texts.mapInArrow(tidy(run), "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def cut_score(a, left, right):
    """floor(1000000 a² / (left right)), exact while a stays under 10**15."""
    wide = lambda c: c.cast("decimal(16,0)")
    top = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(32,0)"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    totals = texts.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORD)).cast("bigint")).alias("n"))
    first = frequent_buckets(texts, least, None, (1, 2))
    short = scratch.save(exact(texts, least, Frequent(**first), (1, 2)), "short")
    third = frequent_buckets(texts, least, Frequent(**first), (3,))
    long = scratch.save(exact(texts, least, Frequent(**first, **third), (3,)), "long")

    one, two = short.where("instr(phrase, ' ') = 0"), short.where("instr(phrase, ' ') > 0")
    w = F.split("phrase", " ")
    pair = lambda i: F.concat_ws(" ", w[i], w[i + 1])
    count_of = lambda df, name: df.select("lang", F.col("phrase").alias(name), F.col("n").alias(f"f_{name}"))
    triples = long.select("lang", "phrase", F.col("n").alias("a"), w[0].alias("w0"), pair(1).alias("w12"), pair(0).alias("w01"), w[2].alias("w2"))
    for name, df in (("w0", one), ("w12", two), ("w01", two), ("w2", one)):
        triples = triples.join(count_of(df, name), ["lang", name])
    triples = scratch.save(triples, "triples")
    cuts = [cut_score(F.col("a"), F.col(f"f_{x}"), F.col(f"f_{y}")) for x, y in (("w0", "w12"), ("w01", "w2"))]
    lower = lambda x, y: F.when(cuts[0] <= cuts[1], x).otherwise(y)
    of_three = triples.select("lang", "phrase", "a", lower(F.col("f_w0"), F.col("f_w01")).alias("l"), lower(F.col("f_w12"), F.col("f_w2")).alias("r"), F.least(*cuts).alias("score"))

    inside = triples.select("lang", F.explode(F.array("w01", "w12")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    pairs = two.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < COVERED * F.col("n"), F.lit(True)))
    pairs = pairs.select("lang", "phrase", F.col("n").alias("a"), w[0].alias("w0"), w[1].alias("w1"))
    for name in ("w0", "w1"):
        pairs = pairs.join(count_of(one, name), ["lang", name])
    of_two = pairs.select("lang", "phrase", "a", F.col("f_w0").alias("l"), F.col("f_w1").alias("r"), cut_score(F.col("a"), F.col("f_w0"), F.col("f_w1")).alias("score"))

    # first within DEALT parts of each language, so what meets in a language's one task is at most DEALT * top rows
    order = [F.desc("score"), F.desc("a"), "phrase"]
    every = of_three.unionByName(of_two).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    few = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM words, range(1, 4) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT c.lang, c.phrase, c.k, c.a, c.j, x.a AS l, y.a AS r, (1000000 * c.a::HUGEINT * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT * FROM candidates, range(1, 3) t(j) WHERE j < k) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE k = 3),
kept AS (SELECT b.* FROM best b WHERE b.k = 3 OR NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 50 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
