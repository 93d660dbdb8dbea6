"""Cross-entropy difference: how much better a target model predicts a document than a background model does.

Both are bigram models over one vocabulary, with counts of all texts, exact under 64-bit hashes: every document counts for the background,
those of the target (labelled good) count for the target as well. A text is its words and an end mark, the first word follows a start mark.

    prior(w)  = (words(w) + A / s) / (all words + A / s * vocabulary)
    p(w | v)  = (pairs(v, w) + MU / s * prior(w)) / (words(v) + MU / s)

This is Dirichlet smoothing, so p sums to one over the vocabulary (the words of the corpus, the end mark and one for what is unknown). s
matches the models by size: it is 1 for the target, and for the background the target's words over its own, so that A and MU weigh the same
against both. A document's own counts are taken off words and pairs before it is scored (what that frees goes to the unknown word, so the
sum stays one): it is judged by what all others say, and a document of the target has no advantage from having been counted. The score is the mean of -log2 p(target) minus that of -log2 p(background):
lower is closer to the target.

Flow. A first pass counts words: sizes of the vocabulary and the models, and the words that hold 1 / FREQUENT of all. In the second each task
sends, for blocks of its documents, rows (word, word before, document, own counts) as packets to the bucket of the word. There all counts
that a row needs meet; what it adds to its document goes back as a packet to the document's block and is summed. Words that are frequent are
dealt by the pair instead, with their total known. No text moves, nothing is joined, and what is gathered grows with the corpus.

Defined cases: a null or empty text has no words, zero bits and score 0; with no target document the target's prior is uniform; labels other
than good and null ids don't mark a target; repeated rows count again and score alike; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm.common import Scratch, mix, slices, small_batches, table, tidy, word_hashes

MU, A = 64.0, 0.1
START, END = (mix(np.array([k], np.uint64))[0] for k in (0xB5297A4D3F84D5B5, 0x68E31DA4C5A1B7E9))
#: A word is frequent if it is so many-th of all words; there are no more of them than that.
FREQUENT = 1024
#: Ids of the target up to which they are broadcast; more are joined.
MOST_IDS = 1 << 20
#: Parts of a document's bits travel as multiples of one UNIT-th.
UNIT = 1 << 20
#: Words after which a task hands its counts on, and ends a block; documents of a block at most.
HELD, BLOCK, DOCS = 1 << 20, 1 << 19, 60_000


def sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all texts end to end: each word or end mark, what stands before it, which text it is of; and the texts' numbers of words."""
    w, off = word_hashes(column)
    n = np.diff(off)
    size = np.where(n > 0, n + 1, 0)
    stop = np.cumsum(size)
    of = np.repeat(np.arange(len(n)), size)
    word = np.empty(len(of), np.uint64)
    at_end = np.zeros(len(of), bool)
    at_end[stop[n > 0] - 1] = True
    word[at_end], word[~at_end] = END, w
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[(stop - size)[n > 0]] = START
    return word, before, of, n


def small(x: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, and those of 255 or more once again."""
    return [np.minimum(x, 255).astype(np.uint8), x[x >= 255].astype(np.int64)]


def unsmall(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = x.astype(np.int64)
    out[x == 255] = more
    return out


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], np.uint32).tobytes() + b"".join(a.dtype.str.encode() for a in arrays)
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(packet: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(packet, np.uint32, 1)[0])
    sizes = np.frombuffer(packet, np.uint32, n, 4).tolist()
    at = 4 + 4 * n
    kinds = [packet[at + 3 * i : at + 3 * i + 3].decode() for i in range(n)]
    at, out = at + 3 * n, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(packet, kind, size, at))
        at += out[-1].nbytes
    return out


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, the first counting most, and where in it a new combination begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int32)


def buckets_held(batches):
    """(bucket, packets, blocks) of rows that are sorted by bucket: bucket, block, packet."""
    of, packets, blocks = None, [], []
    for batch in batches:
        for k, b, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if k != of and packets:
                yield of, packets, blocks
                packets, blocks = [], []
            of = k
            packets.append(p)
            blocks.append(b)
    if packets:
        yield of, packets, blocks


PACKETS = "bucket int, block bigint, packet binary"


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "packet"])


def word_packets(bits: int):
    """doc_id, text, target -> counts of words as packets by bucket; in bucket -1 the numbers of texts with words, all and of the target."""

    def run(batches):
        kept, texts = [], np.zeros(2, np.int64)

        def fold():
            word, *counts = (np.concatenate(x) for x in zip(*kept, strict=True))
            order, cut = grouped(word)
            return word[order][cut], *(np.add.reduceat(c[order], cut) for c in counts)

        def out(word, background, target):
            bucket = bucket_of(word, bits)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows = [(int(bucket[i]), 0, pack(word[i:j], background[i:j].astype(np.uint32), target[i:j].astype(np.uint32))) for i, j in zip(cut, [*cut[1:], len(word)], strict=True)]
            for i in range(0, len(rows), 256):
                yield rows_of(rows[i : i + 256])

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                word, _, of, n = sentences(part.column(1))
                flag = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                texts += (n > 0).sum(), ((n > 0) & (flag == 1)).sum()
                if len(word):
                    kept.append((word, np.ones(len(word), np.int64), flag[of]))
                    size += len(word)
                if size >= HELD:
                    kept = [fold()]
                    size = len(kept[0][0])
                    if size > HELD // 2:
                        yield from out(*kept[0])
                        kept, size = [], 0
        if size:
            yield from out(*fold())
        yield rows_of([(-1, 0, pack(texts))])

    return run


SIZES = "word bigint, background bigint, target bigint, words bigint"


def count_words(batches):
    """Packets of word_packets, sorted by bucket -> for each bucket a row with its sums and its number of words, and rows of words that hold much of it;
    for bucket -1 numbers of texts, with words null."""
    for bucket, packets, _ in buckets_held(batches):
        if bucket < 0:
            a, b = sum(unpack(p)[0] for p in packets).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([None], [a], [b], [None])], names=["word", "background", "target", "words"])
            continue
        word, *counts = (np.concatenate(x) for x in zip(*map(unpack, packets), strict=True))
        order, cut = grouped(word)
        word = word[order][cut]
        background, target = (np.add.reduceat(c.astype(np.int64)[order], cut) for c in counts)
        much = np.flatnonzero(background * 64 >= background.sum())
        columns = ([None, *word[much].view(np.int64).tolist()], [int(background.sum()), *background[much].tolist()], [int(target.sum()), *target[much].tolist()], [len(word), *[None] * len(much)])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["word", "background", "target", "words"])


class Models:
    """The sizes of both models (background, target) and the counts of the frequent words."""

    def __init__(self, tokens: tuple[int, int], texts: tuple[int, int], vocabulary: int, frequent: list[tuple[int, int, int]]):
        self.tokens, self.texts, self.vocabulary = tokens, texts, vocabulary
        self.scale = (min(1.0, tokens[1] / tokens[0]) if tokens[0] and tokens[1] else 1.0, 1.0)
        order = np.argsort(np.array([w for w, _, _ in frequent], np.int64).view(np.uint64))
        self.word = np.array([w for w, _, _ in frequent], np.int64).view(np.uint64)[order]
        self.counts = np.array([x[1:] for x in frequent], np.int64).reshape(-1, 2)[order]

    def frequent(self, word: np.ndarray) -> np.ndarray:
        """Each word's place among the frequent ones, or -1."""
        if not len(self.word):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        return np.where(self.word[at] == word, at, -1)

    def log2_probability(self, m: int, pair, word, before):
        """log2 p(word | before) by counts that lack the document's own; arrays or numbers."""
        a, mu = A / self.scale[m], MU / self.scale[m]
        return np.log2(pair + mu * (word + a) / (self.tokens[m] + a * self.vocabulary)) - np.log2(before + mu)


def gram_packets(bits: int, models: Models):
    """doc_id, text, target -> for blocks of documents the packets of their pairs, by bucket, and under a bucket below zero of their heads."""

    def run(batches):
        k, held, docs = 0, [], 0

        def out():
            nonlocal k
            name, k = TaskContext.get().partitionId() << 32 | k, k + 1
            word, before, of, n, ids, null, flag = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = [(-1 - name % (1 << bits), name, pack(ids, null, n.astype(np.uint32), flag))]
            if len(word):
                _, which, own_word = np.unique(mix(word + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
                own_word = own_word[which]
                short = before >> np.uint64(24)
                bucket = bucket_of(np.where(models.frequent(word) >= 0, mix(word ^ before), word), bits)
                tail = (short << np.uint64(16)) | of.astype(np.uint64)
                order, cut = grouped(bucket, word, tail)
                own = np.diff(np.append(cut, len(order)))
                at = order[cut]
                bucket, word, short, of, own_word = bucket[at], word[at], short[at], of[at], own_word[at]
                ends = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                for i, j in zip(ends.tolist(), [*ends[1:].tolist(), len(at)], strict=True):
                    run_at = np.flatnonzero(np.concatenate([[True], word[i + 1 : j] != word[i : j - 1]]))
                    there, local = np.unique(of[i:j], return_inverse=True)
                    rows.append((int(bucket[i]), name, pack(
                        word[i:j][run_at], np.diff(np.append(run_at, j - i)).astype(np.uint32), short[i:j].astype(np.uint32), (short[i:j] >> np.uint64(32)).astype(np.uint8),
                        local.astype(np.uint16), *small(own[i:j]), *small(own_word[i:j]), there.astype(np.uint16), np.packbits(flag[there]))))
            for i in range(0, len(rows), 64):
                yield rows_of(rows[i : i + 64])

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                word, before, of, n = sentences(part.column(1))
                ids = part.column(0)
                if docs + len(n) > DOCS or size >= BLOCK:
                    if held:
                        yield from out()
                    held, docs, size = [], 0, 0
                null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                held.append((word, before, of + docs, n, ids.fill_null(0).to_numpy(), null, part.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)))
                docs += len(n)
                size += len(word)
        if held:
            yield from out()

    return run


def rounded(bits: np.ndarray) -> np.ndarray:
    """Bits as whole numbers of 1 / UNIT, where they fit in four bytes."""
    return np.rint(bits * UNIT).astype(np.int32) if len(bits) and np.abs(bits).max() < (1 << 31) / UNIT else bits


def part_bits(models: Models, packets: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the packets of a bucket what they add to their documents: places in the block, bits by background and target."""
    got = [unpack(p) for p in packets]
    word = np.concatenate([np.repeat(g[0], g[1]) for g in got])
    before = np.concatenate([g[2].astype(np.uint64) | g[3].astype(np.uint64) << np.uint64(32) for g in got])
    n_docs = np.array([len(g[9]) for g in got])
    base = np.cumsum(n_docs) - n_docs
    doc = np.concatenate([g[4].astype(np.int64) + b for g, b in zip(got, base.tolist(), strict=True)])
    own = np.concatenate([unsmall(g[5], g[6]) for g in got])
    own_word = np.concatenate([unsmall(g[7], g[8]) for g in got])
    flag = np.concatenate([np.unpackbits(g[10], count=k) for g, k in zip(got, n_docs.tolist(), strict=True)]).astype(np.int64)
    order, pair_at = grouped(word, before)
    word, before, doc, own, own_word = (x[order] for x in (word, before, doc, own, own_word))
    word_at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    place = models.frequent(word[word_at])
    spread = lambda cut, x: np.repeat(x, np.diff(np.append(cut, len(word))))
    out = []
    for m in (0, 1):
        counted = np.ones(len(doc), np.int64) if m == 0 else flag[doc]
        pairs = spread(pair_at, np.add.reduceat(own * counted, pair_at)) - own * counted
        total = np.add.reduceat(own * counted, word_at)
        if len(models.counts):
            total = np.where(place >= 0, models.counts[place, m], total)
        words = spread(word_at, total) - own_word * counted
        said = models.log2_probability(m, pairs, words, 0) + np.log2(MU / models.scale[m])  # the share of what stands before follows
        said -= np.where(word == END, 0, np.log2(words + MU / models.scale[m]))  # and here this word itself is what stands before
        out.append(np.bincount(doc, -own * said, len(flag)))
    return [(g[9], rounded(out[0][b : b + k]), rounded(out[1][b : b + k])) for g, b, k in zip(got, base.tolist(), n_docs.tolist(), strict=True)]


def add_up(models: Models):
    """Packets of gram_packets, sorted by bucket -> packets by block: heads as they are, and bits of documents."""

    def run(batches):
        for bucket, packets, blocks in buckets_held(batches):
            got = packets if bucket < 0 else [pack(*x) for x in part_bits(models, packets)]
            for i in range(0, len(got), 64):
                yield rows_of([(int(bucket >= 0), b, p) for b, p in zip(blocks[i : i + 64], got[i : i + 64], strict=True)])

    return run


SCORES = "doc_id bigint, n_tokens bigint, target_bits double, background_bits double, score double"


def scores(models: Models):
    """Packets of add_up, sorted by block -> the documents of each block with their scores."""

    def total(packets, heads):
        ids, null, n, flag = next(unpack(p) for p, h in zip(packets, heads, strict=True) if h == 0)
        bits = np.zeros((2, len(ids)))
        for p, h in zip(packets, heads, strict=True):
            if h:
                there, *more = unpack(p)
                for m in (0, 1):
                    bits[m][there] += more[m] if more[m].dtype == np.float64 else more[m] / UNIT
        n = n.astype(np.int64)
        some = n > 0
        for m in (0, 1):
            counted = np.where(m == 0, 1, flag.astype(np.int64))
            bits[m][some] += np.log2(models.texts[m] - counted + MU / models.scale[m])[some]
        mean = np.where(some, bits / (n + 1), 0.0)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(n), *(pa.array(np.round(x, 6)) for x in (mean[1], mean[0], mean[1] - mean[0]))], names=["doc_id", "n_tokens", "target_bits", "background_bits", "score"])

    def run(batches):
        of, packets, heads = None, [], []
        for batch in batches:
            for h, b, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != of and packets:
                    yield total(packets, heads)
                    packets, heads = [], []
                of = b
                packets.append(p)
                heads.append(h)
        if packets:
            yield total(packets, heads)

    return run


def marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, text and target. Up to MOST_IDS ids of the target are broadcast; more are joined."""
    spark = docs.sparkSession
    chosen = target_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if chosen.count() > MOST_IDS:
        return docs.join(chosen.withColumn("target", F.lit(True)), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    box = spark.sparkContext.broadcast(np.sort(chosen.toArrow().column(0).to_numpy().astype(np.int64)))

    def run(batches):
        ids = box.value
        for batch in batches:
            own = batch.column(0).fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
            hit = (ids[at] == own) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(own), bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=["doc_id", "text", "target"])

    return docs.mapInArrow(tidy(run), "doc_id bigint, text string, target boolean")


def dealt(packets: DataFrame, by: str) -> DataFrame:
    return packets.repartition(by).sortWithinPartitions(by)


def fit(spark: SparkSession, docs: DataFrame, bits: int) -> Models:
    """docs: doc_id, text and target. What comes to the driver is sums and FREQUENT rows at most."""
    scratch = Scratch(spark, "language-model")
    found = scratch.save(dealt(docs.mapInArrow(tidy(word_packets(bits)), PACKETS), "bucket").mapInArrow(tidy(count_words), SIZES), "words")
    part = found.where("word is null").groupBy(F.col("words").isNull().alias("texts")).agg(*[F.sum(c).alias(c) for c in ("background", "target", "words")]).collect()
    texts = next((r for r in part if r.texts), None)
    words = next((r for r in part if not r.texts), None)
    tokens = (words.background, words.target) if words else (0, 0)
    much = found.where(F.col("word").isNotNull() & (F.col("background") * FREQUENT >= tokens[0])).collect()
    scratch.drop(found)
    return Models(tokens, (texts.background, texts.target) if texts else (0, 0), (words.words if words else 0) + 1, [(r.word, r.background, r.target) for r in much])


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """docs: doc_id and text; target_ids: doc_id of the target's documents -> doc_id, n_tokens, target_bits and background_bits a word, score."""
    spark = docs.sparkSession
    small_batches(spark)
    bits = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() + 1)
    docs = marked(docs, target_ids)
    models = fit(spark, docs, bits)
    grams = docs.mapInArrow(tidy(gram_packets(bits, models)), PACKETS)
    sums = dealt(grams, "bucket").mapInArrow(tidy(add_up(models)), PACKETS)
    return dealt(sums, "block").mapInArrow(tidy(scores(models)), SCORES)


def op2_cross_entropy_difference(spark, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
