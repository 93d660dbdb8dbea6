"""Token ids in shuffled-plane files.

A shard holds the ids of consecutive documents as blocks of BLOCK ids. Each block is transposed into its byte planes (or bit planes), every
plane is compressed with zstandard by itself, planes of zeros take no room, and the shard ends with an index: for each chunk its place,
ids and planes, for each document its id and length.

    b"SPLN1"  chunk*  index  u64 place of the index  b"SPLN1"
    index: zstandard of u32 header length, JSON header, int64 doc ids, int64 lengths, int64 chunks[n][3 + planes]

Documents are dealt to shards by ranges of their id, so the shards in order are the ids in order. Tasks write to names of their own and
report them; a task that is run again writes another file, and only the reported one is read. Files are written and read through
pyarrow's file systems, by the address in spark.checkpoint.dir or any that is given.

Defined cases: a null text is the empty text, so its document is the end id alone; documents with equal ids stand in the order of
their texts' hashes; null ids come first; columns other than id and text are ignored; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm.bpe import pieces
from strandex.llm.common import Scratch, prefix_hash, slices, small_batches, substring_hash, table, tidy

MAGIC, BLOCK, END_ID = b"SPLN1", 1 << 16, 2


def to_planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """One row a plane: 4 byte planes, or 32 bit planes packed eight ids a byte."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    return np.ascontiguousarray(raw.T)


def from_planes(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if bits:
        raw = np.packbits(np.unpackbits(planes, axis=1, count=n).T, axis=1, bitorder="little")
    else:
        raw = np.ascontiguousarray(planes.T)
    return raw.reshape(-1).view("<u4")


class ShardWriter:
    """Appends documents to an open file; holds one block of ids and the index."""

    def __init__(self, out, bits: bool = False, level: int = 3):
        self.out, self.bits = out, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.chunks: list[list[int]] = []
        self.held: list[np.ndarray] = []
        self.n_held, self.at, self.total = 0, len(MAGIC), 0
        out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= BLOCK:
            flat = np.concatenate(self.held)
            for i in range(0, len(flat) - BLOCK + 1, BLOCK):
                self._chunk(flat[i : i + BLOCK])
            self.held = [flat[len(flat) // BLOCK * BLOCK :].copy()]
            self.n_held = len(self.held[0])

    def _chunk(self, ids: np.ndarray) -> None:
        sizes, start = [], self.at
        for plane in to_planes(ids, self.bits):
            data = self.zip.compress(plane.tobytes()) if plane.any() else b""
            self.out.write(data)
            sizes.append(len(data))
            self.at += len(data)
        self.chunks.append([start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), *sizes])

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        nulls = [i for i, d in enumerate(self.docs) if d is None]
        head = json.dumps({"bits": self.bits, "docs": len(self.docs), "chunks": len(self.chunks), "ids": self.total, "null_ids": nulls}).encode()
        index = struct.pack("<I", len(head)) + head + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes() + np.array(self.chunks, "<i8").tobytes()
        self.out.write(self.zip.compress(index) + struct.pack("<Q", self.at) + MAGIC)


class ShardReader:
    """Reads the index at once and chunks as they are asked for."""

    def __init__(self, file):
        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        file.seek(0, os.SEEK_END)
        size, tail = file.tell(), 8 + len(MAGIC)
        file.seek(size - tail)
        at, magic = struct.unpack("<Q", file.read(8))[0], file.read(len(MAGIC))
        if magic != MAGIC:
            raise ValueError("not a shard of token planes, or cut off")
        file.seek(at)
        raw = self.unzip.decompress(file.read(size - tail - at))
        n = struct.unpack_from("<I", raw)[0]
        self.head = json.loads(raw[4 : 4 + n])
        rest = np.frombuffer(raw, "<i8", offset=4 + n) if (len(raw) - 4 - n) % 8 == 0 else np.frombuffer(raw[4 + n :], "<i8")
        d, c = self.head["docs"], self.head["chunks"]
        self.docs, self.lengths = rest[:d], rest[d : 2 * d]
        self.chunks = rest[2 * d :].reshape(c, -1) if c else np.zeros((0, 7), np.int64)

    def chunk(self, k: int) -> np.ndarray:
        at, n, crc, *sizes = map(int, self.chunks[k])
        width = -(-n // 8) if self.head["bits"] else n
        self.file.seek(at)
        planes = np.zeros((len(sizes), width), np.uint8)
        for i, size in enumerate(sizes):
            if size:
                planes[i] = np.frombuffer(self.unzip.decompress(self.file.read(size), max_output_size=width), np.uint8)
        ids = from_planes(planes, n, self.head["bits"])
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc id, ids) in order; holds a document and a chunk at once."""
        nulls, rest, k = set(self.head["null_ids"]), np.zeros(0, np.uint32), 0
        for i, (doc, n) in enumerate(zip(self.docs.tolist(), self.lengths.tolist(), strict=True)):
            got = [rest]
            have = len(rest)
            while have < n:
                got.append(self.chunk(k))
                have += len(got[-1])
                k += 1
            flat = np.concatenate(got) if len(got) > 1 else rest
            yield (None if i in nulls else doc), flat[:n]
            rest = flat[n:]


class PieceEncoder:
    """The tokenizers library, asked once for each piece.

    Texts are cut by the array scanner of bpe.py, whose pattern is that of the library's byte-level pre-tokeniser; a piece not seen before goes
    to the library's model in its alphabet of bytes. Pieces are remembered by 64-bit hashes up to a bound, then anew. Texts that hold an added token (which the
    library takes for its id even where none is added), and those with code points that the library's older Unicode tables may class
    otherwise, go to the library whole.
    """

    def __init__(self, path: str, cached: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        split = ByteLevel(add_prefix_space=False, use_regex=False)
        #: The library's character for each byte, read off from enough texts of one character to see all bytes of UTF-8.
        self.letters = np.full(256, 0x20, "<u4")
        for c in map(chr, [*range(0x800), *range(0x800, 0xD800, 64), *range(0xE000, 0x110000, 4096)]):
            self.letters[list(c.encode())] = [ord(x) for x in split.pre_tokenize_str(c)[0][0]]
        self.cached = cached
        self._forget()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def odd(self, text: str) -> bool:
        return any(a in text for a in self.added) or (not text.isascii() and bool(_NEWER.search(text)))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Pieces become rows of a table of ids, and the texts' ids are gathered from it at once."""
        odd = [self.odd(t) for t in texts]
        raw, start, end, upto = pieces(["" if o else t for t, o in zip(texts, odd, strict=True)])
        hashes, first, which = np.unique(substring_hash(prefix_hash(np.frombuffer(raw, np.uint8)), start, end), return_index=True, return_inverse=True)
        if len(self.row) > self.cached:
            self._forget()
        hashes, row = hashes.tolist(), self.row
        known = [row.get(h, -1) for h in hashes]
        if new := [i for i, k in enumerate(known) if k < 0]:
            tokenize, n, at = self.tokenizer.model.tokenize, self.rows, first[new]
            written = self.letters[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")
            got = [[t.id for t in tokenize(written[a:b])] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            for k, i in enumerate(new, n):
                row[hashes[i]] = known[i] = k
            self._remember(np.fromiter(map(len, got), np.int64, len(got)), np.fromiter(chain.from_iterable(got), np.uint32))
        at = np.array(known, np.int64)[which]
        n = self.size[at]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.start[at] - before[:-1], n) + np.arange(before[-1])]
        stop = before[upto]
        for t, o, i, j in zip(texts, odd, np.concatenate([[0], stop[:-1]]).tolist(), stop.tolist(), strict=True):
            yield np.array(self.whole(t), np.uint32) if o else ids[i:j]

    def _remember(self, size: np.ndarray, flat: np.ndarray) -> None:
        """Appends to tables that double when they are full, so what a slice of text costs doesn't follow what is remembered."""

        def room(table, used, more):
            if used + more <= len(table):
                return table
            out = np.zeros(max(2 * len(table), used + more, 1 << 12), table.dtype)
            out[:used] = table[:used]
            return out

        k, n = self.rows, len(size)
        self.size, self.start, self.flat = room(self.size, k, n), room(self.start, k, n), room(self.flat, self.ids, len(flat))
        self.size[k : k + n] = size
        self.start[k : k + n] = self.ids + np.cumsum(size) - size
        self.flat[self.ids : self.ids + len(flat)] = flat
        self.rows, self.ids = k + n, self.ids + len(flat)

    def _forget(self) -> None:
        self.row: dict[int, int] = {}
        self.rows = self.ids = 0
        self.size, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)


#: Code points outside the blocks of common scripts and symbols, where the tables agree.
_NEWER = regex.compile(r"[^\x00-\u052f\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]")


_OPEN: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _OPEN:
        _OPEN[path] = PieceEncoder(path)
    return _OPEN[path]


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


MANIFEST = "path string, part int, first bigint, n_docs bigint, n_ids bigint"


def write_tokens(docs: DataFrame, tokenizer: str, to: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID, bits: bool = False) -> DataFrame:
    """Writes the shards under the address to. Returns the manifest, not yet run: one row a shard, in order of part."""

    def run(batches):
        name = f"part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.spln"
        writer, sink, first = None, None, None
        encode = piece_encoder(tokenizer).encode
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                docs = part.column(0).to_pylist()
                for doc, ids in zip(docs, encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    if writer is None:
                        where, path = filesystem(to)
                        where.create_dir(path, recursive=True)
                        sink, first = where.open_output_stream(f"{path}/{name}"), doc
                        writer = ShardWriter(sink, bits)
                    writer.add(doc, np.append(ids, np.uint32(end_id)) if end_id is not None else ids)
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{to}/{name}"], "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first], pa.int64()), "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    small_batches(docs.sparkSession)
    dealt = docs.select(F.col(key).cast("bigint").alias(key), text).repartitionByRange(F.col(key).asc_nulls_first(), F.xxhash64(text))
    return dealt.sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64(text)).mapInArrow(tidy(run), MANIFEST)


def read_tokens(manifest: DataFrame, each, schema: str) -> DataFrame:
    """each(doc id, start, ids) -> a row, for every document of the shards; start counts all ids before it.

    Where shards begin comes from their totals, one row a shard, summed on the driver."""
    spark = manifest.sparkSession
    rows, at, starts = sorted(manifest.select("path", "part", "first", "n_ids").collect(), key=lambda r: (r["first"] is not None, r["first"] or 0, r["part"])), 0, []
    for r in rows:
        starts.append((r["path"], at))
        at += r["n_ids"]

    def run(batches):
        kind = None
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, name = filesystem(path)
                with where.open_input_file(name) as f:
                    out = []
                    for doc, ids in ShardReader(f).documents():
                        out.append(each(doc, start, ids))
                        start += len(ids)
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, schema=(kind := kind or _arrow(schema)))
                            out = []
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=(kind := kind or _arrow(schema)))

    shards = spark.createDataFrame(starts, "path string, start bigint").repartition(max(1, len(starts)))
    return shards.mapInArrow(tidy(run), schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[t]) for n, t in (c.strip().split(" ") for c in schema.split(","))])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_files(spark, sf_dir: str, tokenizer: str | None = None, bits: bool = False) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    manifest = scratch.save(write_tokens(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path(), scratch.path("shards"), bits=bits), "manifest")

    def digest(doc, start, ids):
        return {"doc_id": doc, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())}

    return read_tokens(manifest, digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
