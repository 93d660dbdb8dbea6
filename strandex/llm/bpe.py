"""Byte-level BPE without a regular expression engine.

Texts are cut into pieces the way this pattern would, by arrays:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Each code point has a class, each class a function from scanner state to scanner state. Composition of such functions is associative and
few of them exist, so they are numbered once and composed through a table: rows of a batch are scanned side by side, the rows' products
are scanned in turn, and both are combined. A boundary follows from the state before a code point and its class. White space, the one
part that looks ahead, is settled by run ends. The pieces, as slices of the UTF-8 bytes, go through a cache to pair merging by rank.

Defined cases: a null text is the empty text and has no ids; repeated rows are encoded alike; texts of any length are scanned in
parts of bounded memory only by batch, a text itself is never cut; columns other than id and text are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandex.llm.common import slices, small_batches, table, tidy

# Classes of code points. TICK2 and TICK3 are apostrophes that would start a contraction of 2 or 3 code points.
LETTER, NUMBER, OTHER, TICK2, TICK3, GAP, BLANK, EDGE = range(8)
# States: what the last piece is. FRESH: the next code point starts a piece, as at the text's start, after a contraction or white space other
# than the blank. ONE, TWO: so many code points of a contraction are to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, ONE, TWO = range(7)

#: White space as Unicode defines it (fixed values).
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow the apostrophe (fixed values).
SHORT, LONG = "stmd", ("re", "ve", "ll")


def _step(state: int, cls: int) -> int:
    if cls in (EDGE, GAP):
        return FRESH
    if state in (ONE, TWO):
        return FRESH if state == ONE else ONE
    if cls in (TICK2, TICK3):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS
        return ONE if cls == TICK2 else TWO
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: AFTER_BLANK}[cls]


def _starts(state: int, cls: int) -> bool:
    """Whether a piece starts at a code point of a class after a state; white space is settled elsewhere."""
    if cls in (EDGE, GAP, BLANK) or state == FRESH:
        return True
    if state in (ONE, TWO, AFTER_BLANK):
        return False
    return _step(state, cls) != state


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that sequences of classes amount to: (number of each class's function, product table, value at FRESH)."""
    unit = tuple(range(7))
    maps = [tuple(_step(s, c) for s in range(7)) for c in range(8)]
    found = {unit: 0}
    queue = [unit]
    while queue:
        f = queue.pop()
        for g in maps:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    every = list(found)
    product = np.array([[found[tuple(g[x] for x in f)] for g in every] for f in every], np.uint8)
    return np.array([found[m] for m in maps], np.uint8), product, np.array([f[FRESH] for f in every], np.uint8)


_NUMBER_OF, _PRODUCT, _AT_FRESH = _monoid()
_FLAT, _WIDTH = _PRODUCT.ravel(), np.intp(_PRODUCT.shape[1])
_STARTS = np.array([[_starts(s, c) for c in range(8)] for s in range(7)])
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, built once a process from the Unicode tables of the library whose ids ours must equal: an encoder of
    single bytes that passes over whatever isn't in a class hands the class back."""
    if not _CLASSES:
        import tiktoken

        out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
        for of, one in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            only = tiktoken.Encoding("class", pat_str=one, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            out[np.frombuffer(bytes(only.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = of
        out[list(WHITE)] = GAP
        out[32] = BLANK
        _CLASSES.append(out)
    return _CLASSES[0]


def _compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _FLAT.take(a * _WIDTH + b)


def scan(cls: np.ndarray, width: int = 256) -> np.ndarray:
    """The state before each element, FRESH before the first: an exclusive scan by function composition."""
    n = len(cls)
    rows = -(-n // width)
    f = np.zeros(rows * width, np.uint8)  # 0 is the identity
    f[:n] = _NUMBER_OF[cls]
    columns = np.ascontiguousarray(f.reshape(rows, width).T)
    before = np.empty_like(columns)
    acc = np.zeros(rows, np.uint8)
    for j in range(width):
        before[j] = acc
        acc = _compose(acc, columns[j])
    total = np.zeros(rows, np.uint8)  # each row's product with all rows before it
    if rows > width:
        shift = scan_products(acc, width)
    else:
        shift, run = total, 0
        for i in range(rows):
            shift[i] = run
            run = int(_PRODUCT[run, acc[i]])
    state = _AT_FRESH[_compose(shift[None, :], before)]
    return np.ascontiguousarray(state.T).ravel()[:n]


def scan_products(f: np.ndarray, width: int) -> np.ndarray:
    """Exclusive products of functions, by doubling: composition is associative."""
    out = np.concatenate([[np.uint8(0)], f[:-1]]).astype(np.uint8)
    step = 1
    while step < len(out):
        nxt = out.copy()
        nxt[step:] = _compose(out[:-step], out[step:])
        out, step = nxt, 2 * step
    return out


def pieces(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 of all texts with a byte between them, starts and ends of pieces in it, the number of pieces up to each text's end)."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    cls = classes()[cp]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    cls[ends] = EDGE
    tick = np.flatnonzero(cp == 39)
    if len(tick):
        at = lambda k: cp[np.minimum(tick + k, len(cp) - 1)]
        a, b = at(1), at(2)
        cls[tick[np.isin(a, [ord(c) for c in SHORT])]] = TICK2
        for x, y in LONG:
            cls[tick[(a == ord(x)) & (b == ord(y))]] = TICK3
    starts = _STARTS[scan(cls), cls]
    white = (cls == GAP) | (cls == BLANK)
    before = np.concatenate([[False], white[:-1]])
    after = np.concatenate([white[1:], [False]])
    edge_next = np.concatenate([cls[1:] == EDGE, [True]])
    w = white.nonzero()[0]
    starts[w] = ~before[w] | (~after[w] & ~edge_next[w])  # a run's start, and its last code point unless the text ends there
    at = np.concatenate([[0], np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000).astype(np.int64))])
    begin = np.flatnonzero(starts)
    real = cls[begin] != EDGE
    stop = np.concatenate([begin[1:], [len(cp)]])
    upto = np.cumsum(real)[np.searchsorted(begin, ends)]
    return joined.encode(), at[begin[real]], at[stop[real]], upto


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: the adjacent pair of the lowest rank, the leftmost of equals, is joined until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    if n > 48:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(n)]
    get, none = ranks.get, 1 << 60
    rank = [get(piece[i : i + 2], none) for i in range(n - 1)]
    while rank and (low := min(rank)) < none:
        i = rank.index(low)
        parts[i] += parts.pop(i + 1)
        rank.pop(i)
        if i < len(rank):
            rank[i] = get(parts[i] + parts[i + 1], none)
        if i:
            rank[i - 1] = get(parts[i - 1] + parts[i], none)
    return tuple(ranks[p] for p in parts)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same by a heap over a linked list: n log n for pieces of any length."""
    n = len(piece)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := nxt[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class BytePairs:
    """Encoder and decoder for one rank file. cached: pieces remembered at once; when full, the cache starts anew, so memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], cached: int = 400_000):
        self.ranks, self.cached = ranks, cached
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.token[v] = k

    @classmethod
    def read(cls, path: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        return (ids for ids, _ in self.encode_with_offsets(texts))

    def encode_with_offsets(self, texts: list[str]) -> Iterator[tuple[list[int], tuple[np.ndarray, np.ndarray]]]:
        """For each text its ids, and its pieces' starts and ends in the UTF-8 bytes of the text."""
        if not texts:
            return
        raw, start, end, upto = pieces(texts)
        found = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        cache, ranks = self.cache, self.ranks
        if len(cache) > self.cached:
            cache.clear()
        for p in set(found).difference(cache):
            cache[p] = merge(p, ranks)
        ids, i, base = list(map(cache.__getitem__, found)), 0, 0
        for t, j in zip(texts, upto.tolist(), strict=True):
            yield list(chain.from_iterable(ids[i:j])), (start[i:j] - base, end[i:j] - base)
            i, base = j, base + len(t.encode()) + 1

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_OPEN: dict[str, BytePairs] = {}


def encoder(path: str) -> BytePairs:
    """One encoder a worker process and file."""
    if path not in _OPEN:
        _OPEN[path] = BytePairs.read(path)
    return _OPEN[path]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array<int>) and the byte offsets of the pieces (array<int>, one more than pieces) of every row."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            for part in slices(batch, text):
                names = part.schema.names
                texts = [t or "" for t in part.column(names.index(text)).to_pylist()]
                got = list(bpe.encode_with_offsets(texts))
                offsets = [np.concatenate([s[:1] if len(s) else [0], e]).astype(np.int32) for _, (s, e) in got]
                yield pa.RecordBatch.from_arrays([part.column(names.index(key)), pa.array([ids for ids, _ in got], pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))], names=[key, "ids", "offsets"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(run), f"{key} {kind}, ids array<int>, offsets array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encoding every text and decoding its ids again gives."""

    def run(batches):
        bpe = encoder(path)
        word = [str(i) for i in range(len(bpe.token))].__getitem__
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                n, of_ids, of_text = [], [], []
                for ids in bpe.encode([t or "" for t in part.column(1).to_pylist()]):
                    n.append(len(ids))
                    of_ids.append(sha(",".join(map(word, ids)).encode()))
                    of_text.append(sha(bpe.decode(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op5_byte_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), path or ranks_path())


def encoding_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the digests of every document that is left."""
    return digests(docs, ranks_path())
