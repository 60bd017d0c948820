"""Byte-level BPE encoding and decoding.

Pre-tokenisation needs no regex: every code point becomes a symbol of a small
transducer, symbol sequences are composed by an associative scan over the
transducer's transition monoid, and the state before each character tells where
slices begin.  Slices go through a bounded cache to the pair merging.
"""

from __future__ import annotations

import base64
import heapq
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.llm.common import chunks, decode, lean, pick, text_bytes

# Code points with the property White_Space.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Code point classes.
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
#: Symbols: a character in its context.  QUOTE2 and QUOTE3 open a contraction of so many characters; JOIN is a space before a visible character, LAST another blank there, RUN a blank elsewhere; EDGE separates texts.
S_OTHER, S_LETTER, S_NUMBER, S_JOIN, S_LAST, S_RUN, S_QUOTE2, S_QUOTE3, S_EDGE = range(9)
#: States: what the slice so far is.
FRESH, LETTERS, NUMBERS, OTHERS, JOINED, BLANKS, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at the symbol."""
    if symbol == S_LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (FRESH if state == ONE_LEFT else ONE_LEFT), False
        return LETTERS, state not in (LETTERS, JOINED)
    if symbol == S_NUMBER:
        return NUMBERS, state not in (NUMBERS, JOINED)
    if symbol in (S_OTHER, S_QUOTE2, S_QUOTE3):
        if state in (OTHERS, JOINED):
            return OTHERS, False
        return {S_OTHER: OTHERS, S_QUOTE2: ONE_LEFT, S_QUOTE3: TWO_LEFT}[symbol], True
    if symbol == S_RUN:
        return BLANKS, state != BLANKS
    return {S_JOIN: JOINED, S_LAST: FRESH, S_EDGE: FRESH}[symbol], True


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = BLANK
    table[32] = SPACE
    return table


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions reachable by composition: their product table (flat), their values by state, and boundaries by state and symbol."""
    states, symbols = range(8), range(9)
    first = [tuple(_step(s, x)[0] for s in states) for x in symbols]
    known = {f: i for i, f in reversed(list(enumerate(first)))}
    found = list(first)  # equal functions of two symbols keep two places
    at = 0
    while at < len(found):
        for g in first:
            if (h := tuple(g[found[at][s]] for s in states)) not in known:
                known[h] = len(found)
                found.append(h)
        at += 1
    product = [[known[tuple(g[f[s]] for s in states)] for g in found] for f in found]
    begins = [[_step(s, x)[1] for x in symbols] for s in states]
    return np.array(product, np.uint16).ravel(), np.array(found, np.uint8), np.array(begins, bool)


def _scan(codes: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive products of transition functions, by blocks: within them side by side, then over their totals, then both joined."""
    product, values, _ = _monoid()
    m, n = len(values), len(codes)
    if n <= block:
        out = codes.copy()
        for i in range(1, n):
            out[i] = product[int(out[i - 1]) * m + int(out[i])]
        return out
    pad = -n % block
    grid = np.ascontiguousarray(np.pad(codes, (0, pad), mode="edge").reshape(-1, block).T)
    for j in range(1, block):
        grid[j] = product[grid[j - 1] * np.uint16(m) + grid[j]]
    before = _scan(grid[-1].copy(), block)
    grid[:, 1:] = product[before[:-1][None, :] * np.uint16(m) + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def boundaries(joined: str, edges: np.ndarray) -> np.ndarray:
    """Code point offsets where slices of ``joined`` begin; ``edges`` are the offsets of its separators, which count as slices."""
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.zeros(0, np.int64)
    kind = _classes()[cp]
    sym = np.array([S_OTHER, S_LETTER, S_NUMBER, S_RUN, S_RUN], np.uint16)[kind]
    blank = kind >= SPACE
    seen = ~blank
    seen[edges] = False
    before_seen = np.flatnonzero(blank[:-1] & seen[1:])
    sym[before_seen] = np.where(kind[before_seen] == SPACE, S_JOIN, S_LAST)
    quote = np.flatnonzero(cp == 0x27)
    if len(quote):
        pad = np.concatenate([cp, np.zeros(2, np.uint32)])
        a, b = pad[quote + 1], pad[quote + 2]
        sym[quote[np.isin(a, [ord(c) for c in "stmd"])]] = S_QUOTE2
        sym[quote[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]] = S_QUOTE3
    sym[edges] = S_EDGE
    _, values, begins = _monoid()
    state = np.empty(len(sym), np.uint8)
    state[0] = FRESH
    state[1:] = values[_scan(sym)[:-1], FRESH]
    return np.flatnonzero(begins[state, sym])


class Merges(dict):
    """Slice of text to its packed ids, merged when first met; forgotten when ``limit`` slices are held."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 150_000):
        super().__init__()
        self.ranks, self.limit = ranks, limit

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [self.ranks[raw]] if raw in self.ranks else self._short(raw) if len(raw) < 200 else self._long(raw)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) < 200:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = out
        return out

    def _short(self, raw: bytes) -> list[int]:
        ranks, parts = self.ranks, [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _long(self, raw: bytes) -> list[int]:
        """The same merges in n log n steps: a heap of pairs over a linked list."""
        n, ranks = len(raw), self.ranks
        end, prev, nxt, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := ranks.get(raw[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := nxt[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def encode_texts(texts: list[str], merges: Merges) -> list[bytes]:
    """Packed little-endian unsigned 32-bit ids of each text."""
    joined = "\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    edges = ends[:-1] - 1
    starts = boundaries(joined, edges)
    cut = np.searchsorted(starts, np.concatenate([[0], ends])).tolist()
    at = starts.tolist()
    at.append(len(joined))
    out = []
    for k in range(len(texts)):
        lo, hi = cut[k], cut[k + 1] - (k + 1 < len(texts))  # the separator is a slice of its own
        out.append(b"".join([merges[joined[i:j]] for i, j in zip(at[lo:hi], at[lo + 1 : hi + 1])]))
    return out


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, offsets: bool = False) -> DataFrame:
    """Encodes whole texts with the ranks in the file ``vocabulary``.

    Returns ``id_col``, ``token_ids`` (binary: little-endian unsigned 32-bit ids),
    ``n_tokens`` and, if asked for, ``decoded`` (the bytes that the ids stand for,
    looked up again) and ``offsets`` (array of the byte offset of each token, by
    which :func:`decode_span` decodes part of a text).  Null and empty texts give
    no ids; invalid UTF-8 becomes U+FFFD first; rows, repeated ones too, are
    encoded one by one; an empty table gives an empty table.
    """
    raw = open(vocabulary, "rb").read()
    ranks = df.sparkSession.sparkContext.broadcast(raw)  # below 1 MB; executors need no such file
    rows = pick(df, id=id_col, text=text_col).select("id", text_bytes().alias("text"))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, words = _model(ranks.value)
        lengths = np.array([len(w) for w in words], np.int32)
        out_type = None
        for rows in chunks(batches, 1_000_000):
            ids = encode_texts([decode(t) for _, t in rows], merges)
            back: list = [None] * len(rows)
            at: list = [None] * len(rows)
            if decoded or offsets:
                for k, x in enumerate(ids):
                    numbers = np.frombuffer(x, "<u4")
                    if decoded:
                        back[k] = b"".join(map(words.__getitem__, numbers.tolist()))
                    if offsets:
                        size = lengths[numbers]
                        at[k] = np.cumsum(size) - size
            cols = [pa.array([r[0] for r in rows], out_type), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(back, pa.binary()), pa.array(at, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "token_ids", "n_tokens", "decoded", "offsets"])

    done = rows.mapInArrow(lean(run), schema)
    return done.select(F.col("id").alias(id_col), "token_ids", "n_tokens", *["decoded"] * decoded, *["offsets"] * offsets)


@lru_cache(2)
def _model(raw: bytes) -> tuple[Merges, list[bytes]]:
    ranks = parse_ranks(raw)
    words = [b""] * (max(ranks.values()) + 1)
    for w, i in ranks.items():
        words[i] = w
    return Merges(ranks), words


def decode_ids(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Bytes of packed ids: ``id_col`` and ``decoded`` (null ids: null)."""
    raw = df.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())
    rows = pick(df, id=id_col, ids=ids_col)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _model(raw.value)[1]
        for rows in chunks(batches):
            back = [None if x is None else b"".join(map(words.__getitem__, np.frombuffer(x, "<u4").tolist())) for _, x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(back, pa.binary())], names=["id", "decoded"])

    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def decode_span(token_ids: bytes, offsets: list[int], words: list[bytes], start: int, stop: int) -> bytes:
    """Bytes ``start:stop`` of the text, decoding only the tokens that reach into them."""
    ids = np.frombuffer(token_ids, "<u4")
    first = max(0, int(np.searchsorted(offsets, start, "right")) - 1)
    last = int(np.searchsorted(offsets, stop, "left"))
    part = b"".join(words[i] for i in ids[first:last])
    base = offsets[first] if len(offsets) else 0
    return part[start - base : stop - base]


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What an encoding with ``decoded=True`` comes to: counts and SHA-256 digests."""
    return encoded.select(id_col, "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
