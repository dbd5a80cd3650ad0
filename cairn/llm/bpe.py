"""Byte-level BPE encoding and decoding, with pre-tokens found by scans of transition functions.

Each code point gets a symbol from its class (letter, number, space, other) and from what follows
it (white space or not; the rest of a contraction). An automaton of eight states reads the symbols.
A symbol is a function from states to states, and such functions compose associatively: the text is
cut into lanes, every lane's function is composed for all lanes at once, the lanes' functions are
scanned by doubling, and a second pass replays each lane from its known first state. A token starts
wherever the transition says so. No regular expression is used.

The slices feed a cache from bytes to ids. Slices that it lacks are merged together: each round
finds every slice's best pair at once in numpy.

Defined cases: a null text is empty and has no tokens; other columns come along under names of the
caller's choice; special tokens don't exist, their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common

#: White space as Unicode defines it.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
L, N, O, SP, WS = range(5)  # classes: letter, number, other, the space, other white space
# Symbols: the first three classes, then these.
LAST_SPACE, LAST_WS, INNER_WS, SHORT, LONG = 3, 4, 5, 6, 7
FRESH, IN_L, IN_N, IN_O, IN_WS, PREFIX, ONE_MORE, TWO_MORE = range(8)

#: Slices that the cache holds at most, and the longest slice that it and the joint merging take.
CACHE, LONGEST = 100_000, 48


def code_point_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, O, np.uint8)
    out[: 0x30000] = [{"L": L, "N": N}.get(unicodedata.category(chr(i))[0], O) for i in range(0x30000)]
    out[0x30000:0x32400] = [{"L": L, "N": N}.get(unicodedata.category(chr(i))[0], O) for i in range(0x30000, 0x32400)]
    out[SPACES] = WS
    out[32] = SP
    return out


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]; symbols from 8 on are the same at a text's first character."""
    begin = {L: IN_L, N: IN_N, O: IN_O, LAST_SPACE: PREFIX, LAST_WS: FRESH, INNER_WS: IN_WS, SHORT: ONE_MORE, LONG: TWO_MORE}
    goes = {(IN_L, L): IN_L, (IN_N, N): IN_N, (IN_WS, INNER_WS): IN_WS, (PREFIX, L): IN_L, (PREFIX, N): IN_N}
    goes |= {(s, x): IN_O for s in (IN_O, PREFIX) for x in (O, SHORT, LONG)}
    goes |= {(ONE_MORE, x): FRESH for x in range(8)} | {(TWO_MORE, x): ONE_MORE for x in range(8)}
    follow, starts = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for x in range(8):
        for s in range(8):
            follow[x, s] = goes.get((s, x), begin[x])
            starts[x, s] = (s, x) not in goes
            follow[x + 8, s] = begin[x]
    return follow, starts


FOLLOW, STARTS = _automaton()
_classes: list[np.ndarray] = []


def scan_states(symbols: np.ndarray, lane: int = 256) -> np.ndarray:
    """The state before each symbol, by composing transition functions."""
    n = len(symbols)
    lanes = -(-n // lane)
    grid = np.zeros(lanes * lane, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, lane).T)
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (lanes, 8)).copy()
    for row in grid:
        whole = FOLLOW[row[:, None], whole]
    step = 1
    while step < lanes:  # inclusive scan: whole[i] becomes the function of lanes 0 to i
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].copy(), 1)
        step *= 2
    state = np.empty(lanes, np.uint8)
    state[0], state[1:] = FRESH, whole[:-1, FRESH]
    out = np.empty((lane, lanes), np.uint8)
    for k, row in enumerate(grid):
        out[k] = state
        state = FOLLOW[row, state]
    return out.T.reshape(-1)[:n]


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte offsets at which pre-tokens start, over the joined UTF-8 of several texts. No token crosses texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    if not _classes:
        _classes.append(code_point_classes())
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    kind = _classes[0][points]
    head = np.zeros(len(points) + 1, bool)
    head[np.searchsorted(at, offsets[offsets < len(data)])] = True
    head[-1] = True
    after = np.append(points[1:], 0)
    after[head[1:]] = 0
    after2 = np.append(after[1:], 0)
    after2[head[1:]] = 0
    space = kind >= SP
    before_black = np.append(~space[1:], False) & ~head[1:]
    symbols = kind.copy()
    symbols[space] = INNER_WS
    symbols[(kind == WS) & before_black] = LAST_WS
    symbols[(kind == SP) & before_black] = LAST_SPACE
    quote = np.flatnonzero(points == 39)
    x, y = after[quote], after2[quote]
    symbols[quote[np.isin(x, [115, 116, 109, 100])]] = SHORT  # s t m d
    long_ = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))  # re ve ll
    symbols[quote[long_]] = LONG
    symbols[head[:-1]] += 8
    return at[STARTS[symbols, scan_states(symbols)]]


class Codec:
    """Encodes and decodes by merge ranks: ranks maps each token's bytes to its id, every byte among them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        order = sorted(ranks, key=ranks.__getitem__)
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for token in order:
            self.lengths[ranks[token]] = len(token)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(order), np.uint8)  # in the order of ids, so gaps take no room
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, made in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = made
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()] + [1 << 40], np.int64)
        self.cache: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.cache.clear()
        self.flat, self.from_, self.count, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        i = np.searchsorted(self.pair_keys, key)
        i[i == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[i] == key, self.pair_ids[i], 1 << 40)

    def merge(self, slices: list[bytes]) -> list[np.ndarray]:
        """The ids of each slice, none longer than LONGEST: all slices' best (leftmost) pairs merge in each round."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(slices)
        sizes = np.array([len(x) for x in slices])
        for low, high in ((0, 8), (8, 16), (16, 28), (28, LONGEST)):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(own):
                continue
            width = high
            ids = np.full((len(own), width), -1, np.int64)
            count = sizes[own]
            joined = np.frombuffer(b"".join(slices[i] for i in own.tolist()), np.uint8)
            ids[np.arange(width) < count[:, None]] = self.byte_ids[joined]
            rank = np.full((len(own), width - 1), 1 << 40, np.int64)
            good = ids[:, 1:] >= 0
            rank[good] = self._pair_ranks(ids[:, :-1][good], ids[:, 1:][good])
            live = np.arange(len(own))
            cols = np.arange(width - 1)
            while len(live):
                r = rank[live]
                j = r.argmin(1)
                best = r[np.arange(len(live)), j]
                more = best < 1 << 40
                live, j, best = live[more], j[more], best[more]
                if not len(live):
                    break
                x, r = ids[live], rank[live]
                beyond = cols > j[:, None]
                x[:, :-1] = np.where(beyond, x[:, 1:], x[:, :-1])
                x[:, -1] = -1
                r[:, :-1] = np.where(beyond[:, :-1], r[:, 1:], r[:, :-1])
                r[:, -1] = 1 << 40
                k = np.arange(len(live))
                x[k, j] = best
                count[live] -= 1
                for place in (j - 1, j):
                    valid = (place >= 0) & (place + 1 < count[live])
                    q = k[valid]
                    p = place[valid]
                    r[q, p] = self._pair_ranks(x[q, p], x[q, p + 1])
                    dead = k[(place >= 0) & (place + 1 >= count[live]) & (place < width - 1)]
                    r[dead, place[dead]] = 1 << 40
                ids[live], rank[live] = x, r
            for i, row, m in zip(own.tolist(), ids.astype(np.uint32), count.tolist(), strict=True):
                out[i] = row[:m]
        return out

    def merge_long(self, slice_: bytes) -> np.ndarray:
        """The ids of a slice of any length, by a heap of pairs."""
        ids, ranks = self.byte_ids[np.frombuffer(slice_, np.uint8)].tolist(), self.ranks
        n = len(ids)
        start, end = list(range(n)), list(range(1, n + 1))
        prev, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(slice_[i : i + 2])) is not None]
        heapq.heapify(heap)
        dead = bytearray(n)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if dead[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            dead[j] = 1
            ids[i], end[i], after[i] = r, stop, after[j]
            if after[i] < n:
                prev[after[i]] = i
                if (r := ranks.get(slice_[start[i] : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if prev[i] >= 0 and (r := ranks.get(slice_[start[prev[i]] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        return np.array([x for x, gone in zip(ids, dead, strict=True) if not gone], np.uint32)

    def _learn(self, slices: list[bytes]) -> None:
        known = [self.ranks.get(x) for x in slices]
        open_ = [x for x, k in zip(slices, known, strict=True) if k is None]
        short = iter(self.merge([x for x in open_ if len(x) <= LONGEST]))
        for x, k in zip(slices, known, strict=True):
            ids = np.array([k], np.uint32) if k is not None else next(short) if len(x) <= LONGEST else self.merge_long(x)
            m = len(self.cache)
            if m >= len(self.from_):
                self.from_, self.count = np.resize(self.from_, 2 * m), np.resize(self.count, 2 * m)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            self.from_[m], self.count[m] = self.used, len(ids)
            self.used += len(ids)
            self.cache[x] = m

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Over several texts: the ids, the byte offset in data at which each starts, and the texts' offsets among the ids."""
        starts = pre_tokens(data, offsets)
        whole = data.tobytes()
        ends = np.append(starts[1:], len(data))
        slices = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        cache = self.cache
        new = [x for x in dict.fromkeys(slices) if x not in cache]
        if len(cache) + len(new) > CACHE and cache:
            self._reset()
            new = list(dict.fromkeys(slices))
        self._learn(new)
        index = np.fromiter(map(cache.__getitem__, slices), np.int64, len(slices))
        each = self.count[index]
        ids = self.flat[common.ranges(self.from_[index], each)]
        if len(cache) > CACHE or self.used > 1 << 22:
            self._reset()
        wide = self.lengths[ids]
        places = np.cumsum(wide) - wide
        return ids, places, np.searchsorted(places, offsets)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return self.bytes[common.ranges(self.places[ids], self.lengths[ids])]


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base 64 and its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_codecs: dict[str, Codec] = {}


def _codec(name: str, ranks) -> Codec:
    """One codec a worker process and vocabulary."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(ranks.value)
    return _codecs[name]


def encode(docs: DataFrame, ranks_path: str, text_column: str = "text", others: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """The columns in `others`, then n_tokens, ids (array), starts (each token's byte offset), ids_sha256, decoded_sha256.

    ids and starts only with_ids. The vocabulary is read on the driver and broadcast; a file of more
    than 16 MB raises ValueError. decoded_sha256 is over the bytes that the ids decode to.
    """
    import os

    others = others or []
    if os.path.getsize(ranks_path) > 1 << 24:
        raise ValueError(f"{ranks_path} has over 16 MB")
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, ranks)
        for batch in common.pieces(batches, "text"):
            data, offsets = common.texts(batch.column("text"))
            ids, places, rows = codec.encode(data, offsets)
            body, raw = codec.decode(ids).tobytes(), ids.astype("<u4").tobytes()
            ends = np.append(places, len(body))[rows]  # where each text's tokens begin in what is decoded
            at, by = (4 * rows).tolist(), ends.tolist()
            cols = [pa.array(np.diff(rows)), pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]), pa.array([hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(by[:-1], by[1:], strict=True)])]
            if with_ids:
                inner = places - np.repeat(offsets[:-1], np.diff(rows))
                cols += [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(inner.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cols], ["row", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "starts"] if with_ids else [])])

    rows = docs.select(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(others)), F.lit(0).alias("none")).alias("row"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("starts", T.ArrayType(T.IntegerType()))
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)), *(["n_tokens", "ids", "starts"] if with_ids else ["n_tokens"]), "ids_sha256", "decoded_sha256")


def decode(encoded: DataFrame, ranks_path: str, ids_column: str = "ids", others: list[str] | None = None) -> DataFrame:
    """The columns in `others` and text: what the ids decode to. Null ids give a null text; bytes that aren't UTF-8 become U+FFFD."""
    others = others or []
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, ranks)
        for batch in batches:
            found = [None if ids is None else codec.decode(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], ["row", "text"])

    rows = encoded.select(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(others)), F.lit(0).alias("none")).alias("row"), F.col(ids_column).alias("ids"))
    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)), "text")
