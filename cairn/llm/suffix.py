"""Suffix-array dedup on bytes: shards sorted by Larsson-Sadakane refinement, merged by binary search.

A shard holds fragments (fragments.py) that share minimizers, so equal windows meet in one shard or
in shards of one group. Its suffixes are sorted by their first `window` bytes: by eight bytes, then
doubling, and each round sorts anew only what is still tied. Ranks then name the windows exactly, so
two neighbours have a common prefix of `window` bytes just if their ranks agree. Kasai's pass needs
a total order and refinement stops at the window, so it serves shard_index(), not the query's path.

Defined cases: a null text is empty; matches never cross documents; rows that repeat a doc_id are
documents of their own and repeat each other; texts shorter than a window keep all; an empty table
gives an empty result; other columns are ignored; a cut may fall inside a character, so the kept
text is bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common, fragments

#: Bytes of fragments in one suffix array at most.
SHARD_BYTES = 1 << 20


def refine(data: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes by their first `depth` (8 or more) bytes: equal ranks mean equal bytes, if all of them lie in data.

    A rank is the number of suffixes in earlier groups. Groups of one are settled and not sorted again.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    eights = common.eights(data)
    order = np.argsort(eights, kind="stable")
    rank = np.empty(n, np.int64)
    keys = eights[order]
    new = np.append(True, keys[1:] != keys[:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    del eights, keys
    h = 8
    open_ = order[~(new & np.append(new[1:], True))]
    del order
    while h < depth and len(open_):
        step = min(h, depth - h)
        ahead = open_ + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[open_]  # open_ is in the order of first
        pair = first * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        open_, pair, first = open_[by], pair[by], first[by]
        new = np.append(True, pair[1:] != pair[:-1])
        group = np.append(True, first[1:] != first[:-1])
        at = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(group, at, 0))
        rank_new = first + np.maximum.accumulate(np.where(new, at, 0)) - start
        rank[open_] = rank_new
        open_ = open_[~(new & np.append(new[1:], True))]
        h += step
    return rank


def shard_index(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a text and, for each place in it but the first, the prefix it shares with the one before (Kasai)."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    rank = refine_all(data)
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    shared = np.zeros(n, np.int64)
    h = 0
    for i in range(n):
        if rank[i]:
            j = int(array[rank[i] - 1])
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            shared[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return array, shared


def refine_all(data: np.ndarray) -> np.ndarray:
    """Ranks by whole suffixes, each a number of its own; a suffix that is a prefix of another comes first."""
    n = len(data)
    rank = data.astype(np.int64)
    h = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - h)] = rank[h:] + 1
        pair = rank * (max(n, 256) + 2) + second
        _, rank = np.unique(pair, return_inverse=True)
        if not n or rank.max() == n - 1:
            return rank
        h *= 2


def _compare(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, depth: int) -> np.ndarray:
    """-1, 0 or 1 for depth bytes of a from each at_a against b from at_b. a and b are common.eights() of the texts."""
    out = np.zeros(len(at_a), np.int8)
    live = np.arange(len(at_a))
    for k in range(0, depth, 8):
        k = min(k, depth - 8)
        x, y = a[at_a[live] + k], b[at_b[live] + k]
        out[live[x < y]] = -1
        out[live[x > y]] = 1
        live = live[x == y]
        if not len(live):
            break
    return out


def merge_search(sorted_a: np.ndarray, eights_a: np.ndarray, queries: np.ndarray, eights_b: np.ndarray, depth: int) -> np.ndarray:
    """For each query place of shard b, the place in sorted_a (distinct windows of shard a, in order) that equals it, or -1."""
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(sorted_a), np.int64)
    found = np.full(len(queries), -1, np.int64)
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) // 2
        c = _compare(eights_b, queries[live], eights_a, sorted_a[mid], depth)
        found[live[c == 0]] = mid[c == 0]
        high[live[c < 0]] = mid[c < 0]
        low[live[c > 0]] = mid[c > 0] + 1
        live = live[(c != 0) & (low[live] < high[live])]
    return found


class _Shard:
    """Windows of some fragments: their classes (equal bytes, one class) and how often each class starts."""

    def __init__(self, parts: list[bytes], counts: list[int], window: int) -> None:
        self.lengths = np.array([len(x) - window + 1 for x in parts], np.int64)  # windows in each
        sizes = np.array([len(x) for x in parts], np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        self.places = common.ranges(np.cumsum(sizes) - sizes, self.lengths)
        rank = refine(data, window)[self.places]
        self.data = data
        ranks, first, self.of = np.unique(rank, return_index=True, return_inverse=True)
        self.one = self.places[first]  # a place of each class, in order of the bytes
        self.times = np.bincount(self.of, np.repeat(np.array(counts, np.int64), self.lengths), len(ranks)).astype(np.int64)


def repeated_windows(parts: list[bytes], counts: list[int], window: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each fragment, which of its windows start elsewhere too. counts: how often the fragment itself occurs."""
    if len(parts) == 1 and counts[0] > 1:
        return [np.ones(len(parts[0]) - window + 1, bool)]
    shards, a = [], 0
    while a < len(parts):
        b, size = a, 0
        while b < len(parts) and (b == a or size < shard_bytes):
            size += len(parts[b])
            b += 1
        shards.append(_Shard(parts[a:b], counts[a:b], window))
        a = b
    total = [s.times.copy() for s in shards]
    for i, x in enumerate(shards):
        for j in range(i + 1, len(shards)):
            y = shards[j]
            hit = merge_search(x.one, common.eights(x.data), y.one, common.eights(y.data), window)
            mine = np.flatnonzero(hit >= 0)
            total[j][mine] += x.times[hit[mine]]
            total[i][hit[mine]] += y.times[mine]
    out: list[np.ndarray] = []
    for s, t in zip(shards, total, strict=True):
        flags = (t > 1)[s.of]
        out += np.split(flags, np.cumsum(s.lengths)[:-1])
    return out


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the true runs, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge.tolist()


def _kernel(window: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in fragments.groups(batches, shard_bytes // 2):
            # Groups of one fragment that occurs twice need no sorting; the others share a shard.
            easy = [g[0] for g in held if len(g) == 1 and g[0][3] > 1]
            rest = [r for g in held if not (len(g) == 1 and g[0][3] > 1) for r in g]
            rows = easy + rest
            runs = [[0, len(r[1]) - window + 1] for r in easy]
            if rest:
                runs += map(_runs, repeated_windows([r[1] for r in rest], [r[3] for r in rest], window, shard_bytes))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()), pa.array(runs, pa.list_(pa.int32()))], ["mz", "print", "runs"])

    return run


def _finish(symbols: fragments.Symbols, hot, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            data, offsets = common.texts(batch.column("text"))
            gone = fragments.covered(batch, symbols, data, symbols.cut(data, offsets), hot.value)
            stay = ~gone
            whole = data[stay].tobytes()
            at = np.concatenate(([0], np.cumsum(stay)))[offsets].tolist()
            kept = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            head = gone.copy()
            head[1:] &= stay[:-1]
            firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
            head[firsts] = gone[firsts]  # runs end with their document
            total = np.concatenate(([0], np.cumsum(head)))
            n_removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[offsets])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(np.diff(total[offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept if with_text else [None] * len(kept), pa.binary())],
                ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 200, gram: int = 24, id_column: str = "doc_id", text_column: str = "text", others: list[str] | None = None, with_text: bool = True, shard_bytes: int = SHARD_BYTES, hot: int = 64, bound: int = 1 << 20) -> DataFrame:
    """Removes each byte that a string of `window` bytes covers which starts anywhere else too.

    Gives id_column, the columns in `others`, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, with_text, kept (bytes), a row for each row of docs. window: 16 or more; hot and bound: see Symbols.
    """
    others = others or []
    own = docs.select(common.own_id(id_column, text_column).alias("doc_id"), F.hash(id_column, text_column).alias("key"), F.struct(F.col(id_column).alias("c0"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others, 1))).alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    symbols = fragments.Symbols("bytes", window, min(gram, window), False, hot, bound)
    spans, warm = fragments.repeated(own.select("doc_id", "text", "key"), symbols, _kernel(window, shard_bytes), "mz long, print long, runs array<int>", F.col("runs"))
    rows = fragments.marked(own, spans)
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *(T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.BinaryType())))])
    out = rows.mapInArrow(_finish(symbols, docs.sparkSession.sparkContext.broadcast(warm), with_text), schema)
    return out.select(F.col("row.c0").alias(id_column), *(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others, 1)), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
