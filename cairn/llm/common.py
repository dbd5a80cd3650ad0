"""Helpers that the operators of this subpackage share.

Hashes here are 64 bits wide and fold eight bytes (or one code) at a time by multiplications with
shifts in between, so they aren't linear modulo 2**64: polynomial hashes there are, and collide on
texts that are easy to build. They depend on the input bytes alone, so executors and runs agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.storage import drop, written  # noqa: F401

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BREAKS = r"[\x20\x09-\x0D]+"

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ODD = np.uint64(0x9E3779B97F4A7C15)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Slices beyond so many bytes are hashed by BLAKE2b, one at a time.
LONG = 512


def fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One hash of two, element by element: a bijection in either while the other stays."""
    with np.errstate(over="ignore"):
        z = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + (y ^ (y >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
        return z ^ (z >> np.uint64(30))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number; beyond the end, zeros."""
    x = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    for span in (1, 2, 4):
        x = (x[: len(x) - span] << np.uint64(8 * span)) | x[span:]
    return x[: len(data)]


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]. Slices of up to eight bytes differ if their bytes do."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lanes = eights(data)
    sizes = ends - starts

    def lane(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes, or fewer where fewer are left."""
        return lanes[at] >> (np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64)))

    out = np.zeros(len(starts), np.uint64)
    some = np.flatnonzero(sizes > 0)
    out[some] = lane(starts[some], sizes[some])
    with np.errstate(over="ignore"):
        out = splitmix(out + sizes.astype(np.uint64) * ODD)
    live = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    done = 8
    while len(live):
        out[live] = fold(out[live], lane(starts[live] + done, sizes[live] - done))
        done += 8
        live = live[sizes[live] > done]
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def hash_grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n codes, for the len(codes) - n + 1 places where one starts: of runs of 2, 4, 8 and so on,
    the last two of which overlap."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    span, x = 1, codes
    while span * 2 <= n:
        x = fold(x[: len(x) - span], x[span:])
        span *= 2
    if span < n:
        x = fold(x[:m], x[n - span : n - span + m])
    with np.errstate(over="ignore"):
        return splitmix(x + np.uint64(n) * ODD)


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n bytes, for the len(data) - n + 1 places where one starts."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    lanes = eights(data)
    if n < 8:
        return splitmix(lanes[:m] >> np.uint64(8 * (8 - n)))
    x = lanes[:m]
    for at in [*range(8, n - 7, 8), *([n - 8] if n % 8 else [])]:
        x = fold(x, lanes[at : at + m])
    return splitmix(x)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for each i where it fits."""
    n = len(x)
    if n < width:
        return x[:0]
    span, cur = 1, x
    while span * 2 <= width:
        cur = np.minimum(cur[: len(cur) - span], cur[span:])
        span *= 2
    m = n - width + 1
    return np.minimum(cur[:m], cur[width - span : width - span + m]) if span < width else cur[:m]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, joined, and the len + 1 offsets of its rows. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the column's bytes in each stay under most, or it is one row."""
    for batch in batches:
        _, offsets = texts(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and the len + 1 offsets of the rows among the words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    is_word = IS_WORD[data]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    before[heads] = False
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    after[tails] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + shift


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Surrogates for null ids: after all others, by a hash of the text.
NULL_IDS = 9223372036854775807 - (1 << 40)


def own_id(id_column: str, text_column: str):
    """The id as a long; a null one becomes a surrogate."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_IDS) + F.pmod(F.xxhash64(text_column), F.lit(1 << 39)))


def hash_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each codes[start:end], like hash_slices() but over 64-bit codes."""
    sizes = ends - starts
    with np.errstate(over="ignore"):
        out = splitmix(sizes.astype(np.uint64) * ODD)
    live, done = np.flatnonzero(sizes > 0), 0
    while len(live):
        out[live] = fold(out[live], codes[starts[live] + done])
        done += 1
        live = live[sizes[live] > done]
    return out


def least_hot(table: DataFrame, least: int, most: int) -> int:
    """The least of `least` and its doubles such that at most `most` rows have a k of so many."""
    steps = F.floor(F.log2(F.col("k") / least)).cast("int")
    rows = table.where(F.col("k") >= least).groupBy(steps.alias("e")).count().collect()  # 63 at most
    e = 0
    while sum(r["count"] for r in rows if r["e"] >= e) > most:
        e += 1
    return least << e
