"""Meeting places for repeated windows: what the two substring operators share.

A window is a run of `window` symbols (words or bytes). Each window is named by its minimizer, the
`gram` of it that hashes least (the leftmost of equals), so equal windows have equal minimizers
wherever they stand. Consecutive windows with one minimizer form a fragment of fewer than
2 * window symbols. Only minimizers that occur twice can hold a repeated window, so only the places of
their fragments are kept, as numbers. Equal fragments (by 128 bits: minimizer and print) are folded, one
example of each is cut out of its text and dealt by minimizer, and a kernel decides for each which of
its windows repeat. About 2 / (window - gram + 2) minimizers arise for each symbol.

Hot minimizers, those of passages that very many documents share, take another way, in which no
group of theirs meets in a task: the windows of their distinct fragments are counted by a hash of the
whole window, with partial counts; those that repeat are broadcast, and documents look theirs up where
their text is cut. What is broadcast is counted first: `bound` windows at most, of the most frequent
minimizers; the others, however many, take the way of the kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import common

LAST = common.NULL_IDS
#: Stands for several documents of one batch.
SEVERAL = -9223372036854775808
#: Hot minimizers at most.
HOT = 1 << 14
NONE = np.zeros(0, np.int64)


@dataclass(frozen=True)
class Symbols:
    """Words of a text, or its bytes; windows of `window` of them, minimizers of `gram`.

    across: a repeat counts only in another document, and there in a later one. hot: occurrences that make a minimizer hot,
    at least. bound: windows that are broadcast, at most.
    """

    kind: str
    window: int
    gram: int
    across: bool = False
    hot: int = 64
    bound: int = 1 << 20

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the symbols in the bytes, and the rows' offsets among the symbols."""
        if self.kind == "words":
            return common.words(data, offsets)
        at = np.arange(len(data))
        return at, at + 1, offsets

    def minimizers(self, data: np.ndarray, offsets: np.ndarray):
        """For each fragment: the row it is in, its first window (counted in the row), its number of windows, its minimizer's hash, its print."""
        starts, ends, rows = self.cut(data, offsets)
        if len(starts) < self.window:
            return NONE, NONE, NONE, NONE, NONE
        codes = common.hash_slices(data, starts, ends) if self.kind == "words" else data
        grams = common.hash_grams(codes, self.gram) if self.kind == "words" else common.byte_grams(data, self.gram)
        # The upper half of the hash ranks; the lower half of the word is the place, so that the leftmost wins.
        ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        least = (common.sliding_min(ranked, self.window - self.gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
        at = np.flatnonzero(row[: len(least)] == row[self.window - 1 :])  # windows inside one row
        if not len(at):
            return NONE, NONE, NONE, NONE, NONE
        first = np.ones(len(at), bool)
        first[1:] = (least[at[1:]] != least[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
        heads = np.flatnonzero(first)
        counts = np.diff(np.append(heads, len(at)))
        a = at[heads]
        b = a + counts + self.window - 1
        prints = common.hash_runs(codes, a, b) if self.kind == "words" else common.hash_slices(data, a, b)
        return row[a], a - rows[row[a]], counts, grams[least[a]].view(np.int64), prints.view(np.int64)

    def names(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A hash of each window that starts at one of the symbols `at`."""
        if not len(at):
            return NONE
        if self.kind == "words":
            codes = common.hash_slices(data, starts, ends)
            return common.hash_runs(codes, at, at + self.window).view(np.int64)
        lanes, w = common.eights(data), self.window
        x = lanes[at] if w >= 8 else lanes[at] >> np.uint64(8 * (8 - w))
        for j in [*range(8, w - 7, 8), *([w - 8] if w > 8 and w % 8 else [])]:
            x = common.fold(x, lanes[at + j])
        return common.splitmix(x).view(np.int64)


def _folded(keys: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by the keys (the last ranks first) and then the values; each group's first and last place in it, and its size."""
    order = np.lexsort((values, *keys))
    if not len(order):
        return order, NONE, NONE, NONE
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(order)) - 1
    return order, heads, tails, tails - heads + 1


def _count(symbols: Symbols):
    """Minimizers, folded by batch so that a hot one sends few rows: mz, k (occurrences), one (the document, or SEVERAL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            row, _, _, mz, _ = symbols.minimizers(*common.texts(batch.column("text")))
            docs = np.asarray(batch.column("doc_id"))[row]
            order, heads, tails, times = _folded([mz], docs)
            one = np.where(docs[order][heads] == docs[order][tails], docs[order][heads], SEVERAL)
            yield pa.RecordBatch.from_arrays([pa.array(mz[order][heads]), pa.array(times), pa.array(one.astype(np.int64))], ["mz", "k", "one"])

    return run


def _scan(symbols: Symbols) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            row, pos, n, mz, prints = symbols.minimizers(*common.texts(batch.column("text")))
            docs, keys = (np.asarray(batch.column(c))[row] for c in ("doc_id", "key"))
            yield pa.RecordBatch.from_arrays([pa.array(mz), pa.array(prints), pa.array(docs), pa.array(keys), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], ["mz", "print", "doc_id", "key", "pos", "n"])

    return run


def _extract(symbols: Symbols):
    """Rows of documents with the places of their candidate fragments become a row for each fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            data, offsets = common.texts(batch.column("text"))
            starts, ends, rows = symbols.cut(data, offsets)
            lists = batch.column("at")
            per = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            pos, n, mz, prints, low, times, k = (np.asarray(flat.field(i)) for i in range(7))
            row = np.repeat(np.arange(batch.num_rows), per)
            a = starts[rows[row] + pos]
            b = ends[rows[row] + pos + n + symbols.window - 2]
            take = common.ranges(a, b - a)
            body = data[take]
            at = np.concatenate(([0], np.cumsum(b - a))).astype(np.int32)
            fragment = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))])
            yield pa.RecordBatch.from_arrays([pa.array(mz), pa.array(prints), pa.array(low), pa.array(times), pa.array(k), fragment], ["mz", "print", "low", "n", "k", "fragment"])

    return run


def _windows(symbols: Symbols):
    """Distinct fragments become their distinct windows, folded by batch: mz, name, low, times, k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "fragment"):
            data, offsets = common.texts(batch.column("fragment"))
            starts, ends, rows = symbols.cut(data, offsets)
            each = np.maximum(0, np.diff(rows) - symbols.window + 1)
            name = symbols.names(data, starts, ends, common.ranges(rows[:-1], each))
            mz, low, times, k = (np.repeat(np.asarray(batch.column(c)), each) for c in ("mz", "low", "n", "k"))
            order, heads, _, _ = _folded([name, mz], low)
            total = np.add.reduceat(times[order], heads) if len(heads) else NONE
            first = order[heads]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mz[first], name[first], low[first], total, k[first])], ["mz", "name", "low", "times", "k"])

    return run


def groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[list[tuple]]]:
    """From rows sorted by mz: lists of whole groups (rows of one mz), of about `most` bytes together. Groups of one row come too."""
    held: list[list[tuple]] = []
    size, last = 0, None
    for batch in batches:
        cols = [batch.column(name).to_pylist() for name in ("mz", "fragment", "low", "n", "print")]
        for mz, fragment, low, n, name in zip(*cols, strict=True):
            if mz != last:
                if size >= most:
                    yield held
                    held, size = [], 0
                held.append([])
                last = mz
            held[-1].append((mz, fragment, low, n, name))
            size += len(fragment)
    if held:
        yield held


def repeated(docs: DataFrame, symbols: Symbols, kernel, kernel_schema: str, of_verdict: Column) -> tuple[DataFrame, tuple[np.ndarray, ...]]:
    """A row for each document that may have something to remove: doc_id, key, spans (pos, [first window, end, ...]) and hot
    (pos, n, mz); and the hot windows that repeat: their names, sorted, minimizers and least documents.

    docs: doc_id (not null), key, text; rows that agree in doc_id and key agree in text. The kernel gives mz, print and
    more for each distinct fragment, from rows sorted by mz; of_verdict makes the runs of it.
    """
    folded = docs.select("doc_id", "text").mapInArrow(_count(symbols), "mz long, k long, one long")
    known = folded.groupBy("mz").agg(F.sum("k").alias("k"), F.min("one").alias("a"), F.max("one").alias("b"))
    known = known.where(f"a < b OR a = {SEVERAL}L" if symbols.across else "k > 1").select("mz", "k")
    known = common.written(known)  # as a table: Spark can then split what a hot minimizer joins
    hot = common.least_hot(known, symbols.hot, HOT)
    found = docs.mapInArrow(_scan(symbols), "mz long, print long, doc_id long, key int, pos int, n int")
    places = common.written(found.join(known, "mz"))
    common.drop(known)
    # first() of each column takes them all from one row.
    distinct = places.groupBy("mz", "print").agg(F.min(F.least("doc_id", F.lit(LAST))).alias("low"), F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("doc_id", "key", "pos", "n", "k")))
    at = distinct.groupBy("doc_id", "key").agg(F.collect_list(F.struct("pos", "n", "mz", "print", "low", "times", "k")).alias("at"))
    parts = docs.join(at, ["doc_id", "key"]).mapInArrow(_extract(symbols), "mz long, print long, low long, n long, k long, fragment binary")
    parts = common.written(parts)
    windows = parts.where(F.col("k") >= hot).mapInArrow(_windows(symbols), "mz long, name long, low long, times long, k long")
    windows = common.written(windows.groupBy("mz", "name").agg(F.min("low").alias("low"), F.sum("times").alias("times"), F.max("k").alias("k")).where("times > 1"))
    hot = common.least_hot(windows, hot, symbols.bound)
    table = windows.where(F.col("k") >= hot).select("name", "mz", "low").toArrow()  # symbols.bound at most
    common.drop(windows)
    name, mz, low = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("name", "mz", "low"))
    order = np.argsort(name, kind="stable")
    dealt = parts.where(F.col("k") < hot).repartition("mz").sortWithinPartitions("mz", "low", "print")
    verdicts = common.written(dealt.mapInArrow(kernel, kernel_schema))
    common.drop(parts)
    joined = places.where(F.col("k") < hot).join(verdicts, ["mz", "print"]).select("doc_id", "key", "pos", of_verdict.alias("runs")).where(F.size("runs") > 0)
    span, spot = F.struct("pos", "runs").alias("x"), F.struct("pos", "n", "mz").alias("x")
    warm = places.where(F.col("k") >= hot)
    none = lambda df, x: F.lit(None).cast(df.select(x).schema[0].dataType)
    both = joined.select("doc_id", "key", span.alias("span"), none(warm, spot).alias("spot")).unionByName(warm.select("doc_id", "key", none(joined, span).alias("span"), spot.alias("spot")))
    # Rows that repeat a doc_id and key have their places twice; sets name each once.
    spans = both.groupBy("doc_id", "key").agg(F.collect_set("span").alias("spans"), F.collect_set("spot").alias("hot"))
    return spans, (name[order], mz[order], low[order])


def marked(own: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, row, text, spans, hot of each document; without spans, empty lists."""
    lists = (F.coalesce(c, F.array().cast(spans.schema[c].dataType)).alias(c) for c in ("spans", "hot"))
    return own.join(spans, ["doc_id", "key"], "left").select("doc_id", "row", "text", *lists)


def covered(batch: pa.RecordBatch, symbols: Symbols, data: np.ndarray, cut: tuple[np.ndarray, np.ndarray, np.ndarray], hot: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each symbol of the batch, whether a window to remove covers it. cut: what symbols.cut() gives; hot: what repeated() gives."""
    starts, ends, rows = cut
    step = np.zeros(int(rows[-1]) + 1, np.int64)

    def flat(name: str) -> tuple[np.ndarray, pa.StructArray]:
        lists = batch.column(name)
        return np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets))), lists.flatten()

    row, spans = flat("spans")
    runs = spans.field(1)
    limits = np.asarray(runs.flatten()).reshape(-1, 2)
    base = np.repeat(rows[:-1][row] + np.asarray(spans.field(0)), np.diff(np.asarray(runs.offsets)) // 2)
    np.add.at(step, base + limits[:, 0], 1)
    np.add.at(step, base + limits[:, 1] + symbols.window - 1, -1)
    row, spots = flat("hot")
    if len(row) and len(hot[0]):
        pos, n, mz = (np.asarray(spots.field(i)) for i in range(3))
        at = common.ranges(rows[:-1][row] + pos, n)
        name = symbols.names(data, starts, ends, at)
        name_of, mz_of, low_of = hot
        i = np.minimum(np.searchsorted(name_of, name), len(name_of) - 1)
        hit = (name_of[i] == name) & (mz_of[i] == np.repeat(mz, n))
        if symbols.across:
            own = np.minimum(np.asarray(batch.column("doc_id")), LAST)
            hit &= low_of[i] < np.repeat(own[row], n)
        np.add.at(step, at[hit], 1)
        np.add.at(step, at[hit] + symbols.window, -1)
    return np.cumsum(step)[:-1] > 0
