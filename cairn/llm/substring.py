"""Substring dedup on words: suffix automata of reference shards give matching statistics.

The reference is the corpus itself, so its automata can't be broadcast whole: their size has no
bound. Instead a shard holds the fragments that share a minimizer (fragments.py); its automaton is
built where the shard lies and the shard's distinct fragments stream through it. An automaton
carries, for each state, the least doc_id in which the state's strings end, so the state that a
window reaches says whether an earlier document has it. Where the reference is a bounded table,
remove_reference() does broadcast the automata.

Defined cases: a null text has no words; a null doc_id comes after all others; rows that repeat a
doc_id and text are one document to each other, so neither removes the other's words; a document
shorter than a window keeps all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common, fragments

#: Bytes of fragments in one automaton at most.
SHARD_BYTES = 1 << 19


class Automaton:
    """Suffix automaton of several sequences; low[state] is the least label among those in which the state's strings occur."""

    def __init__(self) -> None:
        self.to: list[dict] = [{}]
        self.link, self.len, self.low = [-1], [0], [fragments.LAST]

    def _state(self, length: int, link: int, to: dict, low: int) -> int:
        self.to.append(to)
        self.link.append(link)
        self.len.append(length)
        self.low.append(low)
        return len(self.len) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state for what p's strings and symbol spell, taken out of q."""
        made = self._state(self.len[p] + 1, self.link[q], self.to[q].copy(), fragments.LAST)
        self.link[q] = made
        while p >= 0 and self.to[p].get(symbol) == q:
            self.to[p][symbol] = made
            p = self.link[p]
        return made

    def add(self, sequence: Iterable, label: int) -> None:
        to, link, length, low = self.to, self.link, self.len, self.low
        last = 0
        for symbol in sequence:
            q = to[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, symbol, q)
            else:
                made = self._state(length[last] + 1, 0, {}, fragments.LAST)
                p = last
                while p >= 0 and symbol not in to[p]:
                    to[p][symbol] = made
                    p = link[p]
                if p >= 0:
                    q = to[p][symbol]
                    link[made] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
                last = made
            if label < low[last]:
                low[last] = label

    def settle(self) -> None:
        """Hands each state's label down to its suffixes. Once, after the last add()."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.low[s] < self.low[self.link[s]]:
                self.low[self.link[s]] = self.low[s]

    def windows(self, sequence: Iterable, width: int) -> Iterator[int]:
        """For each window of the sequence, the least label with it; LAST if none has it."""
        to, link, length, low = self.to, self.link, self.len, self.low
        state = matched = 0
        for at, symbol in enumerate(sequence, 1):
            while state and symbol not in to[state]:
                state = link[state]
                matched = length[state]
            if symbol in to[state]:
                state = to[state][symbol]
                matched += 1
            while state and length[link[state]] >= width:
                state = link[state]
                matched = length[state]
            if at >= width:
                yield low[state] if matched >= width else fragments.LAST


def least_labels(shard: list[tuple[list, int]], width: int, shard_bytes: int = SHARD_BYTES) -> list[list[int]]:
    """For each (sequence, label) of a shard, the least label with each of its windows.

    A shard beyond the bound is cut; every part's automaton sees all the sequences, so none is lost.
    """
    if len(shard) == 1 and len(shard[0][0]) < 2 * width:
        return [[shard[0][1]] * (len(shard[0][0]) - width + 1)]
    best: list[list[int]] | None = None
    a = 0
    while a < len(shard):
        b, size = a, 0
        automaton = Automaton()
        while b < len(shard) and (b == a or size < shard_bytes):
            automaton.add(*shard[b])
            size += sum(map(len, shard[b][0]))
            b += 1
        automaton.settle()
        got = [list(automaton.windows(sequence, width)) for sequence, _ in shard]
        best = got if best is None else [[min(x, y) for x, y in zip(p, q, strict=True)] for p, q in zip(best, got, strict=True)]
        a = b
    return best or []


def _kernel(width: int, shard_bytes: int):
    """Sorted distinct fragments become mz, print and the least doc_id of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in fragments.groups(batches, 1 << 18):
            mz, name, best = [], [], []
            for group in held:
                for row, labels in zip(group, least_labels([(r[1].split(), r[2]) for r in group], width, shard_bytes), strict=True):
                    mz.append(row[0])
                    name.append(row[4])
                    best.append(labels)
            yield pa.RecordBatch.from_arrays([pa.array(mz, pa.int64()), pa.array(name, pa.int64()), pa.array(best, pa.list_(pa.int64()))], ["mz", "print", "best"])

    return run


def join_words(data, starts, ends, rows, keep) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row joined by one space: bytes and the rows' offsets in them."""
    index = np.flatnonzero(keep)
    lengths = (ends - starts)[index]
    row_of = np.searchsorted(rows, index, "right") - 1
    first = np.append(True, row_of[1:] != row_of[:-1]) if len(index) else np.zeros(0, bool)
    wide = lengths + ~first  # a space before all but a row's first
    out = np.full(int(wide.sum()), 32, np.uint8)
    out[common.ranges(np.cumsum(wide) - lengths, lengths)] = data[common.ranges(starts[index], lengths)]
    total = np.concatenate(([0], np.cumsum(wide)))
    return out, total[np.searchsorted(index, rows)]


def _finish(symbols: fragments.Symbols, hot, keep_breaks: bool, with_text: bool):
    """With keep_breaks the text keeps its white space: a removed word goes with the break after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            data, offsets = common.texts(batch.column("text"))
            starts, ends, rows = cut = common.words(data, offsets)
            gone = fragments.covered(batch, symbols, data, cut, hot.value)
            if keep_breaks:
                step = np.zeros(len(data) + 1, np.int64)
                row_ends = offsets[1:][np.searchsorted(rows, np.arange(len(starts)), "right") - 1]
                until = np.minimum(np.append(starts[1:], len(data)), row_ends) if len(starts) else starts
                np.add.at(step, starts[gone], 1)
                np.add.at(step, until[gone], -1)
                stay = np.cumsum(step)[:-1] == 0
                body = data[stay]
                at = np.concatenate(([0], np.cumsum(stay)))[offsets]
            else:
                body, at = join_words(data, starts, ends, rows, ~gone)
            whole = body.tobytes()
            removed = np.concatenate(([0], np.cumsum(gone)))[rows]
            kept = [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.diff(rows)), pa.array(np.diff(removed)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode("utf-8", "replace") if with_text else None for x in kept], pa.string())],
                ["row", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 13, gram: int = 5, id_column: str = "doc_id", text_column: str = "text", keep_breaks: bool = False, others: list[str] | None = None, with_text: bool = True, hot: int = 64, bound: int = 1 << 20) -> DataFrame:
    """Removes each word that a window covers which an earlier document has too.

    Gives id_column, the columns in `others`, n_words, n_removed, kept_sha256 and, with_text, kept_text,
    a row for each row of docs. Windows are judged on the input. gram: words in a minimizer; hot and bound: see Symbols.
    """
    others = others or []
    own = docs.select(common.own_id(id_column, text_column).alias("doc_id"), F.hash(id_column, text_column).alias("key"), F.struct(F.col(id_column).alias("c0"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others, 1))).alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    symbols = fragments.Symbols("words", window, min(gram, window), True, hot, bound)
    runs = F.expr(f"flatten(transform(filter(sequence(0, size(best) - 1), j -> best[j] < least(doc_id, {fragments.LAST}L)), j -> array(j, j + 1)))")
    spans, warm = fragments.repeated(own.select("doc_id", "text", "key"), symbols, _kernel(window, SHARD_BYTES), "mz long, print long, best array<long>", runs)
    rows = fragments.marked(own, spans)
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())))])
    out = rows.mapInArrow(_finish(symbols, docs.sparkSession.sparkContext.broadcast(warm), keep_breaks, with_text), schema)
    return out.select(F.col("row.c0").alias(id_column), *(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others, 1)), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))


#: Bytes of a reference table that are broadcast as automata at most.
REFERENCE_BYTES = 1 << 24


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = 13, id_column: str = "doc_id", text_column: str = "text", reference_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept_text: each document without the words in a window that the reference has too.
    spans are the maximal runs removed, (first, last) by words from 0; the words kept are joined by blanks.

    The reference's size is measured first; beyond REFERENCE_BYTES this raises ValueError, and
    remove_repeats() on the union of both is the way. Its automata are broadcast by shards.
    """
    size = reference.agg(F.sum(F.octet_length(F.coalesce(F.col(reference_text), F.lit(""))))).first()[0] or 0
    if size > REFERENCE_BYTES:
        raise ValueError(f"the reference has {size} bytes; {REFERENCE_BYTES} are broadcast at most")
    shards: list[list[list[bytes]]] = [[]]
    held = 0
    for (text,) in reference.select(F.col(reference_text)).where(F.col(reference_text).isNotNull()).collect():
        if held >= shard_bytes:
            shards.append([])
            held = 0
        shards[-1].append(text.encode().split())
        held += len(text)
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    built: list[Automaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            for shard in sent.value:
                built.append(Automaton())
                for sequence in shard:
                    built[-1].add(sequence, 0)
                built[-1].settle()
        for batch in batches:
            total, removed, spans, kept = [], [], [], []
            for text in batch.column("text").to_pylist():
                sequence = (text or "").encode().split()
                hit = np.zeros(len(sequence) + 1, np.int64)
                for automaton in built:
                    for j, low in enumerate(automaton.windows(sequence, window)):
                        if low == 0:
                            hit[j] += 1
                            hit[j + window] -= 1
                gone = np.cumsum(hit)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
                total.append(len(sequence))
                removed.append(int(gone.sum()))
                spans.append([{"first": int(i), "last": int(j) - 1} for i, j in turns])
                kept.append(b" ".join(w for w, g in zip(sequence, gone, strict=True) if not g).decode())
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept_text string")


def reference_matches(docs: DataFrame, reference: DataFrame, window: int = 13, id_column: str = "doc_id", text_column: str = "text", reference_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_matched: what remove_reference() would take from each document, counted."""
    return remove_reference(docs, reference, window, id_column, text_column, reference_text, shard_bytes).select("doc_id", "n_words", F.col("n_removed").alias("n_matched"))
