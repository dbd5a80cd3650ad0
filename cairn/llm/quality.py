"""Positive-unlabelled quality classifier: a linear model under the non-negative unbiased risk.

Trusted positives are learn rows that the labels call good; the unlabelled set is all learn rows
without regard to their labels. With class prior p the risk is p R+(f) + max(0, Ru-(f) - p R+-(f)),
under the squared loss (1 - y f)^2 / 4. The prior is the share of good rows among the labelled learn
rows. Under this loss the risk of a linear f depends on the first and second moments of both sets
alone, so it is minimised over all unlabelled rows and about TRUSTED positives: one pass sums the moments, row by row of the matrix,
and the driver gets N_FEATURES + 1 rows whatever the corpus. The features are shares of pairs of byte
classes, of the words' shapes and of repeated words, all over the whole text.

Defined cases: a null or empty text has zero features and a score from the intercept; labels that
are null don't count; an id with several labels is good if half of them or more are; rows that repeat
an id all count; without any good learn row, or without text, every score is the prior; an empty
table gives an empty result; a text of any length is one row of features; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import common

def _byte_classes() -> np.ndarray:
    """24 classes: letters by case, digits, breaks, each common mark, control characters, bytes of longer characters."""
    out = np.zeros(256, np.int64)
    out[97:123], out[65:91], out[48:58] = 1, 2, 3
    out[32], out[[9, 11, 12, 13]], out[10] = 4, 5, 6
    for i, mark in enumerate(b".,!?*%$#&-'\"/@:;", 7):
        out[mark] = i
    out[128:192], out[192:] = 23, 23
    return out


CLASSES, WIDTH = _byte_classes(), 24
N_FEATURES = WIDTH * WIDTH + 6
#: Trusted positives that are used, about: of more, those of least hash. Their ids are broadcast. The unlabelled side has no bound.
TRUSTED = 50_000
#: What is added to the second moments, as a share of each feature's variance.
RIDGE = 0.1


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES for each text: square roots of shares."""
    m = len(offsets) - 1
    out = np.zeros((m, N_FEATURES), np.float32)
    if not len(data):
        return out
    of = CLASSES[data]
    row = np.repeat(np.arange(m), np.diff(offsets))
    inside = row[1:] == row[:-1]
    pair = (row[1:] * (WIDTH * WIDTH) + of[:-1] * WIDTH + of[1:])[inside]
    counts = np.bincount(pair, minlength=m * WIDTH * WIDTH).reshape(m, -1)
    out[:, : WIDTH * WIDTH] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    starts, ends, rows = common.words(data, offsets)
    n = np.maximum(1, np.diff(rows))
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[rows])
    length = ends - starts
    upper = np.concatenate(([0], np.cumsum(of == 2)))
    shouted = (upper[ends] - upper[starts]) * 2 > length
    codes = common.hash_slices(data, starts, ends)
    word_row = np.repeat(np.arange(m), np.diff(rows))
    order = np.lexsort((codes, word_row))
    new = np.append(True, (codes[order][1:] != codes[order][:-1]) | (word_row[order][1:] != word_row[order][:-1])) if len(codes) else np.zeros(0, bool)
    grams = np.zeros(len(codes), np.uint64)
    three = common.hash_grams(codes, 3)
    grams[: len(three)] = three
    order3 = np.lexsort((grams, word_row))
    new3 = np.append(True, (grams[order3][1:] != grams[order3][:-1]) | (word_row[order3][1:] != word_row[order3][:-1])) if len(codes) else new
    more = [total(length) / n / 20, total(shouted) / n, total(length > 15) / n, total(new) / n, total(new3) / n, np.log1p(np.diff(rows)) / 10]
    for i, x in enumerate(more):
        out[:, WIDTH * WIDTH + i] = x
    return out


def moments(x: np.ndarray) -> np.ndarray:
    """The sums of products of the columns of (1, x): [0, 0] is the number of rows."""
    x = np.concatenate((np.ones((len(x), 1), np.float32), x.astype(np.float32)), 1)
    return (x.T @ x).astype(np.float64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's moments of all its rows (u) and of the good ones among them (p), a row for each row of the matrix."""
    u, p = (np.zeros((N_FEATURES + 1, N_FEATURES + 1)) for _ in range(2))
    for batch in common.pieces(batches, "text"):
        x = features(*common.texts(batch.column("text")))
        good = np.asarray(batch.column("good"))
        u += moments(x)
        if good.any():
            p += moments(x[good])
    if u[0, 0]:
        rows = lambda m: pa.array([m[i, i:].tobytes() for i in range(len(m))], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(u), dtype=np.int32)), rows(u), rows(p)], ["i", "u", "p"])


def _summed(table: pa.Table) -> pa.Table:
    total = lambda c: np.sum([np.frombuffer(x) for x in table.column(c).to_pylist()], 0).tobytes()
    return pa.table({"i": table.column("i").slice(0, 1), "u": pa.array([total("u")], pa.binary()), "p": pa.array([total("p")], pa.binary())})


def risk(w: np.ndarray, u: np.ndarray, p: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of f(x) = w . (1, x): prior R+(f), Ru-(f) - prior R+-(f), and the gradients of both. u and p: mean moments."""
    square = lambda m, sign: (1 + 2 * sign * m[0] @ w + w @ m @ w) / 4  # noqa: E731  the mean of (1 + sign f)^2 / 4
    slope = lambda m, sign: (sign * m[0] + m @ w) / 2
    return prior * square(p, -1), square(u, 1) - prior * square(p, 1), prior * slope(p, -1), slope(u, 1) - prior * slope(p, 1)


def fit(u: np.ndarray, p: np.ndarray, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights, the intercept first, that minimise the non-negative risk. u and p: moments, as sums.

    Where the second part is not negative at the least sum of both, that is the minimum. Else the minimum lies where the
    second part is 0, and is the least of R+ plus a share of that part; the share is found by bisection. The ridge, as a
    share of each feature's variance, grows with the number of features to a row.
    """
    ridge += len(u) / u[0, 0]
    u, p = u / u[0, 0], p / p[0, 0]
    spread = ridge * (np.maximum(np.diag(u) - u[0] ** 2, 0) + 1e-6)
    spread[0] = 0

    def least(share: float) -> np.ndarray:
        both = (1 - share) * prior * p + share * u
        return np.linalg.solve(both + np.diag(spread + 1e-9), prior * p[0] - share * (u[0] - prior * p[0]))

    low, high = 0.0, 1.0
    if risk(least(1.0), u, p, prior)[1] >= 0:
        return least(1.0)
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if risk(least(middle), u, p, prior)[1] >= 0 else (low, middle)
    return least(low)


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; null ids are learn rows."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"):
    """The model for score(): weights, and the prior. Held-out rows are in neither set, nor in the prior."""
    good = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_column).alias("id")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).alias("good")).where(~held_out(F.col("id")))
    n, n_good = good.agg(F.count("*"), F.coalesce(F.count_if("good"), F.lit(0))).first()
    prior = min(0.98, max(0.02, n_good / n)) if n else 0.5
    own = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL AND id IS NOT NULL").where(~held_out(F.col("id")))
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) * max(1, n_good) < (1 << 20) * TRUSTED
    marked = own.join(F.broadcast(good.where(F.col("good") & share)), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    found = marked.mapInArrow(_measure, "i int, u binary, p binary").groupBy("i").applyInArrow(_summed, "i int, u binary, p binary").toArrow().to_pylist()
    u, p = (np.zeros((N_FEATURES + 1, N_FEATURES + 1)) for _ in range(2))
    for row in found:
        for matrix, name in ((u, "u"), (p, "p")):
            matrix[row["i"], row["i"] :] = matrix[row["i"] :, row["i"]] = np.frombuffer(row[name])
    return (fit(u, p, prior) if p[0, 0] else None), prior


def score(docs: DataFrame, model, id_column: str = "doc_id", text_column: str = "text", others: list[str] | None = None) -> DataFrame:
    """id_column, the columns in `others`, score: (1 + f) / 2 between 0 and 1, which estimates the chance that a text is good; a
    row for each row of docs."""
    others = others or []
    found, prior = model
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            x = features(*common.texts(batch.column("text")))
            if sent.value is None:
                out = np.full(len(x), prior)
            else:
                out = np.clip((1 + sent.value[0] + x.astype(np.float64) @ sent.value[1:]) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(F.col(id_column).alias("c0"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others, 1))).alias("row"), F.col(text_column).alias("text"))
    out = rows.mapInArrow(run, rows.select("row").schema.add("score", "double"))
    return out.select(F.col("row.c0").alias(id_column), *(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others, 1)), "score")


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", others: list[str] | None = None) -> DataFrame:
    """id_column, the columns in `others`, held_out, score, predicted (1 if score >= 0.5)."""
    out = score(docs, train(docs, labels, id_column), id_column, others=others)
    return out.select(id_column, *(others or []), held_out(F.col(id_column)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
