"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their hashes. It is cut into fragments, more of them than the
largest difference that two linked sets of a size class can have. Linked sets then agree in `need` or
more whole fragments, so the hash of a fragment's grams, with the fragment and the class, is a
signature that both have: that finds all candidates, with no cap. A set of which fewer than `need`
signatures occur in another set has no links and is put aside. What is left is cut again, into many
more and smaller fragments, of which linked sets share far more than sets with a common passage do;
that would be too much for all sets, and lets few go on by chance. (A set that leaves so many fragments empty that none is needed also gives the
grams of its prefix, which any linked set with the same lack shares.) Sets that are equal are folded
first. Candidates are linked to the least of each signature, and the components of those links are
the clusters in which linked sets must lie; a cluster's sets meet in blocks, where the overlaps in
each fragment of the order are counted separately and summed per pair.

Defined cases: a null or wordless text has no set and no links; fewer than n words are one gram;
rows that share an id count as linked; null ids come after all others and give a null component_id
where no id is in the component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import common
from cairn.operators.graph import components

#: Sets and grams in one block of a cluster, about.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1 << 20
#: A gram of up to so many sets of a block adds to each pair of them; one of more goes through a matrix product.
FEW = 32
#: How many fragments more than the largest difference, in per cent, in the first and the second cut.
COARSE, FINE = 15, 150
#: Signatures are kept in so many parts, by their upper bits, and dealt a part or several at a time: as many parts as hold
#: PASS_SIGS together, one at least. So what a shuffle holds at once is a share of them, on large inputs an eighth.
PARTS, PASS_SIGS = 8, 1 << 23
#: Copies that make a set hot, at least, and hot sets at most.
HOT_COPIES, HOT_SETS = 64, 1 << 14
NULL_IDS = common.NULL_IDS
A, B, C = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the sorted hashes of its distinct n-grams of words, A to Z in lower case."""
    data = common.LOWER[data]
    starts, ends, rows = common.words(data, offsets)
    codes = common.hash_slices(data, starts, ends)
    grams = common.hash_grams(codes, n)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else common.hash_grams(codes[a:b], b - a) if b > a else grams[:0])
    return out


def most_apart(size: int, num: int, den: int) -> int:
    """The largest difference (grams in one set alone) of two linked sets, the smaller of `size` at most."""
    return (den - num) * (den * size // num) // den


@lru_cache(maxsize=8)
def _classes(num: int, den: int, more: int) -> tuple[list[int], list[int]]:
    """Of each size class: the least size, and its fragments, by `more` per cent more than the largest difference."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, low[-1] * 27 // 20))
    apart = [most_apart(high - 1, num, den) for high in low[1:]]
    return low, [d + -(-more * d // 100) + 3 if d else 0 for d in apart]


def signatures(grams: np.ndarray, num: int, den: int, more: int = COARSE) -> list[tuple[int, int, np.ndarray]]:
    """(class, need, signatures): in one class at least a linked set (but an equal one) has `need` of them too."""
    low, cuts = _classes(num, den, more)
    size = len(grams)
    first, last = (int(np.searchsorted(low, x, "right")) - 1 for x in (-(-num * size // den), size))
    out = []
    with np.errstate(over="ignore"):
        mixed = common.splitmix(grams ^ A)
        for c in range(first, last + 1):
            if not cuts[c]:
                continue  # linked sets of this class are equal
            part = (grams >> np.uint64(32)) * np.uint64(cuts[c]) >> np.uint64(32)
            heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            found = common.splitmix(np.add.reduceat(mixed, heads) + part[heads] * B + np.uint64(c) * C)
            need = len(heads) - min(most_apart(size, num, den), cuts[c])  # all fragments, less those empty, less those that differ
            if need < 1:
                found = np.append(found, common.splitmix(grams[: size - -(-num * size // den) + 1] ^ (C + np.uint64(c))))
            out.append((c, max(1, need), np.unique(found)))
    return out


MARKS = [f"marks{p}" for p in range(PARTS)]
SCANNED = "doc long, n long, s1 long, s2 long, n_sigs long, " + ", ".join(f"{c} array<struct<class:int,need:int,sigs:array<long>>>" for c in MARKS)


def _scan(n: int, num: int, den: int, more: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            sets = gram_sets(*common.texts(batch.column("text")), n)
            with np.errstate(over="ignore"):
                sums = [[int(common.splitmix(s ^ k).sum(dtype=np.uint64).view(np.int64)) for s in sets] for k in (B, C)]
            found = [signatures(s, num, den, more) if len(s) else [] for s in sets]
            flat = [x for y in found for x in y]
            inner = np.concatenate(([0], np.cumsum([len(x[2]) for x in flat]))).astype(np.int64)
            outer = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
            sigs = np.concatenate([x[2] for x in flat]) if flat else np.zeros(0, np.uint64)
            classes, needs, marks = pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), []
            at = (sigs >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)
            for part in range(PARTS):
                inside = at == part
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(inside)))[inner], pa.int32()), pa.array(sigs[inside].view(np.int64)))
                rows = pa.StructArray.from_arrays([classes, needs, lists], ["class", "need", "sigs"])
                marks.append(pa.ListArray.from_arrays(pa.array(outer, pa.int32()), rows))
            plain = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], *sums, np.diff(inner[outer]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *plain, *marks], ["doc", "n", "s1", "s2", "n_sigs", *MARKS])

    return run


def _grouped(parts: list, total: int) -> list[list]:
    """The parts in as few groups as hold PASS_SIGS of all `total` signatures each, about."""
    size = -(-len(parts) // max(1, -(-total // PASS_SIGS)))
    return [parts[i : i + size] for i in range(0, len(parts), size)]


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, tables)


def prune(marked: DataFrame, rounds: int = 2) -> list[DataFrame]:
    """Tables of doc, class, need, sig: of what _scan() gives, the signatures that several sets have, without sets that
    have too few. All rows of a signature are in one table. They are written; `marked` must be, and goes."""
    total = marked.agg(F.sum("n_sigs")).first()[0] or 0
    kept = []
    for some in _grouped(MARKS, total):
        marks = marked.select("doc", F.explode(F.concat(*some)).alias("m"))
        kept.append([marks.select("doc", "m.class", "m.need", F.explode("m.sigs").alias("sig"))])
    gone = [marked]
    for _ in range(rounds):
        fewer, counts = [], []
        for own in kept:
            sigs = union(own)
            shared = common.written(sigs.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig"))
            fewer.append(common.written(sigs.join(shared, "sig")))
            counts.append(common.written(fewer[-1].groupBy("doc", "class").agg(F.count("*").alias("k"), F.max("need").alias("need"))))
            common.drop(shared)
        for done in gone:
            common.drop(done)
        enough = common.written(union(counts).groupBy("doc", "class").agg(F.sum("k").alias("k"), F.max("need").alias("need")).where("k >= need").select("doc", "class", "k"))
        total = enough.agg(F.sum("k")).first()[0] or 0
        left = []
        for table in fewer:
            left.append(common.written(table.join(enough.drop("k"), ["doc", "class"])))
            common.drop(table)
        for done in (*counts, enough):
            common.drop(done)
        gone, kept = left, _grouped(left, total)
    return gone


def links(sets: list[np.ndarray], num: int, den: int, width: int = 1 << 16, cells: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Pairs (i < j) of sets with den * intersection >= num * union. The order of grams is cut into fragments of `width`
    grams; each gives partial overlaps for the pairs of the block, which add up."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    ids, at = np.unique(np.concatenate(sets), return_inverse=True)
    who = np.repeat(np.arange(m), sizes)
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    overlap = np.zeros((m, m), np.float32)
    flat = overlap.reshape(-1)
    for a in range(0, len(ids), width):
        i, j = np.searchsorted(at, (a, a + width))
        gram, own = at[i:j] - a, who[i:j]
        often = np.bincount(gram)
        for d in np.unique(often[(often > 1) & (often <= FEW)]).tolist():
            rows = own[(often == d)[gram]].reshape(-1, d)  # the sets of each such gram, ascending
            x, y = np.triu_indices(d, 1)
            some = max(1, cells // len(x))  # so many grams at a time
            for k in range(0, len(rows), some):
                part = rows[k : k + some]
                np.add.at(flat, (part[:, x] * m + part[:, y]).reshape(-1), 1)
        many = np.flatnonzero(often > FEW)
        step = max(64, cells // m)
        for k in range(0, len(many), step):
            column = np.full(len(often), -1)
            column[many[k : k + step]] = np.arange(len(many[k : k + step]))
            inside = column[gram] >= 0
            part = np.zeros((m, len(many[k : k + step])), np.float32)
            part[own[inside], column[gram[inside]]] = 1
            overlap += part @ part.T
    for top in range(0, m, 256):  # so many rows of the table of pairs at a time
        shared = overlap[top : top + 256].astype(np.int64)
        union = sizes[top : top + 256, None] + sizes[None, :] - shared
        x, y = np.nonzero((den * shared >= num * union) & (union > 0))
        yield from ((i, j) for i, j in zip((x + top).tolist(), y.tolist(), strict=True) if i < j)


def _forest(docs: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(least, doc) for each doc that is linked, over the components inside a block."""
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in links(sets, num, den):
        x, y = find(x), find(y)
        if x != y:
            x, y = (x, y) if docs[x] < docs[y] else (y, x)
            root[y] = x
    return [(docs[r], docs[i]) for i in range(len(docs)) if (r := find(i)) != i]


def _verify(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, sets = None, [], []

        def done() -> pa.RecordBatch:
            found = _forest(docs, sets, num, den) if len(docs) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in common.pieces(batches, "text"):
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("cluster", "bi", "bj")), strict=True))
            for k, doc, grams in zip(keys, batch.column("doc").to_pylist(), gram_sets(*common.texts(batch.column("text")), n), strict=True):
                if k != key:
                    yield done()
                    key, docs, sets = k, [], []
                docs.append(doc)
                sets.append(grams)
        yield done()

    return run


def _matched(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """rows left join table (one row for each key). Rows with keys of `hot`, which is bounded, get theirs by broadcast: no
    group of copies meets in a task."""
    few = hot.select(*keys).distinct()
    warm = rows.join(F.broadcast(few.join(table, keys, "left")), keys)
    return rows.join(F.broadcast(few), keys, "left_anti").join(table, keys, "left").unionByName(warm)


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_column: str = "doc_id", text_column: str = "text", block_sets: int = BLOCK_SETS, block_grams: int = BLOCK_GRAMS, hot_copies: int = HOT_COPIES) -> DataFrame:
    """id_column, n_shingles, component_id, a row for each row of docs; two link when den * intersection >= num * union."""
    own = docs.select(common.own_id(id_column, text_column).alias("doc"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    sets = common.written(own.mapInArrow(_scan(n, num, den, COARSE), SCANNED))
    same = common.written(sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"), F.count("*").alias("k")))
    hot = common.written(same.where(F.col("k") >= common.least_hot(same, hot_copies, HOT_SETS)))
    # One row for each distinct set; its least id stands for all of them.
    named = _matched(sets.select("doc", "n", "s1", "s2"), same.drop("k"), ["n", "s1", "s2"], hot)
    named = common.written(named.select("doc", "n", F.coalesce("rep", "doc").alias("rep")))
    common.drop(same)
    firsts = named.where("n > 0 AND doc = rep").select("doc").distinct()
    coarse = prune(sets)  # copies too: they fold by signature, which costs less than to join them out
    live = own.join(union(coarse).select("doc").distinct().join(firsts, "doc"), "doc")
    live = common.written(live)
    for done in coarse:
        common.drop(done)
    fine = prune(common.written(live.mapInArrow(_scan(n, num, den, FINE), SCANNED)))
    pairs = []
    for own_sigs in fine:
        least = common.written(own_sigs.groupBy("sig").agg(F.min("doc").alias("a")))
        pairs.append(common.written(own_sigs.join(least, "sig").where("doc <> a").select("a", F.col("doc").alias("b")).distinct()))
        for done in (own_sigs, least):
            common.drop(done)
    near = union(pairs)
    clusters = components(near).withColumnRenamed("node", "doc").withColumnRenamed("component", "cluster")
    sizes = named.select("doc", "n").distinct().join(clusters, "doc").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_grams)).cast("int").alias("blocks"))
    members = live.join(clusters.join(sizes, "cluster"), "doc").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    # A cluster of one block meets once; a larger one in each pair of its blocks, so that no pair of sets is lost.
    members = members.select("doc", "text", "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("doc", "text", "cluster", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    dealt = members.repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "doc")
    found = components(dealt.mapInArrow(_verify(n, num, den), "a long, b long"))
    joined = _matched(named, found.withColumnRenamed("node", "rep"), ["rep"], hot).select("doc", "n", F.coalesce("component", "rep").alias("component"))
    blank = lambda c: F.when(F.col(c) < NULL_IDS, F.col(c))
    return joined.select(blank("doc").alias(id_column), F.col("n").alias("n_shingles"), blank("component").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of its component; rows with a null id stay."""
    classes = join(docs, n, num, den, id_column, text_column).where("component_id IS NOT NULL").groupBy(id_column).agg(F.min("component_id").alias("component_id"))
    gone = classes.where(F.col(id_column) != F.col("component_id")).select(id_column)
    return docs.join(gone, id_column, "left_anti")
