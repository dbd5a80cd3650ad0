import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import common, fragments, substring, suffix
from tests.llm import fixture


def brute_words(rows, window):
    """rows: (doc_id or None, text). Covered words by windows that a smaller doc_id has."""
    last = fragments.LAST
    least = {}
    cut = [(last if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in cut:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(d, least.get(g, last))
    out = []
    for d, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, y in zip(w, gone) if not y)
        out.append((None if d == last else d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_bytes(rows, window):
    count = Counter(b[i : i + window] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - window + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return Counter(out)


def test_words_against_brute_force(spark):
    docs = fixture.with_null_id(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for window, gram, hot, bound in ((13, 5, 64, 1 << 20), (4, 2, 64, 1 << 20), (13, 5, 2, 1 << 20), (4, 2, 3, 50), (13, 5, 2, 0)):
        got = substring.remove_repeats(docs, window, gram, with_text=False, hot=hot, bound=bound).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows, window)


def test_bytes_against_brute_force(spark):
    docs = fixture.with_null_id(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for window, shard, hot in ((200, 1 << 20, 64), (60, 300, 64), (60, 300, 2), (203, 1 << 20, 3)):  # small shards merge by binary search
        got = suffix.remove_repeats(docs, window, 16, with_text=False, shard_bytes=shard, hot=hot).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows, window)


def thue_morse(n=1024):
    """Two texts of which every polynomial hash modulo 2**64 makes one."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_hashes_part_what_polynomials_do_not():
    for n in (8, 9, 64, 500, 512, 1024, 4096):
        data = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
        starts, ends = np.array([0, n]), np.array([n, 2 * n])
        codes = common.hash_slices(data, np.arange(2 * n), np.arange(2 * n) + 1)
        for h in (common.hash_slices(data, starts, ends), common.hash_runs(codes, starts, ends), common.hash_grams(codes, n)[[0, n]], common.byte_grams(data, n)[[0, n]]):
            assert h[0] != h[1]
    same = np.frombuffer(b"one two one twofold", np.uint8)
    h = common.hash_slices(same, np.array([0, 8, 4, 12, 12]), np.array([3, 11, 7, 15, 19]))
    assert h[0] == h[1] and h[2] == h[3] and len({*h.tolist()}) == 3


def test_long_words_are_told_apart(spark):
    a, b = thue_morse()
    rows = [(1, " ".join(["w"] * 12 + [a])), (2, " ".join(["w"] * 12 + [b])), (3, f"{a} {b} " + "x" * 100_000), (4, "y" * 2_000_000 + " " + "z z " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.remove_repeats(docs, with_text=False).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows, 13)
    for window in (200, 1024):
        got = suffix.remove_repeats(docs.where("doc_id < 4"), window, with_text=False).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows[:3], window)


def test_empty_tables(spark):
    assert substring.remove_repeats(fixture.empty(spark)).count() == 0
    assert suffix.remove_repeats(fixture.empty(spark)).count() == 0


def test_kept_text_keeps_breaks(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a\n{passage}  b"), (2, f"c\n{passage}  d\te")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substring.remove_repeats(docs, keep_breaks=True).collect()}
    assert got == {1: f"a\n{passage}  b", 2: "c\nd\te"}


def test_automaton_windows():
    rnd = random.Random(1)
    shard = [([rnd.choice("ab") for _ in range(rnd.randint(3, 30))], rnd.randint(0, 9)) for _ in range(25)]
    for bound in (10**6, 40):
        got = substring.least_labels(shard, 5, bound)
        for (s, _), labels in zip(shard, got):
            for i, low in enumerate(labels):
                g = s[i : i + 5]
                assert low == min(label for t, label in shard if any(t[j : j + 5] == g for j in range(len(t) - 4)))


def test_suffix_array_and_kasai():
    rnd = random.Random(2)
    for n in (0, 1, 2, 50, 300):
        text = bytes(rnd.choice(b"abc\0") for _ in range(n))
        array, shared = suffix.shard_index(text)
        want = sorted(range(n), key=lambda i: text[i:])
        assert array.tolist() == want
        for k in range(1, n):
            a, b = text[want[k - 1] :], text[want[k] :]
            m = 0
            while m < min(len(a), len(b)) and a[m] == b[m]:
                m += 1
            assert shared[k] == m


def test_refinement_names_windows():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 99, 3000).astype(np.uint8)
    rank = suffix.refine(data, 20)
    windows = [data[i : i + 20].tobytes() for i in range(2981)]
    names = {}
    assert all(names.setdefault(w, r) == r for w, r in zip(windows, rank.tolist())) and len(set(names.values())) == len(names)


def test_reference_automata_are_broadcast(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "c d"), (3, None)], "doc_id long, text string")
    ref = spark.createDataFrame([(passage + " z",), (None,)], "text string")
    got = {r.doc_id: (r.n_words, r.n_matched) for r in substring.reference_matches(docs, ref).collect()}
    assert got == {1: (17, 15), 2: (2, 0), 3: (0, 0)}


def test_hot_groups_stay_whole(spark):
    rows = [(i, f"only{i} " + " ".join(f"p{j}" for j in range(30)) + f" end{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = substring.remove_repeats(docs, with_text=False).agg(F.sum("n_removed")).first()[0]
    assert got == 299 * 30


def test_reference_spans_are_removed(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(1, "a " + " ".join(words[:15]) + " b  c " + " ".join(words[15:28])), (2, " ".join(words[:12])), (3, None), (4, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ref = spark.createDataFrame([(" ".join(words[:16]),), (" ".join(words[10:]),)], "text string")
    for shard_bytes in (1, 1 << 19):
        got = {r.doc_id: (r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept_text) for r in substring.remove_reference(docs, ref, shard_bytes=shard_bytes).collect()}
        assert got == {1: (31, 28, [(1, 15), (18, 30)], "a b c"), 2: (12, 0, [], " ".join(words[:12])), 3: (0, 0, [], ""), 4: (30, 30, [(0, 29)], "")}
