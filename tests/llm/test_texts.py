import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import storage
from cairn.llm import bpe, chat, common, imatch, jaccard, media, mixing, quality, warc
from cairn.llm.queries import vocabulary
from tests.llm import fixture


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(vocabulary()), special_tokens={})


def test_bpe_equals_the_library(spark, encoding):
    docs = fixture.with_null_id(spark)
    for r in bpe.encode(docs, vocabulary(), others=["doc_id", "text", "row"]).collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert len(r.starts) == len(ids) and r.starts == sorted(r.starts)
    back = bpe.decode(bpe.encode(docs, vocabulary(), others=["text"]), vocabulary(), others=["text"])
    assert back.toDF("want", "got").where("coalesce(want, '') <> got").count() == 0
    assert bpe.encode(fixture.empty(spark), vocabulary()).count() == 0


def test_pre_tokens_on_odd_texts(encoding):
    rnd = random.Random(4)
    codec = bpe.Codec(bpe.load_ranks(vocabulary()))
    for _ in range(60):
        found = ["".join(rnd.choice("ab 'srtvemld\n\t é1²٣中!.-_ſ\U0001f600$") for _ in range(rnd.randint(0, 300))) for _ in range(9)]
        raw = [x.encode() for x in found]
        ids, _, rows = codec.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(rows, rows[1:])] == [encoding.encode_ordinary(x) for x in found]


def brute_components(rows, n, num):
    sets = defaultdict(set)
    out = []
    for d, t in rows:
        w = (t or "").encode()
        w = bytes(x + 32 if 65 <= x <= 90 else x for x in w).split()
        g = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
        sets[d] |= g
        out.append((d, len(g)))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] | sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return Counter((d, k, find(d)) for d, k in out)


def test_jaccard_components(spark):
    docs = fixture.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for n, num, blocks, copies in ((4, 85, 512, 64), (5, 80, 2, 2), (1, 50, 512, 3)):
        got = jaccard.join(docs, n, num, 100, block_sets=blocks, hot_copies=copies).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, num)
    assert jaccard.join(fixture.empty(spark)).count() == 0
    assert jaccard.join(fixture.with_null_id(spark)).where("doc_id is null").count() == 2
    kept = jaccard.keep_one(docs, 4, 85, 100)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in brute_components(rows, 4, 85)}


def test_signatures_are_dealt_in_parts(spark, monkeypatch):
    """What a query of signatures shuffles is a part of them, for all that meets is the same."""
    docs = common.documents(spark, "/root/testdata/sf0.01")
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p: p.stat().st_size for d in folders for p in Path(d).rglob("shuffle_*.data")}
    written, most, got = storage.written, Counter(), {}

    def weighed(df):
        before = files()
        table = written(df)
        if "sig" in df.columns:
            most[size] = max(most[size], sum(k for p, k in files().items() if p not in before))
        return table

    monkeypatch.setattr(storage, "CLEANUP", "spark.cairn.keep")
    monkeypatch.setattr(common, "written", weighed)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for size in (1 << 40, 1):
            monkeypatch.setattr(jaccard, "PASS_SIGS", size, raising=False)
            got[size] = Counter(jaccard.join(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert got[1] == got[1 << 40] and len(got[1]) == docs.count()
    assert 0 < most[1] < most[1 << 40] / 5


def test_jaccard_on_long_words(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = ("".join(x[i] for i in bits) for x in ("ab", "ba"))  # equal under any polynomial hash modulo 2**64
    rows = [(1, a), (2, b), (3, f"{a} {b} c d"), (4, f"{b} {a} c d"), (5, a.upper()), (6, "x" * 100_000), (7, "x" * 100_000)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85)


def test_overlaps_of_a_block_in_small_fragments():
    rnd = np.random.default_rng(8)
    sets = [np.unique(rnd.integers(0, 300, int(rnd.integers(1, 200)))) for _ in range(60)] + [np.arange(250)] * 3
    want = {(i, j) for i in range(63) for j in range(i + 1, 63) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    for width, cells in ((1 << 16, 1 << 21), (7, 64), (100, 1 << 21)):
        assert set(jaccard.links(sets, 60, 100, width, cells)) == want


def test_linked_sets_share_a_signature():
    rnd = np.random.default_rng(5)
    for size in [*range(6, 40), 200, 700]:
        for _ in range(6):
            union = rnd.integers(0, 2**63, size * 2, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            a = np.unique(union[:size])
            lost = int(rnd.integers(0, size * 15 // 100 + 1))
            more = int(rnd.integers(0, size))
            b = np.unique(np.concatenate((a[lost:], union[size : size + more])))
            same = len(np.intersect1d(a, b))
            if 100 * same >= 85 * (len(a) + len(b) - same) and not np.array_equal(a, b):
                x, y = ({c: (need, sigs) for c, need, sigs in jaccard.signatures(s, 85, 100)} for s in (a, b))
                assert any(len(np.intersect1d(x[c][1], y[c][1])) >= max(x[c][0], y[c][0]) for c in x.keys() & y.keys())


def test_imatch(spark):
    docs = fixture.with_null_id(spark)
    got = imatch.edited_report(docs, 0.01, 0.9).collect()
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    want = Counter()
    for i, (d, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        want[d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = defaultdict(set)
    for r in imatch.fingerprints(docs.select(F.col("text").alias("doc_id"), "text"), imatch.lexicon(docs, 0.01, 0.9)).collect():
        by[r.doc_id].add(tuple(r.fingerprint))
    assert all(len(x) == 1 for x in by.values())
    assert sum(r.near_edited for r in got) > sum(r.near_next for r in got)
    assert imatch.edited_report(fixture.empty(spark)).count() == 0


def test_imatch_order_crosses_ranges(spark):
    docs = spark.createDataFrame([(i * 3000, f"text {i}") for i in range(9)], "doc_id long, text string")
    got = {r.doc_id: r.next for r in imatch.with_next(docs).collect()}
    assert got == {i * 3000: f"text {(i + 1) % 9}" for i in range(9)}
    # Ids far apart, null ids, and copies: each but a document's last copy is followed by the same.
    rows = [(7919 * i * i * (-1) ** i, f"t{i}") for i in range(200)] + [(None, f"n{i}") for i in range(40)] + [(0, "t0")] * 3
    got = imatch.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    want = Counter((*order[i], order[(i + 1) % len(order)][1]) for i in range(len(order)))
    assert Counter((r.doc_id, r.text, r.next) for r in got) == want


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert ((held.score >= 0.5).astype(int) == held.predicted).all()


def moments_of(rng, n, d, shift):
    x = np.concatenate((np.ones((n, 1)), rng.normal(shift, 1, (n, d))), 1)
    return x, x.T @ x


def test_risk_and_its_gradient():
    rng = np.random.default_rng(9)
    (xp, p), (xu, u), prior = moments_of(rng, 40, 5, 0.7), moments_of(rng, 300, 5, 0.0), 0.4
    p, u, w = p / 40, u / 300, rng.normal(0, 1, 6)

    def plain(w):  # the risk by its definition, row by row
        loss = lambda x, y: np.mean((1 - y * (x @ w)) ** 2 / 4)
        return prior * loss(xp, 1), loss(xu, -1) - prior * loss(xp, -1)

    first, inner, up, down = quality.risk(w, u, p, prior)
    assert np.allclose((first, inner), plain(w))
    for k in range(6):
        e = np.eye(6)[k] * 1e-6
        assert np.allclose([(a - b) / 2e-6 for a, b in zip(plain(w + e), plain(w - e))], [up[k], down[k]], atol=1e-6)


def test_fit_finds_the_least_non_negative_risk():
    rng = np.random.default_rng(10)
    for n, d, shift in ((400, 3, 0.5), (30, 12, 1.5), (25, 20, 0.2)):
        (_, p), (_, u) = moments_of(rng, n // 2, d, shift), moments_of(rng, n, d, 0.0)
        w = quality.fit(u, p, 0.5, 0.0)
        mean_u, mean_p = u / n, p / (n // 2)
        spread = (d + 1) / n * (np.diag(mean_u) - mean_u[0] ** 2)  # the ridge that fit() adds
        spread[0] = 0

        def total(v):
            first, inner, _, _ = quality.risk(v, mean_u, mean_p, 0.5)
            return first + max(0.0, inner) + (v * spread) @ v / 4

        assert quality.risk(w, mean_u, mean_p, 0.5)[1] >= -1e-9
        assert all(total(w) <= total(w + rng.normal(0, 10.0 ** -k, d + 1)) + 1e-6 for k in (0, 1, 2, 3) for _ in range(50))


def test_moments_are_of_all_rows(spark):
    docs = fixture.documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)], "doc_id long, quality int")
    model, prior = quality.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    learn = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    good = {r.doc_id for r in learn if r.quality}
    raw = [t.encode() for _, t in rows]
    x = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    x = np.concatenate((np.ones((len(x), 1)), x), 1)
    mine = x[[d in good for d, _ in rows]]
    assert prior == len(good) / len(learn)
    assert np.allclose(model, quality.fit(x.T @ x, mine.T @ mine, prior), atol=2e-3)


def test_quality_without_labels_or_text(spark):
    docs, none = fixture.with_null_id(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == docs.count() and all(r.score == 0.5 for r in got)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (5, 1), (6, 1), (7, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, labels).collect())
    assert quality.classify(fixture.empty(spark), labels).count() == 0


def test_media_round_trip(spark):
    docs = fixture.with_null_id(spark)
    got = media.read_back(media.store(docs)).collect()
    want = Counter()
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))
        want[r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert media.read_back(media.store(fixture.empty(spark))).count() == 0


def plain_means(pixels, height, width):
    """Area means of each target pixel, by the share of each source pixel that it covers."""
    out = np.zeros((height, width))
    share = lambda n, to, i, k: max(0.0, min((i + 1) * n / to, k + 1) - max(i * n / to, k))
    for i in range(height):
        for j in range(width):
            w = np.outer([share(pixels.shape[0], height, i, k) for k in range(pixels.shape[0])], [share(pixels.shape[1], width, j, k) for k in range(pixels.shape[1])])
            out[i, j] = (w * pixels).sum() / w.sum()
    return out


def test_media_columns_against_plain_code(spark):
    rows = [(1, "a"), (2, "héllo wörld " * 11), (3, None), (4, "x" * 1000), (5, "".join(chr(33 + i * 7 % 90) for i in range(64 * 31)))]
    got = {r.doc_id: r for r in media.read_back(media.store(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for d, text in rows:
        b = (text or "").encode()
        h = max(1, -(-len(b) // 64))
        payload = b + bytes(64 * h - len(b))
        pixels = np.frombuffer(payload, np.uint8).reshape(h, 64)
        if h % 2 == 0:
            stored = f"P5\n64 {h}\n255\n".encode() + payload
        else:  # BITMAPFILEHEADER, BITMAPINFOHEADER, 256 greys, rows from the bottom
            head = b"BM" + (1078 + 64 * h).to_bytes(4, "little") + bytes(4) + (1078).to_bytes(4, "little")
            info = b"".join(int(v).to_bytes(n, "little") for v, n in ((40, 4), (64, 4), (h, 4), (1, 2), (8, 2), (0, 4), (64 * h, 4), (2835, 4), (2835, 4), (256, 4), (0, 4)))
            stored = head + info + b"".join(bytes([i, i, i, 0]) for i in range(256)) + pixels[::-1].tobytes()
        r = got[d]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        tile = np.load(__import__("io").BytesIO(r.tile))
        assert tile.shape == (16, 16) and tile.dtype == np.uint8 and np.abs(tile - plain_means(pixels, 16, 16)).max() <= 0.5 + 1e-6
        small = np.rint(plain_means(pixels, 8, 9) * 1024)
        bits = "".join("1" if small[i, j] < small[i, j + 1] else "0" for i in range(8) for j in range(8))
        assert r.feature == f"{int(bits, 2):016x}:{hashlib.sha256(r.tile).hexdigest()}"


def test_very_long_texts(spark, encoding):
    rows = [(1, "word " * 400_000), (2, "x" * 100_000), (3, "é" * 1_000_000), (4, "y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in bpe.encode(docs.where("doc_id <> 3"), vocabulary(), others=["doc_id"], with_ids=False).collect():
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id - 1][1].encode()).hexdigest()
    assert {r.doc_id: r.n_bytes for r in media.read_back(media.store(docs)).collect()} == {d: len(t.encode()) for d, t in rows}
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 4
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4)}
    assert imatch.edited_report(docs, 0.1, 0.9).count() == 4


def test_media_formats(spark):
    rnd = np.random.default_rng(6)
    for shape in ((5, 7), (3, 4, 3), (1, 1), (2, 9, 3)):
        pixels = rnd.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(media.encode_pgm(pixels)) == pixels).all() and (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert media.decode(b"P2 # a\n2 1\n15\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]] and media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    big = rnd.integers(0, 256, (12, 10)).astype(np.uint8)
    assert np.allclose(media.area_resize(big, 3, 5), big.reshape(3, 4, 5, 2).mean((1, 3)))
    assert np.isclose(media.area_resize(big, 5, 3).mean(), big.mean())
    df = spark.createDataFrame([(1, media.encode_pgm(big)), (2, None), (3, b"junk"), (4, b"P5\n9 9\n255\n")], "id long, media binary")
    got = {r.id: r for r in media.tiles(df).collect()}
    assert got[1].height == 12 and np.load(__import__("io").BytesIO(got[1].tile)).shape == (32, 32)
    assert got[2].tile is None and got[2].problem is None and got[3].problem and got[4].problem


def test_chat(spark):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", "why"), (2, "chosen", None, None, None), (None, "chosen", 0, "user", "x"), (3, "other", 0, "user", "x"), (4, "chosen", 0, "user", "a"), (4, "chosen", 0, "user", "a"), (4, "rejected", 0, "user", "a")]
    turns = spark.createDataFrame([(*r, 1, "z") for r in rows], "pair_id long, side string, turn int, role string, text string, n int, section string")
    got = {(r.pair_id, r.section): (r.n_turns, r.rendered, r.learn) for r in chat.format_preferences(turns).collect()}
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got == {
        (1, "prompt"): (1, say("user", "hi"), ""), (1, "chosen"): (1, say("assistant", "yes"), "14-25"), (1, "rejected"): (2, say("assistant", "no") + say("user", "why"), "14-24"),
        (2, "chosen"): (1, say("user", ""), ""), (4, "chosen"): (1, say("user", "a") * 2, ""), (4, "rejected"): (1, say("user", "a"), ""),
    }
    assert chat.format_preferences(turns.limit(0)).count() == 0
    long = spark.createDataFrame([(9, s, t, "user", "x" if t < 150 or s == "chosen" else "y") for s in ("chosen", "rejected") for t in range(200)], "pair_id long, side string, turn int, role string, text string")
    parts = Counter((r.section, r.part, r.n_turns) for r in chat.format_preferences(long).collect())
    assert parts == Counter({("prompt", 0, 64): 1, ("prompt", 1, 64): 1, ("prompt", 2, 22): 1, ("chosen", 2, 42): 1, ("chosen", 3, 8): 1, ("rejected", 2, 42): 1, ("rejected", 3, 8): 1})


def test_warc(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        kind = rnd.choice(["response", "revisit", "request"])
        h = rnd.choice([None, {}, {"ETag": rnd.choice("ab"), "X": str(i)}, {"Last-Modified": rnd.choice("ab"), "Content-Length": "9"}])
        rows.append((i, kind, rnd.choice(["http://WWW.a.org/x/?utm_source=q#f", "https://a.org:443/x", "http://b.org/", None]), rnd.choice([None, *range(0, 400000, 20000)]), h, f"p{i}" if kind == "response" else None, "extra"))
    df = spark.createDataFrame(rows, "record_id long, type string, url string, ts long, headers map<string,string>, payload string, status string")
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    name = lambda u: None if u is None else "b.org" if "b.org" in u else "a.org/x"
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    assert len(got) == sum(r[1] == "revisit" for r in rows)
    for i, kind, url, ts, h, _, _ in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[1] == "response" and url and name(r[2]) == name(url) and ts is not None and r[3] is not None and r[3] < ts]
        best = max(before, key=lambda r: (r[3], r[0]), default=None)
        status = "no_response"
        if best:
            mine, own = low(h), low(best[4])
            field = "etag" if "etag" in mine else "last-modified"
            status = "no_validator" if field not in mine or field not in own else "resolved" if mine[field] == own[field] else "mismatch"
        r = got[i]
        assert (r.status, r.source_id) == (status, best and best[0])
        if status == "resolved":
            assert r.payload == best[5] and r.headers == own | {k: v for k, v in mine.items() if k != "content-length"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def brute_budget(total, nodes):
    """nodes: name -> (weight, capacity). Water-filling by rounds."""
    out, left, open_ = {}, total, {k: v for k, v in nodes.items() if v[0] > 0}
    while open_:
        w = sum(v[0] for v in open_.values())
        full = {k: v for k, v in open_.items() if v[1] * w <= left * v[0]}
        if not full:
            return out | {k: left * v[0] // w for k, v in open_.items()}
        k = min(full, key=lambda k: (full[k][1] / full[k][0], k))
        out[k] = open_.pop(k)[1]
        left -= out[k]
    return out


def test_mixing(spark):
    docs = fixture.with_null_id(spark)
    weights = {"d0": 5, "d1": 1, "d0/en": 3, "d0/en/src2": 4, "d1/": 0}
    domain = F.concat(F.lit("d"), (F.coalesce("doc_id", F.lit(0)) % 2).cast("string"))
    got = mixing.mix(docs, 900, weights, domain, epochs=2)
    assert got.columns == [*docs.columns, "mix_domain", "mix_tokens", "mix_copies"]
    size = defaultdict(int)
    per = defaultdict(int)
    taken = defaultdict(int)
    for r in docs.collect():
        leaf = (f"d{(r.doc_id or 0) % 2}", r.lang or "", r.source or "")
        size[leaf] += len((r.text or "").encode().split())
    for r in got.collect():
        taken[r.mix_domain, r.lang or "", r.source or ""] += r.mix_tokens * r.mix_copies
    weight = lambda *k: weights.get("/".join(k), 1)
    cap = lambda *k: sum(2 * v for x, v in size.items() if x[: len(k)] == k)
    top = brute_budget(900, {d: (weight(d), cap(d)) for d in {x[0] for x in size}})
    for d, b in top.items():
        for lang, c in brute_budget(b, {y: (weight(d, y), cap(d, y)) for y in {x[1] for x in size if x[0] == d}}).items():
            for s, e in brute_budget(c, {z: (weight(d, lang, z), cap(d, lang, z)) for z in {x[2] for x in size if x[:2] == (d, lang)}}).items():
                per[d, lang, s] = e
    for leaf in size:
        assert taken[leaf] <= per[leaf] and per[leaf] <= 2 * size[leaf], leaf
        assert taken[leaf] == per[leaf] if per[leaf] == 2 * size[leaf] else True
    assert sum(per.values()) <= 900 and sum(taken.values()) > 0
    assert mixing.mix(fixture.empty(spark), 0.5, weights, domain).count() == 0
    again = mixing.mix(docs.repartition(5), 900, weights, domain, epochs=2)
    assert Counter((r.doc_id, r.mix_copies) for r in again.collect()) == Counter((r.doc_id, r.mix_copies) for r in got.collect())
