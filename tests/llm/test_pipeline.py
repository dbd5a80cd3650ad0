"""The pipeline's stages, each on what its predecessor kept, against brute force."""

from collections import Counter, defaultdict

import corpus_pipeline as cp
from cairn.llm import common, mixing
from tests.llm.test_substrings import brute_words
from tests.llm.test_texts import brute_budget, brute_components


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert [name for name, _ in cp.STAGES] == ["quality", "near_duplicates", "passages", "mix", "encode"]
    docs = common.documents(spark, sf_dir)
    columns = docs.columns
    kept = []
    for i, (name, stage) in enumerate(cp.STAGES):
        before = docs
        docs = common.written(stage(spark, docs, sf_dir))
        kept.append(docs.count())
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if i < 4:
            assert docs.columns == columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            assert sum((d in left) == bool(q) for d, q in labels.items()) >= 0.97 * len(labels)
        elif name == "near_duplicates":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {c for _, _, c in brute_components(rows, 5, 80)}
        elif name == "passages":
            got = Counter((r.doc_id, len((r.text or "").encode().split())) for r in docs.collect())
            assert got == Counter({(d, n - gone): k for (d, n, gone, _), k in brute_words(rows, cp.PASSAGE_WORDS).items()})
            assert docs.where("n_chars <> length(text)").count() == 0
        elif name == "mix":
            total = before.select(mixing.tokens(before["text"]).alias("n")).groupBy().sum("n").first()[0]
            taken = docs.select(mixing.tokens(docs["text"]).alias("n")).groupBy().sum("n").first()[0]
            assert 0.8 * cp.MIX_SHARE * total < taken <= cp.MIX_SHARE * total
            assert set(docs.collect()) <= set(before.collect())
        else:
            import public_tokenizers
            import tiktoken

            from cairn.llm import bpe

            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(cp.vocabulary()), special_tokens={})
            want = {d: own.encode_ordinary(t or "") for d, t in rows}
            assert {r.doc_id: r.ids for r in docs.collect()} == want
    assert kept[0] > kept[1] >= kept[3] and kept[1] == kept[2] and kept[3] == kept[4]


def test_mix_against_budgets_by_leaf(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    leaf = [mixing.domain_of(docs["source"]).alias("domain"), "lang", "source", mixing.tokens(docs["text"]).alias("n")]
    size, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for *k, n in docs.select(*leaf).collect():
        k = tuple(x or "" for x in k)
        size[k] += n
        longest[k] = max(longest[k], n)
    got = cp.mix_sources(spark, docs, "/root/testdata/sf0.01")
    for *k, n in got.select(mixing.domain_of(got["source"]), "lang", "source", mixing.tokens(got["text"])).collect():
        taken[tuple(x or "" for x in k)] += n
    total = int(sum(size.values()) * cp.MIX_SHARE)
    level = {(): total}
    for depth in (1, 2, 3):
        down = {}
        for up, b in level.items():
            below = {k[:depth] for k in size if k[: depth - 1] == up}
            down |= brute_budget(b, {k: (mixing.WEIGHTS.get("/".join(k), 1), sum(v for x, v in size.items() if x[:depth] == k)) for k in below})
        level = down
    assert set(level) == set(size) and sum(level.values()) <= total
    for k, b in level.items():
        assert taken[k] == b if b == size[k] else b - longest[k] < taken[k] <= b, k
