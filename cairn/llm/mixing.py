"""Mixing sources to target weights: hierarchical budgets over a tree of domain, language and source.

Every node's capacity is its documents' tokens times the epochs allowed. From the top, a node's
budget is dealt to its children by weight; a child that lacks tokens gets all it has and its
brothers share the rest by their weights (water-filling), so a shortage stays among brothers as long
as they can take it and only then falls to the parent's brothers. Budgets are whole tokens, rounded
down. A leaf reads its documents in whole epochs; of one more epoch it takes the prefix, in that
epoch's seeded order, whose tokens fit into what is left of its budget.

The prefix is found without sorting a leaf in one task: documents fall into `ranges` by the first
bits of their order, the ranges' sums are added up, and only a range's own documents are sorted.

Defined cases: a null text has no tokens; null domain, language or source is the name ''; nodes
without a weight have default_weight; negative weights count as 0 and get nothing; repeated rows are
documents of their own, ordered by id, tokens and a hash of the row; a document without tokens is in a
prefix if those before it fit; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import common

TREE = ("domain", "lang", "source")
WIDE = "decimal(38,0)"
RANGES = 1024


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def _weights(spark, weights: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in weights.items()], "name string, weight long")


def _deal(nodes: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Deals each parent's budget to its nodes (weight, capacity): nodes sorted by capacity per weight; those that the level
    reached covers are full, the others share what is left by weight."""
    whole = Window.partitionBy(*parent)
    order = whole.orderBy(F.col("capacity") / F.col("weight"), "name").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(WIDE)
    sums = nodes.withColumns({"left": F.col(budget).cast(WIDE) - F.coalesce(F.sum("capacity").over(order), zero), "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), zero)})
    sums = sums.withColumn("full", F.col("capacity").cast(WIDE) * F.col("open") <= F.col("left") * F.col("weight"))
    key = F.struct(F.col("capacity") / F.col("weight"), "name", "left", "open")
    sums = sums.withColumn("first", F.min(F.when(~F.col("full"), key)).over(whole))
    share = F.expr("cast((first.left * weight) div first.open as bigint)")
    return sums.withColumn(out, F.when(F.col("full"), F.col("capacity")).otherwise(share)).drop("left", "open", "full", "first")


def budgets(leaves: DataFrame, total: int, weights: dict[str, int], default_weight: int = 1, epochs: int = 1) -> DataFrame:
    """domain, lang, source, n_tokens, budget. leaves: domain, lang, source, n_tokens. weights: by 'domain', 'domain/lang' or 'domain/lang/source'."""
    spark = leaves.sparkSession
    table = F.broadcast(_weights(spark, weights))  # as long as the caller's dict
    weight = F.greatest(F.coalesce("weight", F.lit(default_weight)), F.lit(0))
    level = leaves.withColumn("capacity", (F.col("n_tokens") * epochs).cast("long"))
    out = None
    for depth in range(1, 4):
        keys = list(TREE[:depth])
        nodes = level.groupBy(*keys).agg(F.sum("capacity").cast("long").alias("capacity"))
        nodes = nodes.withColumn("name", F.concat_ws("/", *keys)).join(table, "name", "left").withColumn("weight", weight).where("weight > 0")
        if out is None:
            nodes = nodes.withColumns({"root": F.lit(0), "parent": F.lit(total).cast("long")})
            out = _deal(nodes, ["root"], "parent", "budget")
        else:
            up = out.select(*keys[:-1], F.col("budget").alias("parent"))
            out = _deal(nodes.join(up, keys[:-1]), keys[:-1], "parent", "budget")
        out = out.select(*keys, "budget")
    return level.join(out, list(TREE), "left").select(*TREE, "n_tokens", F.coalesce("budget", F.lit(0)).alias("budget"))


def mix(docs: DataFrame, total: int | float, weights: dict[str, int], domain: Column, seed: int = 0, default_weight: int = 1, epochs: int = 1, id_column: str = "doc_id", n_tokens: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """The columns of docs, then mix_domain, mix_tokens and mix_copies: the documents taken and how often, 1 or more.

    total: tokens, or if a float the share of all tokens. domain: each row's domain. n_tokens: each row's tokens, the words of text if None.
    """
    columns = docs.columns
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    own = docs.select(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("row"), blank(domain).alias("domain"), blank(F.col("lang")).alias("lang"), blank(F.col("source")).alias("source"), (tokens(F.col("text")) if n_tokens is None else n_tokens).alias("n"), F.col(id_column).cast("string").alias("id"))
    slim = own.drop("row")
    leaves = common.written(slim.groupBy(*TREE).agg(F.sum("n").alias("n_tokens")))
    if isinstance(total, float):
        total = int((leaves.agg(F.sum("n_tokens")).first()[0] or 0) * total)
    plan = budgets(leaves, total, weights, default_weight, epochs)
    plan = common.written(plan.select(*TREE, F.expr("if(n_tokens > 0, budget div n_tokens, 0)").alias("whole"), F.expr("if(n_tokens > 0, budget % n_tokens, 0)").alias("rest")))
    # The order of the epoch that is cut: a seeded hash of the id.
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce("id", F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = own.join(plan, list(TREE)).where("whole > 0 OR rest > 0").withColumn("key", key).withColumn("range", F.floor(F.col("key") / F.lit((1 << 60) // ranges)).cast("long"))
    sums = rows.groupBy(*TREE, "range").agg(F.sum("n").alias("s"))
    before = sums.select(*TREE, "range", F.coalesce(F.sum("s").over(Window.partitionBy(*TREE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*TREE, "range").orderBy("key", "id", F.col("n"), F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, 0)
    picked = rows.withColumn("upto", F.sum("n").over(inside)).join(before, [*TREE, "range"])
    copies = F.col("whole") + ((F.col("base") + F.col("upto")) <= F.col("rest")).cast("long")
    taken = picked.withColumn("copies", copies).where("copies > 0")
    return taken.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)), F.col("domain").alias("mix_domain"), F.col("n").alias("mix_tokens"), F.col("copies").alias("mix_copies"))


#: What the query and the pipeline use: four domains out of the sources' numbers, of unequal weights.
DOMAINS = ("web", "books", "code", "news")
WEIGHTS = {"web": 4, "books": 3, "code": 1, "news": 2, "web/en": 3, "books/en": 2, "news/de": 2, "web/en/src0": 2}


def domain_of(source: Column) -> Column:
    number = F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*(F.lit(d) for d in DOMAINS)), number % len(DOMAINS) + 1)


ORACLE = """
WITH d AS (SELECT doc_id, lang, source, ['web', 'books', 'code', 'news'][regexp_extract(source, '([0-9]+)$', 1)::INT % 4 + 1] AS domain, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
wt(name, weight) AS (VALUES ('web', 4), ('books', 3), ('code', 1), ('news', 2), ('web/en', 3), ('books/en', 2), ('news/de', 2), ('web/en/src0', 2)),
l3 AS (SELECT domain, lang, source, sum(n)::HUGEINT AS tok, 2 * sum(n)::HUGEINT AS cap FROM d GROUP BY ALL),
t AS (SELECT floor(0.6 * sum(tok))::HUGEINT AS total FROM l3),
n1 AS (SELECT x.*, coalesce(weight, 1) AS w FROM (SELECT domain, domain AS name, sum(cap) AS cap FROM l3 GROUP BY ALL) x LEFT JOIN wt USING (name)),
s1 AS (SELECT *, total - coalesce(sum(cap) OVER p, 0) AS lft, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS opn FROM n1, t WINDOW p AS (ORDER BY cap::DOUBLE / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f1 AS (SELECT *, cap * opn <= lft * w AS ful FROM s1),
b1 AS (SELECT domain, CASE WHEN ful THEN cap ELSE (min_by(lft, cap::DOUBLE / w) FILTER (NOT ful) OVER ()) * w // (min_by(opn, cap::DOUBLE / w) FILTER (NOT ful) OVER ()) END AS b FROM f1),
n2 AS (SELECT x.*, coalesce(weight, 1) AS w, b AS total FROM (SELECT domain, lang, domain || '/' || lang AS name, sum(cap) AS cap FROM l3 GROUP BY ALL) x LEFT JOIN wt USING (name) JOIN b1 USING (domain)),
s2 AS (SELECT *, total - coalesce(sum(cap) OVER p, 0) AS lft, sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER p, 0) AS opn FROM n2 WINDOW p AS (PARTITION BY domain ORDER BY cap::DOUBLE / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f2 AS (SELECT *, cap * opn <= lft * w AS ful FROM s2),
b2 AS (SELECT domain, lang, CASE WHEN ful THEN cap ELSE (min_by(lft, cap::DOUBLE / w) FILTER (NOT ful) OVER q) * w // (min_by(opn, cap::DOUBLE / w) FILTER (NOT ful) OVER q) END AS b FROM f2 WINDOW q AS (PARTITION BY domain)),
n3 AS (SELECT x.*, coalesce(weight, 1) AS w, b AS total FROM (SELECT *, domain || '/' || lang || '/' || source AS name FROM l3) x LEFT JOIN wt USING (name) JOIN b2 USING (domain, lang)),
s3 AS (SELECT *, total - coalesce(sum(cap) OVER p, 0) AS lft, sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER p, 0) AS opn FROM n3 WINDOW p AS (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f3 AS (SELECT *, cap * opn <= lft * w AS ful FROM s3),
b3 AS (SELECT domain, lang, source, tok, CASE WHEN ful THEN cap ELSE (min_by(lft, cap::DOUBLE / w) FILTER (NOT ful) OVER q) * w // (min_by(opn, cap::DOUBLE / w) FILTER (NOT ful) OVER q) END AS b FROM f3 WINDOW q AS (PARTITION BY domain, lang)),
pl AS (SELECT domain, lang, source, CASE WHEN tok > 0 THEN b // tok ELSE 0 END AS whole, CASE WHEN tok > 0 THEN b % tok ELSE 0 END AS rest FROM b3),
k AS (SELECT d.*, whole, rest, ('0x' || substr(md5('0|' || whole::VARCHAR || '|' || doc_id::VARCHAR), 1, 15))::BIGINT AS key FROM d JOIN pl USING (domain, lang, source)),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, domain, lang, source, n::BIGINT AS n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
