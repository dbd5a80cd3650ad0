"""I-Match fingerprints, in DataFrame functions alone.

Terms are words in lower case (A-Z alone). The lexicon keeps the terms whose inverse document
frequency lies in a band, counted over all documents. A document's distinct terms in the lexicon are
sorted by their code (60 bits of a seeded MD5), and each randomised subset of the lexicon gives a
hash of those that it holds. Subsets come in levels that keep 1 of 16, 128 and 1024 terms, so short
and long documents both have some that hold a few of their terms: the more subsets agree, the more
alike two documents are.

The lexicon holds at most (mean number of distinct terms) / min_share rows, whatever the corpus; it
is broadcast if its counted rows are under BROADCAST_ROWS, and else joined by a shuffle.

The order of documents is found on slim rows alone, dealt by ranges; texts and fingerprints then move
to their neighbours by a hash of the document, so no range of ids makes a large task.

Defined cases: a null text is empty; a document without terms in the lexicon has a fingerprint of
blanks; null ids come after all others; rows that repeat an id are documents of their own, in the
order of their texts (of the first TIE characters, then of a hash); the document after the last is
the first, which may be the same; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import common

LEVELS, PER_LEVEL = (16, 128, 1024), 16
BLANK = "------"
BROADCAST_ROWS = 1_000_000
#: Characters by which texts with one id are ordered.
TIE = 64
#: What names a document: whether its id is null, the id, a hash of the text.
KEY = ("nul", "id", "h")


def terms(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.array_distinct(F.split(lower, common.BREAKS)), lambda w: w != "")


def lexicon(docs: DataFrame, min_share: float = 0.001, max_share: float = 0.25, seed: str = "0", text_column: str = "text") -> DataFrame:
    """term, code: the terms in at least min_share and at most max_share of the documents, which is the band
    ln(1 / max_share) to ln(1 / min_share) of inverse document frequencies."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.coalesce(F.col(text_column), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    code = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("term"))), 1, 15), 16, 10).cast("long")
    return df.filter((F.col("df") >= min_share * n) & (F.col("df") <= max_share * n)).select("term", code.alias("code"))


def subsets(codes: Column) -> Column:
    """The hash of each subset, of sorted codes: an array of strings."""
    def of_level(shift: int, mask: int) -> Column:
        held = lambda x, j: F.shiftright(x, shift).bitwiseAND(F.lit(mask)) == j
        return F.transform(F.sequence(F.lit(0), F.lit(PER_LEVEL - 1)), lambda j: F.filter(codes, lambda x: held(x, j)))

    out = [of_level(16 * level, keep - 1) for level, keep in enumerate(LEVELS)]
    lists = F.flatten(F.array(*out))
    return F.transform(lists, lambda c: F.when(F.size(c) == 0, BLANK).otherwise(F.substring(F.md5(F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))), 1, 6)))


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets that agree among those that either document has terms in; 1 if neither has any."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    some = F.size(F.filter(pairs, lambda p: (p["a"] != BLANK) | (p["b"] != BLANK)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] != BLANK) & (p["a"] == p["b"])))
    return F.when(some == 0, F.lit(1.0)).otherwise(same / some)


def _neighbours(own: DataFrame) -> DataFrame:
    """KEY, copies, prev (KEY and n): of each distinct document, how often it is there and which one comes before it; before
    the first comes the last. Only the ends of ranges look across; there are as many as shuffle partitions."""
    spark = own.sparkSession
    order = ("nul", "id", "tie", "h")
    slim = own.select(*KEY, F.length("text").alias("n"), F.substring("text", 1, TIE).alias("tie")).groupBy(*order, "n").agg(F.count("*").alias("copies"))
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = common.written(slim.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    at = lambda c="": F.struct(*(F.col(f"{c}{k}").alias(k) for k in (*KEY, "n")))
    ends = slim.groupBy("range").agg(F.max(F.struct(*order, "n")).alias("last"))
    ends = ends.select("range", F.coalesce(F.lag("last").over(Window.orderBy("range")), F.max("last").over(Window.partitionBy())).alias("last")).select("range", at("last.").alias("around"))
    inside = Window.partitionBy("range").orderBy(*order)
    ranked = slim.withColumn("prev", F.lag(at()).over(inside)).join(F.broadcast(ends), "range")  # a row for each range
    found = common.written(ranked.select(*KEY, "copies", F.coalesce("prev", "around").alias("prev")))
    common.drop(slim)
    return found


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", half: bool = False) -> DataFrame:
    """KEY, copy, copies, doc_id, text, prev, next: each document with the text of the one after it by ascending id; with half,
    as much of that text's beginning as half of its own length, rounded down. A copy that isn't its last is followed by the same."""
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    own = own.select(F.col("doc_id").isNull().alias("nul"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"), "text")
    rows = own.join(_neighbours(own), list(KEY)).withColumn("copy", F.row_number().over(Window.partitionBy(*KEY).orderBy("copies")))
    begins = lambda n: F.expr(f"substring(text, 1, cast({n} div 2 as int))") if half else F.col("text")
    after = rows.where("copy = 1").select(*(F.col(f"prev.{k}").alias(k) for k in KEY), begins("prev.n").alias("after"))
    got = rows.join(after, list(KEY))
    return got.select(*KEY, "copy", "copies", F.when(~F.col("nul"), F.col("id")).alias("doc_id"), "text", "prev", F.when(F.col("copy") < F.col("copies"), begins("length(text)")).otherwise(F.col("after")).alias("next"))


def fingerprints(docs: DataFrame, lexicon_: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text's fingerprint as an array, a row for each row of docs. The lexicon as lexicon() gives it."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    marked = F.concat(F.array(F.lit("")), terms(F.col("text")))
    return _grouped(own.select("row", "doc_id", F.explode(marked).alias("term")), lexicon_).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list("code")).alias("codes")).select("doc_id", subsets(F.col("codes")).alias("fingerprint"))


def _grouped(exploded: DataFrame, lexicon_: DataFrame) -> DataFrame:
    """Joins the codes; the empty term, which marks each document, stays without a code."""
    spark = exploded.sparkSession
    lexicon_ = lexicon_.unionByName(spark.range(1).select(F.lit("").alias("term"), F.lit(None).cast("long").alias("code")))
    return exploded.join(F.broadcast(lexicon_) if lexicon_.count() < BROADCAST_ROWS else lexicon_, "term")


def edited_report(docs: DataFrame, min_share: float = 0.001, max_share: float = 0.25, seed: str = "0") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each document against the
    text whose last half is the next document's beginning, and against that document."""
    band = common.written(lexicon(docs, min_share, max_share, seed))
    rows = with_next(docs, half=True)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) div 2 as int))"), F.col("next"))
    each = [*KEY, "copy", "copies", "doc_id", "prev"]
    rows = rows.select(*each, "text", edited.alias("edited"), n.alias("n_chars"))
    of = lambda column, side: F.transform(terms(F.col(column)), lambda w: F.struct(F.lit(side).alias("side"), w.alias("term"), F.lit(None).cast("string").alias("note")))
    mark = F.array(F.struct(F.lit(0).alias("side"), F.lit("").alias("term"), F.concat_ws(":", F.col("n_chars").cast("string"), F.sha2(F.col("edited"), 256)).alias("note")))
    exploded = rows.select(*each, F.explode(F.concat(mark, of("text", 1), of("edited", 2))).alias("x")).select(*each, "x.side", "x.term", "x.note")
    codes = [F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("code")))).alias(f"c{s}") for s in (1, 2)]
    got = _grouped(exploded, band).groupBy(*KEY, "copy").agg(F.max("note").alias("note"), *(F.first(c).alias(c) for c in ("copies", "doc_id", "prev")), *codes)
    got = common.written(got.select(*KEY, "copy", "copies", "doc_id", "prev", "note", *(subsets(F.col(f"c{s}")).alias(f"f{s}") for s in (1, 2))))
    after = got.where("copy = 1").select(*(F.col(f"prev.{k}").alias(k) for k in KEY), F.col("f1").alias("next"))
    after = got.join(after, list(KEY)).withColumn("after", F.when(F.col("copy") < F.col("copies"), F.col("f1")).otherwise(F.col("next")))
    note = F.split("note", ":")
    return after.select("doc_id", note[0].cast("long").alias("n_chars"), note[1].alias("edited_sha256"), F.concat_ws(":", "f1").alias("fingerprint"), F.concat_ws(":", "f2").alias("edited_fingerprint"), likeness(F.col("f1"), F.col("f2")).alias("near_edited"), likeness(F.col("f1"), F.col("after")).alias("near_next"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT doc_id, text, n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM d),
e AS (SELECT doc_id, n, text, nxt, substr(text, 1, n - n // 2) || substr(nxt, 1, n // 2) AS edited FROM x),
w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'))) AS term FROM d),
df AS (SELECT term, count(*) AS df FROM w GROUP BY term),
lex AS (SELECT term, ('0x' || substr(md5('0|' || term), 1, 15))::BIGINT AS code FROM df WHERE df >= 0.001 * (SELECT count(*) FROM d) AND df <= 0.25 * (SELECT count(*) FROM d)),
ew AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(translate(edited, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'))) AS term FROM e),
c AS (SELECT d.doc_id, 1 AS side, coalesce(list_sort(list(code) FILTER (code IS NOT NULL)), []::BIGINT[]) AS codes FROM d LEFT JOIN (SELECT doc_id, code FROM w JOIN lex USING (term)) USING (doc_id) GROUP BY d.doc_id
  UNION ALL SELECT d.doc_id, 2, coalesce(list_sort(list(code) FILTER (code IS NOT NULL)), []::BIGINT[]) FROM d LEFT JOIN (SELECT doc_id, code FROM ew JOIN lex USING (term)) USING (doc_id) GROUP BY d.doc_id),
s AS (SELECT doc_id, side, k, list_filter(codes, lambda v: (v >> (16 * (k // 16))) & [15, 127, 1023][k // 16 + 1] = k % 16) AS own FROM c, range(48) r(k)),
h AS (SELECT doc_id, side, list(CASE WHEN len(own) = 0 THEN '------' ELSE substr(md5(array_to_string(own, ',')), 1, 6) END ORDER BY k) AS f FROM s GROUP BY doc_id, side),
g AS (SELECT a.doc_id, a.f AS f1, b.f AS f2 FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.side = 1 AND b.side = 2),
o AS (SELECT *, coalesce(lead(f1) OVER (ORDER BY doc_id), first_value(f1) OVER (ORDER BY doc_id)) AS f3 FROM g),
l AS (SELECT doc_id, f1, f2, len(list_filter(range(1, 49), lambda i: f1[i] <> '------' OR f2[i] <> '------')) AS n2, len(list_filter(range(1, 49), lambda i: f1[i] <> '------' AND f1[i] = f2[i])) AS m2,
  len(list_filter(range(1, 49), lambda i: f1[i] <> '------' OR f3[i] <> '------')) AS n3, len(list_filter(range(1, 49), lambda i: f1[i] <> '------' AND f1[i] = f3[i])) AS m3 FROM o)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, array_to_string(f1, ':') AS fingerprint, array_to_string(f2, ':') AS edited_fingerprint,
  CASE WHEN n2 = 0 THEN 1.0::DOUBLE ELSE m2::DOUBLE / n2 END AS near_edited, CASE WHEN n3 = 0 THEN 1.0::DOUBLE ELSE m3::DOUBLE / n3 END AS near_next
FROM e JOIN l USING (doc_id)
"""
