"""Preference formatting of chosen and rejected conversations, in DataFrame functions alone.

Input: a row for each turn, with pair_id, side ('chosen' or 'rejected'), turn, role and text. The
turns before the first turn number at which the two sides differ are their longest common prefix;
it is rendered once, as the prompt, and the rest of either side is a completion. In completions what
the assistant says, with its end mark, is to be learnt; everything else is masked.

Output: pair_id, section ('prompt', 'chosen' or 'rejected'), part, n_turns, rendered, learn. A
section comes in parts of `part_turns` turn numbers, so no task gathers a whole conversation; the
parts, joined in order, are the section, and a short conversation has one part of each. learn lists
the spans to learn as 'start-end' (code points in the part), joined by commas; a prompt has none.

Defined cases: turns are compared by number, role and text; several turns of one number are one turn
of several messages, in the order of role and text, and a message that is repeated counts as often
as it is; a null turn number comes first; a null role is 'user', a null text is empty; rows with a
null pair_id or another side are in no pair; a pair with one side only has that side's turns as its
completion; a section without turns has no row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_TURNS = 64
TAIL = "<|end|>\n"


def format_preferences(turns: DataFrame, part_turns: int = PART_TURNS, learn_role: str = "assistant") -> DataFrame:
    """See the module. turns: pair_id, side, turn, role, text; other columns are ignored."""
    said = turns.where("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')").select("pair_id", "side", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    count = lambda side: F.count_if(F.col("side") == side).alias(f"n_{side}")
    # Equal messages of both sides fold into one row before anything moves.
    messages = said.groupBy("pair_id", "turn", "role", "text").agg(count("chosen"), count("rejected"))
    splits = messages.groupBy("pair_id").agg(F.min(F.when(F.col("n_chosen") != F.col("n_rejected"), F.col("turn"))).alias("split"))
    placed = messages.join(splits, "pair_id")
    after = F.coalesce(F.col("turn") >= F.col("split"), F.lit(False))
    sections = F.when(~after, F.array(F.struct(F.lit("prompt").alias("section"), F.col("n_chosen").alias("n")))).otherwise(F.array(F.struct(F.lit("chosen").alias("section"), F.col("n_chosen").alias("n")), F.struct(F.lit("rejected").alias("section"), F.col("n_rejected").alias("n"))))
    rows = placed.withColumn("s", F.explode(sections)).where("s.n > 0").select("pair_id", "s.section", F.floor(F.col("turn") / part_turns).cast("long").alias("part"), "turn", "role", "text", F.col("s.n").alias("n"))
    parts = rows.groupBy("pair_id", "section", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "n"))).alias("m"))
    each = F.flatten(F.transform("m", lambda x: F.array_repeat(F.struct(x["turn"].alias("turn"), x["role"].alias("role"), F.concat(F.lit("<|"), x["role"], F.lit("|>\n")).alias("head"), F.concat(x["text"], F.lit(TAIL)).alias("body")), x["n"].cast("int"))))
    parts = parts.select("pair_id", "section", "part", each.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["role"] == learn_role, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    learn = F.when(F.col("section") == "prompt", F.lit("")).otherwise(F.concat_ws(",", F.aggregate("m", start, step)["spans"]))
    rendered = F.concat_ws("", F.transform("m", lambda x: F.concat(x["head"], x["body"])))
    return parts.select("pair_id", "section", "part", F.size(F.array_distinct(F.transform("m", lambda x: x["turn"]))).alias("n_turns"), rendered.alias("rendered"), learn.alias("learn"))


def pairs_of(conversations: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations: conversation c is chosen; rejected is c with its last turn's
    messages in place of which stand those of the last turn of conversation c XOR 1. No partner: no last turn."""
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", "text")
    last = own.groupBy("conv_id").agg(F.max("turn").alias("last"))
    marked = own.join(last, "conv_id")
    ends = marked.where("turn = last").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), "role", "text")
    swapped = ends.join(last, "conv_id").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("last").alias("turn"), "role", "text")
    sides = F.explode(F.when(F.col("turn") < F.col("last"), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen"))))
    return marked.select(F.col("conv_id").alias("pair_id"), sides.alias("side"), "turn", "role", "text").unionByName(swapped)


ORACLE = """
WITH own AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS last FROM own GROUP BY conv_id),
said AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM own
  UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM own JOIN last USING (conv_id) WHERE turn < last
  UNION ALL SELECT l.conv_id, 'rejected', l.last, o.role, o.text FROM last l JOIN last p ON p.conv_id = xor(l.conv_id, 1) JOIN own o ON o.conv_id = p.conv_id AND o.turn = p.last),
msg AS (SELECT pair_id, turn, role, text, count(*) FILTER (side = 'chosen') AS nc, count(*) FILTER (side = 'rejected') AS nr FROM said GROUP BY ALL),
split AS (SELECT pair_id, coalesce(min(turn) FILTER (nc <> nr), 9223372036854775807) AS split FROM msg GROUP BY pair_id),
sec AS (
  SELECT pair_id, 'prompt' AS section, turn, role, text, nc AS n FROM msg JOIN split USING (pair_id) WHERE turn < split
  UNION ALL SELECT pair_id, 'chosen', turn, role, text, nc FROM msg JOIN split USING (pair_id) WHERE turn >= split
  UNION ALL SELECT pair_id, 'rejected', turn, role, text, nr FROM msg JOIN split USING (pair_id) WHERE turn >= split),
rep AS (SELECT pair_id, section, floor(turn / 64.0)::BIGINT AS part, turn, role, text, unnest(range(n)) AS k FROM sec WHERE n > 0),
r AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM rep),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, section, part ORDER BY turn, role, text, k) AS e FROM r)
SELECT pair_id, section, part, count(DISTINCT turn)::INTEGER AS n_turns, string_agg(head || body, '' ORDER BY turn, role, text, k) AS rendered,
  coalesce(string_agg((e - length(body))::BIGINT || '-' || e::BIGINT, ',' ORDER BY turn, role, text, k) FILTER (role = 'assistant' AND section <> 'prompt'), '') AS learn
FROM o GROUP BY pair_id, section, part
"""
