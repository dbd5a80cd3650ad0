"""A small table with what real ones hold: nulls, empty and long texts, copies, repeated rows, clashing column names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, mz string, side string, spans int, n int"


def texts(seed=0, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    say = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, out = say(60), []
    for i in range(n):
        kind = i % 6
        body = say(rnd.randint(20, 160))
        if kind == 1:
            body = body[: len(body) // 2] + " \n" + passage + "\t" + body[len(body) // 2 :]
        elif kind == 2 and out:
            body = rnd.choice(out)
        elif kind == 3 and out:
            got = rnd.choice(out).split(" ")
            got[rnd.randrange(len(got))] = say(1)
            body = " ".join(got)
        elif kind == 4:
            body = (say(3).upper() + "!! ") * 30
        out.append(body)
    return out + ["", " \n\t ", "one", "x" * 700, say(4), "ab " * 3000, "  　", "'s don't 'll!"]


def documents(spark, seed=0):
    found = texts(seed)
    rows = [(i, t) for i, t in enumerate(found)] + [(len(found), None), (3, found[3]), (len(found) + 1, found[3])]
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, f"src{i % 5}" if i % 7 else None, None, "k", 1, "m", "s", 2, 3) for i, t in rows], SCHEMA).repartition(3)


def with_null_id(spark, seed=0):
    docs = documents(spark, seed)
    return docs.unionByName(docs.where("doc_id in (5, 6)").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" tail"))))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
