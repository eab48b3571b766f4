"""Small document tables for the tests of the dealt operators."""

import hashlib
import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in rows], SCHEMA).repartition(3)


def saved(spark, tmp_path, rows, **others):
    """A folder of tables as queries read them."""
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for name, df in others.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def corpus(seed=1, n=120, vocabulary=400):
    """Random word texts with exact copies, near copies, shared passages, blanks, nulls and long repetitive texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 8))) for _ in range(vocabulary)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(10, 70))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.choice([0, 1, 3, 8, 19, 20, 21, 60, 200]))]
        if r.random() < 0.4:
            at = r.randint(0, len(text))
            text[at:at] = r.choice(passages).split()
        joined = r.choice([" ", "  ", "\n", " \t"]).join(text)
        if rows and r.random() < 0.15:
            joined = r.choice(rows)[1]
        elif rows and r.random() < 0.15:
            other = (r.choice(rows)[1] or "x y z").split() or ["a"]
            other[r.randrange(len(other))] = "edited"
            joined = " ".join(other)
        rows.append((i * 3 - 20, joined))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "De " * 300), (1004, "De " * 40), (1005, "ab" * 400)]
    rows += [(None, "null id " * 30), (1006, "null id " * 30), (1007, "ünï\0cödé \U0001f600 " * 12), (1008, "x\0y" * 60)]
    rows += [rows[5], rows[5]]
    r.shuffle(rows)
    return rows
