"""Small corpora that hold the edge cases every operator must survive."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "re on the st ea ing er an is or ly ed ti wh sh nt".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def corpus(seed=1, n=60):
    """Rows with nulls, empty, very long, repeated and near-copied texts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, prose(rng, rng.randint(1, 160)), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None])))
    rows += [(n, None, "en", "a"), (n + 1, "", None, None), (n + 2, " \n\t ", "en", "b"), (n + 3, prose(rng, 6000), "en", "a")]
    rows += [(n + 4 + k, rows[k][1], "en", "a") for k in range(10)]
    for k in range(10):
        words = rows[n + 3][1].split()[100 * k : 100 * k + 300]
        words[rng.randrange(len(words))] = "changed"
        rows.append((n + 20 + k, " ".join(words), "en", "c"))
    rows += [rows[3], rows[3], (None, rows[5][1], "en", "a"), (n + 40, "1.éü\U0001f600  x\x1fy", "en", "a")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts)


def clashing(df):
    """The same rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    for name in ("key", "h", "fp", "node", "root", "words", "grp", "length", "slot", "token", "part", "place", "count", "n", "rank", "votes", "score", "piece", "start"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df
