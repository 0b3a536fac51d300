"""Small tables with the awkward cases that every operator has to take."""

import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "amber brook cedar delta ember fjord grove haven inlet jetty knoll ledge mesa north ochre prairie quarry ridge shoal tundra".split()


def documents(spark, rows, **extra):
    """rows: (doc_id, text) or whole rows; extra: constant columns, with names that operators may use themselves."""
    from pyspark.sql import functions as F

    full = [tuple(r) if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1]) if r[1] else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *[F.lit(v).alias(k) for k, v in extra.items()])


def prose(seed, n):
    """n words of an own vocabulary, reproducible."""
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward():
    long = prose("long", 60_000)
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, prose(4, 80)), (5, prose(4, 80)), (5, prose(4, 80)), (6, long), (None, prose(7, 50)),
        (None, None), (8, "one"), (9, "Ünïcode — 漢字 \x0b tab\tend"), (10, prose(10, 80)),
    ]


def frame(df):
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
