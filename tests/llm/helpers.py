"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

import duckdb

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, kept string, tokens string"
LABELS = "doc_id long, quality int, toxic int"


def words(rng: random.Random, n: int, vocabulary: int = 40) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed: int = 5) -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, copies, repeated rows, and columns whose names the operators use."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 60)) for _ in range(40)]
    base += [None, "", " \t\n", "x", "é ü", "a b", "\n\n", "..", words(rng, 20_000, 5000), "z" * 70_000]
    base += [base[3], base[3].replace(" ", "\n"), base[3] + "  ", base[5].upper(), base[50 % len(base)]]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "S", None]), None, "r", "s", None, "t") for i, t in enumerate(base)]
    rows += [rows[7], rows[7], (None, base[9], "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [(rows[2][0], "another text under a used identifier", "en", "s1", 1, None, None, "k", None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCUMENTS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)


def by_sql(sql: str, **tables) -> list[tuple]:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cursor = con.execute(sql)
    return sorted_rows([d[0] for d in cursor.description], cursor.fetchall())


def by_spark(df) -> list[tuple]:
    return sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def sorted_rows(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)
