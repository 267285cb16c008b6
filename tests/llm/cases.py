"""Odd tables that every operator must stand."""

LONG = "lorem ipsum dolor sit amet consectetur " * 20000

#: id and text: nulls, empty and blank texts, repeated rows, one id with two texts, a very long text.
ODD = [
    (1, "one two three four five six"), (1, "one two three four five six"), (2, "ONE two three four five six"), (3, None), (4, ""), (5, " \t\n "),
    (None, "a null id here"), (None, None), (6, LONG), (7, "é ß 日本 😀 \u0000 x"), (8, "word"), (8, "other words"), (9, "nope"),
]
SCHEMA = "doc_id long, text string"

#: Columns whose names an operator may use itself.
CLASHING = ["id", "key", "node", "y", "n", "digest", "score", "spans", "size", "shard", "slot", "keep_id", "root", "label", "_id", "u", "v"]


def odd_docs(spark, rows=ODD):
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        docs = docs.selectExpr("*", f"'clash' AS `{c}`")
    return docs


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)
