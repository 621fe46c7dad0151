"""Rows that every operator has to bear: nulls, empties, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

LONG = "lorem ipsum dolor " * 20000


def documents(spark, extra=()):
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, "   \n\t ", None, "b", 6),
        (5, "   \n\t ", None, "b", 6),
        (6, LONG, "en", "b", len(LONG)),
        (None, "a row without an id but with some words in it", "en", "c", 45),
        (7, "ÀÉ ünïcode wörds \U0001f600 and 　 wide spaces", "de", "c", 10),
        (8, "one", "en", "c", 3),
        *extra,
    ]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return base.selectExpr(
        "*", "1 as h", "2 as t", "3 as th", "4 as fp", "5 as a", "6 as b", "7 as score", "8 as start", "9 as _block",
        "10 as component_id", "11 as sequence_id", "12 as shard", "13 as size", "14 as node", "15 as key", "16 as quality",
    )


def nothing(spark):
    return documents(spark).filter("doc_id = -1")


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
