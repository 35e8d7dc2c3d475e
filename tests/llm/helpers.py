"""Inputs that every operator has to take."""

from __future__ import annotations

EDGE = [
    (1, "Plain text, once."),
    (2, None),
    (3, ""),
    (None, "no id"),
    (4, "twice"),
    (4, "twice"),
    (5, " \n\t\n"),
    (6, "x" * 300_000),
    (7, "word " * 60_000),
    (8, "Ünïcödé ß 日本語 \U0001f600 <|endoftext|> a\0b\r\n"),
    (9, "tie"),
    (10, "tie"),
]
SCHEMA = "doc_id long, text string, n_tokens int, id string, text_hash string, `class` string, part int, chunk int, h1 string, row string, score string, `at` string, key string, `ids` string, `lang` string, source string, n_chars long"


def edge(spark, rows=EDGE):
    """The rows with further columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, 0, "i", "h", "c", 0, 0, "h", "r", "s", "a", "k", "x", "en", "src", len(t or "")) for i, t in rows], SCHEMA)


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)
