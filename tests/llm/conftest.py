import pytest

#: Texts that every operator must take: nulls, empty and long ones, ties, repeats, specials.
EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "Hello world  two  spaces\n\n x \t y ", "en", "a"),
    (3, "Hello world  two  spaces\n\n x \t y ", "en", "a"),
    (4, "a <|endoftext|> b  <|endoftext|>  c<|endoftext|>d", None, "b"),
    (5, "don't I'll 12 345 x9 — “quoted” naïve ÀÉ ẞ İ ᠎ ﻿ é  nb sp", "fr", "b"),
    (6, "漢字かな交じり文 \U0001f600 \x00 \x1c \x85", "xx", "b"),
    (None, "null id here", "de", "c"),
    (7, "word " * 9000, "en", "c"),
    (8, "z" * 5000, "en", "c"),
    (9, " ", "en", "c"),
]


@pytest.fixture()
def edge(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in EDGE], "doc_id long, text string, lang string, source string, n_bytes string, row int")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
