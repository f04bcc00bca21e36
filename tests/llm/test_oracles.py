"""The queries with SQL give its rows, on the driver's tables and on a table of edge cases."""

import math
import random

import pytest
from compare import assert_same, duck

from vexilar.llm.oracle import oracle_sql
from vexilar.llm.queries import queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert_same(queries()[name](spark, sf), duck(sf), oracle_sql()[name])


LONG = " ".join(f"w{i % 97}" for i in range(5000))
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "under the MIT license under the mit license"), (4, "under the MIT license under the mit license"), (None, "Apache License, Version 2.0"),
    (5, "CC BY-NC 4.0; cc by nc"), (6, "a b c a b c a b c\na b c\na b c"), (7, LONG), (8, "É é ÀÉ under THE mit License é"), (9, "GNU General Public License version 3"), (10, "x"),
    (11, "# * $ % & | < > \n # * $"), (12, "one\n\none\n one\none"), (13, "alpha beta gamma delta " * 30), (14, "licensed under the gnu general public license"), (16, "GNU General Public License, of course"), (17, "Source and binary forms"), (18, "public domain"), (19, "x GNU general public license"),
    (15, "日本 語 words 日本 語 words 日本 語 words"),
    *[(30 + k, f"A line that {'five' if k < 5 else 'four'} documents hold, with many words\n  \t{'É' * 40} \r\nown {k} line of this document, which is long enough\n{'x' * 39}") for k in range(9)],
    (34, "A LINE THAT FIVE documents hold, with many words\f"), (None, "É" * 40), (None, "\n" + "É" * 40 + "\n"), (50, "É" * 40 + "\x00"), (51, "𝔘" * 40), (52, "𝔘" * 39),
    (60, ("separate seperate separated separat seprate " * 30) + "seperatte seperatte " + "Äpfelkuchen apfelkuchen " * 40 + "äpfelkuchen " * 2 + "aaaaaaaa aaaaaaa aaaaaaaaa abaaaaaa " * 3),
    (61, "separate " * 2500 + "×÷×÷×÷×÷ " * 3 + "z" * 3000 + " " + "z" * 3000 + " " + "z" * 2999 + " " + "z" * 2999),
]
BENCH = [(1, "alpha beta gamma delta alpha beta"), (2, LONG[:2000]), (3, None), (4, ""), (None, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (4, "x"), (5, "under the mit")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 9) for i, t in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint, _w string, _row bigint")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    page = lambda canonical: f'<html><head><link rel="canonical" href="{canonical}"><meta http-equiv="refresh" content="0;url=/en/2"></head></html>'
    pages = [
        (1, "http://a.example.org/es/1", "<p>"), (2, "http://b.net/x#f", page("http://a.example.org/es/1")), (3, "https://c.net/y", page("http://b.net/x")), (4, None, page("/z")), (5, "no address", None),
        (6, "http://D.COM/fr/1", page("http://a.example.org/es/1")), (7, "http://d.com/de/1", ""), (8, "http://org", "<p>"), (9, "http://c.net/en/2", None), (9, "http://c.net/en/2", None), (None, "ftp://example.org/en/12?q=/es/", "<p>"),
        (None, "ftp://e.org/a b\n", "only without ids"), (None, "ftp://e.org/a!b", "only without ids"), (20, "http://e.org/1", "tie"), (20, "http://e.org/1", "tie"), (20, None, "tie"), (21, "http://e.org/2", "tie"),
        (22, "http://e.org/3", "été 日本" * 5000), (23, "http://e.org/3", "été 日本" * 5000), (9, "http://e.org/9", "another page of the same id"),
    ]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    rng = random.Random(5)
    vectors = [(i, [rng.choice((-1.0, -0.3, 0.25, 0.9)) + rng.random() / 9 for _ in range(24)], i % 3 or None, 7, "x") for i in range(60)]
    vectors += [(3, vectors[3][1], 1, 7, "x"), (3, vectors[3][1], 1, 7, "x"), (100, None, 1, 7, "x"), (101, [0.1] * 23 + [None], 1, 7, "x"), (102, [0.1] * 23 + [math.nan], 1, 7, "x"), (103, [-math.inf] + [0.5] * 23, 2, 7, "x"), (None, [0.5] * 24, 2, 7, "x")]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int, _id int, code string").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_url_filter", "op7_warc", "op8_quality", "op9_decontaminate", "op11_spelling", "op12_vector_codes", "op13_line_dedup"])
def test_edge_cases_match_sql(spark, odd, name):
    con = duck("/nowhere", **{t: f"{odd}/{t}.parquet/*.parquet" for t in ("documents", "benchmark", "pages", "embeddings")})
    assert_same(queries()[name](spark, odd), con, oracle_sql()[name])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0
