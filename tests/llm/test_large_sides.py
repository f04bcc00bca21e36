"""Sides beyond their broadcast bound take a shuffled join and give the same rows."""

import pytest
from pyspark.sql import functions as F

from vexilar.llm import decontaminate, simhash, text, warc
from vexilar.session import scratch_path, table


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_large_test_sets_are_joined_by_shuffle(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    bench = table(spark, sf, "benchmark").select("item_id", "text").union(spark.createDataFrame([(900, "the and of"), (901, "the"), (None, "of the and to in a is on by for as it at")], "item_id bigint, text string"))
    few = decontaminate.contamination(docs, bench)
    assert few.where("n_items > 0").count() > 0
    for options in ({"broadcast_bytes": 0}, {"broadcast_prints": 500}, {"broadcast_bytes": 0, "broadcast_prints": 700}):
        assert rows(decontaminate.contamination(docs, bench, **options)) == rows(few)


def test_large_test_sets_shuffle_no_texts(spark, sf):
    docs, bench = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    found = decontaminate.contamination(docs, bench, broadcast_bytes=0)
    assert rows(found) == rows(decontaminate.contamination(docs, bench))
    plans = []
    keep = decontaminate.materialize
    decontaminate.materialize = lambda df, tag: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or keep(df, tag)
    try:
        decontaminate.contamination(docs, bench, broadcast_bytes=0)
    finally:
        decontaminate.materialize = keep
    passes = [p for tag, p in plans if tag == "seen_windows"]
    assert passes and all("Exchange hashpartitioning" not in p for p in passes)


def test_many_rows_to_drop_are_joined_by_shuffle(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    kept = rows(simhash.keep_one(docs).select("doc_id"))
    left = rows(decontaminate.remove_contaminated(docs, table(spark, sf, "benchmark")).select("doc_id"))
    monkeypatch.setattr(text, "BROADCAST_DROPS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_DROPS", 0)
    assert rows(simhash.keep_one(docs).select("doc_id")) == kept
    assert rows(decontaminate.remove_contaminated(docs, table(spark, sf, "benchmark")).select("doc_id")) == left


@pytest.fixture(scope="module")
def repeated_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    odd = [(None, "http://a/1", "same"), (None, "http://a/2", "same"), (5, "http://a/3", None), (5, "http://a/3", None), (9_999_999, "http://a/4", ""), (7, "http://b/1", "tied"), (7, "http://b/2", "tied"), (7, "http://b/2", "tied"), (8, None, "tied")]
    return pages.union(pages.select(F.col("page_id") + 10_000, "url", "html")).union(spark.createDataFrame(odd, "page_id bigint, url string, html string"))


def test_many_repeated_payloads_pass_filters(repeated_pages):
    plan = lambda **options: rows(warc.plan_records(repeated_pages, **options).select("page_id", "url", "digest", "shared", "revisit", "refers_to", F.sha1("payload")))
    assert plan(broadcast_rows=0) == plan() and plan(broadcast_rows=0, least=6) == plan(least=6)


def test_filters_that_let_all_pass_change_no_record(repeated_pages, monkeypatch):
    want = rows(warc.plan_records(repeated_pages).select("page_id", "url", "digest", "shared", "revisit", "refers_to", F.sha1("payload")))
    monkeypatch.setattr(warc, "_may_hold", lambda df, column, n: lambda digest: F.lit(True))
    assert rows(warc.plan_records(repeated_pages, broadcast_rows=0).select("page_id", "url", "digest", "shared", "revisit", "refers_to", F.sha1("payload"))) == want


def test_distinct_payloads_are_not_shuffled(spark, sf):
    pages = table(spark, sf, "pages").dropDuplicates(["html"]).select("page_id", "url", F.concat("html", F.col("page_id").cast("string")).alias("html"))
    pages.write.mode("overwrite").parquet(path := scratch_path(spark, "distinct_pages"))
    plan = warc.plan_records(spark.read.parquet(path), broadcast_rows=0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_revisits_are_settled_without_their_payload(repeated_pages, monkeypatch):
    plans, keep = [], warc.materialize
    monkeypatch.setattr(warc, "materialize", lambda df, tag: plans.append((tag, df.columns)) or keep(df, tag))
    found = warc.plan_records(repeated_pages, broadcast_rows=0)
    assert "page_decisions" in dict(plans) and all("payload" not in columns for _, columns in plans)
    assert found.where("payload is not null").count() < repeated_pages.count() / 2 + 10
