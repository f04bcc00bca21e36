"""Costs of quality rules are measured on the sample."""

from pyspark.sql import functions as F

from vexilar.llm import quality
from vexilar.session import table

CHEAP, DEAR = quality.Rule("cheap", "n_words < 5"), quality.Rule("dear", "100 * n_repeat_words > 99 * n_words")


def test_measured_costs_order_rules(spark, sf):
    docs = table(spark, sf, "documents")
    found = {m.rule.name: m for m in quality.measure_rules(docs, (DEAR, CHEAP))}
    assert found["dear"].cost > found["cheap"].cost > 0
    texts = [(r["text"] or "").encode() for r in docs.select("text").collect()]
    assert found["cheap"].share == sum(len(t.split()) < 5 for t in texts) / len(texts)  # bytes: the six ASCII blanks
    every = quality.BASE_RULES + quality.METHOD_RULES
    assert sorted(r.name for r in quality.plan_cascade(docs, every, runs=quality.RUNS)) == sorted(r.name for r in every)


def test_costs_are_taken_from_the_runs(spark, sf, monkeypatch):
    docs, rules = table(spark, sf, "documents"), quality.BASE_RULES + quality.METHOD_RULES
    took = iter([(1.0, 0.1)] + [(1.0 + k, 0.1) for k in range(len(rules))])  # the first rule is within what runs differ by
    monkeypatch.setattr(quality, "_seconds", lambda build, runs: next(took))
    n = min(docs.count(), quality.TIMED_TEXTS)
    found = quality.measure_rules(docs, rules)
    counted = quality.measure_rules(docs, rules, runs=0)
    assert found[0] == counted[0] and [round(m.cost, 3) for m in found[1:]] == [round(1e9 * k / n, 3) for k in range(1, len(rules))]
    assert [m.share for m in found] == [m.share for m in counted]


def test_no_texts_have_no_worth(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    rules = quality.BASE_RULES + quality.METHOD_RULES
    assert all(m.share == 0 and m.cost > 0 for m in quality.measure_rules(empty, rules)) and quality.plan_cascade(empty, rules, runs=1) == list(rules)
    nulls = spark.range(3).select("id", F.lit(None).cast("string").alias("text"))
    assert quality.plan_cascade(nulls, rules, runs=1)[0].name == "few_words"
