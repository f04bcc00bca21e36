"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A rule is a predicate over a text's metrics that rejects. ``plan_cascade`` estimates each rule's cost and the share it
rejects on a sample of rows and orders the rules by rejection per cost. That order becomes one CASE, in which the
metrics that only a rule needs are part of its branch: neither is worked out for a text that an earlier rule rejects.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexilar.llm.text import BLANKS, own_columns, with_row_key, with_words
from vexilar.session import materialize

# Fixed values of the contract.
SYMBOLS = r"[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"
#: A position takes so many low bits beside a shingle's hash; texts with more words take the slower exact path.
POSITION_BITS = 24


@dataclass(frozen=True)
class Rule:
    """rejects: SQL predicate over the metrics that is true for a text to drop; null counts as false."""

    name: str
    rejects: str


#: The contract's base rules and the method's own. Thresholds are shares of the text, so length doesn't matter.
BASE_RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
)
METHOD_RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines > 3 and 10 * n_dup_lines > 5 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("few_letters", "2 * n_letter_words < n_words"),
    Rule("bullets", "n_lines > 3 and 10 * n_bullet_lines > 9 * n_lines"),
)
#: Metrics that only rules of the method need: words with a letter, and lines that begin with a bullet.
OWN_METRICS = {
    "n_letter_words": r"regexp_count(_text, r'\p{L}[^\x20\x09-\x0D]*')",
    "n_bullet_lines": r"regexp_count(_text, r'(?:\A|\n)[\x20\x09]*[-*\u2022]')",
}
#: Runs of which a measured cost is the median, and texts that they take.
RUNS, TIMED_TEXTS = 3, 100
#: What a metric costs where it can't be measured, in nanoseconds: so much for each character, each word, and each word times the words' logarithm.
COSTS = {
    "n_words": (4, 0, 0), "word_chars": (4, 10, 0), "n_symbols": (10, 0, 0), "n_lines": (8, 0, 0), "n_dup_lines": (12, 0, 0),
    "n_repeat_words": (4, 60, 20), "n_letter_words": (25, 0, 0), "n_bullet_lines": (8, 0, 0),
}


def _packed(words: str, n: Column) -> Column:
    """Three-word windows as hash and position in one long, so that a primitive sort brings equal windows together."""
    keep = F.lit(-1 << POSITION_BITS).cast("bigint")
    one = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(keep).bitwiseOR(i.cast("bigint"))
    return F.transform(F.sequence(F.lit(0), n - 3), one)


def _union_of_threes(starts: Column) -> Column:
    """Words inside the three-word windows that begin at the sorted ``starts``."""
    add = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p + 3 - a["end"])).cast("bigint").alias("n"), (p + 3).alias("end"))
    return F.aggregate(starts, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")), add, lambda a: a["n"])


def _uses(rule: Rule, metric: str) -> bool:
    return re.search(rf"\b{metric}\b", rule.rejects) is not None


def _rejects(rule: Rule) -> Column:
    """The rule as a column over the contract's metrics and ``_text``; the method's own metrics stand in it as such."""
    sql = rule.rejects
    for name, metric in OWN_METRICS.items():
        sql = re.sub(rf"\b{name}\b", lambda _, m=metric: m, sql)
    return F.expr(f"coalesce({sql}, false)")


def _first(rules: list[tuple[int, Rule]]) -> Column:
    """The place of the first rule that rejects, else null: one CASE, which stops at that rule."""
    first = F.lit(None).cast("int")
    for k, rule in reversed(rules):
        first = F.when(_rejects(rule), k).otherwise(first)
    return first


def text_metrics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), ordered: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (all long), one row a row of ``docs``.

    ordered: rules to run as a cascade; adds rejected_by, the name of the first that rejects, else null. Rules about
    repeated words know them only at the end, so they can't spare the others; every other rule runs, with the metrics
    of its own, where none before it rejects.

    A null text has no words, lines or symbols. Repeated rows each get a row, ids may be null, other columns are
    ignored unless named in ``keep``, which needs names that differ from the metrics'. Only windows whose hash
    prefix occurs twice leave the row, and those are compared by a 64-bit hash of their words.
    """
    ranked = list(enumerate(ordered or []))
    early = [(k, r) for k, r in ranked if not _uses(r, "n_repeat_words")]
    late = [(k, r) for k, r in ranked if _uses(r, "n_repeat_words")]
    if any(_uses(r, m) for _, r in late for m in OWN_METRICS):
        raise ValueError("a rule about repeated words can't use the method's own metrics")
    own = with_row_key(own_columns(docs, _id=doc_id, _text=F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), **{f"_k_{c}": c for c in keep}))
    w = with_words(own, F.col("_text"), BLANKS, "_w")
    with_word = F.filter(F.split("_text", "\n"), lambda x: x.rlike(HAS_WORD))
    kept = [f"_k_{c}" for c in keep]
    m = w.select(
        "_row", "_id", *kept, "_w", "_text", F.size("_w").cast("bigint").alias("n_words"), F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), with_word.alias("_lines"),
    )
    n, longest = F.size("_w"), 1 << POSITION_BITS
    m = m.select(
        "_row", "_id", *kept, "_w", "_text", "n_words", "word_chars", "n_symbols", F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
    )
    m = m.select(
        "_row", "_id", *kept, "_w", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", _first(early).alias("_first"),
        F.when((n >= 4) & (n < longest), F.sort_array(_packed("_w", n))).otherwise(F.array().cast("array<bigint>")).alias("_s"),
    )
    prefix = lambda i: F.shiftright(F.get("_s", i), POSITION_BITS)
    j = F.col("_j")
    at = F.when(F.size("_s") > 0, F.sequence(F.lit(-1), F.size("_s") - 1)).when(n >= longest, F.sequence(F.lit(-1), n - 3)).otherwise(F.array(F.lit(-1)))
    rows = m.select("*", F.explode(at).alias("_j"))
    twice = F.coalesce(prefix(j) == prefix(j - 1), F.lit(False)) | F.coalesce(prefix(j) == prefix(j + 1), F.lit(False))
    rows = rows.where((j < 0) | (F.size("_s") == 0) | twice)
    pos = F.when(F.size("_s") == 0, j).otherwise(F.get("_s", j).bitwiseAND(F.lit(longest - 1).cast("bigint")).cast("int"))
    rows = rows.withColumn("_p", F.when(j >= 0, pos))
    window = F.struct(F.xxhash64(F.get("_w", F.col("_p")), F.get("_w", F.col("_p") + 1), F.get("_w", F.col("_p") + 2)).alias("h"), F.col("_p").alias("p"))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "_first")
    head = F.col("_p").isNull()
    rows = rows.select("_row", *[F.when(head, F.col(c)).alias(c) for c in ("_id", *kept, *names)], F.when(~head, window).alias("_t"))
    found = rows.groupBy("_row").agg(*[F.max(c).alias(c) for c in ("_id", *kept, *names)], F.sort_array(F.collect_list("_t")).alias("_t"))
    h = lambda i: F.get("_t", i)["h"]
    again = F.filter("_t", lambda x, i: F.coalesce(x["h"] == h(i - 1), F.lit(False)) | F.coalesce(x["h"] == h(i + 1), F.lit(False)))
    spots = F.sort_array(F.transform(again, lambda x: x["p"]))
    repeated = F.when(F.size("_t") > 0, _union_of_threes(spots)).otherwise(F.lit(0).cast("bigint"))
    found = found.select(F.col("_id").alias("doc_id"), *[F.col(f"_k_{c}").alias(c) for c in keep], *names, repeated.alias("n_repeat_words"))
    if ordered is None:
        return found.drop("_first")
    which = F.least(F.col("_first"), _first(late)) if late else F.col("_first")  # nulls don't count
    labels = F.array(*[F.lit(r.name) for r in ordered]) if ordered else F.array().cast("array<string>")
    return found.withColumn("rejected_by", F.get(labels, which)).drop("_first")


def _row_repeat_words() -> Column:
    """n_repeat_words from ``_w`` alone, for a cascade that evaluates it only where no cheaper rule has rejected."""
    n = F.size("_w")
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.slice("_w", i + 1, 3)).alias("h"), i.alias("p"))))
    again = F.transform(
        F.array(pairs),
        lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))),
    )
    return F.when(n >= 4, _union_of_threes(F.sort_array(F.transform(F.get(again, F.lit(0)), lambda x: x["p"])))).otherwise(F.lit(0).cast("bigint"))


def row_metrics() -> dict[str, Column]:
    """The metrics as expressions over ``_text`` and ``_w`` of one row."""
    with_word = F.filter(F.split("_text", "\n"), lambda x: x.rlike(HAS_WORD))
    return {
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint"),
        "n_lines": F.size(with_word).cast("bigint"),
        "n_dup_lines": (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("bigint"),
        "n_repeat_words": _row_repeat_words(),
    } | {name: F.expr(sql).cast("bigint") for name, sql in OWN_METRICS.items()}


def _words(docs: DataFrame, text: str) -> DataFrame:
    own = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    return with_words(own, F.col("_text"), BLANKS, "_w")


def _cost(rule: Rule, chars: Column, words: Column) -> Column:
    """A rule's estimated nanoseconds for a text: those of the metrics it uses, each of its steps counted as COSTS says."""
    per_char, per_word, per_sort = (sum(c[i] for m, c in COSTS.items() if _uses(rule, m)) for i in range(3))
    return chars * per_char + words * per_word + words * F.log2(words + 1) * per_sort + 100


def sample_of(docs: DataFrame, rows: int, text: str = "text", seed: int = 17) -> DataFrame:
    """About so many texts of all of ``docs`` (all of them if there are fewer), chosen at random in each partition, as a stored table.

    The number of texts is counted first, so no task gets more than a share of ``rows``, however large the input.
    """
    n = docs.count()
    own = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    some = own if n <= rows else own.sample(False, rows / n, seed)
    return materialize(some.repartition(4), "sample")


@dataclass(frozen=True)
class Measured:
    """What the sample says of a rule: the share of texts that it rejects alone, and nanoseconds a text."""

    rule: Rule
    share: float
    cost: float

    @property
    def worth(self) -> float:
        return self.share / self.cost


def _seconds(build: Callable[[], DataFrame], runs: int) -> tuple[float, float]:
    """(median, spread) of the time that an aggregate takes to run, each time planned beforehand; a first run, which compiles, doesn't count."""
    times = []
    for _ in range(runs + 1):
        df = build()
        df._jdf.queryExecution().executedPlan()
        began = time.perf_counter()
        df.collect()  # one row
        times.append(time.perf_counter() - began)
    return median(times[1:]), max(times[1:]) - min(times[1:])


def measure_rules(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = 2_000, runs: int = RUNS, timed_texts: int = TIMED_TEXTS) -> list[Measured]:
    """Each rule's selectivity and cost on a sample of about ``sample_rows`` rows of all of ``docs``.

    The sample is stored. A rule's cost is what counting its rejections takes on ``timed_texts`` of it, the median of
    ``runs`` runs, less what reading those and their words takes. Where that is no more than the runs differ
    by, which very cheap rules are, and with 0 runs, the cost is counted instead: characters and words of the sampled texts times what the
    metrics take for each (COSTS). An empty table has shares of 0.
    """
    stored = sample_of(docs, sample_rows, text)
    n = stored.count()
    sample = _words(stored, "text")
    chars, words = F.length("_text"), F.size("_w").cast("double")
    metrics = row_metrics()
    counted = sample.agg(*[F.coalesce(F.avg(_cost(r, chars, words)), F.lit(1.0)).alias(f"c{k}") for k, r in enumerate(rules)]).first()
    measured = sample.select("_text", *[m.alias(name) for name, m in metrics.items() if any(_uses(r, name) for r in rules)])
    shares = measured.agg(*[F.count_if(F.expr(f"coalesce({r.rejects}, false)")).alias(f"r{k}") for k, r in enumerate(rules)]).first() if n else None
    timed, m = bool(n and runs), min(n, timed_texts)
    many = _words(materialize(stored.limit(timed_texts).coalesce(1), "timed_texts"), "text") if timed else None
    base = _seconds(lambda: many.agg(F.sum(F.size("_w")), F.sum(F.length("_text"))), runs) if timed else (0.0, 0.0)
    out = []
    for k, rule in enumerate(rules):
        cost = counted[f"c{k}"]
        if timed:
            own = many.select(*[metrics[x].alias(x) for x in metrics if _uses(rule, x)])
            took, spread = _seconds(lambda own=own, rule=rule: own.agg(F.count_if(F.expr(f"coalesce({rule.rejects}, false)"))), runs)
            if took - base[0] > spread + base[1]:
                cost = 1e9 * (took - base[0]) / m
        out.append(Measured(rule, shares[f"r{k}"] / n if n else 0.0, cost))
    return out


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = 2_000, runs: int = 0) -> list[Rule]:
    """The rules by falling rejection per cost, both from a sample of all of ``docs``: see ``measure_rules``.

    With ``runs`` costs are measured, as production does; without, they are counted, and the same sample gives the same
    order on any machine. The order only says which rule names a rejected row and which metrics are spared, never which
    rows are rejected. Ties keep the given order; an empty table keeps it too.
    """
    found = measure_rules(docs, rules, text, sample_rows, runs)
    return [m.rule for m in sorted(found, key=lambda m: -m.worth)]


def quality_filter(docs: DataFrame, ordered: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns unchanged; later rules never run on rejected rows.

    A null text counts as an empty one; repeated rows stay repeated; columns may have any names, as they travel in one
    struct; an empty table gives no row, and no rules keep every row.
    """
    found = _words(docs, text)
    for rule in ordered:
        metrics = row_metrics()
        wanted = [metrics[m].alias(m) for m in metrics if _uses(rule, m)]
        found = found.select("_doc", "_text", "_w", *wanted).where(f"not coalesce({rule.rejects}, false)").select("_doc", "_text", "_w")
    return found.select("_doc.*")


def cascade(docs: DataFrame, ordered: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``text_metrics`` with rejected_by and kept (no rule rejects) from the rules in the given order."""
    return text_metrics(docs, doc_id, text, ordered=ordered).withColumn("kept", F.col("rejected_by").isNull())
