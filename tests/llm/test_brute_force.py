"""Operators without SQL against plain Python written from their contracts, on odd and real texts."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vexilar.llm import pii, quality, simhash, token_count, toxicity, url_filter, warc
from vexilar.llm.queries import queries
from vexilar.session import table

ODD = [None, "", " ", "\n\t", "a", "x" * 30_000, "word " * 3000, "é É ß 日本 語", "under the MIT license", "a@b.c", "😀 " * 50, "\x00\x1f", "<|endoftext|> a <|endoftext|>", "▁a"]


@pytest.fixture(scope="module")
def docs(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("texts")
    odd = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)] + [(10_001, "")], "doc_id bigint, text string")
    real = table(spark, sf, "documents").select("doc_id", "text")
    real.union(odd).withColumn("_id", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("lang", F.lit("en")).coalesce(2).write.parquet(f"{d}/documents.parquet")
    table(spark, sf, "labels").write.parquet(f"{d}/labels.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="module")
def texts(spark, docs):
    return [(r[0], r[1]) for r in table(spark, docs, "documents").select("doc_id", "text").collect()]


# ---- personal data ----

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_spans(text):
    digits = lambda s: re.sub(r"\D", "", s, flags=re.ASCII)
    rules = {
        "email": (EMAIL, lambda s: True), "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (CARD, lambda s: 16 <= len(digits(s)) <= 19 and plain_luhn(digits(s))), "phone": (PHONE, lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [(kind, m.start(), m.end()) for kind, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]


PIECES = ["a", "b.c", "@", "@x.y", ".", "1", "12", "255", "256", ".1", " ", "-", "+", "+1 ", "(", ")", "4111111111111111", "4111 1111 1111 1111", "é", "_", "%", "\n", "GB82 WEST 1234 5698 7654 32", "iban", "000.1.2.3", "5500-0055-5555-5559"]


def test_base_spans_match_plain_regular_expressions(texts):
    rng = random.Random(3)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for t in made + [t for _, t in texts if t and len(t) < 20_000]:
        assert [(s.kind, s.start, s.end) for s in pii.find_spans(t) if s.kind in pii.BASE_KINDS] == plain_spans(t), t[:200]


def test_pii_query_digests(spark, docs, texts):
    got = {(r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in queries()["op3_pii"](spark, docs).collect()}
    want = set()
    for i, t in texts:
        s = plain_spans(t or "") if len(t or "") < 25_000 else [(x.kind, x.start, x.end) for x in pii.find_spans(t) if x.kind in pii.BASE_KINDS]
        n = [sum(k == kind for k, *_ in s) for kind in pii.BASE_KINDS]
        want.add((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest(), *n))
    assert got == want


def test_checksums_and_redaction():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    assert [s.kind for s in pii.find_spans("pay to iban GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert pii.redact("mail a.b@c.de or +49 30 1234567!") == "mail [EMAIL] or [PHONE]!"
    assert pii.redact(None) is None and pii.redact("") == "" and pii.redact("clean") == "clean"


@pytest.mark.parametrize("code", ["AT611904300234573201", "ES91 2100 0418 4502 0005 1332", "GB82 WEST 1234 5698 7654 32"])
def test_ibans_end_before_what_follows(code):
    for before, after in (("", ""), ("", " EUR"), ("to ", " BIC"), ("", " SWIFT"), ("AB12 ", " DATE EUR."), ("", " GB82 WEST 1234 5698 7654 32")):
        text = before + code + after
        got = [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "iban"]
        assert got == [code] + (["GB82 WEST 1234 5698 7654 32"] if "GB" in after else [])
    assert not any(s.kind == "iban" for s in pii.find_spans(code[:-1] + ("4" if code[-1] != "4" else "5") + " EUR"))


def test_ibans_have_their_countrys_length():
    found = lambda t: [t[s.start : s.end] for s in pii.find_spans(t) if s.kind == "iban"]
    for code in ("ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for after in (" BANK", " EUR", " AB12", ".", " 1234", ""):
            assert found(f"to {code}{after}") == [code]
        assert found(f"to {code}7") == [] and found(code.replace("0", "1", 1)) == []
    small = "gb82west12345698765432"
    assert found(f"iban {small} please") == [small] and found(f"the code {small} please") == [] and found("GB82west12345698765432 iban") == []


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 70_000, "1 " * 100_000):
        pii.find_spans(t)


def test_redaction_keeps_rows_and_sets_length(spark, docs):
    rows = table(spark, docs, "documents").withColumn("n_chars", F.length("text").cast("bigint"))
    out = pii.redact_documents(rows)
    assert out.columns == rows.columns and out.count() == rows.count()
    assert out.where("not (n_chars <=> cast(length(text) as bigint))").count() == 0
    left = [t for (t,) in out.select("text").collect() if t and len(t) < 20_000 and plain_spans(t)]
    assert not left


# ---- token counts ----


def test_token_counts_match_library(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_count.vocabulary("byte_bpe_50k.json"))
    want = {(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in texts}
    got = queries()["op6_token_count"](spark, docs).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got} == want and len(got) == len(texts)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


PARTS = ["They", "'re", "'ve", "'ll", "'s", "'", " ", "  ", "\n", "\t", "\u00a0", "\x1c", "naïve", "日本", "語", "12345", "!!", " <|", "<|endoftext|>", "<|endo", "x", " é", "😀", "\r\n", "ß'r"]


def test_every_prefix_and_budget():
    from tokenizers import Tokenizer

    path = token_count.vocabulary("byte_bpe_50k.json")
    t, c = Tokenizer.from_file(path), token_count.counter(path)
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    rng = random.Random(4)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    for text in ["", "They've  been   here's 12345 naïve\n\n  x", "a<|endoftext|>b<|endo", "a  <|endoftext|> \n b", "supercalifragilistic" * 3, "   ", *made]:
        counts = [count(text[:n]) for n in range(len(text) + 1)]
        assert c.prefix_counts(text).tolist() == counts, text
        for budget in range(-1, max(counts) + 2):
            longest = max((n for n, k in enumerate(counts) if k <= budget), default=0)
            assert c.truncate(text, budget) == text[:longest]


def test_long_runs_are_truncated_in_a_second():
    import time

    c = token_count.counter(token_count.vocabulary("byte_bpe_50k.json"))
    for text in ("a" * 100_000, " " * 100_000, "日本" * 30_000, "ab1é-" * 20_000):
        began = time.process_time()
        counts = c.prefix_counts(text)
        cut = [c.truncate(text, b, counts) for b in range(0, 2000, 7)]
        assert time.process_time() - began < 1.5 and all(c.count(x) <= b for x, b in zip(cut[:20], range(0, 140, 7)))
    assert c.prefix_counts("x" * 3000)[-1] == c.count("x" * 3000)


def test_prefix_tables_answer_budgets(spark, docs, texts):
    c = token_count.counter(token_count.vocabulary("byte_bpe_50k.json"))
    tables = token_count.prefix_tables(table(spark, docs, "documents"))
    short = [(i, t) for i, t in texts if len(t or "") < 5_000]
    for budget in (-1, 0, 3, 100):
        got = Counter((r["doc_id"], r["chars"], r["tokens"]) for r in token_count.chars_within(tables, budget).collect())
        want = [(i, None, None) if budget < 0 else (i, len(cut := c.truncate(t, budget)), c.count(cut)) for i, t in short]
        assert not Counter(want) - got
    got = Counter((r["doc_id"], r["chars"], r["tokens"]) for r in token_count.tokens_within(tables, 77).collect())
    assert got == Counter((i, len((t or "")[:77]), c.count((t or "")[:77])) for i, t in texts)


# ---- SimHash ----


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(points):
    """Least id of each component of (id, fingerprint) rows at two bits, by comparing all pairs."""
    root = {f: f for _, f in points}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    prints = sorted(root)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in points:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f, least.get(find(f))) for i, f in points]


def test_simhash_query(spark, docs, texts):
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries()["op10_simhash"](spark, docs).collect())
    want = sorted((i, f"{f:016x}", c) for i, f, c in plain_components([(i, plain_fingerprint(t)) for i, t in texts]))
    assert got == want


def test_dense_groups_keep_all_links(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(400):
        f = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randint(1, 3)):
            f ^= 1 << b
        prints.add(f)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp bigint")
    from vexilar.operators.components import connected_components

    for group in (4, 64, 10_000):  # nearly all by one-bit neighbours; the default; all by pivots
        found = connected_components(simhash.links(df, pair_group=group))
        parts = {}
        for r in found.collect():
            parts.setdefault(r["component"], set()).add(r["node"])
        want = {}
        for i, _, c in plain_components([(signed(f), f) for f in prints]):
            want.setdefault(c, set()).add(i)
        assert sorted(map(sorted, parts.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_ids_of_any_type_and_components_without_ids(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4
    rows = spark.createDataFrame([("b", long), ("a", long), ("a", long), (None, long), (None, "other words here"), (None, "other words here"), ("c", "third text of its own")], "doc_id string, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()}
    assert got == {("b", "a"), ("a", "a"), (None, "a"), (None, None), ("c", "c")}
    assert sorted((str(r[0]), r[1][:5]) for r in simhash.keep_one(rows).collect()) == [("None", "other"), ("a", "alpha"), ("c", "third")]


def test_keep_one(spark, docs):
    rows = table(spark, docs, "documents")
    extra = spark.createDataFrame([(None, "only here " * 9), (None, "only here " * 9), (None, "a"), (20_000, "said twice " * 9), (20_000, "said twice " * 9)], "doc_id bigint, text string")
    both = rows.unionByName(extra, allowMissingColumns=True)
    kept = simhash.keep_one(both)
    classes = simhash.near_duplicates(rows).collect()
    want = sorted({r["component_id"] for r in classes})
    got = [r[0] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in got if i is not None and i < 20_000) == want and got.count(20_000) == 1 and got.count(None) == 1
    assert kept.columns == both.columns


# ---- toxicity ----


def test_a_long_row_does_not_end_the_sample(spark, monkeypatch):
    ids = spark.range(60).where("crc32(cast(id as string)) % 4 <> 2").orderBy(F.xxhash64("id", F.lit(11)))
    order = [r["id"] for r in ids.collect()]
    long = {order[0], order[7]}
    docs = spark.createDataFrame([(i, "word " * (2000 if i in long else 5), "en") for i in range(60)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, s, f=toxicity.train: (seen.append(y.tolist()), f(texts, y, s))[1])
    toxicity.fit(docs, labels, words=1000)
    used = [i for i in order if i not in long]
    assert seen == [[i % 2 for k, i in enumerate(used) if k % 5]]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    s = toxicity.Settings(buckets=23, width=3, filters=4)
    m = toxicity.Model(s)
    m.p = {n: np.asarray(v, np.float64) + (rng.normal(0.2, 0.1, np.shape(v)) if n[0] == "b" else 0) for n, v in m.p.items()}  # off the kink at 0
    ids, starts, stops = toxicity._layout([rng.integers(0, 23, (n, s.parts)).astype(np.int32) for n in (1, 7, 4, 0)], max(s.widths) - 1)
    y = np.array([1.0, 0.0, 1.0, 0.0])
    loss, grads, words, ge = toxicity.gradients(m, ids, starts, stops, y)
    full = np.zeros_like(m.p["e"])
    full[words] = ge
    grads = grads | {"e": full}
    for name, value in m.p.items():
        at = [()] if np.ndim(value) == 0 else [tuple(i) for i in np.argwhere(np.ones(value.shape))]
        for i in at:
            if name == "e" and i[0] == 0:
                continue
            both = []
            for step in (1e-6, -1e-6):
                m.p[name] = value.copy() if np.ndim(value) else value + step
                if np.ndim(value):
                    m.p[name][i] += step
                both.append(toxicity.gradients(m, ids, starts, stops, y)[0])
            m.p[name] = value
            assert (both[0] - both[1]) / 2e-6 == pytest.approx(float(np.asarray(grads[name])[i]), abs=1e-6), (name, i)


def test_scores_are_those_of_a_plain_forward_pass(spark, docs, texts):
    model = toxicity.fit(table(spark, docs, "documents"), table(spark, docs, "labels"))
    p, s = model.p, model.s

    def plain(text):
        rows = [toxicity.word_rows(w, s) for w in toxicity.WORD.findall((text or "").lower())]
        x = [p["e"][r].astype(float).mean(axis=0) for r in rows] or [np.zeros(s.width)]
        z = float(p["c"])
        pooled = []
        for k in s.widths:
            own = [np.concatenate([x[i + j] if i + j < len(x) else np.zeros(s.width) for j in range(k)]) @ p[f"w{k}"] for i in range(len(x))]
            pooled.append(np.maximum(np.max(own, axis=0) + p[f"b{k}"], 0))
        z += float(np.concatenate(pooled) @ p["v"])
        return 1 / (1 + np.exp(-(model.scale * z + model.shift)))

    got = Counter((r["doc_id"], round(r["score"], 4)) for r in toxicity.score_documents(table(spark, docs, "documents"), model).collect())
    short = [(i, t) for i, t in texts if len(t or "") < 3_000]
    assert all(min(abs(plain(t) - score) for j, score in got if j == i) < 1e-3 for i, t in short)
    assert all(0 <= score <= 1 for _, score in got)


def test_repeated_ids_count_once_and_languages_have_thresholds(spark):
    docs = spark.createDataFrame([(i % 40, f"word{i % 40} text", "en") for i in range(4000)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    assert toxicity.training_rows(docs, labels, toxicity.Settings()).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
    model = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).distinct().collect()}
    some = docs.limit(40).withColumn("lang", F.when(F.col("doc_id") < 20, "en").when(F.col("doc_id") < 30, "de").otherwise(F.lit(None)))
    model.thresholds = {"en": 2.0, "de": 0.0}
    left = {r[0] for r in toxicity.reject_toxic(some, model).select("doc_id").collect()}
    ids = {r[0] for r in some.select("doc_id").collect()}
    assert left == {i for i in ids if i < 20 or i >= 30 and scores[i] < toxicity.CUT}
    assert toxicity.reject_toxic(some.drop("lang"), model).columns == ["doc_id", "text"]


# ---- quality ----


def plain_metrics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(threes)
    again = [i for i, t in enumerate(threes) if counts[t] > 1]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for i in again for k in range(3)}), "n_letter_words": sum(any(c.isalpha() for c in w) for w in words),
        "n_bullet_lines": sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in text.split("\n")),
    }


def test_cascade_names_the_first_rule_of_its_order(spark, docs):
    odd = spark.createDataFrame([(20_000, "1 2 3 4 " * 20), (20_001, "- a b\n* c d\n- e f\n  • g h\n- i j"), (20_002, "#*$ # # #"), (20_003, "abcdefghijklmnopqrstuvwxyz " * 3), (20_003, None)], "doc_id bigint, text string")
    rows = table(spark, docs, "documents").select("doc_id", "text").union(odd)
    rules = quality.BASE_RULES + quality.METHOD_RULES
    texts = [(r[0], r[1]) for r in rows.collect()]
    fails = {t: {r.name for r in rules if eval(r.rejects, {}, plain_metrics(t))} for _, t in texts}
    orders = [rules, rules[::-1], tuple(quality.plan_cascade(rows, rules))]
    for order in orders:
        got = Counter((r["doc_id"], r["rejected_by"], r["kept"]) for r in quality.cascade(rows, list(order)).collect())
        first = [next((r.name for r in order if r.name in fails[t]), None) for _, t in texts]
        assert got == Counter((i, f, f is None) for (i, _), f in zip(texts, first))
    assert {r.name for _, t in texts for r in rules if r.name in fails[t]} == {r.name for r in rules}
    left = quality.quality_filter(rows, list(orders[2]))
    assert sorted(r[0] for r in left.select("doc_id").collect()) == sorted(i for i, t in texts if not fails[t])


def test_cascade_order_is_that_of_a_bounded_sample(spark, docs):
    rules = quality.BASE_RULES + quality.METHOD_RULES
    rows = table(spark, docs, "documents").repartition(13)
    assert quality.plan_cascade(rows, rules) == quality.plan_cascade(rows, rules)
    many = spark.range(0, 50_000, 1, 40).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    assert 1500 < quality.sample_of(many, 2_000).count() < 2500
    assert quality.plan_cascade(rows.where("false"), rules) == list(rules)


# ---- URL filter ----


def test_entities_in_links(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/es/?a=1&b=2", None), (2, "http://b.net/", '<link rel="canonical" href="http://a.example.org/es/?a=1&amp;b=2">'), (3, None, None)], "page_id bigint, url string, html string")
    assert {(r["page_id"], r["verdict"], r["inherited"]) for r in url_filter.judge_urls(pages).collect()} == {(1, "block", False), (2, "block", True), (3, "allow", False)}


def test_relative_repeated_and_mixed_case_links(spark):
    from urllib.parse import urldefrag, urljoin

    base = "http://Shop.net/a/b/page?x=1"
    targets = ["next.html", "../up", "../../../top", "?p=2", "./", "..", "a/../b?q=/../", "/r/./s", "//Other.net/Q", "HTTP://Far.net/Q#f", "#here", "sub/x#y"]
    rows = spark.createDataFrame([(base, t) for t in targets], "u string, t string")
    for r in rows.select("t", url_filter.node_of(url_filter.resolved(F.col("u"), F.col("t"))).alias("n")).collect():
        want = urldefrag(urljoin(base, r["t"])).url
        head, rest = want.split("://")[0], want.split("://")[1]
        host, slash, tail = rest.partition("/")
        assert r["n"] == f"{head.lower()}://{host.lower()}{slash}{tail}", r["t"]
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (1, "http://Example.org/es/1", None), (2, "http://one.net/a/x", link("http://two.net/") + link("http://example.ORG/es/1")), (3, "http://one.net/a/y", link("x")),
        (4, "http://one.net/z", '<meta http-equiv="refresh" content="0;url=http://two.net/q"><meta http-equiv="refresh" content="0;url=a/y">'), (5, "http://one.net/free", ""), (6, "http://ONE.net/a/y#k", ""),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block"}


# ---- WARC ----


def test_index_lookups_read_records_back(spark, sf, tmp_path):
    pages = table(spark, sf, "pages")
    again = pages.select((F.col("page_id") + 5000).alias("page_id"), "url", "html").where("page_id % 3 = 0").union(spark.createDataFrame([(9999, None, None), (None, "http://x.y/z z", "p")], "page_id bigint, url string, html string"))
    every = pages.select("page_id", "url", "html").union(again)
    root = str(tmp_path)
    lines = warc.write_archives(every, root, archive_bytes=100_000)
    directory = warc.build_index(lines, root, block_lines=7)
    index = warc.CaptureIndex.load(root, directory)
    rows = {r["page_id"]: r for r in every.select("*", warc.url_key(F.col("url")).alias("k")).collect()}
    for k in {r["k"] for r in rows.values()}:
        found = index.find(k)
        assert {f["page_id"] for f in found} == {i for i, r in rows.items() if r["k"] == k}
        for f in found:
            record = index.fetch(f)
            payload = (rows[f["page_id"]]["html"] or "").encode()
            assert record.payload == (payload if f["record_type"] == "response" else b"") and warc.digest_of(payload) == f["digest"]
    assert index.find("nowhere)/") == []
    assert warc.read_archives(root, directory).count() == every.count()


def test_only_payloads_of_the_least_size_are_revisited(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://a.b/", "same"), (2, "http://a.b/", "same"), (1, "http://c.d/", "x"), (5, "http://c.d/", "x")], "page_id bigint, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(spark, pages, str(tmp_path), least=2).collect()}
    assert got == {(3, "revisit", 2), (2, "response", None), (1, "response", None), (5, "response", None)}


def test_records_have_ids_of_their_own_and_lost_archives_go(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/", "same"), (1, "http://a.b/", "same"), (1, "http://a.b/", "other"), (2, "http://c.d/ x!", "same"), (None, None, None), (None, None, None)], "page_id bigint, url string, html string")
    root = str(tmp_path)
    for left in (".now-0.warc.gz.open", "now-f00.warc.gz", "before-f00.warc.gz"):
        (tmp_path / left).write_bytes(b"left by a lost task, or of another run")
    lines = warc.write_archives(pages, root, run="now")
    assert {p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")} == {r["file"] for r in lines.collect()} | {"before-f00.warc.gz"}
    index = warc.CaptureIndex.load(root, warc.build_index(lines, root, 2))
    records = [index.fetch(r.asDict()) for r in lines.collect()]
    ids = [r.headers["WARC-Record-ID"] for r in records]
    assert len(set(ids)) == 6 and sum(r.headers["WARC-Type"] == "response" for r in records) == 3
    referred = {r.headers["WARC-Refers-To"] for r in records if r.headers["WARC-Type"] == "revisit"}
    assert referred == {r.headers["WARC-Record-ID"] for r in records if r.headers["WARC-Type"] == "response" and r.payload != b"other"}


# ---- toxicity ----


def test_classifier_separates_held_out_rows(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(1200):
        w = rng.choices(words, k=rng.randint(5, 60))
        toxic = i % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), "vilest" + rng.choice(["", "ly", "ness"]))
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    out = toxicity.score_documents(df, model).join(df.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    changed = toxicity.score_documents(df.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1), model)
    assert {r["doc_id"] - 1: r["score"] for r in changed.collect()} == {r["doc_id"]: r["score"] for r in out}


def test_long_texts_score_as_their_runs(monkeypatch):
    s = toxicity.Settings(buckets=512)
    m = toxicity.Model(s)
    words = toxicity.Words(s)
    t = [words.of("alpha beta gamma " * 500), words.of("")]
    table_ = words.table()
    whole = toxicity.score_texts(m, [table_[i] for i in t])
    monkeypatch.setattr(toxicity, "RUN", 64)
    assert np.allclose(whole, toxicity.score_texts(m, [table_[i] for i in t]))


# ---- pipeline ----


def test_pipeline_stages_take_effect(spark, docs):
    import corpus_pipeline

    rows = table(spark, docs, "documents").select("doc_id", "text", "lang").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint"))
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "sentencepiece"]
    kept = stages["toxicity"](spark, rows, docs)
    model = toxicity.fit(rows, table(spark, docs, "labels"))
    clean = sorted(r["doc_id"] for r in toxicity.score_documents(rows, model).where("not flagged").collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == clean and kept.columns == rows.columns
    one = stages["near_duplicates"](spark, rows, docs)
    assert sorted(r[0] for r in one.select("doc_id").collect()) == sorted({c for *_, c in plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in rows.collect()])})
    left = stages["decontamination"](spark, rows, docs)
    bad = {r["doc_id"] for r in queries()["op9_decontaminate"](spark, docs).where("contaminated").collect()}
    assert bad and sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in rows.collect() if r["doc_id"] not in bad)
    last = stages["sentencepiece"](spark, rows, docs)
    assert last.where("not round_trip").select("doc_id").distinct().count() == 1  # the text that holds the blank mark itself
    assert corpus_pipeline.run(spark, docs).count() > 0


def test_pipeline_on_empty_tables_and_clashing_names(spark, docs, tmp_path):
    import corpus_pipeline

    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, docs, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(1, None, "en"), (1, None, "en"), (None, "", None), (2, "x " * 40_000, "en")], "doc_id bigint, text string, lang string")
    clash = ["_id", "_key", "_text", "_row", "_seed", "fp", "spans", "score", "component_id", "ids", "items", "_t", "_w", "_h"]
    odd = odd.select("*", F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"), *[F.lit(7).alias(c) for c in clash])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, docs)
        if name != "sentencepiece":
            assert out.columns == odd.columns
        got = sorted(str(r["doc_id"]) for r in out.collect())
        assert got == (["1", "2"] if name == "near_duplicates" else ["1", "1", "2", "None"]), name


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """Beyond what the driver takes, rows of all shards move the model: words of single rows are known afterwards."""
    monkeypatch.setattr(toxicity, "LOCAL_ROWS", 100)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)
    draw = random.Random(3)
    common = [f"plain{k}" for k in range(200)]
    rows = [(i, " ".join(draw.choices(common, k=12) + ([f"foul{i % 7}"] if i % 3 == 0 else [])), "en" if i % 2 else "de", int(i % 3 == 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda *a: pytest.fail("the driver has learned by itself"))
    s = toxicity.Settings(buckets=4096, epochs=12, rate=0.03, least_steps=1)
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), s)
    got = toxicity.score_documents(df, model).join(df.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)
    scored = spark.createDataFrame([(f"l{k % 2}", int(draw.random() < k % 97 / 97), round(k % 97 / 97, 2)) for k in range(500)], "lang string, toxic int, score double")
    local = scored.toPandas()
    for r in toxicity._best_ranges(scored, ["lang"]):
        own = local[local.lang == r["lang"]]
        assert (r["below"], r["most"]) == toxicity.best_range(own.score.to_numpy(), own.toxic.to_numpy())
    r = toxicity._best_ranges(scored, [])[0]
    assert (r["below"], r["most"]) == toxicity.best_range(local.score.to_numpy(), local.toxic.to_numpy())


def test_only_repeated_ids_shuffle_their_texts(spark, monkeypatch):
    """Of an id with several texts the least is learned from; texts of other ids stay where they are."""
    rows = [(i, f"{k} word{i} " * 40) for i in range(200) for k in ((1, 0) if i % 50 == 0 else (0,))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    found = toxicity.training_rows(docs, labels, toxicity.Settings())
    s = toxicity.Settings()
    want = {i: b"".join(np.array(toxicity.word_rows(w, s), np.uint16).tobytes() for w in f"0 word{i} ".split() * 40) for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert {r["_id"]: bytes(r["ids"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    lone = toxicity.training_rows(docs.where("text like '0%'"), labels, s)
    assert "hashpartitioning(_id" in plan and "hashpartitioning(_id" not in lone._jdf.queryExecution().executedPlan().toString()


def test_words_of_many_texts_are_those_of_each():
    texts = ["One two two, one", None, "", "three one éa_b", "aaaaaaaaa aaaaaaaab"]
    one, many = toxicity.Words(toxicity.Settings()), toxicity.Words(toxicity.Settings())
    each, every = [one.of(t) for t in texts], many.of_all(texts)
    assert len(each) == len(every) and all((one.table()[a] == many.table()[b]).all() for a, b in zip(each, every, strict=True))
    assert many.of_all([]) == [] or sum(map(len, many.of_all([]))) == 0


def test_rounds_of_training_leave_no_shuffle_files(spark, monkeypatch):
    """Disk doesn't grow with the rounds: what a round shuffles goes when it ends."""
    monkeypatch.setattr(toxicity, "LOCAL_ROWS", 100)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(os.path.getsize(f) for d in disk.localDirsString() for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True))
    rows = [(i, f"word{i % 90} plain", "en", i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int")
    seen, keep = [], toxicity._mean_state
    monkeypatch.setattr(toxicity, "_mean_state", lambda *a: seen.append(held()) or keep(*a))
    toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), toxicity.Settings(buckets=1 << 14, epochs=6, least_steps=1))
    assert len(seen) == 6 and seen[-1] - seen[0] < 2_000_000  # a round shuffles some 7 MB
