"""Encoding equals the model's, samples are distinct, decode to their text and follow the lattice's distribution."""

import math
from collections import Counter

import pytest

from vexilar.llm import sentencepiece_ops as sp
from vexilar.session import table


@pytest.fixture(scope="module")
def codec():
    return sp.codec("piece_bpe_32k.model")


ODD = ["", " ", "  a", "a  b", "\n", "a\n\nb ", "\ta\tb", "日本 語 😀", "x" * 300, "a\r\nb", "<s> </s> <0x41>", "Hello, world! (it's) a test...", "a.b,c;d", "²., e.g. x², 3.5"]


def test_encoding_is_the_models(codec, spark, sf):
    for t in ODD + [r[0] for r in table(spark, sf, "documents").select("text").collect()]:
        ids = codec.encode(t)
        assert ids.tolist() == codec.sp.encode(t) and codec.decode(ids) == t


def test_documents_round_trip(spark, sf):
    docs = table(spark, sf, "documents")
    encoded = sp.encode_documents(docs)
    assert encoded.where("round_trip").count() == docs.count()
    back = sp.decode_documents(encoded).join(docs.select("doc_id", docs["text"].alias("t")), "doc_id")
    assert back.where("text = t").count() == docs.count()


def all_paths(codec, text):
    """Every segmentation of a text with its weight, by recursion over characters."""
    s = sp.BLANK + text.replace(" ", sp.BLANK)

    def walk(i):
        if i == len(s):
            return [((), 0.0)]
        out = []
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in codec.text_id:
                out += [((codec.text_id[s[i:j]], *rest), codec.text_weight[s[i:j]] + w) for rest, w in walk(j)]
        if s[i] not in codec.text_id:
            data = s[i].encode()
            out += [((*(codec.byte_id[b] for b in data), *rest), codec.byte_weight * len(data) + w) for rest, w in walk(i + 1)]
        return out

    paths = walk(0)
    z = math.log(sum(math.exp(w) for _, w in paths))
    return {ids: w - z for ids, w in paths}


def test_small_lattices_are_exhausted(codec):
    for text in ("then", "a b", "é", "日", "of the"):
        want = all_paths(codec, text)
        got = codec.sample(text, len(want) + 5, 3)
        assert {tuple(map(int, s.ids)) for s in got} == set(want)
        assert all(abs(s.logp - want[tuple(map(int, s.ids))]) < 1e-9 and s.inclusion == 1.0 for s in got)
        assert [s.perturbed for s in got] == sorted((s.perturbed for s in got), reverse=True)


def test_sampling_without_replacement_follows_the_distribution(codec):
    want = all_paths(codec, "then")
    first, second, n = Counter(), Counter(), 6000
    inclusion = Counter()
    for seed in range(n):
        a, b = codec.sample("then", 2, seed)
        first[tuple(a.ids)] += 1
        second[tuple(b.ids)] += 1
        for s in (a, b):
            inclusion[tuple(s.ids)] += 1 / s.inclusion  # an inverse-probability weight: 1 on average
    for ids, lp in want.items():
        p = math.exp(lp)
        q = sum(math.exp(o) * p / (1 - math.exp(o)) for other, o in want.items() if other != ids)
        assert abs(first[ids] / n - p) < 0.03 and abs(second[ids] / n - q) < 0.03
        if p > 0.05:
            assert abs(inclusion[ids] / n - 1) < 0.1


def test_samples_depend_on_the_row_alone(spark, sf):
    docs = table(spark, sf, "documents").limit(40)
    one = {r["doc_id"]: r["samples"] for r in sp.sample_documents(docs, 3).collect()}
    two = {r["doc_id"]: r["samples"] for r in sp.sample_documents(docs.orderBy("text"), 3).coalesce(1).collect()}
    both = {r["doc_id"]: r["samples"] for r in sp.encode_and_sample(docs, 3).collect()}
    assert one == two == both
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    c = sp.codec("piece_bpe_32k.model")
    import numpy as np

    for i, samples in one.items():
        assert len({tuple(s["ids"]) for s in samples}) == len(samples)
        assert all(c.decode(np.array(s["ids"], np.int32)) == texts[i] for s in samples)


def test_draws_do_not_depend_on_the_batch():
    words = [f"{a}{b}ion{n}" for n in range(40) for a in ("re", "con", "über", "x") for b in ("fract", "struct", "日", "ß")]
    import public_tokenizers

    alone, after = (sp.Codec(public_tokenizers.path("piece_bpe_32k.model")) for _ in range(2))
    after.numbers([f"{sp.BLANK}w{k}" for k in range(30_000)])
    text = " ".join(words)
    for c in (alone, after):
        c.mine = [c.arcs[c.first_arc[r] : c.first_arc[r + s]] for r, s in ((c.root[n], c.span[n]) for n in c.numbers(c.stretches(text)))]
    assert all((a == b).all() for a, b in zip(alone.mine, after.mine))
    many = [after.numbers(after.stretches(t)) for t in (text[:900], text, "", "a b")]
    batch = sp.search(after, many, 3, [5, 6, 7, 8])[1]
    assert [(s.ids.tolist(), s.logp, s.perturbed, s.inclusion) for s in batch] == [(s.ids.tolist(), s.logp, s.perturbed, s.inclusion) for s in alone.sample(text, 3, 6)]


def test_null_lists_decode_to_null(spark):
    rows = sp.decode_documents(spark.createDataFrame([(1, None), (2, []), (3, [262, 1000])], "doc_id bigint, ids array<int>")).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert got[1] is None and got[2] == "" and got[3] == sp.codec("piece_bpe_32k.model").decode([262, 1000])


def test_null_and_empty_texts(spark):
    rows = sp.encode_and_sample(spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id bigint, text string")).collect()
    got = {r["doc_id"]: (len(r["ids"]), len(r["samples"])) for r in rows}
    assert got[1] == got[2] == (0, 1) and got[None][0] > 0
