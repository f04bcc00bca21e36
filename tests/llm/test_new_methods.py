"""Spelling variants, vector codes and shared lines: their parts against plain versions, and their other ways."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexilar.llm import line_dedup, spelling, vector_codes
from vexilar.session import table


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


# ---- spelling ----


def plain_neighbourhood(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + x + word[i + 1 :] for i in range(len(word)) for x in letters if x != word[i]}
    return out | {word[:i] + x + word[i:] for i in range(len(word) + 1) for x in letters}


@pytest.mark.parametrize("letters", ["ab", "abcé", "x", "aß😀"])
def test_neighbourhoods_are_whole_and_distinct(letters):
    rng = random.Random(len(letters))
    words = ["", "a", "aa", "abab", "bbaaabb"] + ["".join(rng.choice(letters + "z") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    found = defaultdict(list)
    for k, x in spelling.neighbours(words, letters):
        found[k].append(x)
    for k, w in enumerate(words):
        assert len(found[k]) == len(set(found[k])) and set(found[k]) == plain_neighbourhood(w, letters)


def test_filter_loses_no_word():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(5, 9))) for _ in range(4000)})
    values = spelling.word_values(words)
    depth = spelling.WordFilter.depth_for(len(words))
    cells = np.zeros(1 << depth, np.uint64)
    cell, bit = spelling.WordFilter.places(values, depth)
    np.bitwise_or.at(cells, cell, (np.uint64(1) << bit) | spelling.WordFilter.more_bits(values))
    known = spelling.WordFilter(cells)
    assert len(known.holds(values)) == len(words)
    other = spelling.word_values([w + "zz" for w in words])
    assert len(known.holds(other)) < 0.02 * len(words)
    have = set(words)
    got = {(words[k], x) for k, x in spelling.neighbours(words[:300], "abcde", known) if x in have}
    assert got == {(w, x) for w in words[:300] for x in plain_neighbourhood(w, "abcde") if x in have}


def plain_words(docs, misprint=31):
    import re

    seen = Counter()
    for i, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % misprint == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def test_words_are_those_of_the_texts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    got = {r["word"]: r["n"] for r in spelling.observed_words(docs).collect()}
    assert got == plain_words([tuple(r) for r in docs.collect()])


def test_chains_lead_to_their_root(spark):
    chain = [("aaaaaaaa", 2), ("aaaaaaab", 30), ("aaaaaabb", 400), ("aaaaabbb", 5000), ("aaaabbbb", 60_000), ("aaabbbbb", 700_000), ("zzzzzzzz", 9), ("zzzzzzzy", 80)]
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(chain, "word string, n bigint")).collect()}
    assert all(got[w]["root"] == "aaabbbbb" for w, _ in chain[:6]) and got["aaaaaaaa"]["form"] == "aaaaaaab" and got["aaaaaaaa"]["form_n"] == 30
    assert got["zzzzzzzz"]["form"] is None and got["zzzzzzzz"]["root"] == "zzzzzzzz" and got["zzzzzzzz"]["n_near"] == 1


def test_a_full_filter_changes_no_pair(spark, monkeypatch):
    rng = random.Random(9)
    words = spark.createDataFrame([("".join(rng.choice("abcd") for _ in range(rng.randint(3, 6))), 1) for _ in range(3000)], "word string, n bigint").dropDuplicates(["word"])
    want = rows(spelling.near_words(words))
    assert want
    monkeypatch.setattr(spelling, "MOST_CELLS", 4)
    monkeypatch.setattr(spelling.WordFilter, "depth_for", staticmethod(lambda n: 6))
    assert rows(spelling.near_words(words)) == want


# ---- vector codes ----


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 13])
def test_bounds_lose_no_nearest_entry(width):
    rng = np.random.default_rng(width)
    for spread in (3, 50, 5000, 2**24):
        book = rng.integers(-spread, spread, (16, width))
        book[7] = book[3]  # ties fall to the lower entry
        x = np.vstack([rng.integers(-spread, spread, (300, width)), book, book + 1, np.zeros((2, width), np.int64)])
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        entry, exact, compared = vector_codes.nearest_entries(x, book)
        assert (entry == d.argmin(axis=1)).all() and (exact == d.min(axis=1)).all() and compared <= 17 * len(x)


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(1)
    book = rng.normal(0, 900, (16, 8)).astype(np.int64)
    x = book[rng.integers(0, 16, 4000)] + rng.normal(0, 60, (4000, 8)).astype(np.int64)
    assert vector_codes.nearest_entries(x, book)[2] < 0.3 * 16 * len(x)


def test_few_short_and_empty_vectors(spark):
    frame = lambda data: spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label string")
    few = {r["vec_id"]: r for r in vector_codes.compress(frame([(5, [1.0] * 8, "a"), (6, [2.0] * 8, "b")])).collect()}
    assert few[5]["code"] == "00" * 8 and few[6]["code"] == "01" * 8 and few[5]["error"] == 0
    mixed = vector_codes.compress(frame([(1, [1.0] * 3, None), (2, [1.0] * 11, None), (3, [], None)])).collect()
    assert len(mixed) == 3 and all(r["error"] == 0 for r in mixed) and len({r["code"] for r in mixed}) == 3
    nothing = vector_codes.compress(frame([(1, [], None)])).collect()
    assert [(r["code"], r["error"]) for r in nothing] == [("00" * 8, 0)]
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(frame([(1, [1e30] * 8, None)])).collect()


def test_many_labels_and_decoding(spark, sf):
    df = table(spark, sf, "embeddings")
    assert rows(vector_codes.compress(df, broadcast_labels=0)) == rows(vector_codes.compress(df))
    vectors = vector_codes.kept_vectors(df)
    books = vector_codes.train_books(vectors)
    decoded = vector_codes.decode(vector_codes.encode(vectors, books), books)
    whole = F.expr("transform(embedding, x -> floor(4096 * double(x)))")
    both = decoded.join(df.select(F.col("vec_id").alias("_id"), whole.alias("w")), "_id")
    off = both.where("error <> aggregate(zip_with(w, vector, (a, b) -> (a - b * 4096) * (a - b * 4096)), 0D, (s, x) -> s + x)")
    assert off.count() == 0 and both.count() == df.count()


# ---- shared lines ----


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 50_000])
def test_perfect_hash_gives_each_its_own_place(n):
    hashes = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
    index = line_dedup.PerfectHash.build(hashes)
    assert sorted(index.places(hashes).tolist()) == list(range(len(hashes))) and index.n == len(hashes)
    if n >= 1000:
        assert 64 * len(index.words) < 6 * n  # bits


def test_shards_know_members_from_others_and_equal_hashes():
    rng = np.random.default_rng(3)
    h, f = rng.integers(0, 1 << 64, (2, 5000), dtype=np.uint64)
    n, last = rng.integers(5, 1 << 34, 5000), rng.integers(-9, 1 << 40, 5000)
    shard, = line_dedup.Shard.all_of(line_dedup.Shard.build(h, f, n, last).to_bytes())
    got, ids = shard.probe(h, f)
    assert (got == np.minimum(n, (1 << 32) - 1)).all() and (ids == last).all()
    other, fp = rng.integers(0, 1 << 64, (2, 5000), dtype=np.uint64)
    assert not shard.probe(other, fp)[0].any() and not shard.probe(h, fp)[0].any()


def plain_lines(docs):
    keyed = [(i, (t or "").split("\n")) for i, t in docs]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(list)
    for i, lines in keyed:
        for k in {key(x) for x in lines}:
            held[k].append(i if i is not None else -(10**19))
    goes = {k: max(ids) for k, ids in held.items() if len(k) >= 40 and len(ids) >= 5}
    return sorted((str(i), str(len(lines)), str(sum(1 for x in lines if goes.get(key(x), i) != (i if i is not None else -(10**19)) and key(x) in goes)), "\n".join(x for x in lines if key(x) not in goes or goes[key(x)] == (i if i is not None else -(10**19)))) for i, lines in keyed)


@pytest.fixture(scope="module")
def lines(spark, sf):
    rng = random.Random(8)
    pool = [f"shared line number {k} of the pool, with enough letters in it" for k in range(40)] + ["short", "", "   "]
    made = [(rng.choice([None, *range(30)]), "\n".join(rng.choice(pool).upper() + rng.choice(["", " ", "\t\r"]) for _ in range(rng.randint(0, 9)))) for _ in range(150)]
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame(made + [(1, None), (None, "")], "doc_id bigint, text string"))
    return docs.withColumn("_id", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("places", F.lit(2)).repartition(3)


def test_lines_go_as_in_a_plain_version(lines):
    want = plain_lines([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert rows(line_dedup.drop_shared_lines(lines)) == want
    assert sum(int(r[2]) for r in want) > 300


def test_probing_by_shard_gives_the_same_rows(lines, monkeypatch):
    want = rows(line_dedup.drop_shared_lines(lines, digest=True))
    assert rows(line_dedup.drop_shared_lines(lines, digest=True, held_bytes=0, shard_lines=7)) == want
    assert rows(line_dedup.drop_shared_lines(lines, digest=True, shard_lines=7)) == want


def test_a_text_of_many_lines(spark):
    long = "\n".join(f"line {k % 3000} of a very long text, long enough to count" for k in range(60_000))
    docs = spark.createDataFrame([(k, long) for k in range(6)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_shared_lines(docs, digest=True).collect()}
    assert got == {k: (60_000, 60_000 if k < 5 else 0) for k in range(6)}


def test_neighbours_of_pairs_are_mutual(spark):
    words = ["separate", "seperate", "seprate", "seperates", "operate"]
    got = {(r["word"], r["near"]) for r in spelling.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")).collect()}
    near = lambda a, b: b in plain_neighbourhood(a, "abcdefghijklmnopqrstuvwxyz")
    assert got == {p for a, b in combinations(words, 2) if near(a, b) for p in ((a, b), (b, a))}
