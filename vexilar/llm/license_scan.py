"""Licence scan by a positional rare-token index, with DataFrame functions only.

The templates' words are counted over all files, which gives each word its IDF. Every template is indexed under its
rarest words: a posting is (word, template, position). A file's occurrences of indexed words are looked up, postings
of a template must agree on the relative position of its two rarest words, and the mandatory key phrase is then
compared in place. Both rarest words are the key phrase's, so they stand in every match and none is missed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexilar.llm.text import NOT_WORD, ascii_lower, own_columns, with_row_key, with_words
from vexilar.session import materialize


@dataclass(frozen=True)
class Template:
    """phrase: the words of the template; key: the part of it that must stand in place (None: all of it)."""

    phrase: str
    label: str
    key: str | None = None


# The contract's phrases, then wordings that licence texts and notices are known by.
BASE_TEMPLATES = (
    Template("under the mit license", "mit"),
    Template("apache license version 2", "apache-2"),
    Template("cc by nc", "cc-by-nc"),
)
METHOD_TEMPLATES = (
    Template("gnu general public license version 2", "gpl-2"),
    Template("gnu general public license version 3", "gpl-3"),
    Template("licensed under the gnu general public license", "gpl", "gnu general public license"),
    Template("gnu lesser general public license", "lgpl"),
    Template("gnu affero general public license", "agpl"),
    Template("mozilla public license", "mpl"),
    Template("eclipse public license", "epl"),
    Template("redistribution and use in source and binary forms", "bsd", "source and binary forms"),
    Template("bsd 3 clause", "bsd-3"),
    Template("bsd 2 clause", "bsd-2"),
    Template("permission is hereby granted free of charge to any person obtaining a copy", "mit", "permission is hereby granted free of charge"),
    Template("creative commons attribution", "cc-by"),
    Template("creative commons attribution noncommercial", "cc-by-nc"),
    Template("cc by sa", "cc-by-sa"),
    Template("released into the public domain", "public-domain", "public domain"),
    Template("all rights reserved", "proprietary"),
)


def _template_rows(base: tuple[Template, ...], extra: tuple[Template, ...]) -> list[tuple]:
    rows = []
    for k, t in enumerate((*base, *extra)):
        words, key = t.phrase.split(), (t.key or t.phrase).split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows.append((k, t.label, k < len(base), words, key, at))
    return rows


def document_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """(word, df): in how many of all files each of a few words stands; words in none have no row."""
    own = own_columns(docs, _text=text).select(ascii_lower(F.col("_text")).alias("_low"))
    words = with_words(own, F.col("_low"), NOT_WORD, "_w")
    known = F.array(*[F.lit(w) for w in vocabulary])
    return words.select(F.explode(F.array_intersect("_w", known)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def rare_token_index(docs: DataFrame, base: tuple[Template, ...] = BASE_TEMPLATES, extra: tuple[Template, ...] = METHOD_TEMPLATES, text: str = "text") -> DataFrame:
    """One posting a template: word and its position (the rarest), word2 and its position (the next), the key phrase.

    IDF is ln((files + 1) / (df + 1)) over all files; ties fall to the word that comes first in the template. The
    table has as many rows as there are templates.
    """
    spark = docs.sparkSession
    rows = _template_rows(base, extra)
    vocabulary = sorted({w for r in rows for w in r[3]})
    df = {r["word"]: r["df"] for r in document_frequencies(docs, vocabulary, text).collect()}  # a row a template word at most
    out = []
    for k, label, is_base, words, key, at in rows:
        order = sorted(range(at, at + len(key)), key=lambda i: (df.get(words[i], 0), i))  # the key stands in every match
        first, second = order[0], order[1] if len(order) > 1 else order[0]
        out.append((k, label, is_base, words, key, at, words[first], first, words[second], second))
    return spark.createDataFrame(out, "template int, label string, is_base boolean, words array<string>, key array<string>, key_at int, word string, word_at int, word2 string, word2_at int")


def _labels(bits: Column, labels: list[str]) -> Column:
    each = F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(x)) for i, x in enumerate(labels)])
    return F.array_join(F.array_compact(each), ",")


def scan_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: tuple[Template, ...] = BASE_TEMPLATES, extra: tuple[Template, ...] = METHOD_TEMPLATES, min_cover: float = 0.5,
) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are their least and greatest start (null:
    none). labels adds those of the method's templates whose key phrase stands in place and of whose words at least
    ``min_cover`` do; words that the text would need before its beginning or after its end don't stand. score is the greatest share of a matched template's words that stand in place, 0 if none.
    A null or empty text has no words and no labels; repeated rows each get a row, ids may be null, other columns are
    ignored, and an empty table gives none. At most 63 labels.
    """
    postings = materialize(rare_token_index(docs, base, extra, text), "licence_index")
    labels = sorted({t.label for t in (*base, *extra)})
    anchors = sorted({r["word"] for r in postings.select("word").collect()})  # a row a template

    own = with_row_key(own_columns(docs, _id=doc_id, _text=text))
    words = with_words(own.select("_row", "_id", ascii_lower(F.col("_text")).alias("_low")), F.col("_low"), NOT_WORD, "_w").drop("_low")
    has = F.arrays_overlap("_w", F.array(*[F.lit(a) for a in anchors]))
    head = F.array(F.lit(-1))
    at = F.when(has, F.concat(head, F.sequence(F.lit(0), F.size("_w") - 1))).otherwise(head)
    rows = words.select("_row", "_id", "_w", F.explode(at).alias("_p")).withColumn("_word", F.when(F.col("_p") >= 0, F.get("_w", F.col("_p"))))
    rows = rows.join(F.broadcast(postings.withColumnRenamed("word", "_a")), F.col("_word") == F.col("_a"), "left")
    start = F.col("_p") - F.col("word_at")
    near = (start + F.col("key_at") >= 0) & (F.get("_w", start + F.col("word2_at")) == F.col("word2"))  # a text may begin with the key
    phrase = near & (F.slice("_w", F.greatest(start + F.col("key_at"), F.lit(0)) + 1, F.size("key")) == F.col("key"))
    rows = rows.where((F.col("_p") < 0) | phrase)
    # word by word rather than by a lambda, which would end the generated stage and copy the words for every row
    longest = max(len(t.phrase.split()) for t in (*base, *extra))
    agree = sum((F.when(F.get("_w", start + i) == F.get("words", F.lit(i)), 1).otherwise(0) for i in range(longest)), F.lit(0))
    share = agree / F.size("words")
    rows = rows.select("_row", "_id", "_p", F.size("_w").cast("bigint").alias("_n"), start.cast("bigint").alias("_start"), "label", "is_base", F.when(F.col("_p") >= 0, share).alias("_share"))
    rows = rows.where((F.col("_p") < 0) | (F.col("_share") >= min_cover))
    bit = F.lit(0).cast("bigint")
    for i, x in enumerate(labels):
        bit = F.when(F.col("label") == x, F.lit(1 << i).cast("bigint")).otherwise(bit)
    rows = rows.withColumn("_bit", bit)
    of_base = F.col("_p").isNotNull() & F.coalesce(F.col("is_base"), F.lit(False))
    found = rows.groupBy("_row").agg(
        F.max("_id").alias("doc_id"), F.max("_n").alias("n_words"), F.count(F.when(of_base, 1)).alias("n_base"), F.min(F.when(of_base, F.col("_start"))).alias("first_word"),
        F.max(F.when(of_base, F.col("_start"))).alias("last_word"), F.coalesce(F.bit_or(F.when(of_base, F.col("_bit"))), F.lit(0).cast("bigint")).alias("_base"),
        F.coalesce(F.bit_or("_bit"), F.lit(0).cast("bigint")).alias("_all"), F.coalesce(F.max("_share"), F.lit(0.0)).alias("score"),
    )
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", _labels(F.col("_base"), labels).alias("base_labels"), _labels(F.col("_all"), labels).alias("labels"), F.round("score", 6).alias("score"))
