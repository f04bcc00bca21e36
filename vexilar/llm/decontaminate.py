"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every window of ``span`` words of a text is fingerprinted by the least hash of its ``k``-word grams (winnowing with
span - k + 1 grams in a window). Training and test fingerprints are joined, and a hit is extended to the full window
and compared word by word. Two equal windows have equal fingerprints, so every shared passage of at least ``span``
words is found, and the word comparison leaves no false ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexilar.llm.text import BROADCAST_DROPS, NOT_WORD, ascii_lower, no_ints, own_columns, text_key, with_row_key, with_words
from vexilar.session import materialize

#: Bytes of test windows, or of lists of items, that are broadcast at most.
BROADCAST_BYTES = 64_000_000
#: Fingerprints that are broadcast at once, at some 60 bytes each; more go over the texts in several blocks.
BROADCAST_PRINTS = 1_000_000


def _gram_min(words: str, start: str, span: int, k: int) -> Column:
    """The least k-gram hash in the window; each word's hash is one common subexpression."""
    word = [F.xxhash64(F.get(words, F.col(start) + i)) for i in range(span)]
    grams = [F.xxhash64(*word[i : i + k]) for i in range(span - k + 1)]
    return F.least(*grams) if len(grams) > 1 else grams[0]


def _window(words: str, start: str, length: str) -> Column:
    return F.slice(words, F.greatest(F.col(start), F.lit(0)) + 1, F.col(length))


def benchmark_windows(bench: DataFrame, item_id: str = "item_id", text: str = "text", span: int = 13, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of a test set, (win, len, print, whole, win_words), and what holds them, (win, item); both stored.

    An item with fewer than ``span`` words, but not none, is one window, whose print is the hash of all of it, as
    whole is for every window. A null text has no windows, a null id is item ''; items with the same id count once.
    """
    own = own_columns(bench, _item=item_id, _text=text)
    words = with_words(own.select(F.coalesce(F.col("_item").cast("string"), F.lit("")).alias("item"), ascii_lower(F.col("_text")).alias("_low")), F.col("_low"), NOT_WORD, "_w")
    words = words.select("item", "_w", F.least(F.size("_w"), F.lit(span)).alias("len")).where("len > 0")
    rows = words.select("item", "_w", "len", F.explode(F.sequence(F.lit(0), F.size("_w") - F.col("len"))).alias("_p"))
    rows = rows.select("item", "len", _window("_w", "_p", "len").alias("win_words"), F.when(F.col("len") == span, _gram_min("_w", "_p", span, k)).alias("_f")).withColumn("whole", F.xxhash64("win_words"))
    rows = materialize(rows.select("item", "len", F.coalesce("_f", "whole").alias("print"), "whole", "win_words"), "test_rows")
    key = ["len", "print", "whole", "win_words"]
    windows = materialize(rows.select(*key).distinct().select(F.monotonically_increasing_id().alias("win"), *key), "windows")
    return windows, materialize(rows.join(windows, key).select("win", "item").distinct(), "window_items")


def _covered(hits: Column) -> Column:
    """Words inside the union of intervals; hits: array of (start, len)."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    add = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["end"], x["start"]))).cast("bigint").alias("n"),
        F.greatest(acc["end"], x["start"] + x["len"]).alias("end"),
    )
    return F.aggregate(F.sort_array(hits), start, add, lambda acc: acc["n"])


def _bytes(df: DataFrame, strings: str, numbers: int) -> int:
    """About the bytes that rows with an array of strings and so many numbers take in a broadcast table."""
    each = F.octet_length(F.array_join(strings, "")) + 16 * F.size(strings) + 8 * numbers + 48
    return df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def _items_of(rows: DataFrame, pairs: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Adds items, sorted, to rows with the sorted array ``wins``: looked up once for each distinct array."""
    hit, clean = rows.where("size(wins) > 0"), rows.where("size(wins) = 0")
    sets = hit.select("wins").distinct().select("wins", F.explode("wins").alias("win")).join(pairs, "win")
    sets = materialize(sets.groupBy("wins").agg(F.sort_array(F.collect_set("item")).alias("items")), "item_sets")
    small = _bytes(sets, "items", 8) <= broadcast_bytes
    return hit.join(F.broadcast(sets) if small else sets, "wins").select(*rows.columns, "items").union(clean.select("*", F.array().cast("array<string>")))


def contamination(
    docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = 13, k: int = 5, share: int = 20, broadcast_bytes: int = BROADCAST_BYTES, broadcast_prints: int = BROADCAST_PRINTS,
) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items (array), contaminated.

    A word inside any occurrence of a test window is hit; a document is contaminated if n_hit > 0 and
    ``share`` * n_hit >= n_words. Null or empty texts have no words and no hits; repeated rows each get a row, and a
    null doc_id stays null. Items with the same id count once; a null item_id is listed as ''. An empty test set
    leaves every document clean. Columns beyond the named ones are ignored.

    Fingerprints are broadcast, so that only windows with one of the test set's leave the pass over the texts. Test
    windows of at most ``broadcast_bytes`` are broadcast too; more are joined by shuffle with those few. More than
    ``broadcast_prints`` fingerprints go over the texts, which are then stored with a key of the row, block by block.
    """
    windows, pairs = benchmark_windows(bench, item_id, item_text, span, k)
    short = [r[0] for r in windows.where(f"len < {span}").select("len").distinct().collect()]  # at most span - 1 numbers
    small = _bytes(windows, "win_words", 5) <= broadcast_bytes
    prints = materialize(windows.select("print", F.col("len").alias("_plen"), F.lit(True).alias("_seen")).distinct(), "prints")
    blocks = max(1, -(-prints.count() // max(1, broadcast_prints)))

    own = with_row_key(own_columns(docs, _id=doc_id, _text=text))
    if blocks > 1:
        own = materialize(own, "keyed_texts")
    words = with_words(own.select("_row", "_id", ascii_lower(F.col("_text")).alias("_low")), F.col("_low"), NOT_WORD, "_w").drop("_low")
    words = words.withColumn("_n", F.size("_w").cast("bigint"))
    least = min((span, *short))
    at = F.when(F.size("_w") >= least, F.sequence(F.lit(0), F.size("_w") - least)).otherwise(no_ints())
    kind = "struct<start:int,len:int>"

    def seen(block: int) -> DataFrame:
        """The windows whose fingerprint is in this block; in the first also a row a text, at -1, that has n_words."""
        rows = words.select("_row", "_id", "_n", "_w", F.explode(F.concat(F.array(F.lit(-1)), at) if block == 0 else at).alias("_p"))
        if short:
            every = F.array(*[F.lit(x) for x in (span, *short)])
            rows = rows.withColumn("_len", F.explode(F.when(F.col("_p") < 0, F.array(F.lit(span))).otherwise(every)))
        else:
            rows = rows.withColumn("_len", F.lit(span))
        rows = rows.where("_p < 0 or _p + _len <= _n")
        long = _gram_min("_w", "_p", span, k)
        rows = rows.withColumn("_m", F.when(F.col("_len") == span, long).otherwise(F.xxhash64(_window("_w", "_p", "_len"))) if short else long)
        known = prints.where(F.pmod("print", F.lit(blocks)) == block) if blocks > 1 else prints
        same = F.col("_m") == F.col("print")
        return rows.join(F.broadcast(known), same & (F.col("_len") == F.col("_plen")) if short else same, "left").where("_p < 0 or _seen")

    wins = windows.select("win", F.col("whole").alias("_whole"), F.col("len").alias("_wlen"), "win_words")
    hit = F.struct(F.col("_p").alias("start"), F.col("_len").alias("len"))
    if small and blocks == 1:
        rows = seen(0).withColumn("_h", F.when(F.col("_p") >= 0, F.xxhash64(_window("_w", "_p", "_len"))))
        same = (F.col("_h") == F.col("_whole")) & (F.col("_len") == F.col("_wlen")) & (_window("_w", "_p", "_len") == F.col("win_words"))
        rows = rows.join(F.broadcast(wins), same, "left").where("_p < 0 or win is not null")
        found = rows.select("_row", "_id", "_n", F.when(F.col("_p") >= 0, hit).alias("_hit"), "win")
    else:
        taken = [seen(b).select("_row", "_id", "_n", "_p", "_len", F.when(F.col("_p") >= 0, _window("_w", "_p", "_len")).alias("_t")) for b in range(blocks)]
        taken = [materialize(t, "seen_windows") for t in taken]
        rows = taken[0]
        for t in taken[1:]:
            rows = rows.union(t)
        hits = rows.where("_p >= 0").withColumn("_h", F.xxhash64("_t"))
        hits = hits.join(wins, (F.col("_h") == F.col("_whole")) & (F.col("_len") == F.col("_wlen")) & (F.col("_t") == F.col("win_words")))
        heads = taken[0].where("_p < 0").select("_row", "_id", "_n", F.lit(None).cast(kind).alias("_hit"), F.lit(None).cast("bigint").alias("win"))
        found = heads.union(hits.select("_row", F.lit(None), F.lit(None), hit, "win"))
    grouped = found.groupBy("_row").agg(F.max("_id").alias("_id"), F.max("_n").alias("_n"), F.collect_list("_hit").alias("_hits"), F.sort_array(F.collect_set("win")).alias("wins"))
    grouped = grouped.select("_id", "_n", F.when(F.size("_hits") > 0, _covered(F.col("_hits"))).otherwise(F.lit(0).cast("bigint")).alias("_hit"), "wins")
    out = _items_of(materialize(grouped, "hits"), pairs, broadcast_bytes)
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_words"), F.col("_hit").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        "items", ((F.col("_hit") > 0) & (F.col("_hit") * share >= F.col("_n"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged.

    Contamination depends on the text alone, so rows are told by its SHA-256: repeated and null ids don't matter. Null
    and empty texts stay; an empty table gives no row.
    """
    keyed = docs.select(text_key(F.col(f"`{text}`")).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    keys = contamination(keyed, bench, **options).where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    keys = materialize(keys, "contaminated")
    few = keys.count() <= BROADCAST_DROPS
    return docs.join(F.broadcast(keys) if few else keys, text_key(docs[text]) == keys["_key"], "left_anti")
